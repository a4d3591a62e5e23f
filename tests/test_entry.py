"""The entry can be read before there is a session, with and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
LOOK = """
import sys, importlib.abc
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.startswith("sparkloom.llm") or name == "corpus_pipeline":
            raise ImportError(name)
if sys.argv[1] == "without":
    sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names, sql = e.queries(), e.oracle_sql()
assert set(sql) <= set(names)
print(len(names), sum(n.startswith("op") and n[2:3].isdigit() for n in names), "pipeline" in names)
"""


def test_entry_needs_no_session():
    for how, ops, pipeline in (("with", "13", "True"), ("without", "0", "False")):
        done = subprocess.run([sys.executable, "-c", LOOK, how], cwd=ROOT, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr[-2000:]
        assert done.stdout.split()[1:] == [ops, pipeline] or (how == "with" and not (ROOT / "sparkloom/llm").exists())
