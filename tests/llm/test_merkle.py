"""Merkle manifest against a tree built whole, level by level."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import merkle

from .fixtures import ROWS, documents


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def climb(levels, at, node):
    """The siblings on the way up, and what the node gives."""
    proof = ""
    for level in levels[:-1]:
        begin, end = at - at % 8, min(at - at % 8 + 8, len(level))
        before, after = "".join(level[begin:at]), "".join(level[at + 1 : end])
        proof, node, at = proof + before + after, sha(before + node + after), at // 8
    return proof, node


def plain(rows):
    """What op11 returns, for rows (doc_id, text, lang, source, n_chars)."""
    lower = str.maketrans(merkle.UPPER, merkle.LOWER)
    trees = collections.defaultdict(list)
    for i, text, lang, source, n in rows:
        own = plain_leaf((i, source, lang, n, text))
        hit = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        other = plain_leaf((i, source, lang, n, text.translate(lower) if hit and text is not None else text))
        trees[lang].append((i is not None, i or 0, own, other))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    built = {t: plain_tree([x[2] for x in sorted(trees[t])]) for t in names}
    crown = plain_tree([built[t][-1][0] for t in names])
    out = collections.Counter()
    for k, t in enumerate(names):
        for at, (there, i, own, other) in enumerate(sorted(trees[t])):
            proof, node = climb(built[t], at, other)
            more, root = climb(crown, k, node)
            out[(i if there else None, own, built[t][-1][0], crown[-1][0], sha(proof + more), root, root == crown[-1][0])] += 1
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def checked(docs):
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = merkle.checked(docs, {"text": (third, F.translate("text", merkle.UPPER, merkle.LOWER))})
    return collections.Counter(tuple(r[c] for c in COLUMNS) for r in found.collect())


def test_odd_rows_and_clashing_columns(spark):
    assert checked(documents(spark, clashes=True)) == plain(ROWS)


def test_no_rows_and_one_row(spark):
    assert not checked(documents(spark, []))
    assert checked(documents(spark, ROWS[:1])) == plain(ROWS[:1])


@pytest.mark.parametrize("sizes", [(8, 9, 64), (65, 512, 513), (1, 4_700)])
def test_trees_of_many_sizes(spark, sizes):
    """Full and ragged runs, one block and several; a third of a tree's rows are equal."""
    r = random.Random(sum(sizes))
    rows = []
    for k, n in enumerate(sizes):
        rows += [(7, "Same", f"l{k}", None, 4) if i % 3 == 0 else (r.randrange(10**6), f"Text {r.random()}", f"l{k}", "s", i) for i in range(n)]
    assert checked(documents(spark, rows)) == plain(rows)


def test_more_trees_than_a_run(spark):
    rows = [(i, "A", f"tree {i % 11}" if i % 11 else None, "s", 1) for i in range(60)]
    assert checked(documents(spark, rows)) == plain(rows)


def test_paths_fold_to_the_root_and_tell_a_changed_leaf(spark):
    rows = documents(spark, [(i, f"text {i}", "en", None, i) for i in range(600)])
    leaves = rows.select(F.col("lang").alias("tree"), F.col("doc_id").alias("id"), F.unhex(merkle.leaf(*merkle.FIELDS)).alias("leaf"), F.lit(None).cast("binary").alias("tampered"))
    found = merkle.manifest(leaves, levels_in_block=1).collect()  # blocks of 8, so four tables of them
    (whole,) = merkle.manifest(leaves).select("root").distinct().collect()
    assert {r["root"] for r in found} == {whole["root"]}
    assert len(found) == 600 and len({r["root"] for r in found}) == 1
    for r in found[::37]:
        way = merkle.unpacked(r["path"])
        assert merkle.folded(r["leaf"].encode(), way).decode() == r["root"]
        assert merkle.folded(sha("else").encode(), way).decode() != r["root"]


def test_a_stack_holds_few_nodes():
    stack, most = merkle.Treehash(3), 0
    for i in range(512):
        stack.add(sha(str(i)).encode())
        most = max(most, sum(map(len, stack.waiting)))
    assert most <= 3 * merkle.FAN and len(stack.close()) == 1
