"""Compiled schemas against a plain validator."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.json_schema import schema_errors

SCHEMA = {
    "title": "a test", "type": "object", "required": ["a", "b"], "additionalProperties": False,
    "properties": {
        "a": {"type": ["integer", "null"], "minimum": -2, "maximum": 3}, "b": {"enum": ["x", 1, None, True, 2.5]}, "c": {"type": "string", "minLength": 1, "maxLength": 3, "pattern": "[a-c]"},
        "d": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": ["number", "object"], "minimum": 0, "properties": {"e": {"type": "boolean"}}, "required": ["e"]}}, "f": {"minimum": 1, "items": {"type": "string"}},
    },
}
KINDS = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null", int: "integer", float: "number"}


def plain(value, schema, path="$"):
    kind = KINDS[type(value)]
    types = [schema["type"]] if isinstance(schema.get("type"), str) else schema.get("type", [])
    if types and not any(kind in ("integer", "number") if t == "number" else kind == t for t in types):
        return [f"{path}: expected {'/'.join(types)}, got {kind}"]
    same = lambda o: (isinstance(o, bool) == isinstance(value, bool)) and o == value
    text, out = json.dumps(value, separators=(",", ":")), []
    if "enum" in schema and not any(same(o) for o in schema["enum"]):
        out.append(f"{path}: {text} isn't allowed")
    if kind in ("integer", "number"):
        out += [f"{path}: {text} < {schema.get('minimum')}"] * ("minimum" in schema and value < schema["minimum"])
        out += [f"{path}: {text} > {schema.get('maximum')}"] * ("maximum" in schema and value > schema["maximum"])
    if kind == "string":
        out += [f"{path}: longer than {schema.get('maxLength')} characters"] * ("maxLength" in schema and len(value) > schema["maxLength"])
        out += [f"{path}: shorter than {schema.get('minLength')} characters"] * ("minLength" in schema and len(value) < schema["minLength"])
        out += [f"{path}: doesn't match {schema.get('pattern')}"] * ("pattern" in schema and not re.search(schema["pattern"], value))
    if kind == "object":
        out += [f"{path}: field {n!r} is missing" for n in schema.get("required", []) if n not in value]
        for n, inner in schema.get("properties", {}).items():
            out += plain(value[n], inner, f"{path}.{n}") if n in value else []
        if schema.get("additionalProperties") is False:
            out += [f"{path}: unknown field '{n}'" for n in sorted(set(value) - set(schema.get("properties", {})))]
    if kind == "array":
        out += [f"{path}: fewer than {schema.get('minItems')} entries"] * ("minItems" in schema and len(value) < schema["minItems"])
        out += [f"{path}: more than {schema.get('maxItems')} entries"] * ("maxItems" in schema and len(value) > schema["maxItems"])
        for i, x in enumerate(value):
            out += plain(x, schema["items"], f"{path}[{i}]") if "items" in schema else []
    return out


def some(r, depth=0):
    leaf = [None, True, False, 0, 1, 2, -3, 7, 2.5, -0.5, "", "x", "abc", "bcde", "zz", 10**17]
    if depth > 2 or r.random() < 0.5:
        return r.choice(leaf)
    if r.random() < 0.4:
        return [some(r, depth + 1) for _ in range(r.randrange(4))]
    return {k: some(r, depth + 1) for k in "abcdefg" if r.random() < 0.5}


def test_errors_equal_the_plain_ones(spark):
    r = random.Random(2)
    values = [some(r) for _ in range(250)] + [{k: some(r, 1) for k in "abcdf" if r.random() < 0.85} for _ in range(350)] + [{"a": 1, "b": "x", "c": "ab", "d": [1, {"e": True}]}]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, t string").repartition(3)
    got = {x["i"]: x["e"] for x in df.select("i", schema_errors(F.col("t"), SCHEMA).alias("e")).collect()}
    assert [got[i] for i in range(len(values))] == [plain(v, SCHEMA) for v in values]
    assert got[len(values) - 1] == [] and len({e for x in got.values() for e in x}) > 60


def test_what_is_no_json_and_what_is_no_known_rule(spark):
    df = spark.createDataFrame([("{",), (None,), ("",), ("null",), ('{"a": NaN}',)], "t string")
    assert [x[0] for x in df.select(schema_errors(F.col("t"), {"type": "null"})).collect()] == [["$: not JSON"]] * 3 + [[], ["$: not JSON"]]
    assert df.limit(0).select(schema_errors(F.col("t"), SCHEMA)).count() == 0
    for bad in ({"oneOf": []}, {"properties": {"a": {"format": "date"}}}, {"type": "date"}, {"additionalProperties": {"type": "string"}}, {"enum": [[1]]}):
        with pytest.raises(ValueError):
            schema_errors(F.col("t"), bad)


def test_a_text_is_parsed_once(spark):
    """Each use of a value parsed the whole text again."""
    from sparkloom.functions.json_schema import schema_errors
    from sparkloom.plans.schemas import SCHEMA

    rows = spark.createDataFrame([("{}",)], "j string").repartition(2)
    plan = rows.select(schema_errors(rows["j"], SCHEMA).alias("e"))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parsejson") + plan.count("parse_json") == 1
