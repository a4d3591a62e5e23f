"""JSON documents built from orders and their lines, some of them wrong on purpose, held against a schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.json_schema import schema_errors
from .base import table

SCHEMA = {
    "type": "object", "required": ["id", "status", "lines"], "additionalProperties": False,
    "properties": {
        "id": {"type": "integer", "minimum": 1}, "status": {"type": "string", "enum": ["O", "F"]}, "clerk": {"type": ["string", "null"], "minLength": 3, "maxLength": 5, "pattern": "^[a-z]+$"},
        "lines": {"type": "array", "minItems": 2, "maxItems": 6, "items": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}, "quantity": {"type": "number", "maximum": 45}}}},
    },
}


def _documents(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")  # noqa: E741
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    quantity = F.col("l_quantity").cast("int").cast("string")
    body = F.when((k + n) % 29 == 0, F.lit('"many"')).otherwise(quantity)
    line = F.concat(F.lit("{"), F.when((k + n) % 17 > 0, F.concat(F.lit('"n":'), n.cast("string"), F.when((k + n) % 31 == 0, ".5").otherwise(""), F.lit(","))).otherwise(""), F.lit('"quantity":'), body, F.lit("}"))
    lines = l.groupBy(k.alias("order_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("t")))), lambda x: x["t"]), ",").alias("t"))
    i = F.col("o_orderkey")
    clerk = F.when(i % 7 == 0, "null").when(i % 7 == 1, '"ab"').when(i % 7 == 2, '"toolong"').when(i % 7 == 3, '"AB1"').when(i % 7 == 4, "true").otherwise('"anna"')
    whole = F.concat(
        F.lit("{"), F.when(i % 23 > 0, F.concat(F.lit('"id":'), F.when(i % 19 == 0, "-").otherwise(""), i.cast("string"), F.lit(","))).otherwise(""), F.lit('"status":"'), F.col("o_orderstatus"), F.lit('","clerk":'), clerk,
        F.when(i % 11 == 0, ',"zeta":1,"alpha":2').otherwise(""), F.when(i % 13 == 0, ',"lines":{}').otherwise(F.concat(F.lit(',"lines":['), "t", F.lit("]"))), F.when(i % 37 > 0, "}").otherwise(""),
    )
    return o.join(lines, i == F.col("order_id")).select("order_id", whole.alias("json"))


def schema_problems(spark, sf_dir):
    return _documents(spark, sf_dir).select("order_id", F.array_join(schema_errors(F.col("json"), SCHEMA), " | ").alias("problems"))


QUERIES = {"schema_problems": schema_problems}

ORACLE = {
    "schema_problems": """
WITH lines AS (
  SELECT l_orderkey AS i, count(*) AS n, list(CASE WHEN (l_orderkey + l_linenumber) % 17 = 0 THEN '$.lines[' || (rn - 1) || ']: field ''n'' is missing' END ORDER BY rn) AS missing,
    list(CASE WHEN (l_orderkey + l_linenumber) % 17 > 0 AND (l_orderkey + l_linenumber) % 31 = 0 THEN '$.lines[' || (rn - 1) || '].n: expected integer, got number' END ORDER BY rn) AS whole,
    list(CASE WHEN (l_orderkey + l_linenumber) % 29 = 0 THEN '$.lines[' || (rn - 1) || '].quantity: expected number, got string' WHEN l_quantity >= 46 THEN '$.lines[' || (rn - 1) || '].quantity: ' || CAST(l_quantity AS INTEGER) || ' > 45' END ORDER BY rn) AS quantity
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '}') AS rn FROM lineitem) GROUP BY l_orderkey),
told AS (SELECT i, list_concat(
    CASE WHEN i % 23 = 0 THEN ['$: field ''id'' is missing'] ELSE [] END,
    CASE WHEN i % 23 > 0 AND i % 19 = 0 THEN ['$.id: -' || i || ' < 1'] ELSE [] END,
    CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN ['$.status: "' || o_orderstatus || '" isn''t allowed'] ELSE [] END,
    CASE i % 7 WHEN 1 THEN ['$.clerk: shorter than 3 characters'] WHEN 2 THEN ['$.clerk: longer than 5 characters'] WHEN 3 THEN ['$.clerk: doesn''t match ^[a-z]+$'] WHEN 4 THEN ['$.clerk: expected string/null, got boolean'] ELSE [] END,
    CASE WHEN i % 13 = 0 THEN ['$.lines: expected array, got object'] ELSE list_concat(CASE WHEN n < 2 THEN ['$.lines: fewer than 2 entries'] WHEN n > 6 THEN ['$.lines: more than 6 entries'] ELSE [] END,
      list_filter(flatten(list_transform(range(n), lambda k: [missing[k + 1], whole[k + 1], quantity[k + 1]])), lambda x: x IS NOT NULL)) END,
    CASE WHEN i % 11 = 0 THEN ['$: unknown field ''alpha''', '$: unknown field ''zeta'''] ELSE [] END) AS all_errors
  FROM lines JOIN orders ON o_orderkey = i)
SELECT i AS order_id, CASE WHEN i % 37 = 0 THEN '$: not JSON' ELSE array_to_string(all_errors, ' | ') END AS problems FROM told""",
}
