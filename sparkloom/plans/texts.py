"""Queries over texts, pages, conversations, JSON properties and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import parsers
from .base import rounded, table


def property_numbers(spark, sf_dir):
    """Numbers of the events' JSON properties, by kind of event."""
    e = table(spark, sf_dir, "events").select("event_type", F.explode(S.numbers_only(F.col("props"))).alias("name", "number"))
    return e.groupBy("event_type", "name").agg(F.count("*").alias("n"), rounded(F.sum("number"), 4).alias("total"))


def page_hosts(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.groupBy(parsers.host_of(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


def excited_turns(spark, sf_dir):
    """Turns of each role with their words, questions and exclamations."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("role").agg(
        F.count("*").alias("n"), F.sum(S.word_hits(F.col("text"), "[^ ]+")).alias("words"), F.sum(S.word_hits(F.col("text"), r"\?")).alias("questions"),
    )


def text_fingerprints(spark, sf_dir):
    """Documents that share their text, by its SHA-256."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return d.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


def length_bands(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("s", F.col("n_chars") / 15.0)
    return d.groupBy(S.length_level(F.col("s")).alias("level"), S.length_band(F.col("s")).alias("band")).agg(F.count("*").alias("n"))


def label_logits(spark, sf_dir):
    """A logistic of three document features with a length penalty."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.coalesce(S.word_hits(F.col("text"), "[#$%&*]{3}"), F.lit(0)).alias("marks"))
    x = 2.0 - 0.5 * F.least(F.col("marks"), F.lit(20)) - S.length_penalty(F.col("n_chars") / 15.0, 60.0, 0.01)
    return d.select("doc_id", rounded(S.logistic(x)).alias("p"))


def embedding_norms(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return e.groupBy("label").agg(F.count("*").alias("n"), rounded(F.avg(F.sqrt(square)), 4).alias("norm"))


QUERIES = {f.__name__: f for f in (property_numbers, page_hosts, excited_turns, text_fingerprints, length_bands, label_logits, embedding_norms)}

ORACLE = {
    "property_numbers": """WITH k AS (SELECT event_type, props, unnest(json_keys(props)) AS name FROM events), v AS (SELECT event_type, name, json_extract(props, '$.' || name) AS v FROM k)
SELECT event_type, name, count(*) AS n, round(sum(v::DOUBLE), 4) AS total FROM v WHERE json_type(v) IN ('UBIGINT', 'BIGINT', 'DOUBLE') GROUP BY event_type, name""",
    "page_hosts": r"SELECT nullif(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '') AS host, count(*) AS n FROM pages GROUP BY 1",
    "excited_turns": r"""SELECT role, count(*) AS n, sum(len(regexp_extract_all(text, '[^ ]+')))::BIGINT AS words, sum(len(regexp_extract_all(text, '\?')))::BIGINT AS questions FROM conversations GROUP BY role""",
    "text_fingerprints": "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1",
    "length_bands": """SELECT CASE WHEN s <= 22.5 THEN 'short' WHEN s <= 36 THEN 'middle' ELSE 'long' END AS level,
  CASE WHEN s < 45 THEN 'under 45' WHEN s <= 60 THEN '45 to 60' ELSE 'over 60' END AS band, count(*) AS n FROM (SELECT n_chars / 15.0::DOUBLE AS s FROM documents) GROUP BY 1, 2""",
    "label_logits": """WITH m AS (SELECT doc_id, n_chars, coalesce(len(regexp_extract_all(text, '[#$%&*]{3}')), 0) AS marks FROM documents)
SELECT doc_id, round(1 / (1 + exp(-(2.0::DOUBLE - 0.5::DOUBLE * least(marks, 20) - greatest(0.0::DOUBLE, (n_chars / 15.0::DOUBLE - 60.0::DOUBLE) / 10.0::DOUBLE) * 0.01::DOUBLE))), 6) AS p FROM m""",
    "embedding_norms": "SELECT label, count(*) AS n, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 4) AS norm FROM embeddings GROUP BY label",
}
