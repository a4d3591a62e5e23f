"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every document gets a 60-bit hash. A source that is to give ``target`` words gives all its documents
``floor(target / source_size)`` times and, for the remainder, those whose hash lies below a threshold.
The threshold comes from nested histograms: words are summed by source and the first 12 hash bits, the
bucket in which the running sum passes the remainder is the boundary, and only that bucket's documents
are summed again by the next bits, until one hash value is left. It is taken if that brings the source
nearer to its target. Nothing is sorted but histogram rows, and no document moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of each histogram level; the first is coarse, later ones see 1/4096 of the rows at most.
LEVELS = (12, 24, 24)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_hash(doc_id: Column, text: Column) -> Column:
    """60 bits that depend on the id and the whole text, so rows without an id are still spread."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """One row for each source of ``sizes(source, size)``: source, source_size, target.

    Sources by code point, null last, take ``weights`` in turn. ``share`` of all words is dealt out by
    weight; a target stops at ``cap`` times its source and the excess is dealt anew. The fixed point is
    ``least(cap * source_size, level * weight)``: sources fill up in the order of ``cap * size / weight``.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.array(*[F.lit(float(w)) for w in weights])
    full = by_source.withColumn("weight", F.element_at(turn, (place % len(weights) + 1).cast("int"))).withColumn(
        "most", F.col("source_size") * F.lit(float(cap))
    )
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = full.withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct(F.col("most") / F.col("weight"), "level"))).over(everything)
    # Beyond the sum of all caps (share >= cap) no level fits and every source gives its cap.
    target = F.coalesce(F.least("most", first["level"] * F.col("weight")), F.col("most"))
    return leveled.withColumn("target", target).select("source", "source_size", "target")


def thresholds(hashed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, source_size, target, repeats, bound, with_bound: documents below hash ``bound`` (and at it, if
    ``with_bound``) are taken once more than ``repeats`` times. ``hashed`` has source, size, h."""
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = targets.withColumn("repeats", repeats).select(
        "source", "source_size", "target", "repeats",
        (F.col("target") - F.col("repeats") * F.col("source_size")).alias("rest"),
        F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("at"),
    )
    left = 60
    for bits in LEVELS:
        state, rest = written(state, "mix-state"), left - bits
        bound = state.select(F.col("source").alias("s_source"), F.col("prefix").alias("s_prefix"))
        inside = hashed.join(bound, F.col("source").eqNullSafe(F.col("s_source")) & (F.shiftright("h", left) == F.col("s_prefix")))
        histogram = inside.groupBy(F.col("source").alias("b_source"), F.shiftright("h", rest).alias("bucket")).agg(F.sum("size").alias("words"))
        running = Window.partitionBy("b_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        passed = (
            histogram.withColumn("upto", F.sum("words").over(running))
            .join(state, F.col("b_source").eqNullSafe(F.col("source")))
            .where(F.col("below") + F.col("upto") > F.col("rest"))
            .groupBy("b_source")
            .agg(F.min(F.struct("bucket", "upto", "words")).alias("b"))
        )
        # A source without words passes nothing: its bound stays 0 and nothing is below it.
        state = state.join(passed, F.col("source").eqNullSafe(F.col("b_source")), "left").select(
            "source", "source_size", "target", "repeats", "rest",
            F.coalesce(F.col("b.bucket"), F.shiftleft("prefix", bits)).alias("prefix"),
            (F.col("below") + F.coalesce(F.col("b.upto") - F.col("b.words"), F.lit(0))).alias("below"),
            F.coalesce(F.col("b.words"), F.lit(0)).cast("long").alias("at"),
        )
        left = rest
    nearer = (F.col("at") > 0) & (F.col("below") + F.col("at") - F.col("rest") < F.col("rest") - F.col("below"))
    return written(
        state.select("source", "source_size", "target", "repeats", F.col("prefix").alias("bound"), nearer.alias("with_bound")), "mix-bounds"
    )


def mix_plan(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """doc_id, source, size, h, source_size, target, times, taken for each row of ``docs``.

    ``times`` says how often the mix takes the document and ``taken`` is ``size * times``.
    Null text counts no words; a null source is a source of its own, last in order; other columns are not
    read, whatever their names. Equal rows have equal hashes and are taken together. No rows give no rows.
    """
    slim = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"), mix_hash(F.col(id_col), F.col(text_col)).alias("h"),
    )
    slim = written(slim, "mix-sizes")
    bounds = thresholds(slim, source_targets(slim, weights, share, cap))
    return _decide(slim, bounds)


def _decide(slim: DataFrame, bounds: DataFrame) -> DataFrame:
    bounds = bounds.withColumnRenamed("source", "b_source")
    more = (F.col("h") < F.col("bound")) | ((F.col("h") == F.col("bound")) & F.col("with_bound"))
    return (
        slim.join(bounds, F.col("source").eqNullSafe(F.col("b_source")))
        .withColumn("times", F.col("repeats") + more.cast("long"))
        .withColumn("taken", F.col("size") * F.col("times"))
        .drop("b_source", "repeats", "bound", "with_bound")
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns and no others."""
    parts = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source"),
        word_count(F.col("text")).alias("size"), mix_hash(F.col("doc_id"), F.col("text")).alias("h"),
    )
    slim = written(parts.drop("row"), "mix-sizes")
    decided = _decide(parts, thresholds(slim, source_targets(slim, weights, share, cap)))
    return decided.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("copy")).select("row.*")


def op8(spark, sf_dir) -> DataFrame:
    from .common import table

    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
    2.0::DOUBLE * source_size AS most FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER f, 0)) /
    ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER f, 0)) AS lev
  FROM w WINDOW f AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(most, (SELECT arg_min(lev, most / weight) FROM l WHERE lev <= most / weight) * weight) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS repeats FROM t),
h AS (SELECT source, h, sum(size)::BIGINT AS words FROM d GROUP BY source, h),
c AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h ROWS UNBOUNDED PRECEDING) AS upto FROM h),
b AS (SELECT c.source, min(struct_pack(h := c.h, upto := upto, words := words)) AS b
  FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source WHERE upto > target - repeats * source_size GROUP BY c.source)
SELECT doc_id, size, source_size, target, size * (repeats + (CASE WHEN d.h < b.b.h OR (d.h = b.b.h AND
    b.b.upto - (target - repeats * source_size) < (target - repeats * source_size) - (b.b.upto - b.b.words)) THEN 1 ELSE 0 END)) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""
