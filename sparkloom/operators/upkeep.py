"""Keeping samples up to date: what is due, which samples are new, what to poll next; starts of clips, render times."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeline import latest, micros, seconds


def due(posted: Column, scored: Column, now: Column, least_days: float) -> Column:
    """Not scored yet and ``least_days`` old or more; false without a time."""
    old = micros(now) - micros(posted) >= seconds(least_days * 86_400)
    return scored.isNull() & F.coalesce(old, F.lit(False))


def accepted_samples(new: DataFrame, samples: DataFrame, key: str, at: str, tie: str, fields: list[str], scored: Column, again_s: float) -> DataFrame:
    """Rows of ``new`` that say something new: with a value at all, and other ones than the key's last sample has.

    Equal values (null equals null) count again where the key isn't ``scored`` and the last sample is ``again_s`` old.
    """
    last = latest(samples.select(key, at, tie, *fields), key, at, tie)
    last = last.select(key, F.col(at).alias("__at"), *[F.col(c).alias(f"__{c}") for c in fields], F.lit(True).alias("__known"))
    both = new.join(last, key, "left")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in fields], F.coalesce("__known", F.lit(False)))
    soon = F.coalesce(micros(at) - micros("__at") < seconds(again_s), F.lit(False))
    some = F.coalesce(*[F.col(c).cast("string") for c in fields]).isNotNull()
    return both.where(some & ~(same & (F.coalesce(scored, F.lit(False)) | soon))).select(*new.columns)


def poll_order(posts: DataFrame, samples: DataFrame, post: str, posted: str, scored: str, at: str, since: Column, before: Column, most: int) -> DataFrame:
    """The next ``most`` posts to sample, with their last sample's time: posted from ``since`` on, none after ``before``.

    Posts without a score go first, the newest first; then those sampled longest ago (never is longest), newer posts first.
    """
    last = samples.groupBy(post).agg(F.max(at).alias("last_sample"))
    open_ = posts.where(F.col(posted) >= since).join(last, post, "left").where(F.col("last_sample").isNull() | (F.col("last_sample") <= before))
    unscored = F.when(F.col(scored).isNull(), F.col(posted))
    return open_.orderBy(F.col(scored).isNotNull(), unscored.desc(), F.col("last_sample").asc_nulls_first(), F.desc(posted), F.desc(post)).limit(most)


def clip_starts(clips: DataFrame, kills: DataFrame, key: str, first: str, end: str, earliest: str, latest_: str, at: str, lead_s: float, after_s: float, before_s: float, most_s: float) -> DataFrame:
    """``clips`` with start_us, uncapped_us and foreign: a clip begins ``lead_s`` before its first action, not before
    ``earliest`` and not after ``latest_`` (either may be null).

    Where a kill of the key lies in the lead, the clip begins ``after_s`` after the last such, at most up to ``before_s``
    before the action. One that would be longer than ``most_s`` is cut in front. The kill is found in one ordered pass.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in clips.columns]).alias("row")
    c = clips.select(F.col(key).alias("__key"), micros(first).alias("us"), F.lit(None).cast("long").alias("kill"), whole)
    k = kills.select(F.col(key).alias("__key"), micros(at).alias("us"), micros(at).alias("kill"), F.lit(None).cast(c.schema["row"].dataType).alias("row"))
    earlier = Window.partitionBy("__key").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    rows = c.unionByName(k).withColumn("kill", F.max("kill").over(earlier)).where("row is not null").select("row.*", "us", "kill")
    begin = F.least(F.greatest(F.col("us") - seconds(lead_s), micros(earliest)), micros(latest_))
    moved = F.least(F.col("kill") + seconds(after_s), F.col("us") - seconds(before_s))
    rows = rows.withColumn("begin", begin).withColumn("foreign", F.coalesce((F.col("kill") >= F.col("begin")) & (moved > F.col("begin")), F.lit(False)))
    rows = rows.withColumn("uncapped_us", F.when(F.col("foreign"), moved).otherwise(F.col("begin")))
    limit = F.least(micros(latest_), micros(end) - seconds(most_s))
    start = F.when(micros(end) - F.col("uncapped_us") > seconds(most_s), F.greatest(F.col("uncapped_us"), limit)).otherwise(F.col("uncapped_us"))
    return rows.withColumn("start_us", start).select(*clips.columns, "start_us", "uncapped_us", "foreign")


def render_report(renders: DataFrame, encoder: Column, version: Column, draft: str, measured: Column, length: Column, planned: Column, file_s: Column, fell_back: Column, cutoff_s: float) -> DataFrame:
    """encoder, version, n, median, p90 (nearest rank), max of seconds by second of video, from_files, fallbacks.

    Without a measured time a draft's comes from its file's age, over 0 and up to ``cutoff_s``, by its planned length;
    other renders without one don't count. Renders that fell back are an encoder of their own.
    """
    ran = F.coalesce(fell_back, F.lit(False))
    rows = renders.select(encoder.alias("encoder"), version.alias("version"), measured.alias("m"), length.alias("l"), planned.alias("p"), file_s.alias("f"), ran.alias("fell"))
    own = F.col("m").isNotNull() & (F.col("l") != 0)
    from_file = (F.col("version") == draft) & (F.col("p") != 0) & (F.col("f") > 0) & (F.col("f") <= cutoff_s)
    ratio = F.when(own, F.try_divide(F.col("m"), F.col("l"))).when(from_file, F.try_divide(F.col("f"), F.col("p")))
    rows = rows.select(
        F.when(own & F.col("fell"), F.concat(F.coalesce("encoder", F.lit("unknown")), F.lit(" (fell back)"))).otherwise(F.coalesce("encoder", F.lit("unknown"))).alias("encoder"),
        "version", ratio.alias("ratio"), F.when(own, 0).otherwise(1).alias("file"), (F.coalesce(own, F.lit(False)) & F.col("fell")).cast("int").alias("fell"),
    ).where("ratio is not null")
    return rows.groupBy("encoder", "version").agg(
        F.count("*").alias("n"), F.median("ratio").alias("median"), F.expr("percentile_disc(0.9) within group (order by ratio)").alias("p90"),
        F.max("ratio").alias("max"), F.sum("file").alias("from_files"), F.sum("fell").alias("fallbacks"),
    )
