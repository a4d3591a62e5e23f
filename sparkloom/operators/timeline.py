"""Event timelines: gap chains, window merging, interval and as-of joins, thinning, bursts and gaps.

All times are compared in whole microseconds. Operators take the names of their columns and add columns of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.scalars import instant, local_time


def micros(at: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp column, with or without time zone."""
    return F.unix_micros((F.col(at) if isinstance(at, str) else at).cast("timestamp"))


def seconds(s: float) -> int:
    return round(s * 1_000_000)


def gap_chains(events: DataFrame, key: str, at: str, gap_s: float, tie: str | None = None) -> DataFrame:
    """Adds ``chain`` (1, 2, ... within ``key``): a new one begins where the step from the event before exceeds ``gap_s``."""
    order = Window.partitionBy(key).orderBy(at, *([tie] if tie else []))
    step = micros(at) - F.lag(micros(at)).over(order)
    begins = F.when(step.isNull() | (step > seconds(gap_s)), 1).otherwise(0)
    return events.withColumn("begins", begins).withColumn("chain", F.sum("begins").over(order)).drop("begins")


def merge_windows(windows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """key, window, start, end, n: overlapping or touching windows of a key as one (start <= the largest end before)."""
    order = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    numbered = windows.withColumn("begins", begins).withColumn("window", F.sum("begins").over(order))
    return numbered.groupBy(key, "window").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"))


def best_cover(windows: DataFrame, recordings: DataFrame, key: str, slack_s: float, ranking: list[Column], bucket_s: float = 21_600) -> DataFrame:
    """``windows(key, w_id, w_start, w_end, first, last)`` with the recording that holds first and last event within
    ``slack_s`` and ranks best: ``coverage`` (share of the window, 2 places) first, then ``ranking``.

    ``recordings`` has key, r_id, r_start, r_end. Windows without such a recording have nulls. A recording is dealt to
    all time buckets that it touches, a window to that of its first event: they meet by key and bucket, once.
    """
    slack, bucket = seconds(slack_s), seconds(bucket_s)
    at = lambda us: F.floor(us / bucket)
    r = recordings.withColumn("__bucket", F.explode(F.sequence(at(micros("r_start") - slack), at(F.greatest(micros("r_end"), micros("r_start")) + slack))))
    both = windows.withColumn("__bucket", at(micros("first"))).join(r, [key, "__bucket"]).where(
        (micros("r_start") <= micros("first") + slack) & (micros("r_end") >= micros("last") - slack)
    )
    inside = F.least(micros("r_end"), micros("w_end")) - F.greatest(micros("r_start"), micros("w_start"))
    share = F.greatest(inside, F.lit(0)) / F.greatest(micros("w_end") - micros("w_start"), F.lit(1))
    both = both.withColumn("coverage", F.round(share, 2))
    place = F.row_number().over(Window.partitionBy(key, "w_id").orderBy(F.desc("coverage"), *ranking))
    best = both.withColumn("place", place).where("place = 1").select(key, "w_id", "r_id", "r_start", "r_end", "coverage")
    return windows.join(best, [key, "w_id"], "left")


def credited(events: DataFrame, key: str, at: str, is_mark: Column, is_close: Column, most_s: float, tie: str, value: str) -> DataFrame:
    """Closing events with ``credit``: ``value`` of the last mark of their key, if at most ``most_s`` old and not yet used.

    A close uses up every mark before it, so marks count within the stretch since the close before.
    """
    order = Window.partitionBy(key).orderBy(at, tie)
    stretch = F.coalesce(F.sum(is_close.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = events.withColumn("stretch", stretch)
    inside = Window.partitionBy(key, "stretch").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(is_mark, F.struct(micros(at).alias("us"), F.col(value).alias("v"))), ignorenulls=True).over(inside)
    marked = marked.withColumn("mark", last).where(is_close)
    fresh = micros(at) - F.col("mark.us") <= seconds(most_s)
    return marked.withColumn("credit", F.when(fresh, F.col("mark.v"))).drop("mark", "stretch")


def running_count(events: DataFrame, key: str, at: str, what: Column, out: str) -> DataFrame:
    """Adds how many events of the key satisfy ``what`` up to each event's time, ties included."""
    order = Window.partitionBy(key).orderBy(micros(at)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn(out, F.sum(what.cast("int")).over(order))


def exists_within(events: DataFrame, key: str, at: str, what: Column, begin_us: int, end_us: int, out: str) -> DataFrame:
    """Adds whether an event of the key satisfies ``what`` at a time from ``at + begin_us`` to ``at + end_us``."""
    order = Window.partitionBy(key).orderBy(micros(at)).rangeBetween(begin_us, end_us)
    return events.withColumn(out, F.coalesce(F.max(what.cast("int")).over(order), F.lit(0)) == 1)


def count_within(events: DataFrame, key: str, at: str, begin_us: int, end_us: int, out: str, weight: Column | None = None) -> DataFrame:
    """Adds the number (or sum of ``weight``) of the key's events from ``at + begin_us`` to ``at + end_us``."""
    order = Window.partitionBy(key).orderBy(micros(at)).rangeBetween(begin_us, end_us)
    return events.withColumn(out, F.sum(weight if weight is not None else F.lit(1)).over(order))


def overlap_pairs(spans: DataFrame, key: str, bucket_s: float, least_s: float, least_share: float) -> DataFrame:
    """a, b, overlap_us: pairs of ``spans(key, id, start, end)`` of a key that overlap by ``least_s`` or by
    ``least_share`` of the shorter; each pair once, a before b by (start, id).

    Spans are dealt to all time buckets that they touch and compared within a bucket; a pair comes from the later one
    of the two first buckets only. The key and the bucket together spread a hot key.
    """
    bucket = seconds(bucket_s)
    s = spans.select(F.col(key).alias("key"), "id", micros("start").alias("s"), micros("end").alias("e"))
    s = s.withColumn("first", F.floor(F.col("s") / bucket)).withColumn("bucket", F.explode(F.sequence("first", F.floor(F.col("e") / bucket))))
    a, b = (s.select(F.col("key"), F.col("bucket"), *[F.col(c).alias(f"{p}_{c}") for c in ("id", "s", "e", "first")]) for p in "ab")
    pairs = a.join(b, ["key", "bucket"]).where(
        ((F.col("a_s") < F.col("b_s")) | ((F.col("a_s") == F.col("b_s")) & (F.col("a_id") < F.col("b_id"))))
        & (F.col("b_s") < F.col("a_e"))
        & (F.col("bucket") == F.greatest("a_first", "b_first"))
    )
    overlap = F.least("a_e", "b_e") - F.col("b_s")
    shorter = F.least(F.col("a_e") - F.col("a_s"), F.col("b_e") - F.col("b_s"))
    pairs = pairs.withColumn("overlap_us", overlap).where((F.col("overlap_us") >= seconds(least_s)) | (F.col("overlap_us") >= F.lit(least_share) * shorter))
    return pairs.select("key", F.col("a_id").alias("a"), F.col("b_id").alias("b"), "overlap_us")


def overlaps(spans: DataFrame, protected: DataFrame, key: str, keep: bool = True) -> DataFrame:
    """Spans(key, start, end) that touch a protected(key, p_start, p_end) span of their key, or those that don't.

    Of all protected spans that begin by a span's end, the largest end tells: one ordered pass, no pairs. A span with a
    null key or bound touches nothing.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in spans.columns]).alias("row")
    shields = protected.where("p_start is not null and p_end is not null")
    both = spans.select(F.col(key).alias("__key"), micros("end").alias("us"), F.lit(1).alias("kind"), micros("start").alias("start"), F.lit(None).cast("long").alias("until"), whole)
    other = shields.select(F.col(key).alias("__key"), micros("p_start").alias("us"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("start"), micros("p_end").alias("until"), F.lit(None).cast(both.schema["row"].dataType).alias("row"))
    order = Window.partitionBy("__key").orderBy("us", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    touch = F.coalesce((F.max("until").over(order) >= F.col("start")) & F.col("__key").isNotNull() & F.col("us").isNotNull(), F.lit(False))
    found = both.unionByName(other).withColumn("touch", touch).where("kind = 1")
    return found.where(F.col("touch") == keep).select("row.*")


def next_pairs(rows: DataFrame, key: str, at: str, tie: str, most: int, within_s: float) -> DataFrame:
    """key, a, b: each row with the ``most`` rows after it in its key, at most ``within_s`` later."""
    order = Window.partitionBy(key).orderBy(at, tie)
    after = F.collect_list(F.struct(F.col(tie).alias("id"), micros(at).alias("us"))).over(order.rowsBetween(1, most))
    each = rows.select(key, F.col(tie).alias("a"), micros(at).alias("a_us"), after.alias("after")).withColumn("n", F.explode("after"))
    return each.where(F.col("n.us") - F.col("a_us") <= seconds(within_s)).select(key, "a", F.col("n.id").alias("b"))


def nearest_sample(samples: DataFrame, key: str, age: Column, target: float, least: float, tie: str) -> DataFrame:
    """One sample for each key: that whose age is nearest to ``target``, not under ``least``; ties: the later, then the larger id."""
    aged = samples.withColumn("age", age).where(F.col("age") >= least)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.abs(F.col("age") - target), F.desc("age"), F.desc(tie)))
    return aged.withColumn("place", place).where("place = 1").drop("place")


def latest(rows: DataFrame, key: str, at: str, *ties: str) -> DataFrame:
    """The last row of each key, by the largest of ``ties`` among equal times; by partial aggregation, without a sort."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    best = rows.groupBy(key).agg(F.max_by(whole, F.struct(at, *ties)).alias("r"))
    return best.select("r.*")


def stretches(events: DataFrame, key: str, at: str, apart_s: float, tie: str | None = None) -> DataFrame:
    """Adds ``chain``: a new one begins where the step from the event before is ``apart_s`` or more."""
    return gap_chains(events, key, at, (seconds(apart_s) - 1) / 1_000_000, tie)


def by_stretch(rows: DataFrame, key: str, at: str, apart_s: float, columns: dict[str, Column], out: dict[str, str], fold, ties: tuple[str, ...] = ()) -> DataFrame:
    """``key`` and columns of those rows that ``fold`` keeps; ``out`` names them by the columns that they are taken from, of ``us`` and ``columns``.

    Events on both sides of a step of ``apart_s`` or more are in different stretches. A task goes through its keys' rows in order
    of key, ``us`` (microseconds) and ``ties``. ``fold`` is given the columns (Arrow) of many whole stretches and the places
    where they begin, and returns the places of the kept rows, in time in proportion to them; only a stretch that goes over the
    end of a batch is held. Rows without a time are left out; a null key is a key.
    """
    timed = rows.select(F.col(key).alias("__key"), micros(at).alias("us"), *[c.alias(n) for n, c in columns.items()]).where("us is not null")
    order = [F.col("us"), *[F.asc_nulls_last(t) for t in ties]]
    step = F.col("us") - F.lag("us").over(Window.partitionBy("__key").orderBy(*order))
    # The window deals whole keys to tasks and sorts them; the sort after it says what the fold relies on, and costs nothing.
    cut = timed.withColumn("begins", F.coalesce(step >= seconds(apart_s), F.lit(True))).sortWithinPartitions("__key", *order)
    schema = StructType([StructField(key, timed.schema["__key"].dataType), *[StructField(n, timed.schema[c].dataType) for n, c in out.items()]])

    def run(batches):
        def kept(parts):
            part = pa.Table.from_batches(parts).combine_chunks()
            starts = np.flatnonzero(part["begins"].to_numpy())
            found = part.take(pa.array(fold(part, starts), type=pa.int64())).select(["__key", *out.values()]).rename_columns(schema.names)
            yield from found.to_batches()

        held = []
        for b in batches:
            starts = np.flatnonzero(b.column("begins").to_numpy(zero_copy_only=False))
            if len(starts):
                last = int(starts[-1])
                whole = [p for p in (*held, b.slice(0, last)) if p.num_rows]
                if whole:
                    yield from kept(whole)
                b, held = b.slice(last), []
            held.append(b)
        if held:
            yield from kept(held)

    return cut.mapInArrow(run, schema)


def thin(events: DataFrame, key: str, at: str, least_s: float) -> DataFrame:
    """key, kept: times of each key's events, from the first on, that are ``least_s`` or more after the last kept one.

    An event that is ``least_s`` after the event before it is kept whatever came before, so a key falls into stretches
    that don't depend on each other.
    """
    step = seconds(least_s)

    def fold(part, starts) -> list[int]:
        begins, kept, due = set(starts.tolist()), [], 0
        for i, us in enumerate(part["us"].to_pylist()):
            if i in begins or us >= due:
                kept.append(i)
                due = us + step
        return kept

    return by_stretch(events, key, at, least_s, {}, {"kept": "us"}, fold)


def bursts(series: DataFrame, key: str, at: str, value: str, above: float, least_s: float, tie: str) -> DataFrame:
    """key, start, end, n: runs of neighbouring samples at or over the key's median plus ``above``, ``least_s`` long."""
    middle = series.groupBy(key).agg(F.median(value).alias("middle"))
    order = Window.partitionBy(key).orderBy(at, tie)
    loud = series.join(middle, key).withColumn("loud", (F.col(value) >= F.col("middle") + above).cast("int"))
    begins = F.when((F.col("loud") == 1) & (F.coalesce(F.lag("loud").over(order), F.lit(0)) == 0), 1).otherwise(0)
    runs = loud.withColumn("begins", begins).withColumn("run", F.sum("begins").over(order)).where("loud = 1")
    found = runs.groupBy(key, "run").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n"))
    return found.where(micros("end") - micros("start") >= seconds(least_s)).select(key, "start", "end", "n")


def longest_gap(events: DataFrame, key: str, at: str, begin: Column, end: Column) -> DataFrame:
    """key, gap_us, gap_start_us: the longest stretch without an event, borders included; the first of equal ones."""
    b, e = micros(begin), micros(end)
    order = Window.partitionBy(key).orderBy("us")
    points = events.select(key, micros(at).alias("us")).unionByName(events.select(key).distinct().select(key, F.explode(F.array(b, e)).alias("us")))
    steps = points.withColumn("gap", F.lead("us").over(order) - F.col("us")).where("gap is not null")
    return steps.groupBy(key).agg(F.max(F.struct("gap", (-F.col("us")).alias("minus"))).alias("m")).select(key, F.col("m.gap").alias("gap_us"), (-F.col("m.minus")).alias("gap_start_us"))


def peaks(series: DataFrame, key: str, at: str, value: str, tie: str, least: float) -> DataFrame:
    """Samples that are at least ``least``, over the one before and not under the one after."""
    order = Window.partitionBy(key).orderBy(at, tie)
    before, after = F.lag(value).over(order), F.lead(value).over(order)
    rise = (F.col(value) > F.coalesce(before, F.lit(float("-inf")))) & (F.col(value) >= F.coalesce(after, F.lit(float("-inf"))))
    return series.withColumn("peak", rise & (F.col(value) >= least)).where("peak").drop("peak")


def evening(at: str | Column, zone: str, switch_hour: int) -> Column:
    """The local day of an event where days change at ``switch_hour``."""
    local = local_time(F.col(at) if isinstance(at, str) else at, zone)
    return F.to_date(local - F.make_dt_interval(hours=F.lit(switch_hour)))


def weekly_cutoffs(first: Column, last: Column, zone: str, iso_day: int, hour: int) -> Column:
    """Array of UTC times of each week's ``iso_day`` (1 = Monday) at ``hour`` local time between two UTC times."""
    local = local_time(first, zone)
    day = F.date_add(F.to_date(local), F.pmod(F.lit(iso_day - 1) - F.weekday(local), F.lit(7)))
    begin = day.cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(hour))
    all_local = F.sequence(begin, local_time(last, zone) + F.make_dt_interval(days=F.lit(7)), F.make_dt_interval(days=F.lit(7)))
    return F.filter(F.transform(all_local, lambda t: instant(t, zone)), lambda t: (t >= first) & (t <= last))
