"""How well a post did with its audience, against comparable earlier posts, and scores that stay as they were first given."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions.scalars import age_days, measured
from ..streaming.ingest import add_absent
from .cohort import MAD_SIGMA

# Of each component its weight, where it starts from without comparable posts, and its smallest spread.
COMPONENTS = {
    "retention": (0.40, 0.50, 0.25), "completion": (0.18, 0.30, 0.22), "shares": (0.12, 0.01, 0.01), "saves": (0.10, 0.005, 0.005), "follows": (0.05, 0.002, 0.002),
    "rewatches": (0.04, 0.05, 0.05), "comments": (0.04, 0.004, 0.004), "likes": (0.02, 0.04, 0.04), "reach": (0.05, 6.90875477931522, 1.5),
}
# Views that a start value counts for, comparable posts that it counts for, and the most that reach may weigh.
PRIOR_VIEWS, PRIOR_POSTS, REACH_MOST = 100, 8, 0.08
# By how much length and age of comparable posts may differ, and how many such it takes to leave out others.
LENGTH_BAND, AGE_BAND, LEAST_NEAR = (0.75, 1.33), (0.5, 2.0), 3
RATES = ("likes", "comments", "shares", "saves", "follows", "rewatches")
#: Earlier posts that one is compared with, at most: the newest.
COHORT = 60
#: Posts that are compared in one step of a task.
PIECE = 4096


def raw_components(length_s: Column, age: Column, numbers: dict[str, Column]) -> Column:
    """struct of COMPONENTS, each null where it can't be known.

    ``numbers`` may have views, impressions, retention_pct, watch_s, full_pct and RATES; what is missing, negative or not
    finite is unknown. Rates are shrunk towards their start values by PRIOR_VIEWS views; no views, no rates. Reach is
    views per impression where those are known, else views by the square root of the age in days.
    """
    n = {k: measured(v.cast("double")) for k, v in numbers.items()}
    if "views" in n:
        n["views"] = F.when(n["views"] > 0, n["views"])
    return _components(measured(length_s), age, n)


def _components(length: Column, age: Column, n: dict[str, Column]) -> Column:
    """raw_components() of numbers that are known to be measured, and of views that are null where there are none."""
    known = lambda k: n.get(k, F.lit(None).cast("double"))
    views = known("views")
    watched = F.when(length > 0, known("watch_s") / length)
    out = {"retention": F.least(F.lit(1.5), F.coalesce(known("retention_pct") / 100, watched)), "completion": F.least(F.lit(1.0), known("full_pct") / 100)}
    for name in RATES:
        shrunk = (F.least(known(name) / views, F.lit(2.0)) * views + PRIOR_VIEWS * COMPONENTS[name][1]) / (views + PRIOR_VIEWS)
        out[name] = F.when(known(name).isNotNull() & views.isNotNull(), shrunk)
    for name, given in (("retention", F.coalesce(known("retention_pct"), watched)), ("completion", known("full_pct"))):
        out[name] = F.when(given.isNotNull(), out[name])  # least() alone would take the bound for an unknown
    shown = F.when(known("impressions") > 0, F.log1p(1000 * F.least(F.lit(2.0), views / known("impressions"))))
    out["reach"] = F.when(views.isNotNull(), F.coalesce(shown, F.when(age.isNotNull(), F.log1p(views / F.sqrt(F.greatest(F.lit(0.5), age))))))
    return F.struct(*[out[name].alias(name) for name in COMPONENTS])


def _middles(values: np.ndarray, there: np.ndarray) -> np.ndarray:
    """The median of each row's values that are there, the mean of the middle pair where there are two; NaN without any, and NaN come last."""
    n, row = there.sum(axis=1), np.arange(len(values))
    s = np.sort(np.where(there, values, np.nan), axis=1)
    return (s[row, np.maximum(n - 1, 0) // 2] + s[row, n // 2]) / 2.0


def _codes(values: pa.Array) -> np.ndarray:
    """A number for each different value; -1 for null."""
    values = pc.add(values, 0.0) if pa.types.is_floating(values.type) else values  # -0.0 is 0.0
    return values.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def _numbers(values: pa.Array) -> np.ndarray:
    return values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null is NaN


def _comparisons(rows: pa.RecordBatch, first: int, key_from: np.ndarray, time_from: np.ndarray, most: int) -> list[pa.Array]:
    """Of rows from ``first`` on: how many posts each is compared with, and how far each of its components is from the middle of theirs, in spreads.

    Start values are mixed into the middle; a component that isn't known has no distance.

    ``key_from`` and ``time_from`` are where a row's key and its time begin (0, and the first of that time, where they
    began earlier): the posts are those of the ``most`` rows before its time that are of its key and have a time.
    """
    place = time_from[:, None] + np.arange(-most, 0)
    there = place >= key_from[:, None]
    place = np.where(there, place, 0)
    own = slice(first, None)
    column = lambda c: rows.column(c)
    there &= column("timed").to_numpy(zero_copy_only=False)[place]
    target = _codes(column("target"))
    there &= (target[place] != target[own, None]) | (target[place] < 0)
    length, age = _numbers(column("length_s")), _numbers(column("age"))
    with np.errstate(all="ignore"):
        ratio, older = length[place] / length[own, None], np.maximum(0.1, age[place]) / np.maximum(0.1, age[own, None])
        near = there & (length[own, None] > 0) & (ratio >= LENGTH_BAND[0]) & (ratio <= LENGTH_BAND[1]) & (older >= AGE_BAND[0]) & (older <= AGE_BAND[1])
        there = np.where((near.sum(axis=1) >= LEAST_NEAR)[:, None], near, there)
        shown = column("shown").cast(pa.int8()).fill_null(-1).to_numpy(zero_copy_only=False)
        out = [pa.array(there.sum(axis=1), pa.int32())]
        for name, (_, start, least) in COMPONENTS.items():
            values = pc.struct_field(column("parts"), name)
            known, x = values.is_valid().to_numpy(zero_copy_only=False), _numbers(values)
            having = there & known[place]
            if name == "reach":
                having &= (shown[place] == shown[own, None]) & (shown[place] >= 0)
            n, theirs = having.sum(axis=1), x[place]
            middle = _middles(theirs, having)
            mad = _middles(np.abs(theirs - middle[:, None]), having)
            share = n / (n + float(PRIOR_POSTS))
            centre = (1 - share) * start + share * np.where(n > 0, middle, 0.0)
            out.append(pa.array((x[own] - centre) / np.maximum(least, MAD_SIGMA * np.where(n > 0, mad, 0.0)), mask=~known[own]))
    return out


def _with_comparisons(posts: DataFrame, post: str, keys: list[str], target: str, at: str, most: int) -> DataFrame:
    """``posts`` with __compared and each component's __distance_ (_comparisons()).

    A task goes through its keys' posts in order of time, batch by batch, and holds the last ``most`` of a time and of what was before it.
    """
    order = Window.partitionBy(*keys).orderBy(at, post)
    begins = F.row_number().over(order) == 1
    cut = posts.withColumns({"__begins": begins, "__changes": begins | ~F.lag(at).over(order).eqNullSafe(F.col(at))})
    # The window deals whole keys to tasks and sorts them; the sort after it says what the fold relies on, and costs nothing.
    cut = cut.sortWithinPartitions(*keys, at, post)
    added = [StructField("__compared", IntegerType()), *[StructField(f"__distance_{name}", DoubleType()) for name in COMPONENTS]]
    schema, kept = StructType([*posts.schema.fields, *added]), posts.columns

    def run(batches):
        held, begun = [], 0  # rows that later ones may be compared with; where among them the time of the last one begins
        for whole in batches:
            for batch in (whole.slice(i, PIECE) for i in range(0, whole.num_rows, PIECE)):
                new = {"target": target, "length_s": "length_s", "age": "age", "shown": "shown", "parts": "parts"}
                slim = pa.RecordBatch.from_arrays([*[batch.column(c) for c in new.values()], batch.column(at).is_valid()], [*new, "timed"])
                rows = pa.concat_batches([*held, slim])
                first = len(rows) - len(slim)
                here = np.arange(first, len(rows))
                since = lambda flags, start: np.maximum.accumulate(np.where(batch.column(flags).to_numpy(zero_copy_only=False), here, start))  # noqa: E731, B023
                key_from, time_from = since("__begins", 0), since("__changes", begun)
                found = _comparisons(rows, first, key_from, time_from, most)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *found], schema.names)
                start, end = int(time_from[-1]), len(rows)
                before = np.arange(max(int(key_from[-1]), start - most), start)
                held, begun = [rows.take(pa.array(np.concatenate([before, np.arange(max(start, end - most), end)])))], len(before)

    return cut.mapInArrow(run, schema)


def audience_scores(posts: DataFrame, post: str, keys: list[str], target: str, at: str, most: int = COHORT) -> DataFrame:
    """``posts`` with score (-1 to 1), confidence (0 to 1), compared (posts) and standing (a struct of COMPONENTS, -1 to 1 each).

    ``posts`` have parts (raw_components()), views, age, length_s and shown (whether impressions are known). A post is
    compared with the ``most`` newest strictly earlier ones of the same ``keys`` (platform, account), less those of its own
    target; with those alike in length and age only, if there are LEAST_NEAR. Reach is compared with reach of the same
    kind and weighs REACH_MOST at most. Without any component of quality, or without views where those are known,
    there is no score. A post without a time is compared with none and no other with it.
    """
    seen = _with_comparisons(posts, post, keys, target, at, most)
    # Steps of few expressions each: the JVM doesn't compile methods of over 8,000 bytes, which long ones become.
    seen = seen.withColumn("standing", F.struct(*[F.round(F.tanh(f"__distance_{name}"), 6).alias(name) for name in COMPONENTS]))
    quality, total = F.lit(0.0), F.lit(0.0)
    for name, (weight, _, _) in COMPONENTS.items():
        if name != "reach":
            here = F.col(f"standing.{name}")
            quality, total = quality + F.when(here.isNotNull(), weight).otherwise(0.0), total + F.coalesce(weight * here, F.lit(0.0))
    seen = seen.withColumns({"__quality": quality, "__total": total, "__reach": F.col("standing.reach"), "__views": measured(F.col("views").cast("double"))})
    quality, total, reach, views = (F.col(f"__{c}") for c in ("quality", "total", "reach", "views"))
    scored = (quality > 0) & ~F.coalesce(views == 0, F.lit(False))
    share = F.when(reach.isNotNull(), F.least(F.lit(REACH_MOST), COMPONENTS["reach"][0] / (quality + 0.05))).otherwise(0.0)
    seen = seen.withColumns({"__scored": scored, "__share": share})
    scored, share = F.col("__scored"), F.col("__share")
    exposure = F.when(views.isNotNull(), F.sqrt(views / (views + 200))).otherwise(0.25)
    ripe = F.when(F.col("age").isNotNull(), 0.3 + 0.7 * (1 - F.exp(-F.col("age") / 1.5))).otherwise(0.5)
    sure = F.least(F.lit(0.98), (quality + F.when(reach.isNotNull(), 0.05).otherwise(0.0)) * exposure * ripe)
    score = F.when(scored, (1 - share) * F.try_divide(total, quality) + share * F.coalesce(reach, F.lit(0.0)))
    out = seen.withColumns({"score": score, "confidence": F.when(scored, sure).otherwise(0.0), "compared": F.col("__compared")})
    return out.drop(*[c for c in seen.columns if c not in posts.columns and c != "standing"])


def described(posts: DataFrame, at: str, sampled: str, length: str, numbers: dict[str, Column]) -> DataFrame:
    """``posts`` with what audience_scores() asks for: parts, views, age in days at the sample, length_s, shown."""
    age = F.greatest(F.lit(0.0), age_days(F.col(at), F.col(sampled)))
    steps = {f"__{k}": v.cast("double") for k, v in numbers.items()} | {"__length": F.col(length).cast("double")}
    # Steps of few expressions each, as in audience_scores(): what a later one uses often is worked out once.
    wide = posts.withColumns({"__given": numbers["views"], "__age": F.when(F.col(at).isNotNull() & F.col(sampled).isNotNull(), age), **steps})
    wide = wide.withColumns({c: measured(F.col(c)) for c in steps})
    wide = wide.withColumn("__positive", F.when(F.col("__views") > 0, F.col("__views")))
    n = {k: F.col("__positive" if k == "views" else f"__{k}") for k in numbers}
    shown = F.coalesce(F.col("__impressions") > 0, F.lit(False)) if "impressions" in numbers else F.lit(False)
    out = wide.withColumns({"parts": _components(F.col("__length"), F.col("__age"), n), "views": F.col("__given"), "age": F.col("__age"), "length_s": F.col("__length"), "shown": shown})
    return out.drop("__given", "__age", "__positive", *steps)


FROZEN = ("parts", "views", "age", "length_s", "shown", "score", "confidence")


def freeze_scores(spark: SparkSession, due: DataFrame, path: str, post: str, keys: list[str], target: str, at: str, most: int = COHORT) -> int:
    """Adds the scores of ``due`` posts that the table at ``path`` doesn't have; returns how many.

    What is there stays as it is, and is what new posts are compared with: frozen posts by the parts that were frozen, those of
    the same run by their own, the oldest first as far as their times go. So a post whose sample changed later changes no
    earlier result, and a second run adds nothing. Posts without a score wait.
    """
    from pyspark.errors import AnalysisException

    columns = [post, *keys, target, at]
    new = due.select(*columns, *[c for c in FROZEN if c not in ("score", "confidence")])
    every = new.withColumn("__new", F.lit(True))
    try:
        there = spark.read.parquet(path)
        old = there.select(*every.columns[:-1]).withColumn("__new", F.lit(False))
        every = old.unionByName(new.join(there.select(post), post, "left_anti").withColumn("__new", F.lit(True)))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition() or e):
            raise
    scored = audience_scores(every, post, keys, target, at, most).where(F.col("__new") & F.col("score").isNotNull())
    return add_absent(spark, scored.select(*columns, *FROZEN), path, post)
