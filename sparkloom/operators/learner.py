"""What verdicts teach: pairs from votes and from an audience's scores, and weights that are used only if they sort no worse than the start.

Pairs have the columns source, place (their order within the source), weight and, for each feature, better less worse; null is not
comparable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settled import settled
from .cohort import holdout
from .evidence import perceptron
from .learning import hit_rate
from .selection import numbered
from .timeline import micros

# What a thumb up, and one down without a reason, say of each moment; and how near a distance may miss its least.
UP, DOWN, TIE = 1.0, -1.0, 1e-9


def vote_sums(votes: DataFrame, shown: DataFrame, draft: str, moment: str) -> DataFrame:
    """moment, votes: the sum of the verdicts over all drafts that showed it; moments whose verdicts cancel out are left out.

    ``votes(draft, thumb, reasons)`` has a positive thumb for up, any other for down; one down with a reason says nothing of
    the moments. ``shown(draft, moment)`` counts a moment once for each draft. Null moments are none.
    """
    said = F.when(F.col("thumb") > 0, UP).when(F.size(F.coalesce("reasons", F.array().cast("array<string>"))) == 0, DOWN)
    each = votes.select(draft, said.alias("__said")).where("__said is not null").join(shown.where(F.col(moment).isNotNull()).select(draft, moment).distinct(), draft)
    return each.groupBy(moment).agg(F.sum("__said").alias("votes")).where("votes <> 0")


def voted_pairs(sums: DataFrame, moment: str, most: int) -> DataFrame:
    """good, bad, place: liked moments against disliked ones, the clearest first, in turn, ``most`` pairs at most.

    The i-th liked one meets the (i + shift)-th disliked one, for shift 0 first, so no moment comes up much more often than
    others. Equally clear moments stand in order of their names.
    """
    clear = lambda side: numbered(side.select(moment, F.struct((-F.abs("votes")).alias("v"), F.col(moment).alias("m")).alias("__by")), "__by", "__i").select(F.col(moment), "__i")
    good, bad = settled(clear(sums.where("votes > 0"))), settled(clear(sums.where("votes < 0")))
    n, m = good.count(), bad.count()
    if not n or not m:
        return good.select(F.col(moment).alias("good"), F.col(moment).alias("bad"), F.col("__i").alias("place")).limit(0)
    most = min(most, n * m)
    shifts = F.ceil((most - F.col("__i")) / n).cast("int")
    pairs = good.where(shifts > 0).select(F.col(moment).alias("good"), F.col("__i").alias("i"), F.explode(F.sequence(F.lit(0), shifts - 1)).alias("shift"))
    met = pairs.withColumn("__i", F.pmod(F.col("i") + F.col("shift"), F.lit(m))).join(bad.select("__i", F.col(moment).alias("bad")), "__i")
    return met.select("good", "bad", (F.col("shift") * n + F.col("i")).alias("place"))


def audience_pairs(posts: DataFrame, keys: list[str], post: str, moment: str, at: str, score: str, least: float, most: int, first: int = 256) -> DataFrame:
    """good, bad (posts), place: pairs of the same ``keys`` (platform, kind) whose scores differ by ``least``, the ``most`` newest.

    A pair is as new as its newer post, then by its larger and its smaller id. Posts of the same moment are no pair, nor are
    posts without a score, time or moment. Only the newest posts are paired with all others of their keys, as many as it
    takes: ``first``, then four times as many.
    """
    rows = settled(posts.where(F.col(score).isNotNull() & F.col(at).isNotNull() & F.col(moment).isNotNull()).select(F.struct(*keys).alias("k"), F.col(post).alias("id"), F.col(moment).alias("m"), micros(at).alias("us"), F.col(score).cast("double").alias("y")))
    total, n = rows.count(), first
    while True:
        edge = rows.orderBy(F.col("us").desc()).limit(n).agg(F.min("us")).first()[0]
        newer, older = ([F.col(c).alias(f"{p}_{c}") for c in ("id", "m", "us", "y")] for p in "ab")
        a = rows.where(F.col("us") >= F.lit(edge)).select("k", *newer)
        both = a.join(rows.select("k", *older), "k")
        later = (F.col("a_us") > F.col("b_us")) | ((F.col("a_us") == F.col("b_us")) & (F.col("a_id") > F.col("b_id")))
        pairs = both.where(later & (F.col("a_m") != F.col("b_m")) & (F.abs(F.col("a_y") - F.col("b_y")) + TIE >= least) & (F.col("a_y") != F.col("b_y")))
        order = [F.col("a_us").desc(), F.greatest("a_id", "b_id").desc(), F.least("a_id", "b_id").desc()]
        newest = settled(pairs.orderBy(*order).limit(most))  # of most rows
        if n >= total or newest.count() >= most:
            break
        n *= 4
    up = F.col("a_y") > F.col("b_y")
    place = (F.row_number().over(Window.orderBy(*order)) - 1).alias("place")
    return newest.select(F.when(up, F.col("a_id")).otherwise(F.col("b_id")).alias("good"), F.when(up, F.col("b_id")).otherwise(F.col("a_id")).alias("bad"), place)


def _lead(weights: dict[str, float]) -> Column:
    """What a pair's better side leads by; features that can't be compared count 0."""
    return sum((F.coalesce(F.col(f"`{k}`"), F.lit(0.0)) * w for k, w in weights.items()), F.lit(0.0))


def learned_weights(pairs: DataFrame, start: dict[str, float], audience: str, basis: int, least: int, full: int, least_audience: int, step: float = 0.05, epochs: int = 20, share: float = 0.5, narrow: float = 0.5) -> tuple[dict[str, float], dict]:
    """The weights to use, and a report: trust, rates of the learned and the start weights for each side, rate_holdout, active, reason.

    ``pairs`` are of several sources, one of which is ``audience``; they teach in order of (source is audience, source, place), where
    the audience's places count from the newest. Weights move from the start as far as the ``basis``, the number of verdicts, is
    to ``full``; under ``least`` of them nothing is learned. They are dropped for the start ones if they sort the user's pairs
    worse, or from ``least_audience`` pairs on the audience's. rate_holdout is that of weights that never saw the newest fifth
    of each side, on that fifth. Only rates and weights reach the driver.
    """
    names = list(start)
    side = (F.col("source") == audience).cast("int")
    known = settled(pairs.where("weight > 0").select("source", "place", "weight", *[F.col(f"`{n}`").cast("double") for n in names], side.alias("__side")))
    old = F.when(F.col("__side") == 1, -F.col("place")).otherwise(F.col("place"))
    # Both sides' pairs from the oldest on; the user's sources one after another.
    aged = known.withColumn("__old", F.struct("source", old.alias("o")))
    split = holdout(aged, "__old", "weight", key="__side")
    trust = min(1.0, basis / max(1, full))

    def learn(rows: DataFrame) -> dict[str, float]:
        ordered = rows.select(F.lit(0).alias("__pool"), F.struct("__side", "source", "place").alias("__order"), "weight", *names)
        place = F.row_number().over(Window.partitionBy("__pool").orderBy("__order"))
        found = perceptron(ordered.withColumn("__nr", place), "__pool", "__nr", names, "weight", start, step, epochs, share, narrow).collect()
        learned = {r["name"]: r["weight"] for r in found}
        return {n: round(w + trust * (learned.get(n, w) - w), 4) for n, w in start.items()}

    def rates(rows: DataFrame, *weights: dict[str, float]) -> list[float | None]:
        return list(rows.agg(*[hit_rate(rows, _lead(w), F.col("weight")).alias(f"r{i}") for i, w in enumerate(weights)]).first())

    user, viewers = known.where("__side = 0"), known.where("__side = 1")
    held = settled(split.where("held_out").drop("held_out", "__old"))
    out = {"trust": round(trust, 3), "rate_holdout": rates(held, learn(split.where("not held_out")))[0] if held.limit(1).count() else None}
    n_audience = viewers.count()
    if basis < least:
        (u,), (v,) = rates(user, start), rates(viewers, start)
        return dict(start), out | {"rate": u, "rate_start": u, "rate_audience": v, "rate_audience_start": v, "active": False, "reason": f"{least - basis} verdicts to go"}
    new = learn(known)
    (u, u0), (v, v0) = rates(user, new, start), rates(viewers, new, start)
    worse = lambda a, b: a is not None and b is not None and a < b
    for who, bad in (("user", worse(u, u0)), ("audience", n_audience >= least_audience and worse(v, v0))):
        if bad:
            return dict(start), out | {"rate": u0, "rate_start": u0, "rate_audience": v0, "rate_audience_start": v0, "active": False, "reason": f"sorts the {who}'s pairs worse"}
    return new, out | {"rate": u, "rate_start": u0, "rate_audience": v, "rate_audience_start": v0, "active": True, "reason": "active"}
