"""Teachers of the learner: duels as pairs, what each teacher weighs, statistics of choices, the gate before new factors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import feature_sum
from .learning import hit_rate

# What an audience's and a machine's judgement count beside a person's 1.
AUDIENCE, MACHINE = 2.0, 0.34


def won_pairs(duels: DataFrame, drafts: DataFrame, draft: str, format_: str, sure: str, least: float) -> DataFrame:
    """winner, loser, format of duels whose sides are both known and of one format, as sure as ``least`` (null: 0.5)."""
    sides = [drafts.select(F.col(draft).alias(side), F.col(format_).alias(f"{side}_format")) for side in ("winner", "loser")]
    certain = duels.where(F.coalesce(F.col(sure), F.lit(0.5)) >= least)
    both = certain.join(sides[0], "winner").join(sides[1], "loser").where("winner_format = loser_format")
    return both.select("winner", "loser", F.col("winner_format").alias("format"))


def teacher_weights(published: DataFrame, audience_pairs: DataFrame, good: Column, bad: Column, machine_pairs: DataFrame, half: float, budget: float, least: int) -> DataFrame:
    """One row: share (of the audience), checked, hit, trust and weight (of a machine's pair).

    The machine's notes are held against the audience's pairs where both sides have one; trust rises from 0 at a hit rate
    of 0.5 to 1 at 0.7, and is 1 while fewer than ``least`` are checked. A pair weighs 0.5 * (1 - share) * trust, less
    where all would exceed ``budget``. Three sums meet as three rows.
    """
    right = F.when(good > bad, 1.0).when(good == bad, 0.5).otherwise(0.0)
    zero = lambda n, kind="long": F.lit(0).cast(kind).alias(n)
    sums = published.select(F.lit(1).cast("long").alias("p"), zero("c"), zero("r", "double"), zero("m"))
    checked = audience_pairs.where(good.isNotNull() & bad.isNotNull()).select(zero("p"), F.lit(1).cast("long").alias("c"), right.alias("r"), zero("m"))
    machine = machine_pairs.select(zero("p"), zero("c"), zero("r", "double"), F.lit(1).cast("long").alias("m"))
    s = sums.unionByName(checked).unionByName(machine).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "pcrm"])
    s = s.withColumn("share", F.try_divide("p", F.col("p") + half)).withColumn("hit", F.when(F.col("c") >= least, F.col("r") / F.col("c")))
    s = s.withColumn("trust", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("hit") - 0.5) / 0.2)), F.lit(1.0)))
    each = 0.5 * (1 - F.col("share")) * F.col("trust") * F.least(F.lit(1.0), F.try_divide(F.lit(budget), F.col("m")))
    return s.select("share", F.col("c").alias("checked"), "hit", "trust", F.when(F.col("m") > 0, each).otherwise(0.0).alias("weight"))


def arm_statistics(choices: DataFrame, verdicts: DataFrame, audience: DataFrame, machine: DataFrame, duels: DataFrame) -> DataFrame:
    """knob, choice, n, s (weights of all and of hits), yes, no, viewers, viewers_s of ``choices(draft, knob, choice)``.

    verdicts(draft, thumb, knobs): 1 or -1, for ``knobs`` (null: all). audience(draft, y): -1 to 1. machine(draft, note): 0
    to 100. duels(winner, loser, weight) teach only the knobs in which the sides differ. Choices without any are not listed.
    """
    held = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    no = F.lit(0.0)

    def seen(rows, *, n, s, yes=no, nay=no, viewers=no, viewers_s=no, knobs=None):
        knobs = F.lit(None).cast("array<string>") if knobs is None else knobs
        sums = {"n": n, "s": s, "yes": yes, "no": nay, "viewers": viewers, "viewers_s": viewers_s}
        return rows.select("draft", knobs.alias("knobs"), *[c.cast("double").alias(k) for k, c in sums.items()])

    liked = (F.col("thumb") > 0).cast("double")
    y, note = held((F.col("y") + 1) / 2), held(F.col("note") / 100.0)
    all_ = seen(verdicts.where("thumb in (1, -1)"), n=F.lit(1.0), s=liked, yes=liked, nay=1 - liked, knobs=F.col("knobs"))
    all_ = all_.unionByName(seen(audience.where("y is not null"), n=F.lit(AUDIENCE), s=AUDIENCE * y, viewers=F.lit(1.0), viewers_s=y))
    all_ = all_.unionByName(seen(machine.where("note is not null"), n=F.lit(MACHINE), s=MACHINE * note))
    told = all_.join(choices, "draft").where(F.col("knobs").isNull() | F.expr("array_contains(knobs, knob)"))
    a, b = (choices.select(F.col("draft").alias(side), "knob", F.col("choice").alias(f"{side}_choice")) for side in ("winner", "loser"))
    fought = duels.join(a, "winner").join(b, ["loser", "knob"]).where("winner_choice != loser_choice")
    sides = F.explode(F.array(F.struct(F.col("winner_choice").alias("choice"), F.col("weight").cast("double").alias("s")), F.struct(F.col("loser_choice").alias("choice"), no.alias("s"))))
    fought = fought.select("knob", F.col("weight").cast("double").alias("n"), sides.alias("x")).select("knob", "x.choice", "n", "x.s")
    names = ["n", "s", "yes", "no", "viewers", "viewers_s"]
    sums = told.select("knob", "choice", *names).unionByName(fought, allowMissingColumns=True)
    counted = sums.groupBy("knob", "choice").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in names])
    return counted.withColumns({c: F.col(c).cast("long") for c in ("yes", "no", "viewers")})


def blended(learned: dict[str, float], start: dict[str, float], trust: float) -> dict[str, float]:
    """Start weights times the learned factors (logarithms), as far as they are trusted."""
    return {k: w * math.exp(trust * learned.get(k, 0.0)) for k, w in start.items()}


def never_worse(holdout: DataFrame, difference: Column, weight: Column, learned: dict[str, float], start: dict[str, float], trust: float) -> DataFrame:
    """One row: rate, rate_start, active. The blended weights sort the held-out pairs as well as the start ones, or no
    pairs are there; ``difference`` maps features to better less worse."""
    rates = holdout.agg(hit_rate(holdout, feature_sum(difference, blended(learned, start, trust)), weight).alias("rate"), hit_rate(holdout, feature_sum(difference, start), weight).alias("rate_start"))
    return rates.withColumn("active", F.coalesce(F.col("rate") >= F.col("rate_start"), F.lit(True)))
