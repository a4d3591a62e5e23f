"""Weekly crowning: which choice of the makers is proven to do better, replayed cutoff by cutoff."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cohort import welch
from .timeline import micros


def counted_units(units: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """The units of ``units(post, family, posted, done, ...)`` that count at each of ``cutoffs(cutoff)``: of each family
    the one posted first among those done by then.

    Cutoffs are weeks, a few hundred values, and are a constant of the plan; families are grouped by partial aggregation.
    """
    weeks = F.array(*[F.lit(r[0]) for r in cutoffs.select("cutoff").distinct().collect()]).cast(f"array<{cutoffs.schema['cutoff'].dataType.simpleString()}>")
    seen = units.withColumn("cutoff", F.explode(F.filter(weeks, lambda c: c >= F.col("done"))))
    best = seen.groupBy("cutoff", "family").agg(F.min_by(F.struct(*[F.col(c) for c in units.columns]), F.struct("posted", "post")).alias("u"))
    return best.select("cutoff", "u.*")


def findings(counted: DataFrame, choices: list[str], best: str | None, since) -> list:
    """Rows (cutoff, choice, verdict, difference, evidence, all) for each cutoff and choice.

    Without a best choice each one is held against all others, else against the best among units posted after
    ``since``. ``evidence`` changes with the posts of either side, ``all`` with any post that counts at the cutoff.
    """
    mark = F.sum(F.xxhash64("post").cast("decimal(38,0)"))
    everything = counted.groupBy("cutoff").agg(mark.alias("all"))
    rows = counted.where(F.col("choice").isNotNull())
    if best is not None:
        rows = rows.where(micros("posted") > micros(F.lit(since)))
    asked = [c for c in choices if c != best]
    each = rows.withColumn("asked", F.explode(F.array(*[F.lit(c) for c in asked])))
    if best is not None:
        each = each.where((F.col("choice") == F.col("asked")) | (F.col("choice") == best))
    side = F.col("choice") == F.col("asked")
    evidence = F.struct(F.sum(F.when(side, F.xxhash64("post")).cast("decimal(38,0)")).alias("a"), F.sum(F.when(~side, F.xxhash64("post")).cast("decimal(38,0)")).alias("b"))
    found = welch(each, side, "score", "length", by=["cutoff", "asked"], extra=(evidence.alias("evidence"),))
    return everything.join(found, "cutoff", "left").orderBy("cutoff", "asked").collect()


def crown(units: DataFrame, cutoffs: DataFrame, choices: list[str]) -> list[dict]:
    """Entries (cutoff, kind, choice, against): ``lead`` when a choice is proven better, ``best`` when the same choice leads
    at the next cutoff that decides anything, with other evidence.

    A cutoff at which nothing new counts decides nothing. Each crowning starts the comparisons anew, so there is one
    aggregation over all cutoffs for each, not one for each week; what reaches the driver is cutoffs times choices.
    """
    counted = counted_units(units, cutoffs)
    entries, best, since, lead, last = [], None, None, None, None
    while True:
        crowned = None
        table: dict = {}
        for r in findings(counted, choices, best, since):
            table.setdefault(r["cutoff"], (r["all"], []))[1].append(r)
        for cutoff in sorted(table):
            mark, rows = table[cutoff]
            if since is not None and cutoff <= since or mark == last:
                continue
            last = mark
            better = [r for r in rows if r["verdict"] == "more"]
            now = max(better, key=lambda r: r["difference"], default=None)
            if now is not None and lead is not None and now["asked"] == lead["asked"]:
                if now["evidence"] == lead["evidence"]:
                    continue
                entries.append({"cutoff": cutoff, "kind": "best", "choice": now["asked"], "against": best})
                crowned, lead = (now["asked"], cutoff), None
                break
            if now is not None:
                entries.append({"cutoff": cutoff, "kind": "lead", "choice": now["asked"], "against": best})
            lead = now
        if crowned is None:
            return entries
        best, since = crowned
