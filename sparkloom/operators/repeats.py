"""The same pictures twice: source intervals that overlap, and runs of frames that look like frames before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hamming

# Seconds of a source that may come twice, frames of a run, bits by which alike frames differ at most, bits that a
# frame says something with, and seconds between frame and copy at least.
DOUBLE_S, RUN, BITS, TELLING, APART_S = 1.5, 3, 6, (4, 60), 3.0


def doubled_sources(segments: DataFrame, key: str, file: str, number: str, start: str, end: str, most_s: float = DOUBLE_S) -> DataFrame:
    """key, file, a, b, twice_s: segments of a key whose parts of the same file overlap by more than ``most_s``; a before b by (start, number).

    Parts are seconds. They are dealt to pieces of time that are at most as long as the longest part, and compared where the
    later of the two begins, so each pair is met once.
    """
    parts = segments.select(F.col(key).alias("key"), F.col(file).alias("file"), F.col(number).alias("id"), F.col(start).cast("double").alias("s"), F.col(end).cast("double").alias("e")).dropna().where("e > s")
    size = max(1.0, parts.agg(F.max(F.col("e") - F.col("s"))).first()[0] or 1.0)
    at = lambda x: F.floor(x / size)
    a = parts.select("key", "file", *[F.col(c).alias(f"a_{c}") for c in ("id", "s", "e")], F.explode(F.sequence(at(F.col("s")), at(F.col("e")))).alias("piece"))
    b = parts.select("key", "file", *[F.col(c).alias(f"b_{c}") for c in ("id", "s", "e")], at(F.col("s")).alias("piece"))
    first = (F.col("a_s") < F.col("b_s")) | ((F.col("a_s") == F.col("b_s")) & (F.col("a_id") < F.col("b_id")))
    twice = F.least("a_e", "b_e") - F.col("b_s")
    pairs = a.join(b, ["key", "file", "piece"]).where(first & (twice > most_s + 1e-6))
    return pairs.select(F.col("key").alias(key), F.col("file").alias(file), F.col("a_id").alias("a"), F.col("b_id").alias("b"), twice.alias("twice_s"))


def repeated_runs(frames: DataFrame, key: str, place: str, picture: str, rate: float, run: int = RUN, bits: int = BITS, apart_s: float = APART_S) -> DataFrame:
    """key, first, offset, n: runs of ``run`` or more frames in a row that each look like the frame ``offset`` places later.

    ``picture`` is a hash of 64 bits; two frames look alike if at most ``bits`` differ and the earlier one has neither few nor
    nearly all bits set. Copies are ``apart_s`` or more later, at ``rate`` frames a second. Two such hashes agree in one of
    ``bits + 1`` bands of theirs, so frames meet by a band and not all with all. Null hashes are like nothing.
    """
    known = frames.select(F.col(key).alias("key"), F.col(place).cast("long").alias("i"), F.col(picture).cast("long").alias("h")).dropna()
    edges = [round(64 * k / (bits + 1)) for k in range(bits + 2)]
    cut = F.array(*[F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("h", a).bitwiseAND(F.lit((1 << (z - a)) - 1)).alias("part")) for k, (a, z) in enumerate(zip(edges, edges[1:], strict=False))])
    banded = known.select("key", "i", "h", F.explode(cut).alias("x")).select("key", "i", "h", "x.*")
    telling = banded.where(F.bit_count("h").between(*TELLING))
    a, b = telling.select("key", "band", "part", F.col("i").alias("a"), F.col("h").alias("ha")), banded.select("key", "band", "part", F.col("i").alias("b"), F.col("h").alias("hb"))
    least = int(apart_s * rate)
    alike = a.join(b, ["key", "band", "part"]).where((F.col("b") - F.col("a") >= least) & (hamming(F.col("ha"), F.col("hb")) <= bits))
    hits = alike.select("key", F.col("a").alias("i"), (F.col("b") - F.col("a")).alias("offset")).distinct()
    island = F.col("i") - F.row_number().over(Window.partitionBy("key", "offset").orderBy("i"))
    runs = hits.withColumn("island", island).groupBy("key", "offset", "island").agg(F.min("i").alias("first"), F.count("*").alias("n")).where(F.col("n") >= run)
    return runs.select(F.col("key").alias(key), "first", "offset", "n")


def repeated_moments(runs: DataFrame, segments: DataFrame, key: str, rate: float, start: str, end: str, moment: str, match: str, hook: str) -> DataFrame:
    """``runs`` with the moments of the segments that some frame of a run and its copy lie in, where those are different moments of one match.

    ``segments`` are in seconds of the timeline, end excluded; a ``hook`` shows its moment on purpose and counts for nothing. A run
    counts from its RUN-th frame on. One row for each pair of moments.
    """
    each = runs.select("*", F.explode(F.sequence(F.col("first") + RUN - 1, F.col("first") + F.col("n") - 1)).alias("__i"))
    there = segments.where(~F.coalesce(F.col(hook), F.lit(False)) & F.col(match).isNotNull() & F.col(moment).isNotNull()).select(key, F.col(start).alias("__s"), F.col(end).alias("__e"), F.col(moment).alias("__m"), F.col(match).alias("__g"))
    one, two = (there.select(key, *[F.col(c).alias(f"{c}{k}") for c in ("__s", "__e", "__m", "__g")]) for k in "ab")
    t, u = F.col("__i") / rate, (F.col("__i") + F.col("offset")) / rate
    met = each.join(one, key).where((t >= F.col("__sa")) & (t < F.col("__ea"))).join(two, key).where((u >= F.col("__sb")) & (u < F.col("__eb")))
    return met.where("__ma <> __mb and __ga = __gb").select(*runs.columns, F.col("__ma").alias("moment"), F.col("__mb").alias("again")).distinct()
