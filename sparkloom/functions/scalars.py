"""Column functions: scoring terms, buckets, memberships, times, maps and texts. None leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points of a series by its length; longer ones take the last.
POINTS = (0.0, 1.0, 3.0, 6.0, 10.0)


def points(n: Column, table: tuple[float, ...] = POINTS) -> Column:
    """The table's value at n; the last one from there on."""
    return F.element_at(F.array(*[F.lit(p) for p in table]), (F.least(n, F.lit(len(table) - 1)) + 1).cast("int"))


def feature_sum(features: Column, weights: dict[str, float]) -> Column:
    """Weighted sum over a map in the order of ``weights``; a missing feature counts 0."""
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + F.coalesce(features[name], F.lit(0.0)) * w
    return out


def feature_difference(a: Column, b: Column) -> Column:
    """a - b over the keys that both maps have; keys of one side only are unknown, not 0."""
    both = F.map_zip_with(a, b, lambda k, x, y: x - y)
    return F.map_filter(both, lambda k, v: v.isNotNull())


def merged_maps(left: Column, right: Column, cap: float | None = None) -> Column:
    """Both maps' keys; the right side wins; values no larger than ``cap``."""
    both = F.map_zip_with(left, right, lambda k, x, y: F.coalesce(y, x))
    return both if cap is None else F.transform_values(both, lambda k, v: F.least(v, F.lit(cap)))


def numbers_only(json: Column) -> Column:
    """A JSON object's finite numbers as map<string,double>; truth values, texts, lists, objects and nulls go.

    Null for what is no JSON object, and for one that names a key twice.
    """
    each = F.try_variant_get(F.try_parse_json(json), "$", "map<string,variant>")
    number = lambda v: F.when(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double"))
    return F.map_filter(F.transform_values(each, lambda k, v: number(v)), lambda k, x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def ramp_up(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNull(), None).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low))))


def ramp_down(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNull(), None).otherwise(1.0 - ramp_up(x, low, high))


def trapezoid(x: Column, a: float, b: float, c: float | None = None, d: float | None = None) -> Column:
    """0 up to a, rising to 1 at b, 1 up to c, falling to 0 at d; without c and d it stays 1."""
    rising = F.when(x <= a, 0.0).when(x < b, (x - a) / (b - a))
    if c is None:
        return F.when(x.isNull(), None).otherwise(F.coalesce(rising, F.lit(1.0)))
    return F.when(x.isNull(), None).otherwise(F.coalesce(rising, F.when(x <= c, 1.0).when(x < d, (d - x) / (d - c)), F.lit(0.0)))


def logistic(x: Column) -> Column:
    """1 / (1 + exp(-x)) without overflow."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def length_penalty(length_s: Column, free_s: float, weight: float) -> Column:
    """Points off for every 10 seconds over the free length."""
    return F.greatest(F.lit(0.0), (length_s - free_s) / 10.0) * weight


def length_level(length_s: Column) -> Column:
    """Upper bounds belong to their level."""
    # Upper bounds of length levels in seconds.
    return F.when(length_s <= 22.5, "short").when(length_s <= 36, "middle").otherwise("long")


def length_band(length_s: Column) -> Column:
    """Under 45 s, up to and with 60 s, over."""
    return F.when(length_s < 45, "under 45").when(length_s <= 60, "45 to 60").otherwise("over 60")


def age_days(begin: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(begin.cast("timestamp"))) / 86_400_000_000.0


def decay(age: Column, half_life: float, floor: float = 0.25) -> Column:
    """floor + (1 - floor) * 2^(-age / half_life)."""
    return floor + (1.0 - floor) * F.pow(F.lit(2.0), -age / half_life)


_EPOCH = "1970-01-01 00:00:00"


def utc_time(at: Column) -> Column:
    """The UTC wall time (timestamp_ntz) of an instant, whatever the session's zone. A time without zone is UTC as it stands."""
    passed = F.timestamp_add("MICROSECOND", F.unix_micros(at.cast("timestamp")), F.lit(_EPOCH).cast("timestamp_ntz"))
    return F.when(F.typeof(at) == "timestamp_ntz", at.cast("timestamp_ntz")).otherwise(passed)


def local_time(at: Column, zone: str) -> Column:
    """The wall time (timestamp_ntz) in ``zone``."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc_time(at))


def instant(local: Column, zone: str) -> Column:
    """The instant (timestamp) of a wall time in ``zone``, whatever the session's zone."""
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), utc))


def in_day_window(at: Column, zone: str, begin: str, end: str) -> Column:
    """Whether the local time of day is in [begin, end), also across midnight; equal or empty bounds never match."""
    if not begin or not end or begin == end:
        return F.lit(False)
    first, last = (int(x[:2]) * 60 + int(x[3:5]) for x in (begin, end))
    local = local_time(at, zone)
    minute = F.hour(local) * 60 + F.minute(local)
    return (minute >= first) & (minute < last) if first < last else (minute >= first) | (minute < last)


def hard_rejected(status: Column, source: Column) -> Column:
    """Rejected by a person: a null source counts as one, ``auto`` doesn't."""
    return F.coalesce(status == "rejected", F.lit(False)) & ~source.eqNullSafe(F.lit("auto"))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, null if none does; unknown counts as not holding."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        out = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out


def measured(x: Column) -> Column:
    """A finite number that isn't negative, or null."""
    return F.when((x >= 0) & (x < float("inf")), x)  # NaN counts as larger than infinity


def composite_key(kind: Column, item: Column) -> Column:
    """kind:item; without either there is no key."""
    return F.concat(kind, F.lit(":"), item.cast("string"))


def canonical_hash(**columns: Column) -> Column:
    """SHA-256 of the columns as JSON with sorted names; nulls stay in it."""
    body = F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})
    return F.sha2(body, 256)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def word_hits(text: Column, pattern: str) -> Column:
    """How many matches of a pattern a text has, letter case aside; null: 0."""
    return F.coalesce(F.regexp_count(F.lower(text), F.lit(pattern)), F.lit(0))


def elo_expected(a: Column, b: Column) -> Column:
    return 1.0 / (1.0 + F.pow(F.lit(10.0), (b - a) / 400.0))


def implausible(now: dict[str, Column], before: dict[str, Column], watch_s: Column, length_s: Column, full_pct: Column) -> Column:
    """Names of what can't be: counters that fell, watch time over 1.5 times the length, more than 100 % watched."""
    rules = [(name, now[name] < before[name]) for name in now] + [("watch", watch_s > 1.5 * length_s), ("full", full_pct > 100)]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]))
