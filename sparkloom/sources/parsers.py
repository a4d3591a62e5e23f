"""Parsing of file names, log lines, metadata tags, hand-typed metrics and addresses, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns of recorders' file names and of measurement dumps.
STAMPED = r"^(.+?) (\d{4}\.\d{2}\.\d{2}) - (\d{2}\.\d{2}\.\d{2})(?:\.(\d{2}))?"
FRAME = r"pts_time:([-0-9.]+)"
METRIC = r"lavfi\.([A-Za-z0-9_.]+)=([-+0-9.eE]+|nan|inf|-inf)"


def stamped_name(name: Column, zone: str) -> Column:
    """struct<game, at>: what a file name says; ``at`` is UTC. Null where the name has no stamp."""
    game = F.regexp_extract(name, STAMPED, 1)
    text = F.concat_ws(" ", F.regexp_extract(name, STAMPED, 2), F.regexp_extract(name, STAMPED, 3))
    at = F.to_utc_timestamp(F.try_to_timestamp(text, F.lit("yyyy.MM.dd HH.mm.ss")), zone)
    return F.when(name.rlike(STAMPED), F.struct(game.alias("game"), at.alias("at")))


def reference_time(tag: Column, named: Column, within_s: float = 120.0) -> Column:
    """The tag's time if it is within ``within_s`` of the name's, else the name's."""
    apart = F.abs(F.unix_micros(tag) - F.unix_micros(named))
    return F.when(apart <= int(within_s * 1_000_000), tag).otherwise(named)


def joined_tags(tags: Column, prefix: str) -> Column:
    """The values of the tags prefix1, prefix2, ... put together in the order of their numbers."""
    mine = F.filter(F.map_entries(tags), lambda e: e["key"].rlike(f"^{prefix}[0-9]+$"))
    ordered = F.array_sort(F.transform(mine, lambda e: F.struct(F.regexp_extract(e["key"], "([0-9]+)$", 1).cast("int").alias("n"), e["value"].alias("v"))))
    return F.array_join(F.transform(ordered, lambda e: e["v"]), "")


def hand_metrics(line: Column) -> Column:
    """array<double> of 4 or 7 typed fields; decimal commas, a dash for unknown; null for any other number of fields."""
    fields = F.split(F.trim(line), r"\s+")
    typed = F.transform(fields, lambda f: F.when(f == "-", F.lit(None)).otherwise(F.regexp_replace(f, ",", ".").try_cast("double")))
    return F.when(F.size(fields).isin(4, 7), typed)


def host_of(url: Column) -> Column:
    """The lower-cased host of an address, null if it has none."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))
    return F.when(host != "", host)


def video_id(url: Column, hosts: dict[str, str]) -> Column:
    """The id in an address: ``hosts`` maps each accepted host to a pattern whose first group is the id; else null."""
    out = F.lit(None).cast("string")
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    for name, pattern in hosts.items():
        found = F.regexp_extract(url, pattern, 1)
        out = F.when((host == name) & (found != ""), found).otherwise(out)
    return out


def frame_series(lines: DataFrame, file: str, number: str, text: str) -> DataFrame:
    """file, t, name, value: a per-frame dump as a series; a metric belongs to the frame line before it."""
    order = Window.partitionBy(file).orderBy(number)
    t = F.when(F.col(text).rlike(FRAME), F.regexp_extract(text, FRAME, 1).try_cast("double"))
    timed = lines.withColumn("__t", F.last(t, ignorenulls=True).over(order)).where(F.col(text).rlike(METRIC))
    return timed.select(file, F.col("__t").alias("t"), F.regexp_extract(text, METRIC, 1).alias("name"), F.regexp_extract(text, METRIC, 2).try_cast("double").alias("value"))


def intervals(lines: DataFrame, file: str, number: str, text: str, begin: str, end: str, duration: Column) -> DataFrame:
    """file, start, end: begin and end lines paired in order; one that stays open ends at ``duration``."""
    order = Window.partitionBy(file).orderBy(number)
    b, e = (F.regexp_extract(text, p, 1).try_cast("double") for p in (begin, end))
    kinds = lines.select(F.col(file), F.col(number), b.alias("__b"), e.alias("__e")).where("__b is not null or __e is not null")
    kinds = kinds.withColumn("__next", F.coalesce(F.lead("__e").over(order), duration))
    return kinds.where("__b is not null").select(file, F.col("__b").alias("start"), F.col("__next").alias("end"))


def platform_metrics(payload: Column, names: dict[str, str]) -> Column:
    """One nullable record from a platform's JSON: ``names`` maps a field to its path there; counters are whole and not negative."""
    fields = []
    for field, path in names.items():
        raw = F.get_json_object(payload, path)
        whole = F.when(raw.rlike(r"^[0-9]+$"), raw.try_cast("bigint"))
        fields.append(whole.alias(field))
    return F.struct(*fields)
