"""Match and recorder documents in JSON, one a row, as tables: matches and their events, recordings and their marks.

Documents are parsed into variants, so a field of the wrong kind is unknown and doesn't spoil its document. All times
are microseconds since the epoch, or milliseconds since the match began.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import instant

# Names in a match document and in its eliminations.
START, START_KIND, UTC_KIND, LENGTH = "replay_start", "replay_start_kind", "Utc", "laenge_ms"
BRANCH, CHANGE, COUNTED, PLAYERS, TEAM_PLACE = "build.branch", "build.changelist", "stats_eliminierungen", "spieler_gesamt", "team_platzierung"
OWN_IDS, OWN_PLACE, EVENTS = ("ich.epic_id", "ich.player_id"), "ich.platzierung", "eliminierungen"
EVENT_FIELDS = {
    "at_ms": ("t_ms", "bigint"), "doer": ("eliminator", "string"), "victim": ("eliminiert", "string"), "knock": ("knock", "boolean"), "self": ("selbst", "boolean"),
    "weapon": ("waffe", "int"), "victim_bot": ("eliminiert_bot", "boolean"), "doer_bot": ("eliminator_bot", "boolean"),
}
# Names in a recorder's document, and what its marks mean; several kills are marked by a word in the name.
RECORDED, FULL_LENGTH, MARKS = "recording_timestamp", "full_length", "gamesense_events"
MARK_KIND, MARK_NAME, MARK_AT = "type", "unlocalized_display_name", "clip_timestamp"
MANY_KILLS = {"DOUBLE": 2, "TRIPLE": 3, "QUAD": 4, "PENTA": 5, "HEXA": 6}
KILL_KIND, WIN_WORD, DEATH_KINDS, DEATH_NAMES = "KILL", "VICTORY", ("DEATH", "DIED"), ("ELIMINATED", "DEATH")
# What an event in a file's name means, and how many.
NAMED_EVENTS = {
    "eliminierung": ("kill", 1), "doppeleliminierung": ("kill", 2), "dreifacheliminierung": ("kill", 3), "dreifacheliminerung": ("kill", 3),
    "mehrfacheliminierung": ("kill", 4), "am boden": ("knock", 1), "eliminiert": ("death", 1), "sieg": ("win", 1),
}
#: Seconds that a recorder goes on after the event that it was set off by.
AFTER_EVENT_S = 4.0


def _get(document: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(document, f"$.{path}", kind)


def _once(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``rows`` with a column that is computed once for each row, however often and wherever it is used.

    Expressions of a projection are put in the place of its columns, in filters too, and are computed again there; what an
    explode gives isn't.
    """
    return rows.select("*", F.explode(F.array(value)).alias(name))


def stamp_us(text: Column, utc: Column, zone: str) -> Column:
    """Microseconds of an ISO time: its own zone's if it names one, else UTC where ``utc`` holds, else ``zone``'s wall time."""
    own = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    wall = F.when(~own, text.try_cast("timestamp_ntz"))
    there = F.when(utc, F.convert_timezone(F.lit("UTC"), F.lit("UTC"), wall)).otherwise(wall)
    local = F.unix_micros(instant(there, zone))
    plain = F.unix_micros(instant(there, "UTC"))
    return F.when(own, F.unix_micros(text.try_cast("timestamp"))).otherwise(F.when(utc, plain).otherwise(local))


def matches(documents: DataFrame, key: str, json: str, zone: str, local_start: bool = True) -> DataFrame:
    """key, start_us, end_us, build, place, counted, players, mine, eliminations for each document that has a start.

    A start without a zone of its own is ``zone``'s wall time, unless the document says UTC or ``local_start`` is off.
    ``mine`` are the upper-case ids of the document's own player, in order; ``eliminations`` a variant array or null.
    What isn't JSON, or has no start, is no match.
    """
    d = F.col("__d")
    parsed = _once(documents.select(key, json), F.try_parse_json(F.col(json)), "__d")
    utc = F.coalesce(_get(d, START_KIND, "string") == UTC_KIND, F.lit(False)) | F.lit(not local_start)
    ids = F.array_distinct(F.array_compact(F.array(*[F.nullif(F.upper(_get(d, p, "string")), F.lit("")) for p in OWN_IDS])))
    build = F.concat(F.coalesce(F.nullif(_get(d, BRANCH, "string"), F.lit("")), F.lit("?")), F.lit(" CL"), F.coalesce(_get(d, CHANGE, "string"), F.lit("?")))
    own = _get(d, OWN_PLACE, "int")
    found = parsed.select(
        key, stamp_us(_get(d, START, "string"), utc, zone).alias("start_us"), F.coalesce(_get(d, LENGTH, "bigint"), F.lit(0)).alias("__ms"), build.alias("build"),
        F.coalesce(F.nullif(own, F.lit(0)), _get(d, TEAM_PLACE, "int")).alias("place"), _get(d, COUNTED, "int").alias("counted"), _get(d, PLAYERS, "int").alias("players"),
        ids.alias("mine"), _get(d, EVENTS, "array<variant>").alias("eliminations"),
    )
    end = F.col("start_us") + F.col("__ms") * 1000
    return found.where("start_us is not null").select(key, "start_us", end.alias("end_us"), "build", "place", "counted", "players", "mine", "eliminations")


def eliminations(found: DataFrame, key: str) -> DataFrame:
    """key, seq and the fields of each elimination of ``matches()`` that has a time; names are upper-case, unknown ones empty."""
    # Read while they are exploded, so that each field is read once: _once().
    read = lambda e: F.struct(*[_get(e, path, kind).alias(name) for name, (path, kind) in EVENT_FIELDS.items()])
    each = found.select(key, F.posexplode(F.transform("eliminations", read)).alias("seq", "__e"))
    values = {name: F.col(f"__e.{name}") for name in EVENT_FIELDS}
    values |= {name: F.upper(F.coalesce(values[name], F.lit(""))) for name in ("doer", "victim")}
    values["knock"] = F.coalesce(values["knock"], F.lit(False))
    return each.select(key, "seq", *[v.alias(name) for name, v in values.items()]).where("at_ms is not null")


def match_problems(found: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """``matches()`` with kills, the number of the own player's among ``events(key, kind)``, and problems: what doesn't fit, as texts."""
    kills = events.where("kind = 'kill'").groupBy(key).agg(F.count("*").alias("kills"))
    both = found.join(kills, key, "left").withColumn("kills", F.coalesce("kills", F.lit(0)))
    known = F.size("mine") > 0
    unknown = F.when(~known, F.lit("own player not found"))
    differs = F.when(known & (F.col("counted") != F.col("kills")), F.concat(F.lit("counted "), F.col("counted").cast("string"), F.lit(", found "), F.col("kills").cast("string")))
    return both.withColumn("problems", F.array_compact(F.array(unknown, differs)))


def recordings(files: DataFrame, json: str, named_us: str, length_s: str, zone: str, shift_s: float = 0.0) -> DataFrame:
    """``files`` with start_us, end_us, length_s and marks, by the recorder's document where it says so.

    It ends at the time that the document names, else that of the file's name (``named_us``), ``shift_s`` later; its
    length is the document's, else the measured one. No document, or none that can be parsed, has no marks.
    """
    d = F.col("__d")
    fields = F.struct(_get(d, RECORDED, "string").alias("said"), F.nullif(_get(d, FULL_LENGTH, "double"), F.lit(0.0)).alias("length"), _get(d, MARKS, "array<variant>").alias("marks"))
    read = _once(_once(files, F.try_parse_json(F.col(json)), "__d"), fields, "__r")
    end = F.coalesce(stamp_us(F.col("__r.said"), F.lit(False), zone), F.col(named_us)) + round(shift_s * 1e6)
    out = read.withColumns({"__end": end, "__length": F.coalesce("__r.length", F.col(length_s)), "__marks": F.col("__r.marks")})
    start = F.col("__end") - F.round(F.col("__length") * 1e6).cast("long")
    keep = [c for c in files.columns if c not in ("start_us", "end_us", "length_s", "marks")]
    return out.select(*[F.col(f"`{c}`") for c in keep], start.alias("start_us"), F.col("__end").alias("end_us"), F.col("__length").alias("length_s"), F.col("__marks").alias("marks"))


def marks(found: DataFrame, key: str) -> DataFrame:
    """key, at_us, kind (kill, win, death), n for the marks of ``recordings()``; marks of anything else, or without a proper time, go.

    A mark for several kills stands for the one that completes them; n is how many. The kind of a mark goes before its name.
    """

    def read(m: Column) -> Column:
        kind, name = (F.upper(F.coalesce(_get(m, p, "string"), F.lit(""))) for p in (MARK_KIND, MARK_NAME))
        at = F.coalesce(_get(m, MARK_AT, "double"), F.when(_get(m, MARK_AT, "variant").isNull(), 0.0))
        return F.struct(kind.alias("kind"), name.alias("name"), at.alias("at"))

    # Read while they are exploded, so that each field is read once: _once().
    each = found.select(key, "start_us", F.explode(F.transform("marks", read)).alias("__m"))
    kind, name, at = (F.col(f"__m.{c}") for c in ("kind", "name", "at"))
    n = F.lit(None).cast("int")
    for word, many in reversed(MANY_KILLS.items()):
        n = F.when(name.contains(word), many).otherwise(n)
    n = F.when(kind == KILL_KIND, 1).otherwise(n)
    what = F.when(n.isNotNull(), "kill").when(name.contains(WIN_WORD), "win").when(kind.isin(*DEATH_KINDS) | name.isin(*DEATH_NAMES), "death")
    times = each.select(key, (F.col("start_us") + F.round(at * 1e6).cast("long")).alias("at_us"), what.alias("kind"), F.coalesce(n, F.lit(1)).alias("n"))
    return times.where("kind is not null and at_us is not null")


def named_recordings(files: DataFrame, named_us: str, length_s: str, is_end: str, shift_s: float = 0.0) -> DataFrame:
    """``files`` with start_us and end_us, where the time in the file's name is the recording's end (``is_end``) or its start."""
    at, length = F.col(named_us) + round(shift_s * 1e6), F.round(F.col(length_s) * 1e6).cast("long")
    end = F.col(is_end)
    return files.withColumns({"start_us": F.when(end, at - length).otherwise(at), "end_us": F.when(end, at).otherwise(at + length)})


def named_marks(found: DataFrame, key: str, event: str, length_s: str) -> DataFrame:
    """key, at_us, kind, n: the event that the file's name tells of, AFTER_EVENT_S before the recording's end; other names tell none."""
    name = F.lower(F.trim(F.col(event)))
    kind, n = F.lit(None).cast("string"), F.lit(None).cast("int")
    for word, (what, many) in NAMED_EVENTS.items():
        kind, n = F.when(name == word, what).otherwise(kind), F.when(name == word, many).otherwise(n)
    back = F.when(F.col(length_s) > 0, round(AFTER_EVENT_S * 1e6)).otherwise(0)
    return found.select(key, (F.col("end_us") - back).alias("at_us"), kind.alias("kind"), n.alias("n")).where("kind is not null")
