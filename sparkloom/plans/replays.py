"""Match and recorder documents, built as JSON from ``events`` (an hour there is a second here), parsed and attributed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribution as A
from ..sources import replays as R
from ..streaming.attribution import KNOCK_MS
from .base import table

_HOUR_MS = 3_600_000


def _begin():
    """Wall time at which a user's match begins: some in summer, some in winter."""
    return F.make_timestamp_ntz(F.lit(2024), F.pmod(F.col("user_id"), F.lit(12)).cast("int") + 1, F.lit(15), F.pmod(F.col("user_id"), F.lit(24)).cast("int"), F.lit(42), F.lit(22))


def _match_documents(spark, sf_dir):
    """user_id, json: a user's clicks (knocks), purchases and errors (finishes) as a match document."""
    e = table(spark, sf_dir, "events").where("event_type in ('click', 'purchase', 'error')")
    us = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    i = F.col("event_id")
    one = F.struct(
        "event_id", F.floor(us / _HOUR_MS).cast("long").alias("t_ms"), F.concat(F.lit("p"), (i % 4).cast("string")).alias("eliminator"),
        F.when(i % 11 > 0, F.concat(F.lit("P"), (F.floor(i / 4) % 5).cast("string"))).alias("eliminiert"), (F.col("event_type") == "click").alias("knock"),
        (i % 4 == F.floor(i / 4) % 5).alias("selbst"), F.when(i % 3 > 0, (i % 7).cast("int")).alias("waffe"), F.when(i % 5 > 0, i % 2 == 0).alias("eliminiert_bot"),
        F.when(i % 6 > 0, i % 2 == 1).alias("eliminator_bot"),
    )
    each = e.groupBy("user_id").agg(F.array_sort(F.collect_list(one)).alias("eliminierungen"))  # a user's events, a document as they come
    u = F.col("user_id")
    start = F.concat(F.date_format(_begin(), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".6170000"))
    body = F.struct(
        start.alias("replay_start"), F.when(u % 3 == 0, "Utc").otherwise("Unspecified").alias("replay_start_kind"), (u * 1000 + 500_000).alias("laenge_ms"),
        F.struct(F.when(u % 4 > 0, F.lit("main")).alias("branch"), (u + 58_000_000).alias("changelist")).alias("build"),
        F.when(u % 10 > 0, F.struct(F.lit("p1").alias("epic_id"), F.when(u % 2 == 0, F.lit("P1")).otherwise("p2").alias("player_id"), (u % 9).cast("int").alias("platzierung"))).alias("ich"),
        F.lit(7).alias("team_platzierung"), F.when(u % 7 > 0, F.lit(100)).alias("spieler_gesamt"), F.when(u % 5 > 0, F.lit(5)).alias("stats_eliminierungen"), "eliminierungen",
    )
    return each.select("user_id", F.when(u % 13 > 0, F.to_json(body)).otherwise("{broken").alias("json"))


def _found(spark, sf_dir):
    return R.matches(_match_documents(spark, sf_dir), "user_id", "json", "Europe/Berlin")


def owned_kills(spark, sf_dir):
    done = A.owned(R.eliminations(_found(spark, sf_dir), "user_id"), "user_id", KNOCK_MS)
    return done.select("user_id", "seq", "at_ms", "doer", "victim", "owner", "action_ms", F.col("owner_weapon").alias("weapon"))


def own_match_events(spark, sf_dir):
    found = _found(spark, sf_dir)
    own = A.own_events(R.eliminations(found, "user_id"), found, "user_id")
    return own.select("user_id", "seq", "kind", (F.col("at_ms") - F.coalesce("action_ms", "at_ms")).alias("after_ms"), "at_ms", "weapon", "victim_bot", "remaining", "doer_bot", F.col("self").alias("by_self"))


def match_reports(spark, sf_dir):
    found = _found(spark, sf_dir)
    own = A.own_events(R.eliminations(found, "user_id"), found, "user_id")
    told = R.match_problems(found, own, "user_id")
    return told.select("user_id", "start_us", "end_us", "build", "place", F.array_join("mine", ",").alias("mine"), "kills", F.array_join("problems", "; ").alias("problems"))


_EACH = f"""each AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // {_HOUR_MS} AS at_ms,
    'P' || event_id % 4 AS doer, CASE WHEN event_id % 11 > 0 THEN 'P' || event_id // 4 % 5 ELSE '' END AS victim, event_type = 'click' AS knock, event_id % 4 = event_id // 4 % 5 AS self,
    CASE WHEN event_id % 3 > 0 THEN CAST(event_id % 7 AS INTEGER) END AS weapon, CASE WHEN event_id % 5 > 0 THEN event_id % 2 = 0 END AS victim_bot, CASE WHEN event_id % 6 > 0 THEN event_id % 2 = 1 END AS doer_bot
  FROM events WHERE event_type IN ('click', 'purchase', 'error') AND user_id % 13 > 0),
finishes AS (SELECT f.*, (SELECT max((g.at_ms, g.seq)) FROM each g WHERE g.user_id = f.user_id AND g.victim = f.victim AND NOT g.knock AND (g.at_ms, g.seq) < (f.at_ms, f.seq)) AS before FROM each f WHERE NOT knock),
marked AS (SELECT f.*, (SELECT max((k.at_ms, k.seq, k.doer, coalesce(k.weapon, -1))) FROM each k WHERE k.user_id = f.user_id AND k.victim = f.victim AND k.knock AND (k.at_ms, k.seq) < (f.at_ms, f.seq)
    AND (f.before IS NULL OR (k.at_ms, k.seq) > f.before)) AS m FROM finishes f),
aged AS (SELECT * EXCLUDE (m), CASE WHEN at_ms - m[1] <= {KNOCK_MS} THEN m END AS m FROM marked),
owned AS (SELECT *, CASE WHEN victim <> '' AND (m IS NOT NULL OR NOT self) THEN coalesce(m[3], doer) END AS owner FROM aged),
done AS (SELECT * EXCLUDE (weapon), CASE WHEN owner IS NOT NULL THEN m[1] END AS action_ms, CASE WHEN owner IS NOT NULL AND m IS NOT NULL THEN nullif(m[4], -1) ELSE weapon END AS weapon FROM owned),
mine AS (SELECT user_id, CASE WHEN user_id % 10 = 0 THEN [] WHEN user_id % 2 = 0 THEN ['P1'] ELSE ['P1', 'P2'] END AS ids FROM (SELECT DISTINCT user_id FROM each))"""

_OWN = f"""{_EACH},
left_over AS (SELECT e.user_id, e.seq, CASE WHEN user_id % 7 > 0 THEN CAST(greatest(0, 100 - (SELECT count(*) FROM each g WHERE g.user_id = e.user_id AND NOT g.knock AND g.at_ms <= e.at_ms)) AS INTEGER) END AS remaining FROM each e),
own AS (
  SELECT user_id, seq, CASE WHEN knock THEN 'knock_suffered' ELSE 'death' END AS kind, 0 AS after_ms, at_ms, weapon, victim_bot, doer_bot, self AS by_self FROM each JOIN mine USING (user_id) WHERE list_contains(ids, victim)
  UNION ALL SELECT user_id, seq, 'knock', 0, at_ms, weapon, victim_bot, NULL, NULL FROM each JOIN mine USING (user_id) WHERE knock AND list_contains(ids, doer) AND NOT list_contains(ids, victim)
  UNION ALL SELECT user_id, seq, 'kill', CASE WHEN action_ms IS NOT NULL AND list_contains(ids, doer) THEN at_ms - action_ms ELSE 0 END,
    CASE WHEN list_contains(ids, doer) OR action_ms IS NULL THEN at_ms ELSE action_ms END, weapon, victim_bot, NULL, NULL
  FROM done JOIN mine USING (user_id) WHERE list_contains(ids, owner) AND NOT list_contains(ids, victim))"""

_WALL = "make_timestamp(2024, user_id % 12 + 1, 15, user_id % 24, 42, 22.617)"


def _recorder_files(spark, sf_dir):
    """order_id, json, named_us, length_s: an order as a recorder's file, its lines as marks."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")  # noqa: E741
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    kind = F.when(n == 1, "kill").when(n == 2, "Award").when(n == 3, "died").when(n == 4, "award")
    name = F.when(n == 2, F.concat(F.element_at(F.array(*[F.lit(x) for x in ("Double", "Triple", "Quad", "Other")]), (k % 4 + 1).cast("int")), F.lit(" Kill"))).when(n == 4, "Victory Royale").when(n == 5, "Eliminated").otherwise("Quest complete")
    at = F.when(n == 6, F.lit("soon")).when(k % 9 > 0, (F.col("l_quantity") / 4).cast("string"))
    one = F.struct("l_linenumber", kind.alias("type"), name.alias("unlocalized_display_name"), at.alias("clip_timestamp"))
    lines = l.groupBy(k.alias("order_id")).agg(F.array_sort(F.collect_list(one)).alias("gamesense_events"))  # an order's lines
    stamp = F.concat(F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "yyyy-MM-dd"), F.lit("T12:00:00"))
    i = F.col("o_orderkey")
    said = F.when(i % 4 == 0, F.concat(stamp, F.lit("Z"))).when(i % 4 == 1, stamp).when(i % 4 == 2, F.lit("unknown"))
    body = F.struct(said.alias("recording_timestamp"), F.when(i % 3 > 0, F.round(F.col("o_totalprice") / 1000, 1)).alias("full_length"), "gamesense_events")
    named = F.unix_micros(F.col("o_orderdate").cast("timestamp_ntz").cast("timestamp")) + 60_000_000
    return o.join(lines, i == F.col("order_id")).select("order_id", F.when(i % 8 < 7, F.to_json(body)).alias("json"), named.alias("named_us"), F.lit(20.5).alias("measured_s"))


def recordings(spark, sf_dir):
    found = R.recordings(_recorder_files(spark, sf_dir), "json", "named_us", "measured_s", "Europe/Berlin", 1.5)
    return found.select("order_id", "start_us", "end_us", F.round("length_s", 3).alias("length_s"), F.size(F.coalesce("marks", F.array().cast("array<variant>"))).alias("n_marks"))


def recorder_marks(spark, sf_dir):
    found = R.recordings(_recorder_files(spark, sf_dir), "json", "named_us", "measured_s", "Europe/Berlin", 1.5)
    return R.marks(found, "order_id")


_FILES = """lines AS (SELECT l_orderkey AS order_id, l_linenumber AS n, l_quantity FROM lineitem),
files AS (SELECT o_orderkey AS order_id, o_totalprice, o_orderkey % 8 < 7 AS has, epoch_us(o_orderdate) + 60000000 AS named, date_trunc('day', o_orderdate) + INTERVAL 12 HOUR AS noon FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
found AS (SELECT order_id, has, CASE WHEN has AND order_id % 4 = 0 THEN epoch_us(noon) WHEN has AND order_id % 4 = 1 THEN epoch_us(timezone('Europe/Berlin', noon)) ELSE named END + 1500000 AS end_us,
    CASE WHEN has AND order_id % 3 > 0 AND round(o_totalprice / 1000, 1) <> 0 THEN round(o_totalprice / 1000, 1) ELSE 20.5 END AS length_s FROM files),
recorded AS (SELECT order_id, has, end_us - CAST(round(length_s * 1e6) AS BIGINT) AS start_us, end_us, round(length_s, 3) AS length_s FROM found)"""

QUERIES = {f.__name__: f for f in (owned_kills, own_match_events, match_reports, recordings, recorder_marks)}

ORACLE = {
    "owned_kills": f"WITH {_EACH} SELECT user_id, CAST(seq AS INTEGER) AS seq, at_ms, doer, victim, owner, action_ms, weapon FROM done",
    "own_match_events": f"WITH {_OWN} SELECT user_id, CAST(o.seq AS INTEGER) AS seq, kind, CAST(after_ms AS BIGINT) AS after_ms, at_ms, weapon, victim_bot, remaining, doer_bot, by_self FROM own o JOIN left_over r USING (user_id, seq)",
    "match_reports": f"""WITH {_OWN},
counts AS (SELECT user_id, count(*) FILTER (kind = 'kill') AS kills FROM own GROUP BY user_id),
times AS (SELECT user_id, ids, epoch_us(CASE WHEN user_id % 3 = 0 THEN timezone('UTC', {_WALL}) ELSE timezone('Europe/Berlin', {_WALL}) END) AS start_us FROM mine),
told AS (SELECT *, coalesce(kills, 0) AS k FROM times LEFT JOIN counts USING (user_id))
SELECT user_id, start_us, start_us + (user_id * 1000 + 500000) * 1000 AS end_us, CASE WHEN user_id % 4 > 0 THEN 'main' ELSE '?' END || ' CL' || (user_id + 58000000) AS build,
  CAST(CASE WHEN user_id % 10 > 0 AND user_id % 9 > 0 THEN user_id % 9 ELSE 7 END AS INTEGER) AS place, array_to_string(ids, ',') AS mine, k AS kills,
  CASE WHEN len(ids) = 0 THEN 'own player not found' WHEN user_id % 5 > 0 AND k <> 5 THEN 'counted 5, found ' || k ELSE '' END AS problems FROM told""",
    "recordings": f"WITH {_FILES} SELECT order_id, start_us, end_us, length_s, CAST(CASE WHEN has THEN (SELECT count(*) FROM lines l WHERE l.order_id = r.order_id) ELSE 0 END AS INTEGER) AS n_marks FROM recorded r",
    "recorder_marks": f"""WITH {_FILES}
SELECT order_id, start_us + CAST(round(CASE WHEN order_id % 9 > 0 THEN l_quantity / 4 ELSE 0 END * 1e6) AS BIGINT) AS at_us,
  CASE WHEN n <= 2 THEN 'kill' WHEN n = 4 THEN 'win' ELSE 'death' END AS kind, CAST(CASE WHEN n = 2 THEN order_id % 4 + 2 ELSE 1 END AS INTEGER) AS n
FROM recorded JOIN lines USING (order_id) WHERE has AND n <= 5 AND NOT (n = 2 AND order_id % 4 = 3)""",
}
