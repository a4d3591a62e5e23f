"""Thompson sampling: lines by number teach arms (flag and status), each order is a step that chooses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import draws as D
from .base import rounded, table


def _steps(spark, sf_dir):
    """line, step, knob, choice, tries, hits, last: every tenth customer's orders as steps, of the arms of one line number."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    each = lines.select("l_linenumber", "l_discount", "l_returnflag", "l_linestatus").unpivot(["l_linenumber", "l_discount"], ["l_returnflag", "l_linestatus"], "knob", "choice")
    arms = each.groupBy(F.col("l_linenumber").alias("line"), "knob", "choice").agg(F.round(F.count("*") / 200.0, 3).alias("tries"), F.round(F.sum((F.col("l_discount") > 0.05).cast("int")) / 200.0, 3).alias("hits"))
    k = F.col("o_orderkey")
    last = F.when(k % 3 == 0, F.array(F.lit("N"), F.lit("N"))).when(k % 3 == 1, F.array(F.lit("R"), F.lit("A"), F.lit("A"))).otherwise(F.array(F.lit("N")))
    steps = orders.select((k % 7 + 1).cast("int").alias("line"), k.alias("step"), last.alias("last"))
    return steps.join(arms, "line")


def thompson_draws(spark, sf_dir):
    found = D.drawn(_steps(spark, sf_dir), ["step", "knob"], "choice", F.col("hits"), F.col("tries"), "taste", (F.lit(0.5) + F.col("line") / 4, F.lit(2.0)))
    return found.select("step", "knob", "choice", rounded("draw", 7).alias("draw"), "place")


def thompson_choices(spark, sf_dir):
    found = D.drawn(_steps(spark, sf_dir), ["step", "knob"], "choice", F.col("hits"), F.col("tries"), "taste")
    return D.never_thrice(found, ["step", "knob"], "choice", "last").select("step", "knob", "choice", "place")


def daring_choices(spark, sf_dir):
    found = D.drawn(_steps(spark, sf_dir), ["step", "knob"], "choice", F.col("hits"), F.col("tries"), "taste")
    return D.daring(found, ["step"], "knob", "choice", "tries", "hits", "taste", 0.25, "l_returnflag", "last")


QUERIES = {f.__name__: f for f in (thompson_draws, thompson_choices, daring_choices)}

_U = "(CAST('0x' || substr(sha256({0}), {1}, 13) AS BIGINT) + 0.5) / 4503599627370496.0"


def _gamma(side: str) -> str:
    """SQL of the gamma draws of column ``side`` (a or b) of the CTE named."""
    u = [_U.format(f"name || '/{side}#' || k", 1 + 13 * j) for j in range(3)]
    return f"""tries_{side} AS (SELECT step, knob, choice, k, g - 1.0 / 3 AS d, sqrt(-2 * ln(u0)) * cos(2 * pi() * u1) AS x, u2 AS u FROM (
    SELECT step, knob, choice, k, CASE WHEN {side} < 1 THEN {side} + 1 ELSE {side} END AS g, {u[0]} AS u0, {u[1]} AS u1, {u[2]} AS u2 FROM named CROSS JOIN generate_series(0, {D.ATTEMPTS - 1}) t(k))),
vs_{side} AS (SELECT *, power(1 + x / sqrt(9 * d), 3) AS v FROM tries_{side}),
first_{side} AS (SELECT step, knob, choice, d * v AS g FROM (SELECT * FROM vs_{side} WHERE v > 0) WHERE ln(u) < x * x / 2 + d - d * v + d * ln(v) QUALIFY row_number() OVER (PARTITION BY step, knob, choice ORDER BY k) = 1),
gamma_{side} AS (SELECT step, knob, choice, CASE WHEN n.{side} < 1 THEN g * power({_U.format(f"name || '/{side}#small'", 1)}, 1 / n.{side}) ELSE g END AS g{side} FROM named n JOIN first_{side} USING (step, knob, choice))"""


def _drawn(a: str, b: str) -> str:
    return f"""each AS (SELECT l_linenumber AS line, l_discount, unnest([{{'knob': 'l_returnflag', 'choice': l_returnflag}}, {{'knob': 'l_linestatus', 'choice': l_linestatus}}], recursive := true) FROM lineitem),
arms AS (SELECT line, knob, choice, round(count(*) / 200.0, 3) AS tries, round(count(*) FILTER (l_discount > 0.05) / 200.0, 3) AS hits FROM each GROUP BY ALL),
steps AS (SELECT o_orderkey AS step, o_orderkey % 7 + 1 AS line, CASE o_orderkey % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'A' END AS twice FROM orders),
named AS (SELECT step, knob, choice, line, tries, hits, twice, {a} + hits AS a, {b} + tries - hits AS b, 'taste:' || step || ':' || knob || ':' || choice AS name FROM steps JOIN arms USING (line)),
{_gamma("a")},
{_gamma("b")},
drawn AS (SELECT n.*, ga / (ga + gb) AS draw, row_number() OVER (PARTITION BY step, knob ORDER BY ga / (ga + gb) DESC, choice DESC) AS place FROM named n JOIN gamma_a USING (step, knob, choice) JOIN gamma_b USING (step, knob, choice))"""


ORACLE = {
    "thompson_draws": f"WITH {_drawn('0.5 + line / 4', '2.0')} SELECT step, knob, choice, round(draw, 7) AS draw, CAST(place AS INTEGER) AS place FROM drawn",
    "thompson_choices": f"""WITH {_drawn('1.0', '1.0')}
SELECT step, knob, choice, CAST(place AS INTEGER) AS place FROM drawn QUALIFY row_number() OVER (PARTITION BY step, knob ORDER BY CASE WHEN coalesce(choice = twice, FALSE) THEN 1 ELSE 0 END, place) = 1""",
    "daring_choices": f"""WITH {_drawn('1.0', '1.0')},
dares AS (SELECT *, {_U.format("'taste:dare:' || step", 1)} < 0.25 AND knob = ['l_linestatus', 'l_returnflag'][CAST(floor({_U.format("'taste:knob:' || step", 1)} * 2) AS INTEGER) + 1] AND count(*) OVER (PARTITION BY step, knob) > 1 AS dared,
    row_number() OVER (PARTITION BY step, knob ORDER BY CASE WHEN place = 1 THEN 1 ELSE 0 END, tries, {_U.format("'taste:other:' || step || ':' || knob || ':' || choice", 1)}) AS t FROM drawn),
won AS (SELECT *, CASE WHEN dared THEN t = 1 ELSE place = 1 END AS w FROM dares),
third AS (SELECT *, bool_or(w AND knob = 'l_returnflag' AND coalesce(choice = twice, FALSE)) OVER (PARTITION BY step, knob) AND count(*) OVER (PARTITION BY step, knob) > 1 AS again,
    row_number() OVER (PARTITION BY step, knob ORDER BY CASE WHEN w THEN 1 ELSE 0 END, (hits + 1) / (tries + 2) DESC, choice) AS e FROM won)
SELECT step, knob, choice, dared AS experiment FROM third WHERE CASE WHEN again THEN e = 1 ELSE w END""",
}
