"""Audience scores against a plain computation, and scores that stay."""

import datetime as dt
import math
import random
import re
import statistics

from pyspark.sql import functions as F

from sparkloom.operators import audience as A

POSTS = "post int, platform string, account int, target int, posted timestamp, sampled timestamp, seconds double, views double, impressions double, retention_pct double, watch_s double, full_pct double, likes double, shares double, saves double"
NUMBERS = ("views", "impressions", "retention_pct", "watch_s", "full_pct", "likes", "shares", "saves")
T0 = dt.datetime(2026, 1, 1)


def posts(n, seed):
    r = random.Random(seed)
    maybe = lambda x, p=0.75: x if r.random() < p else None
    rows = []
    for i in range(n):
        at = T0 + dt.timedelta(hours=6 * r.randrange(n))  # some at the same time
        rows.append((i, r.choice("ab"), r.choice([1, 1, None]), r.randrange(n // 3), maybe(at, 0.97), maybe(at + dt.timedelta(days=r.randrange(1, 9)), 0.9), maybe(float(r.choice([20, 24, 40])), 0.9), maybe(float(r.choice([0, 50, 900, 4000])), 0.9), maybe(3000.0, 0.4), maybe(r.random() * 130, 0.5), maybe(r.random() * 20), maybe(r.random() * 110), maybe(float(r.randrange(80))), maybe(r.choice([-1.0, 2.0, 9.0, float("nan")])), maybe(3.0)))
    return rows


def number(x):
    return x if x is not None and math.isfinite(x) and x >= 0 else None


def parts(p):
    v = {k: number(p[k]) for k in NUMBERS}
    age = max(0.0, (p["sampled"] - p["posted"]).total_seconds() / 86400) if p["sampled"] and p["posted"] else None
    out = dict.fromkeys(A.COMPONENTS)
    if v["retention_pct"] is not None:
        out["retention"] = min(1.5, v["retention_pct"] / 100)
    elif v["watch_s"] is not None and p["seconds"]:
        out["retention"] = min(1.5, v["watch_s"] / p["seconds"])
    if v["full_pct"] is not None:
        out["completion"] = min(1.0, v["full_pct"] / 100)
    if v["views"]:
        for k in ("likes", "shares", "saves"):
            if v[k] is not None:
                out[k] = (min(v[k] / v["views"], 2) * v["views"] + 100 * A.COMPONENTS[k][1]) / (v["views"] + 100)
        if v["impressions"]:
            out["reach"] = math.log1p(1000 * min(2, v["views"] / v["impressions"]))
        elif age is not None:
            out["reach"] = math.log1p(v["views"] / math.sqrt(max(0.5, age)))
    return out, age, bool(v["impressions"])


def plain(p, others, most):
    mine, age, shown = parts(p)
    same = [q for q in others if q["posted"] and p["posted"] and q["posted"] < p["posted"] and (q["platform"], q["account"]) == (p["platform"], p["account"])]
    same = sorted(same, key=lambda q: (q["posted"], q["post"]))[-most:]
    same = [(q, *parts(q)) for q in same if q["target"] != p["target"]]
    near = [x for x in same if p["seconds"] and x[0]["seconds"] and 0.75 <= x[0]["seconds"] / p["seconds"] <= 1.33 and age is not None and x[2] is not None and 0.5 <= max(0.1, x[2]) / max(0.1, age) <= 2]
    same = near if len(near) >= 3 else same
    z = {}
    for name, x in mine.items():
        if x is not None:
            weight, start, least = A.COMPONENTS[name]
            values = [o[1][name] for o in same if o[1][name] is not None and (name != "reach" or o[3] == shown)]
            m = statistics.median(values) if values else start
            share = len(values) / (len(values) + 8)
            mad = statistics.median(abs(y - m) for y in values) if values else 0.0
            z[name] = math.tanh((x - (1 - share) * start - share * m) / max(least, 1.4826 * mad))
    quality = sum(A.COMPONENTS[k][0] for k in z if k != "reach")
    if not quality or number(p["views"]) == 0:
        return None, 0.0, len(same)
    reach = min(0.08, 0.05 / (quality + 0.05)) if "reach" in z else 0.0
    score = (1 - reach) * sum(A.COMPONENTS[k][0] * v for k, v in z.items() if k != "reach") / quality + reach * z.get("reach", 0)
    views = number(p["views"])
    sure = (quality + (0.05 if "reach" in z else 0)) * (math.sqrt(views / (views + 200)) if views is not None else 0.25) * (0.3 + 0.7 * (1 - math.exp(-age / 1.5)) if age is not None else 0.5)
    return score, min(0.98, sure), len(same)


def described(spark, rows):
    df = spark.createDataFrame(rows, POSTS).withColumns({c: F.lit("own") for c in ("cohort", "near", "mine")}).repartition(3)
    return A.described(df, "posted", "sampled", "seconds", {k: F.col(k) for k in NUMBERS})


def test_scores_equal_the_plain_ones(spark):
    rows = posts(160, 5)
    names = [c.split()[0] for c in POSTS.split(", ")]
    plainly = [dict(zip(names, r, strict=True)) for r in rows]
    got = {r["post"]: r for r in A.audience_scores(described(spark, rows), "post", ["platform", "account"], "target", "posted", 25).collect()}
    assert len(got) == len(rows)
    for p in plainly:
        score, sure, n = plain(p, plainly, 25)
        r = got[p["post"]]
        assert r["compared"] == n and abs(r["confidence"] - sure) < 1e-9 and (r["score"] is None) == (score is None)
        assert score is None or abs(r["score"] - score) < 3e-6
    assert max(r["compared"] for r in got.values()) > 15


def test_frozen_scores_stay_and_are_what_later_posts_are_compared_with(spark, tmp_path):
    rows = sorted((r for r in posts(60, 6) if r[4]), key=lambda r: r[4])
    path, where = f"{tmp_path}/scores", ("post", ["platform", "account"], "target", "posted")
    first = described(spark, rows[:40])
    n = A.freeze_scores(spark, first, path, *where)
    frozen = {r["post"]: r for r in spark.read.parquet(path).collect()}
    assert n == len(frozen) > 20
    want = {r["post"]: r["score"] for r in A.audience_scores(first, "post", ["platform", "account"], "target", "posted").collect()}
    assert all(frozen[k]["score"] == want[k] for k in frozen) and set(frozen) == {k for k, s in want.items() if s is not None}
    assert A.freeze_scores(spark, first, path, *where) == 0  # a second run adds nothing
    changed = [(*r[:7], 4000.0, *r[8:]) for r in rows]  # all samples have changed since
    A.freeze_scores(spark, described(spark, changed), path, *where)
    now = {r["post"]: r for r in spark.read.parquet(path).collect()}
    assert all(now[k] == frozen[k] for k in frozen) and len(now) > len(frozen)
    mixed = described(spark, [r for r in rows if r[0] in frozen] + [r for r in changed if r[0] not in frozen])
    mixed = mixed.where(F.col("post").isin(*frozen) | ~F.col("post").isin(*frozen))
    alone = {r["post"]: r["score"] for r in A.audience_scores(mixed, "post", ["platform", "account"], "target", "posted").collect()}
    assert all(now[k]["score"] == alone[k] for k in now if k not in frozen)


def test_no_rows(spark):
    assert A.audience_scores(described(spark, []), "post", ["platform", "account"], "target", "posted").count() == 0


def test_posts_of_one_time_and_of_other_batches(spark):
    rows = [(*r[:1], "a", 1, *r[3:4], r[4] and T0 + dt.timedelta(days=r[0] * 7 % 6), *r[5:]) for r in posts(90, 9)]  # more of one time than are compared, and than a batch has
    names = [c.split()[0] for c in POSTS.split(", ")]
    plainly = [dict(zip(names, r, strict=True)) for r in rows]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (1, 7):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = {r["post"]: r for r in A.audience_scores(described(spark, rows), "post", ["platform", "account"], "target", "posted", 5).collect()}
            for p in plainly:
                score, sure, n = plain(p, plainly, 5)
                r = got[p["post"]]
                assert r["compared"] == n and abs(r["confidence"] - sure) < 1e-9 and (r["score"] is None) == (score is None)
                assert score is None or abs(r["score"] - score) < 3e-6
            assert {r["compared"] for r in got.values()} >= {0, 3, 4, 5}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_unknown_and_unusual_numbers_keep_their_places(spark):
    """Null is no value, NaN the largest one; targets are compared as they are, unknown ones differ from all."""
    parts = "struct<" + ", ".join(f"{name}: double" for name in A.COMPONENTS) + ">"
    of = lambda x: (x, *[None] * (len(A.COMPONENTS) - 1))
    values = [0.1, None, float("nan"), 0.3, 0.2, 0.9, 0.5]
    rows = [(i, "a", None if i == 3 else 0.0 if i < 5 else -0.0 if i == 5 else 1.0, T0 + dt.timedelta(days=i), of(x), None, None, None, None) for i, x in enumerate(values)]
    df = spark.createDataFrame(rows, f"post int, key string, target double, at timestamp, parts {parts}, views double, age double, length_s double, shown boolean")
    got = {r["post"]: r for r in A.audience_scores(df, "post", ["key"], "target", "at", 60).collect()}
    assert [got[i]["compared"] for i in range(7)] == [0, 0, 0, 3, 1, 1, 6]
    share, start = 5 / 13, A.COMPONENTS["retention"][1]
    want = math.tanh((0.5 - (1 - share) * start - share * 0.3) / max(0.25, 1.4826 * 0.2))  # 0.1, 0.2, 0.3, 0.9, NaN: distances 0, 0.1, 0.2, 0.6, NaN
    assert abs(got[6]["standing"]["retention"] - want) < 1e-6 and got[1]["score"] is None


def test_no_step_is_too_long_for_the_jvm_to_compile(spark):
    from sparkloom.plans.audience import audience_scores

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = audience_scores(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
        text = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenString(plan)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert len(sizes) > 4 and max(sizes) < 8000
