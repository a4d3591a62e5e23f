"""LM scoring against plain counts: vocabulary, pairs, matched models that sum to 1, and what a document gave left out."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import lm_score

from .fixtures import LABELS, ROWS, documents, long_rows


class Plain:
    """Both models with dictionaries, word by word."""

    def __init__(self, texts, targets, least_share):
        words = Counter(w for t in texts for w in lm_score.words_of(t))
        total = sum(words.values())
        self.known = {w for w, n in words.items() if n >= least_share * total}
        self.symbols = [*sorted(self.known), None]
        self.models = []
        for rows in (texts, targets):
            pairs, after, single = Counter(), Counter(), Counter()
            for t in rows:
                for v, w in self.pairs(t):
                    pairs[v, w] += 1
                    after[v] += 1
                    single[w] += 1
            self.models.append((pairs, after, single))
        n = [sum(m[2].values()) for m in self.models]
        self.scales = (n[1] / n[0] if n[0] else 0.0, 1.0)

    def pairs(self, text):
        before = "begin"
        for w in lm_score.words_of(text):
            w = (w,) if w in self.known else (None,)
            yield before, w
            before = w

    def p(self, k, v, w, own=Counter(), own_after=Counter()):  # noqa: B006
        pairs, after, single = self.models[k]
        s = self.scales[k]
        share = (s * single[w] + 0.5) / (s * sum(single.values()) + 0.5 * len(self.symbols))
        return (s * max(0, pairs[v, w] - own[v, w]) + lm_score.PRIOR * share) / (s * max(0, after[v] - own_after[v]) + lm_score.PRIOR)

    def losses(self, text, in_target):
        found = list(self.pairs(text))
        if not found:
            return 0.0, 0.0
        own, own_after = Counter(found), Counter(v for v, _ in found)
        back = -sum(math.log(self.p(0, v, w, own, own_after)) for v, w in found) / len(found)
        left = (own, own_after) if in_target else (Counter(), Counter())
        return back, -sum(math.log(self.p(1, v, w, *left)) for v, w in found) / len(found)


@pytest.mark.parametrize(("share", "often"), [(1e-5, 2e-7), (0.004, 0.002), (0.004, 1.0)])
def test_scores_equal_plain_models(spark, monkeypatch, share, often):
    monkeypatch.setattr(lm_score, "LEAST_SHARE", share)
    monkeypatch.setattr(lm_score, "FREQUENT", often)
    monkeypatch.setattr(lm_score, "HELD_PAIRS", 50)
    rows = [*long_rows(120), *[(r if len(r[1] or "") < 5000 else (*r[:1], "x y", *r[2:])) for r in ROWS]]
    good = {r[0] for r in rows if r[0] is not None and r[0] % 3 == 1}
    labels = spark.createDataFrame([(i, 1, 0) for i in good] + [(0, 0, 0), (None, 1, 1), (5, None, None)], LABELS)
    docs = documents(spark, rows, clashes=True)
    plain = Plain([r[1] for r in rows], [r[1] for r in rows if r[0] in good], share)
    models = lm_score.train(docs, labels)
    assert set(models.vocabulary) == plain.known
    if often < 1 and share > 1e-4:
        assert 0 < len(models.often[0]) < models.pairs.count()  # both ways are taken
    got = defaultdict(list)
    for r in lm_score.score(docs.withColumn("lm_score", F.lit("own")), models, labels).collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, text, *_ in rows:
        back, target = plain.losses(text, i in good)
        assert any(r["loss_background"] == pytest.approx(back, rel=1e-5, abs=1e-6) and r["loss_target"] == pytest.approx(target, rel=1e-5, abs=1e-6) for r in got[i]), i
    for r in (x for rows in got.values() for x in rows):
        assert r["lm_score"] == pytest.approx(r["loss_background"] - r["loss_target"]) and r["a b"] == "own a b"
    for k in (0, 1):
        for v in [*plain.models[0][1], ("never seen",)]:
            assert sum(plain.p(k, v, (w,)) for w in plain.symbols) == pytest.approx(1)


def test_other_documents_are_scored_with_all_counts(spark):
    rows = [(i, f"clean words in good order number {i % 7}", "en", None, 0) for i in range(60)] + [(100 + i, f"zig zag zog zug {i % 5} zig zag", "en", None, 0) for i in range(60)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(60)], LABELS)
    models = lm_score.train(documents(spark, rows), labels)
    new = documents(spark, [(1, "clean words in good order", None, None, 0), (2, "zig zag zog", None, None, 0), (3, None, None, None, None), (4, "?!", None, None, 2)])
    got = {r["doc_id"]: r for r in lm_score.score(new, models).collect()}
    assert got[1]["lm_score"] > 0 > -0.1 > got[2]["lm_score"]
    assert [(got[i]["n_tokens"], got[i]["lm_score"]) for i in (3, 4)] == [(0, 0.0), (0, 0.0)]


def test_target_has_no_bound(spark):
    ids = spark.range(100_500).withColumnRenamed("id", "doc_id")
    docs = ids.withColumn("text", F.lit("good words"))
    labels = ids.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).where("doc_id % 2 = 0")
    assert lm_score.target_texts(docs, labels).count() == 50_250
    models = lm_score.train(docs, labels)
    assert models.total.tolist() == [201_000, 100_500] and sorted(models.vocabulary) == ["good", "words"]


def test_empty(spark):
    empty, none = documents(spark, []), spark.createDataFrame([], LABELS)
    models = lm_score.train(empty, none)
    assert lm_score.score(empty, models, none).count() == 0
    assert {r["lm_score"] for r in lm_score.score(documents(spark), models).collect()} == {0.0}
