"""Models against plain versions, and the bounds of what a fit reads."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import common, language, quality, toxicity

from .fixtures import LABELS, documents

# language


def test_words_are_of_one_script_with_their_marks():
    assert language.words_of("漢字かな abcДом हिन्दी x²7y naïve_é") == ["漢字", "かな", "abc", "Дом", "हिन्दी", "x", "y", "naïve", "é"]
    assert language.words_of("12 ?! ́") == []


def test_any_number_of_documents_has_a_sample():
    for n in (1, 1500, 1501, 10**6, 10**10, 10**13):
        bound = language.hash_bound(n, 1500)
        assert 1 <= bound <= 1 << language.HASH_BITS and abs(bound / 2**language.HASH_BITS * n - min(n, 1500)) < 1


def test_every_language_is_learnt(spark):
    ids = [i for i in range(2000) if not spark_held(i)][:600]
    rows = [(i, f"wort{chr(97 + k % 26)}{chr(97 + k // 26)} " * 3, f"l{k % 300:03}", None, 0) for k, i in enumerate(ids)]
    assert len(language.train(documents(spark, rows)).languages) == 300


def spark_held(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 5 == 0


def test_word_scores_and_predictions_equal_plain_ones(spark):
    texts = {"en": "the house and garden were quiet", "de": "das haus und der garten waren still", "ru": "дом и сад были тихими"}
    rows = [(i, texts[lang], lang, None, 0) for i, lang in enumerate(["en", "de", "ru"] * 20)]
    model = language.train(documents(spark, rows))
    learnt = [r for r in rows if not spark_held(r[0])]

    def grams(word):
        marked = f"^{word.lower()}$"
        for n in range(1, language.LONGEST_GRAM + 1):
            for i in range(len(marked) - n + 1):
                rolled = 0
                for c in marked[i : i + n]:
                    rolled = (rolled * 1_000_003 + ord(c)) % 2**64
                yield ((rolled + n) * 0x9E3779B97F4A7C15 % 2**64 >> 48) % language.FEATURES

    counts = {k: Counter(g for r in learnt if r[2] == k for w in r[1].split() for g in grams(w)) for k in texts}
    plain = lambda w, k: sum(math.log((counts[k][g] + 0.1) / (counts[k].total() + 0.1 * language.FEATURES)) for g in grams(w))
    words = ["house", "haus", "сад", "garten", "zzz"]
    got = model.word_scores(words)
    for i, w in enumerate(words):
        candidates = ["ru"] if w == "сад" else ["en", "de"]
        best = max(plain(w, k) for k in texts)
        for k in texts:
            want = max(plain(w, k) - best, -30) if k in candidates else -60
            assert got[i, model.languages.index(k)] == pytest.approx(want, abs=1e-3)
    mixed = "the quiet house. das stille haus und der garten: дом и сад"
    out = language.identify(documents(spark, [(1, mixed, None, None, 0)]), model).first()
    letters = Counter()
    for s in out["spans"]:
        letters[s["lang"]] += sum(map(len, language.words_of(mixed[s["begin"] : s["end"]])))
    best = max(sorted(letters), key=letters.__getitem__)
    assert out["lang_pred"] == best and out["score"] == pytest.approx(letters[best] / letters.total())


# samples


def test_samples_are_bounded_and_take_repeats_once(spark):
    rows = [(i, f"text {i} " + "x" * (i * 10), "en", "a", 0) for i in range(200)] + [(7, "text 7 " + "x" * 70, "en", "a", 0)] * 300
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(220)] + [(7, 1, 1), (None, 1, 1), (3, None, None)], LABELS)
    docs = documents(spark, rows)
    got = common.labelled_sample(docs, labels, "quality", 30, 1 << 30).collect()
    n = Counter(r["label"] for r in got)  # an id without a document has no text
    assert 20 < min(n.values()) <= max(n.values()) <= 30 and len({r["id"] for r in got}) == sum(n.values())
    some = common.labelled_sample(docs, labels, "quality", 30, 5000).collect()
    for k in (0, 1):
        assert 0 < sum(len(r["text"]) for r in some if r["label"] == k) <= 5000
    plain = {str(r[0]): r[1] for r in rows}
    assert all(r["text"] == plain[r["id"]] for r in [*got, *some])
    everything = common.labelled_sample(docs, labels, "quality", 1000, 1 << 30).collect()
    assert Counter(r["id"] for r in everything) == {str(i): 1 for i in range(200)}
    none = common.labelled_sample(documents(spark, []), spark.createDataFrame([], LABELS), "toxic", 10, 10)
    assert none.count() == 0


def test_ids_may_be_texts(spark):
    docs = spark.createDataFrame([(f"doc-{i}", "vile wretch words" if i % 2 else "kind words here", None) for i in range(80)], "doc_id string, text string, n long")
    labels = spark.createDataFrame([(f"doc-{i}", 1 - i % 2, i % 2) for i in range(60)], "doc_id string, quality int, toxic int")
    got = {r["doc_id"]: r["toxic"] for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert all(got[f"doc-{i}"] == i % 2 for i in range(80))
    assert quality.score(docs, quality.train(docs, labels, most=20)).count() == 80


# quality


def test_network_equals_a_plain_convolution():
    net = quality.ByteNet(3)
    r = np.random.default_rng(4)
    for n in (0, 1, 7, 511, 512, 513, 1400):
        raw = bytes(r.integers(0, 256, n, dtype=np.uint8))
        chunks, begin = [], 0
        while True:
            chunks.append(raw[begin : begin + quality.CHUNK].ljust(quality.CHUNK, b"\0"))
            begin += quality.STEP
            if begin + quality.OVERLAP >= len(raw):
                break
        best = []
        for chunk in chunks:
            row = []
            for f in range(quality.FILTERS):
                values = []
                for at in range(0, quality.CHUNK - quality.SPAN + 1, quality.STRIDE):
                    values.append(sum(float(net.p["embed"][chunk[at + j], d]) * float(net.p["filters"][j * quality.DIMS + d, f]) for j in range(quality.SPAN) for d in range(quality.DIMS)))
                row.append(max(0.0, max(values) + float(net.p["bias"][f])))
            best.append(row)
        best = np.array(best)
        z = best.max(axis=0) @ net.p["top"] + best.mean(axis=0) @ net.p["mean"] + net.p["out"][0]
        assert net.probability(raw) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)


def test_a_score_of_exactly_the_bound_is_good(spark, monkeypatch):
    net = quality.ByteNet()
    docs = documents(spark, [(1, "some text", None, None, 0), (2, None, None, None, 0)])
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, net).collect()}
    monkeypatch.setattr(quality, "GOOD", scores[1])
    assert {r["doc_id"]: r["predicted"] for r in quality.score(docs, net).collect()}[1] == 1
    assert 0 <= scores[2] <= 1


# toxicity


def plain_probabilities(model, text):
    z = sum(model.weights[f] for f in toxicity.features(text))
    upto = [1 / (1 + math.exp(-(t - z))) for t in model.thresholds] + [1.0]
    return [b - a for a, b in zip([0.0, *upto], upto, strict=False)]


def test_severity_equals_plain_probabilities(spark):
    rows = [(i, " ".join(["calm"] * 3 + [f"vile{k}" for k in range(i % 5)] + [f"word{i % 9}"]), None, None, 0) for i in range(200)] + [(900, None, None, None, 0), (901, "", None, None, 0)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 > 0)) for i in range(200)], LABELS)
    docs = documents(spark, rows)
    model = toxicity.train(docs, labels)
    assert (np.diff(model.thresholds) > 0).all() and np.count_nonzero(model.weights)
    for r in toxicity.score(docs, model).collect():
        text = dict((x[0], x[1]) for x in rows)[r["doc_id"]]
        p = plain_probabilities(model, text)
        assert r["severity"] == pytest.approx(sum(k * x for k, x in enumerate(p))) and r["p_toxic"] == pytest.approx(1 - p[0])
        assert r["grade"] == int(np.argmax(p)) and r["toxic"] == int(1 - p[0] > toxicity.REJECT)
        if text is None or text == "":
            assert re.fullmatch("[0-3]", str(r["grade"]))


def test_fit_descends_the_log_loss():
    """Its steps follow the gradient: moving any used weight or threshold from where it ends doesn't help much."""
    r = np.random.default_rng(1)
    toxic = np.array([0, 1] * 40)
    rows = np.repeat(np.arange(80), 3)
    columns = np.where(toxic[rows] == 1, r.integers(0, 6, 240), r.integers(4, 10, 240))
    model = toxicity.fit(toxic, rows, columns)
    y = toxicity.grades(toxic, rows, columns)

    def loss(weights, thresholds):
        s = np.bincount(rows, weights=weights[columns], minlength=80)
        p = toxicity.OrdinalModel(weights, thresholds).probabilities(s)[np.arange(80), y]
        return -np.log(np.maximum(p, 1e-12)).mean() + toxicity.L1 * np.abs(weights).sum()

    best = loss(model.weights, model.thresholds)
    for f in range(10):
        for d in (-0.2, 0.2):
            moved = model.weights.copy()
            moved[f] += d
            assert loss(moved, model.thresholds) > best - 2e-3
    for k in range(len(model.thresholds)):
        for d in (-0.1, 0.1):
            moved = model.thresholds.copy()
            moved[k] += d
            if (np.diff(moved) > 0).all():
                assert loss(model.weights, moved) > best - 2e-3


def test_held_out_labels_are_never_read(spark):
    held = [i for i in range(400) if documents_held(spark, i)]
    labels = spark.createDataFrame([(i, 1, 0) for i in held], LABELS)
    net = quality.train(documents(spark, [(i, "x", None, None, 0) for i in held]), labels)
    assert net.p["out"][0] == -3.0  # no label at all was learnt


def documents_held(spark, i):
    import zlib

    return zlib.crc32(str(i).encode()) % 4 == 2


def test_null_text_is_an_empty_one(spark):
    docs = documents(spark, [(1, None, None, None, None), (2, "", None, None, 0)])
    model = toxicity.OrdinalModel(np.zeros(toxicity.FEATURES), np.array([1.0, 2.0, 3.0]))
    got = toxicity.score(docs, model).select("severity", "p_toxic").distinct().collect()
    assert len(got) == 1 and docs.select(F.count("*")).first()[0] == 2
