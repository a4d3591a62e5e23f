"""Each operator against brute force on small tables, and on odd rows, empty tables and clashing columns."""

import collections
import hashlib
import re
import tarfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import bpe, common, imatch, language, media, mixing, pii, quality, simhash, toxicity

from .fixtures import CLASHES, LABELS, ROWS, documents, long_rows


def by_id(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r)
    return out


# media


def test_media_round_trip_and_shards(spark, tmp_path):
    folder = f"file://{tmp_path}/shards"
    rows = media.store(documents(spark, clashes=True), folder)
    found = media.payload_columns(media.media_columns(rows, folder), folder).collect()
    texts = collections.Counter((r[0], media.payload_of(r[1])) for r in ROWS)
    assert collections.Counter((r["doc_id"], bytes.fromhex(r["payload_sha256"])) for r in found) == collections.Counter({(i, hashlib.sha256(p).digest()): n for (i, p), n in texts.items()})
    for r in found:
        with open(f"{tmp_path}/shards/{r['shard']}", "rb") as f:
            f.seek(r["offset"])
            image = f.read(r["length"])
        payload = media.read_samples(image)
        assert hashlib.sha256(payload).hexdigest() == r["digest"] == r["payload_sha256"]
        assert (len(payload), zlib.crc32(payload[-64:]), hashlib.sha256(image).hexdigest()) == (r["payload_bytes"], r["tail_crc32"], r["media_sha256"])
        assert (r["width"], r["height"], r["depth"]) == (64, len(payload) // 64, 8) and r["a b"] == "own a b"
    for shard in {r["shard"] for r in found}:
        with tarfile.open(f"{tmp_path}/shards/{shard}") as tar:
            names = tar.getnames()
        assert len(names) == len(set(names)) == len({r["digest"] for r in found if r["shard"] == shard})


def test_media_empty_and_damage(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert media.payload_columns(media.store(documents(spark, []), folder), folder).count() == 0
    image = bytearray(media.store_image(bytes(range(64))))
    image[45] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.read_samples(bytes(image))


# language


def test_viterbi_is_the_best_path():
    import itertools

    r = np.random.default_rng(1)
    lengths = np.array([4, 0, 1, 5])
    scores = r.normal(size=(10, 3)) * 3
    got, begin = language.viterbi(scores, lengths, 2.0), 0
    for n in lengths:
        part = scores[begin : begin + n]
        value = lambda p: sum(part[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        if n:
            assert value(got[begin : begin + n]) == pytest.approx(max(map(value, itertools.product(range(3), repeat=int(n)))))
        begin += n


def test_language_learns_and_labels_spans(spark):
    en = "the house and the garden were quiet while the children played with their new ball near the old bridge"
    de = "das Haus und der Garten waren still während die Kinder mit ihrem neuen Ball bei der alten Brücke spielten"
    el = "το σπίτι και ο κήπος ήταν ήσυχα ενώ τα παιδιά έπαιζαν με την μπάλα τους κοντά στο παλιό γεφύρι"
    rows = [(i, {0: en, 1: de, 2: el}[i % 3], ["en", "de", "el"][i % 3], None, 0) for i in range(30)]
    model = language.train(documents(spark, rows))
    assert model.languages == ["de", "el", "en"]
    mixed = f"{en}. {de}! {el}"
    asked = [(1, mixed, None, None, None), (2, "12 34", None, None, None), (3, None, None, None, None), (4, "!!" + de, None, None, None), (4, "!!" + de, None, None, None)]
    got = by_id(language.identify(documents(spark, asked, clashes=True), model))
    spans = [(s["lang"], mixed[s["begin"] : s["end"]]) for s in got[1][0]["spans"]]
    assert spans == [("en", en), ("de", de), ("el", el)]
    assert [got[i][0]["lang_pred"] for i in (2, 3, 4)] == ["und", "und", "de"] and len(got[4]) == 2
    assert [(s["begin"], s["end"]) for s in got[4][0]["spans"]] == [(2, len(de) + 2)]
    assert language.identify(documents(spark), model).count() == len(ROWS)
    assert language.identify(documents(spark, []), model).count() == 0
    none = language.train(documents(spark, []))
    assert {r["lang_pred"] for r in language.identify(documents(spark), none).collect()} == {"und"}


def test_language_never_learns_from_held_out(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0)
    model = language.train(documents(spark, [(held, "alpha beta", "xx", None, 0), (None, "gamma", "yy", None, 0)]))
    assert model.languages == [language.UNKNOWN]


# bpe


@pytest.fixture(scope="module")
def vocab():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_bpe_equals_the_library(spark, vocab):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocab)
    rows = [*ROWS, (20, "ab " * 5 + "𠀀꟎͸ ²½Ⅷ٣", None, None, None), (21, " 's're 'LL", None, None, None)]
    encoded = bpe.encode(documents(spark, rows, clashes=True), vocab)
    decoded = bpe.decode(encoded, vocab, out="back")
    want = collections.Counter((r[0], tuple(tok.encode(r[1] or "", add_special_tokens=False).ids), r[1] or "") for r in rows)
    got = collections.Counter((r["doc_id"], tuple(r["ids"]), r["back"]) for r in decoded.collect())
    assert got == want and set(CLASHES) - {"ids"} <= set(decoded.columns)
    again = bpe.recode(documents(spark, rows, clashes=True), vocab)
    assert collections.Counter((r["doc_id"], tuple(r["ids"]), r["text"]) for r in again.collect()) == want
    assert set(again.columns) == {*CLASHES, *documents(spark).columns}
    assert bpe.encode(documents(spark, []), vocab).count() == 0 == bpe.recode(documents(spark, []), vocab).count()


def test_bpe_merges_in_rank_order_and_from_the_left(vocab):
    from tokenizers import Tokenizer

    tok, v = Tokenizer.from_file(vocab), bpe.Vocabulary(vocab)
    words = ["a" * n for n in range(1, 40)] + ["abab" * 9, "zzzzaazz", "the", " the"]
    ids, counts = bpe.merge_words(v, [w.encode() for w in words])
    ends = np.cumsum(counts)
    for w, end, n in zip(words, ends, counts, strict=True):
        assert ids[end - n : end].tolist() == tok.encode(w, add_special_tokens=False).ids


def test_bpe_decodes_broken_utf8(spark, vocab):
    v = bpe.Vocabulary(vocab)
    ids = [int(v.base[0xE2]), int(v.base[0x82]), int(v.base[0x41])]
    df = spark.createDataFrame([(1, ids), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(df, vocab).collect()} == {1: "�A", 2: "", 3: ""}


# pii

_RAW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(_RAW.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((k, *m.span()))
    return out


def test_pii_base_equals_the_patterns():
    import random

    r = random.Random(2)
    pieces = ["a", ".b", "@", "x@y.z", "1", "22", ".", "+", "-", " ", "(", ")", "4111 1111 1111 1111", "10.0.0.256", "é", "_"]
    for _ in range(4000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 25)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_pii_query_counts_each_kind(spark, tmp_path):
    texts = [(1, "a@b.cd 10.0.0.1 8.8.8.8 999.1.1.1"), (2, "4111 1111 1111 1111, +49 30 1234567"), (3, "a@b.cd c@d.ef g@h.ij"), (4, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in pii.op4(spark, str(tmp_path)).collect()}
    for i, text in texts:
        want = plain_spans(text or "")
        assert [got[i][f"n_{k}"] for k in pii.KINDS[:4]] == [sum(s[0] == k for s in want) for k in range(4)]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want).encode()).hexdigest()


def test_pii_long_texts_stay_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "1 " * 150_000):
        assert isinstance(pii.base_spans(text), list)


def test_pii_removes_what_reveals_an_entity(spark):
    filler = ["meadow", "window", "purple", "lantern", "copper", "harbour"]
    rows = [(i, f"a note on {filler[i % 6]} and {filler[(i + 1) % 6]}", None, None, None) for i in range(200)]
    rows += [(300 + i, f"please ask Quillfeather about {filler[i]} at q.f@example.org today", None, None, 5) for i in range(3)]
    docs = documents(spark, rows, clashes=True)
    got = by_id(pii.find(docs))
    for i in range(3):
        text = rows[200 + i][1]
        terms = {text[s["begin"] : s["end"]] for s in got[300 + i][0]["spans"]}
        assert {"q.f@example.org", "Quillfeather", "please", "ask", "today"} == terms - {"about"} and filler[i] not in terms
    assert all(not got[i][0]["spans"] for i in range(200))
    safe = pii.sanitise(docs)
    assert safe.columns == docs.columns and safe.count() == len(rows)
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in safe.collect()}
    assert "[EMAIL]" in texts[300][0] and "Quillfeather" not in texts[300][0] and texts[300][1] == len(texts[300][0])
    assert texts[5][0] == rows[5][1]


def test_pii_disclosures_equal_counted_ones(spark):
    import math

    r = np.random.default_rng(3)
    people = [f"p{i}@mail{i % 3}.org" for i in range(6)]
    rows = []
    for i in range(160):
        words = [f"w{chr(97 + k)}{chr(97 + k)}x" for k in r.integers(0, 12, 6)]
        who = [people[k] for k in r.integers(0, 6, int(r.integers(0, 3)))]
        hint = [f"Hint{chr(97 + int(w[1]))}" for w in who if r.random() < 0.9]
        rows.append((i, " ".join([*hint[:1], *words, *who, *["filler"] * 30, *hint]), None, None, None))
    rows.append((900, None, None, None, None))
    texts = {t or "" for _, t, *_ in rows}  # each text once, however often it is there
    rows += [(2000 + k, rows[k % 7][1], None, None, None) for k in range(80)]
    docs = [(set(re.findall(_RAW["email"].replace("(", "(?:"), t)), set(pii.terms_of(t, plain_spans(t)))) for t in texts]
    n_entity = collections.Counter(e for es, _ in docs for e in es)
    n_term = collections.Counter(w for _, ws in docs for w in ws)
    n_both = collections.Counter((e, w) for es, ws in docs for e in es for w in ws)
    score = lambda e, w: math.log(n_both[e, w] * len(docs) / (n_entity[e] * n_term[w])) / math.log(len(docs) / n_entity[e])
    want = {(pii.entity_of(0, e), w): round(score(e, w), 9) for (e, w), n in n_both.items() if n >= 2 and score(e, w) >= pii.GENERALISE}
    found = common.written(pii._scan(documents(spark, rows).select("text", F.monotonically_increasing_id().alias("at")), []), "test")
    got = {(r["entity"], r["term"]): round(r["disclosure"], 9) for r in pii.disclosures(found, documents(spark, rows)).collect()}
    assert got == want and len(want) >= 3
    by = by_id(pii.find(documents(spark, rows)))
    for i, text, *_ in rows:
        mine = {pii.entity_of(0, e) for e in re.findall(_RAW["email"].replace("(", "(?:"), text or "")}
        marks = sorted(m.span() for m in pii.TERM.finditer(text or "") if any((e, m[0].lower()) in want for e in mine))
        free = [s for s in marks if not any(a < s[1] and s[0] < b for _, a, b in plain_spans(text or ""))]
        assert sorted((s["begin"], s["end"]) for s in by[i][0]["spans"] if s["kind"] > 3) == free


def test_pii_copies_reveal_nothing_but_other_texts_do(spark):
    """Copies of one text have all their words in common with its address; that says nothing of the words."""
    import random

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(7))
    rows = [(i, " ".join(word() for _ in range(20)), "en", "a", 1) for i in range(100)]
    copy = " ".join(word() for _ in range(200)) + " to lone@copies.org"
    rows += [(500 + i, copy, "en", "a", 1) for i in range(40)]
    rows += [(700 + i, f"{' '.join(word() for _ in range(20))} Marlowe wrote {rows[i][1]} from m@planted.org", "en", "a", 1) for i in range(4)]
    got = by_id(pii.find(documents(spark, rows)))
    assert all(len(g["spans"]) == 1 for i in range(500, 540) for g in got[i])
    for i, text, *_ in rows[140:]:
        assert {text[s["begin"] : s["end"]] for s in got[i][0]["spans"]} == {"m@planted.org", "Marlowe", "wrote", "from"}


def test_pii_many_entities_and_terms_in_the_same_texts_are_one_pair(spark):
    people = " ".join(f"p{i}@list.org" for i in range(1500))
    names = " ".join("name" + "".join("abcdefghij"[int(c)] for c in str(i)) for i in range(1500))
    rows = [(i, f"page{'abc'[i]} {people} {names}", "en", "a", 1) for i in range(2)] + [(9 + i, f"other {i}", "en", "a", 1) for i in range(20)]
    found = common.written(pii._scan(documents(spark, rows).select("text", F.monotonically_increasing_id().alias("at")), []), "test")
    entities, pairs = pii._pairs(found, 22)
    assert entities.count() == 1500 and entities.select("set").distinct().count() == 1
    assert pairs.count() == 1500  # a row for each term, not for each term and entity
    assert all(len(r["spans"]) == 3000 for g in by_id(pii.find(documents(spark, rows[:2] + rows[5:]))).values() for r in g if r["doc_id"] < 2)


def test_pii_classes():
    assert [pii.class_of(w) for w in ("Quill", "quill", "QUILL")] == ["[Name]", "[word]", "[CAPITALS]"]
    assert pii.replaced("ask Quill now", [(4, 4, 9), (5, 10, 13)]) == "ask [Name] "


def test_pii_odd_rows(spark):
    assert pii.find(documents(spark)).count() == len(ROWS) == pii.sanitise(documents(spark)).count()
    assert pii.find(documents(spark, [])).count() == 0 == pii.sanitise(documents(spark, [])).count()
    got = by_id(pii.find(documents(spark)))
    assert [len(r["base"]) for r in got[9]] == [4, 4] and not got[3][0]["spans"] and len(got[None]) == 2


# quality


def test_chunks_cover_whole_texts_and_overlap():
    for n in (0, 1, 511, 512, 513, 5000, quality.STEP * quality.BLOCK_CHUNKS * 2 + 3):
        raw = bytes((i * 7 + i // 256) % 255 + 1 for i in range(n))
        seen = bytearray()
        for chunks in quality.blocks_of(raw):
            for c in chunks:
                part = bytes(c)
                if seen and quality.OVERLAP:
                    assert bytes(seen[-quality.OVERLAP :]) == part[: quality.OVERLAP] or not any(part[quality.OVERLAP :])
                    part = part[quality.OVERLAP :]
                seen += part
        assert bytes(seen[:n]) == raw and not any(seen[n:])


def test_network_gradients_are_right():
    net = quality.ByteNet(3)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    raws, y = [b"hello world " * 60, b"$$## " * 30], np.array([1.0, 0.0])
    loss = lambda: -np.mean([np.log(net.probability(r) if t else 1 - net.probability(r)) for r, t in zip(raws, y, strict=True)])
    g = net.gradients(raws, y)
    for name, grad in g.items():
        spots = np.argsort(-np.abs(grad.ravel()))[:3] if name != "out" else [0]
        for i in spots:
            flat, eps = net.p[name].reshape(-1), 1e-5
            flat[i] += eps
            up = loss()
            flat[i] -= 2 * eps
            down = loss()
            flat[i] += eps
            assert (up - down) / (2 * eps) == pytest.approx(grad.ravel()[i], rel=2e-2, abs=1e-6), name


def test_quality_learns_from_labels_only_where_it_may(spark):
    rows = [(i, ("plain words about the sea and the hills " if i % 2 else "$$$ ### &&& %%% ") * (1 + i % 4), "en", None, 0) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)] + [(None, 1, 1), (3, None, None)], LABELS)
    docs = documents(spark, rows)
    net = quality.train(docs, labels)
    got = by_id(quality.score(docs, net))
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all((got[i][0]["score"] >= 0.7) == bool(i % 2) for i in held)
    odd = by_id(quality.score(documents(spark, clashes=True), net))
    assert odd[3][0]["score"] == odd[4][0]["score"] and 0 <= odd[7][0]["score"] <= 1 and len(odd[2]) == 2
    assert quality.score(documents(spark, []), net).count() == 0
    assert quality.train(documents(spark, []), labels).probability(b"") < 0.5


# fingerprints


def plain_edited(rows):
    ids = sorted({r[0] for r in rows}, key=lambda i: (i is not None, i or 0))
    after = {a: b for a, b in zip(ids, [*ids[1:], ids[0]], strict=True)}
    first = {}
    for r in rows:
        first.setdefault(r[0], []).append(r[1] or "")
    out = []
    for r in rows:
        text = r[1] or ""
        q = len(text) // 4
        out.append((r[0], text, {text[: len(text) - q] + n[:q] for n in first[after[r[0]]]}))
    return out


@pytest.mark.parametrize("rows", [ROWS, long_rows(), ROWS[:1]])
def test_edited_pairs(spark, rows):
    got = imatch.edited_pairs(documents(spark, rows)).collect()
    want = plain_edited(rows)
    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == collections.Counter((a, b) for a, b, _ in want)
    allowed = {(a, b): c for a, b, c in want}
    assert all(r["edited"] in allowed[r["doc_id"], r["text"]] and r["n_chars"] == len(r["text"]) for r in got)


def test_imatch_fingerprints(spark, tmp_path):
    rows = long_rows()
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = imatch.op7(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by_text = collections.defaultdict(set)
    for r in got:
        by_text[dict((x[0], x[1]) for x in rows)[r["doc_id"]]].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(f) == 1 for f in by_text.values())
    assert np.mean([r["near_edited"] for r in got]) > np.mean([r["near_next"] for r in got])


def test_imatch_lexicon_is_the_band(spark):
    rows = long_rows()
    lex = {r["t"] for r in imatch.lexicon(documents(spark, rows).select("text"), low=0.02, high=0.2).collect()}
    df = collections.Counter(w for r in rows for w in set(r[1].lower().split(" ")) if w)
    words = [w for w, n in df.items() if 6 <= n <= 60]
    hashed = spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w").alias("h")).collect()
    assert lex == {r["h"] for r in hashed}


def test_imatch_odd_rows(spark, tmp_path):
    documents(spark, clashes=True).write.parquet(f"{tmp_path}/a/documents.parquet")
    got = by_id(imatch.op7(spark, f"{tmp_path}/a"))
    assert sum(map(len, got.values())) == len(ROWS) and got[1][0]["fingerprint"] == got[2][0]["fingerprint"] == got[2][1]["fingerprint"]
    documents(spark, []).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert imatch.op7(spark, f"{tmp_path}/b").count() == 0


# mixing


def plain_mix(rows, weights=(3, 1, 2), share=1.5, cap=2.0):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    left, target, open_ = share * sum(total.values()), {}, set(sources)
    while open_:
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if part[s] > cap * total[s]}
        if not full:
            return total, target | part
        for s in full:
            target[s] = cap * total[s]
            left -= target[s]
        open_ -= full
    return total, target


@pytest.mark.parametrize("rows", [ROWS, long_rows()])
def test_mix_meets_targets(spark, rows):
    docs = documents(spark, rows, clashes=True)
    got = mixing.mix_plan(docs).collect()
    total, target = plain_mix(rows)
    assert len(got) == len(rows)
    for s in total:
        mine = [r for r in got if r["source"] == s]
        assert mine[0]["target"] == pytest.approx(target[s]) and mine[0]["source_size"] == total[s]
        largest = max(r["size"] for r in mine)
        again = max(collections.Counter(r["h"] for r in mine).values())
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= largest * again / 2 + 1e-9
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in mine)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    want = collections.Counter({(r["doc_id"], r["h"]): r["times"] for r in got})
    assert mixed.count() == sum(r["times"] for r in got) and len(want)


def test_mix_empty(spark):
    assert mixing.mix_plan(documents(spark, [])).count() == 0 == mixing.mix(documents(spark, [])).count()


# toxicity


def test_ordinal_probabilities_and_order():
    m = toxicity.OrdinalModel(np.zeros(4), np.array([-1.0, 0.5, 2.0]))
    p = m.probabilities(np.array([-3.0, 0.0, 3.0]))
    assert p.sum(axis=1) == pytest.approx(1) and (p >= 0).all()
    severity = p @ np.arange(4)
    assert severity[0] < severity[1] < severity[2]


def test_toxicity_learns_and_filters(spark):
    import random

    r = random.Random(4)
    mild = ["river", "stone", "cloud", "lamp", "chair", "green"]
    rows, labels = [], []
    for i in range(300):
        words = [r.choice(mild) for _ in range(12)]
        toxic = i % 5 == 0
        if toxic:
            words[r.randrange(12)] = "grumblefoot"
            if i % 10 == 0:
                words[r.randrange(12)] = "snarlhead"
        rows.append((i, " ".join(words), "en", None, 0))
        if i < 200:
            labels.append((i, 1, int(toxic)))
    docs = documents(spark, rows, clashes=True)
    model = toxicity.train(docs, spark.createDataFrame([*labels, (None, 1, 1), (7, 1, None)], LABELS))
    assert (np.diff(model.thresholds) > 0).all()
    got = by_id(toxicity.score(docs, model))
    assert all(got[i][0]["toxic"] == int(i % 5 == 0) for i in range(200, 300))
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and {x["doc_id"] for x in kept.collect()} == {i for i in range(300) if i % 5}
    odd = toxicity.score(documents(spark), model)
    assert odd.count() == len(ROWS)
    assert toxicity.keep_clean(documents(spark, []), model).count() == 0
    nothing = toxicity.train(documents(spark, []), spark.createDataFrame([], LABELS))
    assert {x["toxic"] for x in toxicity.score(documents(spark), nothing).collect()} == {0}


# simhash


def plain_components(rows, shingle=3, radius=3):
    fps = [simhash.fingerprint_text(t, shingle) for _, t, *_ in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    least = {}
    for (i, *_), g in zip(rows, label, strict=True):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    return collections.Counter((r[0], f, least[g]) for r, f, g in zip(rows, fps, label, strict=True))


def test_fingerprint_by_bits():
    import xxhash

    text = "One two  THREE\tfour é five two three four"
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert simhash.fingerprint_text(text, 3) == want
    assert simhash.fingerprint_text(None, 3) == 0 == simhash.fingerprint_text(" \n", 3)
    assert simhash.fingerprint_text("a b", 3) == xxhash.xxh64_intdigest("a b", 42)


@pytest.mark.parametrize("rows", [ROWS, long_rows(150)])
def test_simhash_components(spark, rows):
    got = simhash.near_duplicates(documents(spark, rows, clashes=True)).collect()
    assert collections.Counter((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in got) == plain_components(rows)
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_bk_tree_and_refined_shards_lose_no_link(spark, monkeypatch):
    import random

    monkeypatch.setattr(simhash, "HOT", 20)
    r = random.Random(9)
    centre = r.getrandbits(64)
    values = {centre}
    while len(values) < 400:  # a tight cluster: every shard of it is hot, and its two refinements too
        v = r.choice(sorted(values)) if r.random() < 0.5 else centre
        for _ in range(r.randint(1, 4)):
            v ^= 1 << r.randrange(64)
        values.add(v)
    values |= {r.getrandbits(64) for _ in range(200)}
    values = sorted(values)
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:40]:
        assert sorted(tree.values[i] for i in tree.within(q, 3)) == [v for v in values if (v ^ q).bit_count() <= 3]
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    rows = fps.select(F.col("fp").alias("key"), "fp")
    got = {x["fp"]: x["first"] for x in simhash.near_groups(rows).collect()}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    label = {s: s for s in signed}
    changed = True
    while changed:
        changed = False
        for a, x in zip(values, signed, strict=True):
            m = min(label[y] for b, y in zip(values, signed, strict=True) if (a ^ b).bit_count() <= 3)
            if m < label[x]:
                label[x], changed = m, True
    assert got == label


def test_long_chains_settle(spark):
    from sparkloom.llm.components import star_components

    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (5, 5)], "u long, v long")
    got = {r["node"]: r["root"] for r in star_components(chain).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}
    assert star_components(chain.limit(0)).count() == 0


def test_keep_one(spark):
    docs = documents(spark, clashes=True)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = collections.Counter(r["doc_id"] for r in kept.collect())
    assert ids[1] == 1 and ids[2] == 0 and ids[9] == 1 and ids[3] + ids[4] + ids[5] == 1 and max(ids.values()) == 1


def test_shared_folder_is_the_session_setting(spark):
    assert common.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
