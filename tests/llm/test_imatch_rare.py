"""I-Match against a plain version; texts without terms of the lexicon are told apart; the lexicon is in no row."""

import collections
import struct

import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import imatch

from .fixtures import documents, long_rows


def fingerprints(docs, lex):
    return imatch.with_fingerprints(docs.select("doc_id", "text"), lex, {"f": "text"})


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def of_long(value, seed=42):
    return xxhash.xxh64_intdigest(struct.pack("<q", value), seed=seed)


def of_terms(pairs):
    seed = 42
    for pair in pairs:
        for value in pair:
            seed = of_long(value, seed)
    return signed(seed)


def plain_fingerprint(text, df, n, low, high):
    """The definition, word by word, with sets and loops."""
    words = {w for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split() if w}
    known = []
    for w in words:
        if max(2, low * n) <= df[w] <= max(2, high * n):
            t = signed(xxhash.xxh64_intdigest(w.encode(), seed=42))
            m = 0
            for i, rate in enumerate(imatch.RATES):
                drawn = xxhash.xxh64_intdigest(struct.pack("<i", i), seed=of_long(t))
                for seed in range(imatch.SEEDS):
                    if (drawn >> (seed * (rate.bit_length() - 1))) % rate == 0:
                        m |= 1 << (i * imatch.SEEDS + seed)
            known.append((t, m))
    known.sort()
    subsets = [[x for x in known if x[1] >> k & 1] for k in range(len(imatch.RATES) * imatch.SEEDS)]
    hashes = [of_terms(s) if s else 0 for s in subsets]
    if any(hashes):
        return hashes
    whole = of_terms([(signed(xxhash.xxh64_intdigest(w.encode(), seed=42)),) for w in sorted(words, key=lambda w: signed(xxhash.xxh64_intdigest(w.encode(), seed=42)))])
    return [whole if words else signed(xxhash.xxh64_intdigest(text.encode(), seed=42)) if text else 0] * len(hashes)


def plain_likeness(a, b):
    told = [(x, y) for x, y in zip(a, b, strict=True) if x or y]
    return sum(x == y for x, y in told) / len(told) if told else 1.0


def as_hex(hashes):
    return "".join(f"{h & 0xFFFFFFFFFFFFFFFF:016x}" for h in hashes)


def test_query_equals_the_plain_version(spark, tmp_path):
    rows = [(i, t, lang, s, n) for i, t, lang, s, n in long_rows(150)] + [(5000, None, None, None, None), (5001, "?!", None, None, 2), (5002, "", None, None, 0), (5003, "Solo wort", None, None, 9)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    df = collections.Counter(w for r in rows for w in {w for w in "".join(c if c.isalnum() else " " for c in (r[1] or "").lower()).split()})
    texts = [(i, t or "") for i, t, *_ in sorted(rows)]
    plain = lambda t: plain_fingerprint(t, df, len(rows), imatch.LOW, imatch.HIGH)
    want = {}
    for k, (i, text) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        own, changed = plain(text), plain(edited)
        want[i] = (as_hex(own), as_hex(changed), plain_likeness(own, changed), plain_likeness(own, plain(after)))
    got = {r["doc_id"]: (r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in imatch.op7(spark, str(tmp_path)).collect()}
    assert got == want


def test_no_row_holds_the_lexicon(spark):
    docs = documents(spark)
    plan = fingerprints(docs, imatch.lexicon(docs.select("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert "__lexicon" not in plan and "scalar-subquery" in plan


def test_texts_without_lexicon_terms_differ(spark):
    texts = ["amber birch", "cedar dune amber", "birch amber", "A.", "This.", "?!", "...", "", None, " \n"]
    common = [(100 + i, f"word{i // 5} other{i // 5}", "en", "a", 1) for i in range(50)]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)] + common
    got = {r["doc_id"]: tuple(r["f"]) for r in fingerprints(documents(spark, rows), imatch.lexicon(documents(spark, common).select("text"))).collect()}
    zeros = (0,) * (len(imatch.RATES) * imatch.SEEDS)
    assert got[7] == got[8] == zeros
    assert got[0] == got[2]  # as sets of terms
    assert len({got[i] for i in (0, 1, 3, 4, 5, 6, 7, 9)}) == 8
    assert got[100] == got[101] != zeros
    alike = spark.createDataFrame([(list(got[3]), list(got[4]))], "a array<long>, b array<long>")
    assert alike.select(imatch.likeness(F.col("a"), F.col("b")).alias("l")).first()["l"] == 0.0


def test_one_lexicon_term_in_no_subset(spark):
    rows = [(i, f"solo{i // 2}", "en", "a", 1) for i in range(200)]
    docs = documents(spark, rows)
    found = [tuple(r["f"]) for r in fingerprints(docs, imatch.lexicon(docs.select("text"), low=0.001)).collect()]
    assert len(set(found)) == 100
