"""I-Match document fingerprints (DataFrame functions only).

A lexicon holds the terms whose document frequency lies in a chosen band. A document keeps its distinct terms in the
lexicon, sorted, and hashes those in each of several randomised subsets of the lexicon: one value for each subset.
A document without lexicon terms in any subset hashes its whole set of distinct terms instead, or its text if it has no terms.
The likeness of two documents is the share of subsets, of those in which either has terms, in which both agree.

Membership is exact. The band has a lower bound that is a share of all documents, so a lexicon has at most (distinct
terms of a mean document) / LOW terms whatever the corpus: some 500,000, or 20 MB. It is one row, made by Spark and
handed to the plan as a scalar subquery, so that fingerprints are expressions over a row and move no data: an array of
BUCKETS short lists of (term, its subsets as bits), by the terms' 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

#: Band of document frequencies, as shares of all documents; and documents that a term needs at least.
LOW, HIGH, LEAST_DOCS = 0.0005, 0.10, 2
#: Lists that the lexicon is dealt out to, by hash.
BUCKETS = 1 << 16
#: Subsets keep one term in so many, as powers of two; so many seeds for each. Sparse ones outlast edits, dense ones tell texts apart.
RATES, SEEDS = (4, 16, 32, 64, 128), 6

TERM = r"[^\p{L}\p{N}]+"


def terms_of(text: Column) -> Column:
    """Hashes of the distinct lower-cased words of a text."""
    words = F.array_remove(F.array_distinct(F.split(F.lower(text), TERM)), "")  # compiled; only distinct words are hashed
    return F.transform(words, lambda w: F.xxhash64(w))


def subsets_of(term: Column) -> Column:
    """The subsets that keep a term, as bits of a long: subset number rate * SEEDS + seed. They depend on the term alone."""
    bits = F.lit(0).cast("long")
    for i, rate in enumerate(RATES):
        width = rate.bit_length() - 1
        drawn = F.xxhash64(term, F.lit(i))  # each seed looks at bits of its own
        for seed in range(SEEDS):
            kept = F.shiftrightunsigned(drawn, seed * width).bitwiseAND(F.lit(rate - 1).cast("long")) == 0
            bits = bits.bitwiseOR(F.when(kept, F.lit(1 << (i * SEEDS + seed)).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def lexicon(texts: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """t, m: the terms of ``texts(text)`` within the band and their subsets; frequencies are of all rows. No rows: no terms."""
    n = texts.count()
    counts = texts.select(F.explode(terms_of(F.col("text"))).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    band = counts.where(F.col("df").between(max(LEAST_DOCS, low * n), max(LEAST_DOCS, high * n)))
    return written(band.select("t", subsets_of(F.col("t")).alias("m")), "imatch-lexicon")


def buckets_of(lex: DataFrame) -> Column:
    """The lexicon as one array of BUCKETS lists of (t, m), sorted: a scalar subquery."""
    lists = lex.groupBy(_bucket(F.col("t")).alias("i")).agg(F.array_sort(F.collect_list(F.struct("t", "m"))).alias("terms"))
    every = lex.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("i")).join(lists, "i", "left")
    none = F.array().cast("array<struct<t:bigint,m:bigint>>")
    ordered = F.array_sort(F.collect_list(F.struct("i", F.coalesce("terms", none).alias("terms"))))
    return every.agg(F.transform(ordered, lambda x: x["terms"]).alias("buckets")).scalar()


def _bucket(term: Column) -> Column:
    return F.pmod(term, F.lit(BUCKETS)).cast("int")


def subset_hashes(known: Column) -> Column:
    """One hash of the sorted lexicon terms ``known`` (t, m) for each randomised subset; 0 where a subset has none of them."""
    none = F.xxhash64(F.array().cast("array<struct<t:bigint,m:bigint>>"))

    def hashed(k: int) -> Column:
        return F.xxhash64(F.filter(known, lambda x: F.getbit(x["m"], F.lit(k)) == 1))

    return F.transform(F.array(*[hashed(k) for k in range(len(RATES) * SEEDS)]), lambda h: F.when(h == none, F.lit(0).cast("long")).otherwise(h))


def likeness(a: Column, b: Column) -> Column:
    """Share of subsets with equal hashes among those in which either has terms; 1 for equal empty fingerprints."""
    both = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), F.lit(None)).otherwise((x == y).cast("int")))
    told = F.filter(both, lambda v: v.isNotNull())
    same = F.aggregate(told, F.lit(0), lambda acc, v: acc + v)
    return F.when(F.size(told) > 0, same / F.size(told)).otherwise(F.lit(1.0)).cast("double")


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def fingerprint(text: Column, lex: Column) -> Column:
    """Array of subset hashes of a text; ``lex`` is the lexicon's buckets, as with_fingerprints() hands them.

    Null and empty texts alone have zeros only. A text without lexicon terms in any subset has the hash of all its
    distinct terms, or of itself if it has none, for every subset. Whole texts; equal texts, equal hashes.
    """
    text = F.coalesce(text, F.lit(""))

    def hashed(terms: Column) -> Column:
        found = F.transform(terms, lambda t: F.get(F.filter(F.get(lex, _bucket(t)), lambda x: x["t"] == t), F.lit(0)))
        known = F.array_sort(F.array_compact(found))
        whole = F.when(F.size(terms) > 0, F.xxhash64(F.array_sort(terms))).when(text != "", F.xxhash64(text)).otherwise(F.lit(0).cast("long"))
        own = F.array_repeat(whole, len(RATES) * SEEDS)
        hashes = F.transform(F.array(known), subset_hashes)  # what a lambda takes is worked out once
        return F.transform(hashes, lambda found: F.when(F.exists(found, lambda h: h != 0), found).otherwise(own))[0]

    return F.transform(F.array(terms_of(text)), hashed)[0]


def with_fingerprints(rows: DataFrame, lex: DataFrame, of: dict[str, str]) -> DataFrame:
    """``rows`` with a fingerprint of the text column ``of[name]`` in each column ``name``; ``lex`` is a lexicon().

    All of them stand in one expression, which names the lexicon once: so Spark folds the subquery into it and no row
    holds a copy (a test looks at the plan).
    """
    made = F.transform(F.array("__lexicon"), lambda x: F.struct(*[fingerprint(F.col(f"`{c}`"), x).alias(n) for n, c in of.items()]))[0]
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in of]
    found = rows.withColumn("__lexicon", buckets_of(lex)).select(*kept, made.alias("__found"))
    return found.select(*kept, *[F.col("__found")[n].alias(n) for n in of])


def next_ids(ids: DataFrame) -> DataFrame:
    """k, next_k: the key of the next larger id of ``ids(id, k)``; after the largest comes the smallest. Null is first.

    Ids are dealt out by range; the next one is looked up within a part, and a part's last id takes the first of
    the next part that has any: one row for each part.
    """
    order = F.col("id").asc_nulls_first()
    parts = ids.distinct().repartitionByRange(order).select("id", "k", F.spark_partition_id().alias("part"))
    parts = written(parts, "imatch-ids")
    inside = Window.partitionBy("part").orderBy(order)
    firsts = parts.groupBy("part").agg(F.min(F.struct(F.col("id").isNotNull().alias("some"), "id", "k")).alias("f")).select("part", F.col("f.k").alias("first"))
    whole = Window.orderBy("part")
    least = F.first("first").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(whole), least).alias("after"))
    told = parts.select("part", "k", F.lead("k").over(inside).alias("inner_k"))
    return told.join(firsts, "part").select("k", F.coalesce("inner_k", "after").alias("next_k"))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, k, text, edited, n_chars, next_k, next_h for each row: ``edited`` is the text whose last quarter is
    replaced by the beginning of the next document's.

    Rows that share a doc_id share their next document, the one of the next larger id; where rows share that id too,
    it is the one whose text comes first by hash. A null text is empty and a null id comes before all others. Texts
    are moved once, and a quarter at most of each once more.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("null")).alias("k")
    sizes = docs.select(F.col("doc_id").alias("id"), key, F.floor(F.length(F.coalesce("text", F.lit(""))) / 4).alias("chars"))
    step = next_ids(sizes.select("id", "k"))
    wanted = sizes.groupBy("k").agg(F.max("chars").cast("int").alias("chars"))
    handed = written(step.join(wanted, "k").select(F.col("k").alias("to"), "next_k", "chars"), "imatch-next")
    rows = docs.select("doc_id", key, F.coalesce("text", F.lit("")).alias("text"))
    pieces = rows.join(handed, rows["k"] == handed["next_k"]).groupBy("to").agg(
        # With doc_id among the columns both joins read the same exchange of the texts.
        F.min(F.struct(F.xxhash64("text").alias("h"), "doc_id", F.expr("substring(text, 1, chars)").alias("piece"), "next_k")).alias("p")
    )
    n, q = F.length("text"), "cast(floor(length(text) / 4) as int)"
    edited = F.concat(F.expr(f"substring(text, 1, length(text) - {q})"), F.expr(f"substring(p.piece, 1, {q})"))
    paired = rows.join(pieces, rows["k"] == pieces["to"])
    return paired.select("doc_id", "k", "text", edited.alias("edited"), n.cast("long").alias("n_chars"), F.col("p.next_k").alias("next_k"), F.col("p.h").alias("next_h"))


def op7(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lex = lexicon(docs)
    rows = with_fingerprints(edited_pairs(docs), lex, {"own": "text", "changed": "edited"})
    slim = rows.select(
        "doc_id", "k", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("sha"), F.xxhash64("text").alias("h"), "next_k", "next_h", "own", "changed",
    )
    slim = written(slim, "imatch-fingerprints")
    others = slim.select(F.col("k").alias("o_k"), F.col("h").alias("o_h"), F.col("own").alias("theirs")).dropDuplicates(["o_k", "o_h"])
    joined = slim.join(others, (slim["next_k"] == others["o_k"]) & (slim["next_h"] == others["o_h"]))
    return joined.select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("theirs")).alias("near_next"),
    )
