"""LM scoring by cross-entropy difference: matched target and background bigram models over one vocabulary.

The background model counts all documents, the target model all those labelled as good. The vocabulary has each word
with LEAST_SHARE of all words or more (1 / LEAST_SHARE of them at most); every other word is the unknown word. Pairs of
neighbouring words are counted exactly, over everything, so their table grows with the corpus. The models are matched:
same order, smoothing and vocabulary, and background counts are scaled to the target's number of words, so that either
weighs as much against the smoothing. For a word w after v, with what the scored document itself gave to the counts
after v left out,

    p(w | v) = (scale * count(v, w) + PRIOR * share(w)) / (scale * count(v) + PRIOR)

which sums to 1 over the vocabulary for every v; the first word of a text comes after a symbol of its own.

Few pairs make up most of all text. Those with FREQUENT of all pairs or more (1 / FREQUENT at most, 24 bytes each) are
broadcast and scored where the texts are; all others are rare by proof, so that joining them to the counts by pair has no
hot key. A document's part sums meet by row number. Losses are added up as whole numbers: reruns agree to the bit.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import table, written

#: Share of all words that a word of the vocabulary has at least: 100,000 words at most.
LEAST_SHARE = 1e-5
#: Share of all pairs from which a pair is broadcast: 5,000,000 pairs at most.
FREQUENT = 2e-7
#: Weight of a word's own share against the counts after the word before.
PRIOR = 20.0
#: Distinct words, and pairs, that a counting task holds before it hands its counts on.
HELD_WORDS, HELD_PAIRS = 500_000, 4_000_000
#: Bits of a word's number in a pair; parts of a nat that losses are counted in.
BITS, UNIT = 20, 1 << 24

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n over all rows of ``texts(text)``, repeated rows too; the word null has the sum of all words."""
    schema = StructType([StructField("word", StringType()), StructField("n", LongType())])

    def run(batches):
        counts, total = Counter(), 0

        def handed_on():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), type=pa.string()), pa.array(list(counts.values()), type=pa.int64())], names=schema.names)

        for b in batches:
            for t in b.column("text"):
                words = words_of(t.as_py())
                counts.update(words)
                total += len(words)
                if len(counts) > HELD_WORDS:
                    yield handed_on()
                    counts.clear()
        yield handed_on()
        yield pa.RecordBatch.from_arrays([pa.array([None], type=pa.string()), pa.array([total])], names=schema.names)

    return texts.select("text").mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary(dict):
    """word -> number; the unknown word is number 0, and ``begin`` stands before the first word of a text."""

    def __missing__(self, word: str) -> int:
        return 0

    @property
    def begin(self) -> int:
        return len(self) + 1


def vocabulary_of(texts: DataFrame) -> Vocabulary:
    """Words with LEAST_SHARE of all words or more, the most frequent first."""
    counts = written(word_counts(texts), "lm-words")
    total = counts.where("word is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    known = counts.where(F.col("word").isNotNull() & (F.col("n") >= LEAST_SHARE * total)).collect()  # 1 / LEAST_SHARE rows at most
    known = sorted(((-r["n"], r["word"]) for r in known))
    return Vocabulary({w: i + 1 for i, (_, w) in enumerate(known)})


def pairs_of(numbers: np.ndarray, begin: int) -> np.ndarray:
    """Each word of a text with the one before it, as one number."""
    return np.r_[begin, numbers[:-1]] << BITS | numbers if len(numbers) else numbers


def numbers_of(text: str | None, vocabulary: Vocabulary) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(vocabulary.__getitem__, words), dtype=np.int64, count=len(words))


def target_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text of each row of ``docs`` whose id is labelled as good; a null id has no label. Ids and texts meet by id, at any size."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("good_id")).distinct()
    return docs.select("doc_id", "text").join(good.hint("merge"), F.col("doc_id") == F.col("good_id"), "left_semi").select("text")


def pair_counts(background: DataFrame, target: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """pair, n, n_target: exact counts of neighbours within texts, over all rows of either."""
    shared = background.sparkSession.sparkContext.broadcast(vocabulary)
    schema = StructType([StructField("pair", LongType()), StructField("n", LongType())])

    def run(batches):
        v = shared.value
        held, size = [], 0

        def handed_on():
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.table([pa.array(pairs), pa.array(n)], names=schema.names).to_batches(max_chunksize=1 << 17)

        for b in batches:
            for t in b.column("text"):
                held.append(pairs_of(numbers_of(t.as_py(), v), v.begin))
                size += len(held[-1])
                if size > HELD_PAIRS:
                    yield from handed_on()
                    held, size = [], 0
        if held:
            yield from handed_on()

    none = F.lit(0).cast("long")
    all_ = background.select("text").mapInArrow(run, schema).select("pair", "n", none.alias("n_target"))
    good = target.select("text").mapInArrow(run, schema).select("pair", none.alias("n"), F.col("n").alias("n_target"))
    return all_.unionByName(good).groupBy("pair").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))


class Models:
    """Both models: the vocabulary, counts after and shares of each of its words, frequent pairs, and the table of all pairs."""

    def __init__(self, vocabulary: Vocabulary, pairs: DataFrame):
        size = len(vocabulary) + 2
        self.vocabulary, self.pairs = vocabulary, pairs
        self.after, self.share = np.zeros((2, size), dtype=np.int64), np.zeros((2, size))  # background, target

        def sums(word):  # as many rows as the vocabulary has, at most
            found = pairs.groupBy(word.alias("w")).agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target")).toArrow()
            out = np.zeros((2, size), dtype=np.int64)
            out[:, found.column("w").to_numpy()] = [found.column("n").to_numpy(), found.column("n_target").to_numpy()]
            return out

        self.after = sums(F.shiftright("pair", BITS))
        counts = sums(F.col("pair").bitwiseAND(F.lit((1 << BITS) - 1)))
        self.total = counts.sum(axis=1)
        self.scale = float(self.total[1] / self.total[0]) if self.total[0] else 0.0
        scaled = counts[:, : size - 1] * np.array([[self.scale], [1.0]])
        self.share[:, : size - 1] = (scaled + 0.5) / (scaled.sum(axis=1, keepdims=True) + 0.5 * (size - 1))
        often = pairs.where(F.col("n") >= max(2.0, FREQUENT * float(self.total[0]))).orderBy("pair").toArrow()
        self.often = [often.column(c).to_numpy() for c in ("pair", "n", "n_target")]

    def shared(self) -> tuple:
        return self.vocabulary, self.after, self.share, self.scale, self.often

    def words(self, spark: SparkSession) -> DataFrame:
        """w, after, after_target, prior, prior_target: a row for each word, as many as the vocabulary has."""
        n = self.after.shape[1]
        t = pa.table([np.arange(n, dtype=np.int64), self.after[0], self.after[1], PRIOR * self.share[0], PRIOR * self.share[1]], names=["w", "after", "after_target", "prior", "prior_target"])
        return spark.createDataFrame(t)


def train(docs: DataFrame, labels: DataFrame) -> Models:
    """Models of all rows of ``docs(doc_id, text)`` and of those labelled as good. No documents: all losses are 0."""
    vocabulary = vocabulary_of(docs)
    return Models(vocabulary, written(pair_counts(docs, target_texts(docs, labels), vocabulary), "lm-pairs"))


def losses_of(n, own, own_after, after, prior, scale) -> np.ndarray:
    """-log p of pairs seen ``n`` times, of them ``own`` in the document itself."""
    return -np.log((scale * (n - own) + prior) / (scale * (after - own_after) + PRIOR))


#: A row's words, its losses from frequent pairs (background, target, target without itself), and its other pairs.
_NAMES = ["n_tokens", "b", "t", "u", "pairs", "times", "afters"]


def _scan(rows: DataFrame, models: Models, left_out: bool) -> DataFrame:
    """``rows(row, at, text)`` without the text and with _NAMES. ``times`` and ``afters`` say how often the document has a
    pair and its first word."""
    kinds = [*[LongType()] * 4, ArrayType(LongType()), ArrayType(IntegerType()), ArrayType(IntegerType())]
    kept = ["row", "at"]
    schema = StructType([*[rows.schema[c] for c in kept], *[StructField(n, k) for n, k in zip(_NAMES, kinds, strict=True)]])
    shared = rows.sparkSession.sparkContext.broadcast(models.shared())

    def run(batches):
        vocabulary, after, share, scale, (often, n_often, n_target) = shared.value

        def scored(text):
            numbers = numbers_of(text, vocabulary)
            if not len(numbers):
                return 0, 0, 0, 0, numbers, numbers, numbers
            pairs, times = np.unique(pairs_of(numbers, vocabulary.begin), return_counts=True)
            v, w = pairs >> BITS, pairs & ((1 << BITS) - 1)
            firsts, place = np.unique(v, return_inverse=True)
            afters = np.bincount(place, weights=times, minlength=len(firsts)).astype(np.int64)[place]
            at = np.minimum(np.searchsorted(often, pairs), max(0, len(often) - 1))
            near = often[at] == pairs if len(often) else np.zeros(len(pairs), dtype=bool)
            p, t, a, k = at[near], times[near], afters[near], near
            own, own_after = (t, a) if left_out else (0 * t, 0 * a)
            parts = (
                losses_of(n_often[p], own, own_after, after[0, v[k]], PRIOR * share[0, w[k]], scale),
                losses_of(n_target[p], 0 * t, 0 * a, after[1, v[k]], PRIOR * share[1, w[k]], 1.0),
                losses_of(np.maximum(n_target[p], own), own, own_after, np.maximum(after[1, v[k]], own_after), PRIOR * share[1, w[k]], 1.0),
            )
            sums = [int(np.rint(x * UNIT).astype(np.int64) @ t) for x in parts]
            return len(numbers), *sums, pairs[~near], times[~near], afters[~near]

        for b in batches:
            for begin in range(0, b.num_rows, 500):  # bounds what rows hold at once
                part = b.slice(begin, 500)
                found = list(zip(*(scored(t.as_py()) for t in part.column("text")), strict=True))
                lists = []
                for values, kind in zip(found[4:], (pa.int64(), pa.int32(), pa.int32()), strict=True):
                    ends = np.r_[0, np.cumsum([len(x) for x in values])].astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values)).cast(kind)))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *[pa.array(x, type=pa.int64()) for x in found[:4]], *lists], names=schema.names)

    return rows.mapInArrow(run, schema)


def score(docs: DataFrame, models: Models, labels: DataFrame | None = None) -> DataFrame:
    """``docs`` without its text and with n_tokens, loss_target, loss_background (mean -log p of a word) and
    lm_score = loss_background - loss_target; over 0 is likelier under the target.

    With the ``labels`` of training, ``docs`` are those that the models counted: each document is left out of the counts
    after a word that it is scored by, in the background and, if labelled as good, in the target. Shares of single words
    stay. Without labels nothing is left out. Null and empty texts, and texts without words, have 0 everywhere. Columns of
    these names are replaced; rows stay, repeated ones too (as documents of their own); no rows give no rows.
    """
    names = ["n_tokens", "loss_target", "loss_background", "lm_score"]
    kept = [c for c in docs.columns if c not in ["text", *names]]
    one = F.struct(*[F.col(f"`{c}`") for c in kept], F.lit(0).alias("__none")).alias("row")
    left_out = labels is not None
    rows = written(_scan(docs.select(one, F.monotonically_increasing_id().alias("at"), "text"), models, left_out), "lm-rows")

    each = rows.select("at", F.explode(F.arrays_zip("pairs", "times", "afters")).alias("x")).select("at", F.col("x.pairs").alias("pair"), F.col("x.times").alias("own"), F.col("x.afters").alias("own_after"))
    words = models.words(docs.sparkSession)
    first = F.broadcast(words.select(F.col("w").alias("v"), "after", "after_target"))  # 1 / LEAST_SHARE rows at most
    second = F.broadcast(words.select("w", "prior", "prior_target"))
    counted = each.join(models.pairs, "pair", "left").fillna(0, ["n", "n_target"])
    counted = counted.withColumn("v", F.shiftright("pair", BITS)).withColumn("w", F.col("pair").bitwiseAND(F.lit((1 << BITS) - 1)))
    counted = counted.join(first, "v").join(second, "w")

    def summed(n, after, prior, scale, out, own=True):
        a, b = (F.col("own"), F.col("own_after")) if left_out and own else (F.lit(0), F.lit(0))
        p = (F.lit(scale) * F.greatest(n - a, F.lit(0)) + prior) / (F.lit(scale) * F.greatest(after - b, F.lit(0)) + F.lit(PRIOR))
        return F.sum(F.rint(-F.log(p) * UNIT).cast("long") * F.col("own")).alias(out)

    n, m, after, after_m = (F.col(c) for c in ("n", "n_target", "after", "after_target"))
    parts = counted.groupBy("at").agg(
        summed(n, after, F.col("prior"), models.scale, "b2"), summed(m, after_m, F.col("prior_target"), 1.0, "t2", own=False), summed(m, after_m, F.col("prior_target"), 1.0, "u2")
    )
    whole = rows.drop("pairs", "times", "afters").join(parts, "at", "left").fillna(0, ["b2", "t2", "u2"])
    if left_out and "doc_id" in kept:
        good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("good_id")).distinct()
        whole = whole.join(good, F.col("row.doc_id") == F.col("good_id"), "left")
        target = F.when(F.col("good_id").isNotNull(), F.col("u") + F.col("u2")).otherwise(F.col("t") + F.col("t2"))
    else:
        target = F.col("t") + F.col("t2")
    mean = lambda total: F.when(F.col("n_tokens") > 0, total / (F.lit(float(UNIT)) * F.col("n_tokens"))).otherwise(F.lit(0.0))
    out = whole.select(*[F.col("row")[c].alias(c) for c in kept], "n_tokens", mean(target).alias("loss_target"), mean(F.col("b") + F.col("b2")).alias("loss_background"))
    return out.withColumn("lm_score", F.col("loss_background") - F.col("loss_target"))


def op5(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    return score(docs, train(docs, labels), labels)
