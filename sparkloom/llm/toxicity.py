"""Toxicity by cumulative-link ordinal regression: P(grade <= k) = sigmoid(threshold_k - w . x).

One weight vector serves all ordered thresholds. Features are sparse: the distinct words of the whole text, by
hash. Labels say toxic or not; the grades of toxic documents come from how many distinct words they have that
labels tie to toxicity (terciles). The model is fitted on a bounded sample of labelled rows (SAMPLE for each
label, taken by a hash of the id); its size is fixed by FEATURES. Scoring runs where the documents are.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from .common import labelled_sample, table

FEATURES = 1 << 18
GRADES = 4
#: Labelled texts of each label that a fit may read, at most, and their bytes together.
SAMPLE, SAMPLE_BYTES = 4000, 32 << 20
#: Rows of the sample that must have a feature, and how much purer than chance a marker of toxicity is.
LEAST_ROWS, MARKER_ODDS = 4, 8.0
L1, EPOCHS = 3e-4, 400
STEM = 4
#: A document is rejected where a grade above 0 is likelier than this.
REJECT = 0.5

_WORD = re.compile(r"[^\W_]+")


def word_features(word: str) -> tuple[int, int]:
    """The word itself, and its first STEM letters, which inflected forms share."""
    return zlib.crc32(word.encode()) % FEATURES, zlib.crc32(f"{word[:STEM]}*".encode()) % FEATURES


def features(text: str | None) -> set[int]:
    return set().union(*map(word_features, set(_WORD.findall((text or "").lower()))))


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id (as text), toxic, x for a labelled_sample(); a text has fewer features than bytes, so they are bounded too."""
    texts = labelled_sample(docs, labels, "toxic", most, most_bytes)
    schema = StructType([StructField("doc_id", StringType()), StructField("toxic", IntegerType()), StructField("x", ArrayType(IntegerType()))])

    def run(batches):
        for b in batches:
            x = [sorted(features(t.as_py())) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.string()), b.column("label"), pa.array(x, type=pa.list_(pa.int32()))], names=schema.names)

    return texts.mapInArrow(run, schema)


class OrdinalModel:
    """Weights by feature and GRADES - 1 ascending thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade = k), one row for each score."""
        upto = _sigmoid(self.thresholds[None, :] - score[:, None])
        full = np.concatenate([np.zeros((len(score), 1)), upto, np.ones((len(score), 1))], axis=1)
        return np.diff(full, axis=1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def grades(toxic: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """0 for documents that aren't toxic, 1 to GRADES - 1 by terciles of the markers that the others have."""
    bad = toxic[rows] == 1
    in_bad = np.bincount(columns[bad], minlength=FEATURES).astype(float)
    in_good = np.bincount(columns[~bad], minlength=FEATURES).astype(float)
    n_bad, n_good = max(1, int((toxic == 1).sum())), max(1, int((toxic == 0).sum()))
    odds = ((in_bad + 0.5) / n_bad) / ((in_good + 0.5) / n_good)
    marker = (in_bad >= LEAST_ROWS) & (odds >= MARKER_ODDS)
    count = np.bincount(rows[marker[columns]], minlength=len(toxic))
    out = np.zeros(len(toxic), dtype=np.int64)
    if (toxic == 1).any():
        cuts = np.quantile(count[toxic == 1], [(k + 1) / (GRADES - 1) for k in range(GRADES - 2)])
        out[toxic == 1] = 1 + (count[toxic == 1][:, None] > cuts[None, :]).sum(axis=1)
    return out


def fit(toxic: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> OrdinalModel:
    """Proximal gradient steps (AdaGrad, L1) on the mean log loss; without examples of both labels nothing is toxic.

    ``rows`` and ``columns`` are the places of the features that are there.
    """
    if len(set(toxic.tolist())) < 2:
        return OrdinalModel(np.zeros(FEATURES), np.array([30.0, 31.0, 32.0])[: GRADES - 1])
    y = grades(toxic, rows, columns)
    often = np.bincount(columns, minlength=FEATURES) >= LEAST_ROWS
    rows, columns = rows[often[columns]], columns[often[columns]]
    used, place = np.unique(columns, return_inverse=True)
    share = 1.0 / len(y)
    w, first, steps = np.zeros(len(used)), 1.0, np.zeros(GRADES - 2)  # threshold_k = first + sum of exp(steps)
    gw, gt = np.full(len(used), 1e-8), np.full(GRADES - 1, 1e-8)
    rate = 0.3
    for _ in range(EPOCHS):
        theta = first + np.r_[0.0, np.cumsum(np.exp(steps))]
        s = np.bincount(rows, weights=w[place], minlength=len(y))
        upto = np.concatenate([np.zeros((len(y), 1)), _sigmoid(theta[None, :] - s[:, None]), np.ones((len(y), 1))], axis=1)
        high, low = upto[np.arange(len(y)), y + 1], upto[np.arange(len(y)), y]
        p = np.maximum(high - low, 1e-9)
        slope_high, slope_low = high * (1 - high), low * (1 - low)
        by_score = share * (slope_high - slope_low) / p  # d(-log p)/ds
        grad_w = np.bincount(place, weights=by_score[rows], minlength=len(used))
        at_threshold = np.zeros(GRADES + 1)
        np.add.at(at_threshold, y + 1, -share * slope_high / p)
        np.add.at(at_threshold, y, share * slope_low / p)
        by_theta = at_threshold[1:GRADES]
        tail = np.cumsum(by_theta[::-1])[::-1]
        grad_t = np.r_[tail[0], tail[1:] * np.exp(steps)]
        gw += grad_w**2
        gt += grad_t**2
        step = rate / np.sqrt(gw)
        w = w - step * grad_w
        w = np.sign(w) * np.maximum(np.abs(w) - step * L1, 0)
        move = rate / np.sqrt(gt) * grad_t
        first, steps = first - move[0], np.clip(steps - move[1:], -6, 6)
    weights = np.zeros(FEATURES)
    weights[used] = w
    return OrdinalModel(weights, first + np.r_[0.0, np.cumsum(np.exp(steps))])


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> OrdinalModel:
    """A model fitted on a bounded sample; numbers of features, not texts, reach the driver, as Arrow columns."""
    t = sample(docs, labels, most, most_bytes).toArrow().combine_chunks()
    ids, toxic = t.column("doc_id").to_pylist(), t.column("toxic").to_numpy().astype(np.int64)
    lengths = pc.list_value_length(t.column("x")).to_numpy().astype(np.int64)
    columns = pc.list_flatten(t.column("x")).to_numpy().astype(np.int32)
    # By id, whatever the order of tasks; equal ids by what they have.
    marks = np.bincount(np.repeat(np.arange(len(ids)), lengths), weights=columns, minlength=len(ids)) if ids else np.zeros(0)
    keys = list(zip(ids, toxic.tolist(), lengths.tolist(), marks.tolist(), strict=True))
    order = np.array(sorted(range(len(ids)), key=keys.__getitem__), dtype=np.int64)
    place = np.empty(len(ids), dtype=np.int32)
    place[order] = np.arange(len(ids), dtype=np.int32)
    rows = np.repeat(place, lengths)
    by_row = np.argsort(rows, kind="stable")
    return fit(toxic[order], rows[by_row], columns[by_row])


def score(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """``docs`` without ``text_col`` and with severity (expected grade), p_toxic, grade (likeliest), toxic (0 or 1).

    Null and empty texts have no features and take the grade that the thresholds alone give. Columns of these names
    are replaced; rows stay as they are, repeated ones too; no rows give no rows.
    """
    added = [("severity", DoubleType()), ("p_toxic", DoubleType()), ("grade", IntegerType()), ("toxic", IntegerType())]
    kept = [c for c in docs.columns if c not in [text_col, *[n for n, _ in added]]]
    schema = StructType([*[docs.schema[c] for c in kept], *[StructField(n, t) for n, t in added]])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        weighty = _Weighty(m.weights)
        for b in batches:
            s = np.zeros(b.num_rows)
            for i, t in enumerate(b.column(text_col)):
                words = set(_WORD.findall((t.as_py() or "").lower()))
                s[i] = m.weights[np.array(sorted(set().union(*map(weighty.__getitem__, words))), dtype=np.int64)].sum()
            weighty.trim()
            p = m.probabilities(s) if len(s) else np.zeros((0, GRADES))
            toxic = 1.0 - p[:, 0]
            columns = [p @ np.arange(GRADES), toxic, p.argmax(axis=1).astype(np.int32), (toxic > REJECT).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *map(pa.array, columns)], names=schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in [*kept, text_col]]).mapInArrow(run, schema)


class _Weighty(dict):
    """word -> its features that have a weight, for the words met so far."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weighs = weights != 0

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = self[word] = tuple(f for f in word_features(word) if self.weighs[f])
        return found

    def trim(self, most: int = 500_000) -> None:
        if len(self) > most:
            self.clear()


def keep_clean(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with their columns and no others."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    return score(rows, model).where("toxic = 0").select("row.*")


def op9(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model)
