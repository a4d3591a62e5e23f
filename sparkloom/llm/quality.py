"""Quality classifier: a byte-level convolutional network in numpy.

Each byte has a learned vector; learned filters slide over overlapping chunks that cover the whole document, and each
chunk keeps every filter's maximum. A document's probability combines the maximum and the mean over its chunks.
Filters are learned by back-propagation on a bounded sample of labelled texts, SAMPLE of each label at most and
SAMPLE_BYTES of them, whole ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import labelled_sample, table

#: Numbers for a byte, bytes that a filter spans, filters, bytes from one position to the next.
DIMS, SPAN, FILTERS, STRIDE = 8, 8, 24, 2
#: Bytes of a chunk and what two chunks share, so that no filter position is lost between them.
CHUNK = 512
OVERLAP = SPAN - STRIDE
STEP = CHUNK - OVERLAP
#: Chunks that are held at once.
BLOCK_CHUNKS = 256
#: Labelled texts of each label that a fit may read, at most, and their bytes together; passes over them, and rows of one step.
SAMPLE, SAMPLE_BYTES, EPOCHS, ROWS = 2000, 24 << 20, 6, 16
RATE, DECAY = 4e-3, 1e-4
GOOD = 0.7


def chunks_of(raw: bytes) -> np.ndarray:
    """Overlapping chunks that cover all bytes, one at least; the last is filled up with zero bytes."""
    n = max(1, -(-max(0, len(raw) - OVERLAP) // STEP))
    data = np.zeros(n * STEP + OVERLAP, dtype=np.uint8)
    data[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(data, CHUNK)[::STEP]


def blocks_of(raw: bytes):
    """The chunks of a text, BLOCK_CHUNKS at a time: memory doesn't grow with the text."""
    most = BLOCK_CHUNKS * STEP
    for begin in range(0, max(1, len(raw) - OVERLAP), most):
        yield chunks_of(raw[begin : begin + most + OVERLAP])


class ByteNet:
    """Weights of the network; arrays by name, so that a training step treats all alike."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.5, (256, DIMS)), "filters": r.normal(0, (SPAN * DIMS) ** -0.5, (SPAN * DIMS, FILTERS)),
            "bias": np.zeros(FILTERS), "top": r.normal(0, 0.1, FILTERS), "mean": r.normal(0, 0.1, FILTERS), "out": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def pool(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each chunk's maximum of every filter, and where it is."""
        n = len(chunks)
        vectors = self.p["embed"][chunks].reshape(n, CHUNK * DIMS)
        windows = np.lib.stride_tricks.sliding_window_view(vectors, SPAN * DIMS, axis=1)[:, :: STRIDE * DIMS]
        places = windows.shape[1]
        values = (windows.reshape(n * places, SPAN * DIMS) @ self.p["filters"]).reshape(n, places, FILTERS)
        at = values.argmax(axis=1)
        best = np.take_along_axis(values, at[:, None, :], axis=1)[:, 0] + self.p["bias"]
        return np.maximum(best, 0), at

    def probability(self, raw: bytes) -> float:
        top, total, n = np.zeros(FILTERS), np.zeros(FILTERS), 0
        for chunks in blocks_of(raw):
            best, _ = self.pool(chunks)
            top = np.maximum(top, best.max(axis=0))
            total += best.sum(axis=0, dtype=np.float64)
            n += len(chunks)
        return float(_sigmoid(top @ self.p["top"] + total / n @ self.p["mean"] + self.p["out"][0]))

    def gradients(self, raws: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss of a few documents."""
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        for raw, label in zip(raws, labels.tolist(), strict=True):
            found = [(chunks, *self.pool(chunks)) for chunks in blocks_of(raw)]
            best = np.concatenate([b for _, b, _ in found])
            top_at = best.argmax(axis=0)
            top, mean = best[top_at, np.arange(FILTERS)], best.mean(axis=0)
            d = np.float32((_sigmoid(top @ self.p["top"] + mean @ self.p["mean"] + self.p["out"][0]) - label) / len(raws))
            g["top"] += d * top
            g["mean"] += d * mean
            g["out"] += d
            by_best = np.repeat((d * self.p["mean"] / len(best))[None, :], len(best), axis=0)
            by_best[top_at, np.arange(FILTERS)] += d * self.p["top"]
            by_best *= best > 0
            begin = 0
            for chunks, b, at in found:
                part = by_best[begin : begin + len(b)]
                begin += len(b)
                g["bias"] += part.sum(axis=0)
                # Only the winning positions have a gradient: chunks by filters of them, SPAN bytes each.
                winners = chunks[np.arange(len(b))[:, None, None], (at * STRIDE)[:, :, None] + np.arange(SPAN)]
                seen = self.p["embed"][winners].reshape(len(b), FILTERS, SPAN * DIMS)
                g["filters"] += np.einsum("cf,cfk->kf", part, seen)
                back = (part[:, :, None] * self.p["filters"].T[None]).reshape(-1, DIMS)
                for k in range(DIMS):
                    g["embed"][:, k] += np.bincount(winners.ravel(), weights=back[:, k], minlength=256)
        return g


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit(raws: list[bytes], labels: list[int], seed: int = 7) -> ByteNet:
    """Adam on rows drawn evenly from both labels."""
    net, y = ByteNet(seed), np.array(labels, dtype=np.float32)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        net.p["out"][:] = 3.0 if len(good) else -3.0
        return net
    r = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    half = ROWS // 2
    steps = max(400, EPOCHS * max(len(good), len(bad)) // half)
    for step in range(1, steps + 1):
        rows = np.concatenate([r.choice(good, half), r.choice(bad, half)])
        rate = RATE * (1 - 0.9 * step / steps)
        for k, g in net.gradients([raws[i] for i in rows], y[rows]).items():
            g = g + DECAY * net.p[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            net.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
    return net


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is never learnt from. A null id has no label and isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> ByteNet:
    """A network fitted on a labelled_sample() of documents that aren't held out; repeated rows are one text."""
    t = labelled_sample(docs, labels.where(~held_out(F.col("doc_id"))), "quality", most, most_bytes).toArrow()
    rows = sorted(zip(t.column("id").to_pylist(), t.column("label").to_pylist(), t.column("text").to_pylist(), strict=True))
    return fit([text.encode("utf-8") for _, _, text in rows], [label for _, label, _ in rows])


def score(docs: DataFrame, net: ByteNet, text_col: str = "text") -> DataFrame:
    """``docs`` without ``text_col`` and with score (probability of label 1) and predicted (score >= GOOD).

    A null text is an empty one: a chunk of zero bytes. Whole texts; equal texts have equal scores. Columns of these
    names are replaced; rows stay, repeated ones too; no rows give no rows.
    """
    kept = [c for c in docs.columns if c not in (text_col, "score", "predicted")]
    schema = StructType([*[docs.schema[c] for c in kept], StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        model = shared.value
        for b in batches:
            scores = np.array([model.probability((t.as_py() or "").encode("utf-8")) for t in b.column(text_col)], dtype=np.float64)
            columns = [pa.array(scores), pa.array((scores >= GOOD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *columns], names=schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in [*kept, text_col]]).mapInArrow(run, schema)


def op6(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = train(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
