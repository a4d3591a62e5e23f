"""Hard negatives by a vector-approximation file.

Components become integers, so scores are exact. A file of approximations has one byte for each of them, the cell of
its dimension that it lies in. For a block of anchors, tables say the least and the most that a cell adds to a score;
summed over the dimensions they bound the score of a row from its cells alone. Only rows whose bounds let them into
an anchor's best ones, or into a window of scores, are scored by their vectors.

Anchors are a query set; rows meet it in blocks: a group of anchors of bounded size goes to all tasks, each of which
goes through its rows once for the positives and once for the negatives and hands on its best few for each anchor.
Rows don't move, whatever their labels are. The work is anchors times rows, as the queries ask for all rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import fresh_path, table, written

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: Percent of a positive's score between which its negatives' lie.
WINDOW = (30, 90)
CELLS = 256
#: Standard deviations around a dimension's mean that its inner cells cover; the outermost cells have the rest.
SPREAD = 4
#: Bytes of the vectors of a group of anchors, which is broadcast.
GROUP_BYTES = 16 * 1024 * 1024
#: Anchors that share a table, and rows of a block.
TOGETHER, ROWS = 64, 8192


def component_limit(dims: int) -> int:
    """Components beyond this are taken as it, so that no score, nor 100 times it, leaves 64 bits."""
    return math.isqrt((1 << 55) // max(dims, 1))


def integers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    limit = min(component_limit(vectors.shape[1]), (1 << 31) - 1)
    return np.clip(np.floor(vectors.astype(np.float64) * scale), -limit, limit).astype(np.int32)


def prepared(rows: DataFrame, dims: int, scale: int) -> DataFrame:
    """``rows(vec_id, label, anchor, vector array<double>)`` with at, a number of the row, and its integers as bytes, written."""
    schema = StructType([*[f for f in rows.schema.fields if f.name != "vector"], StructField("at", LongType()), StructField("vector", BinaryType())])
    kept = [c for c in rows.columns if c != "vector"]

    def run(batches):
        for b in batches:
            lists = b.column("vector")
            lengths = np.asarray(lists.value_lengths(), dtype=np.int64)
            flat = np.asarray(lists.flatten(), dtype=np.float64)
            whole = np.zeros((len(lengths), dims))
            whole[np.arange(dims) < lengths[:, None]] = flat  # a shorter vector's further components are 0
            found = integers(whole, scale)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], b.column("at"), pa.array([v.tobytes() for v in found], type=pa.binary())], names=schema.names)

    return written(rows.withColumn("at", F.monotonically_increasing_id()).mapInArrow(run, schema), "negatives-vectors")


def _matrix(column, dims: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), dims)


def dimensions(vectors: DataFrame, dims: int) -> np.ndarray:
    """least, most, mean and standard deviation of each dimension over all rows."""
    fields = "dim int, n long, s double, q double, least long, most long"

    def run(batches):
        n, s, q, least, most = 0, np.zeros(dims), np.zeros(dims), np.full(dims, np.iinfo(np.int64).max), np.full(dims, np.iinfo(np.int64).min)
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column("vector"), dims, np.int32).astype(np.int64)
                n, s, q = n + len(v), s + v.sum(axis=0), q + np.square(v.astype(np.float64)).sum(axis=0)
                least, most = np.minimum(least, v.min(axis=0)), np.maximum(most, v.max(axis=0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(np.full(dims, n)), pa.array(s), pa.array(q), pa.array(least), pa.array(most)], names=["dim", "n", "s", "q", "least", "most"])

    sums = vectors.select("vector").mapInArrow(run, fields).groupBy("dim").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")], F.min("least").alias("least"), F.max("most").alias("most"))
    out = np.zeros((4, dims))
    for r in sums.collect():  # a row for each dimension
        mean = r["s"] / r["n"]
        out[:, r["dim"]] = r["least"], r["most"], mean, math.sqrt(max(0.0, r["q"] / r["n"] - mean * mean))
    return out


class Cells:
    """For each dimension CELLS cells: equal steps of whole numbers around its mean, and what lies below and above them."""

    def __init__(self, described: np.ndarray):
        least, most, mean, spread = described
        self.begin = np.maximum(least, np.floor(mean - SPREAD * spread)).astype(np.int64)
        end = np.minimum(most, np.ceil(mean + SPREAD * spread)).astype(np.int64)
        self.step = np.maximum(1, -(-(end - self.begin + 1) // (CELLS - 2)))
        edges = self.begin[:, None] + self.step[:, None] * np.arange(CELLS - 1)
        least, most = least.astype(np.int64)[:, None], most.astype(np.int64)[:, None]
        self.low = np.clip(np.concatenate([least, edges], axis=1), least, most)
        self.high = np.clip(np.concatenate([edges - 1, most], axis=1), least, most)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        return np.clip((vectors - self.begin) // self.step + 1, 0, CELLS - 1).astype(np.uint8)

    def tables(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the most that a cell of each dimension adds to each anchor's score: dimensions x CELLS x anchors."""
        reach = np.maximum(np.abs(self.low), np.abs(self.high)).max(axis=1)
        kind = np.int32 if (np.abs(anchors.astype(np.float64)) @ reach).max(initial=0) < 2**31 - 1 else np.int64
        q = anchors.T.astype(kind)[:, None, :]
        a, b = self.low.astype(kind)[:, :, None] * q, self.high.astype(kind)[:, :, None] * q
        return np.minimum(a, b), np.maximum(a, b)


def bounds(codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """rows x anchors: what the tables add up to for each row's cells (``codes``: dimensions x rows)."""
    out = np.zeros((codes.shape[1], tables.shape[2]), dtype=tables.dtype)
    part = np.empty_like(out)
    for d in range(len(codes)):
        np.take(tables[d], codes[d], axis=0, out=part, mode="clip")
        out += part
    return out


def _largest(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each column."""
    return np.partition(values, len(values) - k, axis=0)[len(values) - k]


class Best:
    """The first ``k`` entries of each anchor of a block: higher scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.rows = k, np.zeros((0, 3), dtype=np.int64)  # anchor, -score, id

    def add(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if len(anchor):
            rows = np.concatenate([self.rows, np.stack([anchor, -score, ids], axis=1)])
            rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
            starts = np.r_[0, np.flatnonzero(np.diff(rows[:, 0])) + 1]
            place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
            self.rows = rows[place < self.k]

    def least(self, floor: np.ndarray) -> np.ndarray:
        """The score below which nothing enters any more, ``floor`` or the k-th entry's, for each anchor."""
        out = floor.copy()
        anchors, counts = np.unique(self.rows[:, 0], return_counts=True)
        full = counts == self.k
        out[anchors[full]] = np.maximum(out[anchors[full]], -self.rows[np.cumsum(counts)[full] - 1, 1])
        return out


def _exact(vectors: np.ndarray, row: np.ndarray, anchors: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    out = np.empty(len(row), dtype=np.int64)
    for i in range(0, len(row), 1 << 15):
        part = slice(i, i + (1 << 15))
        out[part] = np.einsum("ij,ij->i", vectors[row[part]].astype(np.int64), anchors[anchor[part]].astype(np.int64))
    return out


_NONE = np.iinfo(np.int64).min


def positives_of_block(block, cells: Cells, group, some: slice, best: Best, k: int) -> None:
    """Adds to ``best`` what a block of rows has for the anchors ``some``: the other rows of their label."""
    at, ids, labels, vectors, codes = block
    low, high = cells.tables(group.vectors[some])
    mine = (labels[:, None] == group.labels[some]) & (at[:, None] != group.at[some])
    floor = best.least(np.full(mine.shape[1], _NONE))
    if len(at) >= k:
        sure = np.where(mine, bounds(codes, low).astype(np.int64), _NONE)
        floor = np.maximum(floor, _largest(sure, k))
    row, anchor = np.nonzero(mine & (bounds(codes, high) >= floor))
    best.add(anchor, _exact(vectors, row, group.vectors[some], anchor), ids[row])


def windows(scores: np.ndarray, window: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The least and the most score that lie between ``window`` percent of each score."""
    return -((-window[0] * scores) // 100), (window[1] * scores) // 100


def negatives_of_block(block, cells: Cells, group, some: slice, best: list[Best], window: tuple[int, int]) -> None:
    """Adds to ``best``, one for each positive's place, what a block of rows has in the windows of the anchors ``some``."""
    _, ids, labels, vectors, codes = block
    low, high = cells.tables(group.vectors[some])
    low, high = bounds(codes, low), bounds(codes, high)
    other = labels[:, None] != group.labels[some]
    floors, tops, possible = [], [], np.zeros_like(other)
    for j, kept in enumerate(best):
        least, most = windows(group.scores[some, j], window)
        least = np.where(group.there[some, j] & (least <= most), least, np.iinfo(np.int64).max)  # no window
        floor = kept.least(least)
        if len(ids) >= kept.k and (floor == least).any():
            sure = np.where(other & (low >= least) & (high <= most), low.astype(np.int64), _NONE)
            floor = np.maximum(floor, _largest(sure, kept.k))
        floors.append(floor)
        tops.append(most)
        possible |= (high >= floor) & (low <= most)
    row, anchor = np.nonzero(possible & other)
    score = _exact(vectors, row, group.vectors[some], anchor)
    for kept, floor, most in zip(best, floors, tops, strict=True):
        enters = (score >= floor[anchor]) & (score <= most[anchor])
        kept.add(anchor[enters], score[enters], ids[row[enters]])


class Group:
    """Anchors that go to all tasks, and what is known of them."""

    def __init__(self, rows: list, dims: int, k: int):
        self.at = np.array([r["at"] for r in rows], dtype=np.int64)
        self.ids = np.array([r["vec_id"] for r in rows], dtype=np.int64)
        self.labels = np.array([r["label"] for r in rows], dtype=np.int64)
        self.vectors = np.frombuffer(b"".join(bytes(r["vector"]) for r in rows), dtype=np.int32).reshape(len(rows), dims)
        self.scores, self.positives, self.there = np.zeros((len(rows), k), dtype=np.int64), np.zeros((len(rows), k), dtype=np.int64), np.zeros((len(rows), k), dtype=bool)

    def put(self, rows: list) -> None:
        """Rows (anchor, place from 1, id, score) of positives."""
        for r in rows:
            where = r["anchor"], r["place"] - 1
            self.positives[where], self.scores[where], self.there[where] = r["id"], r["score"], True

    def blocks(self) -> list[slice]:
        return [slice(i, i + TOGETHER) for i in range(0, len(self.at), TOGETHER)]


def approximations(vectors: DataFrame, cells: Cells, dims: int) -> DataFrame:
    """``vectors`` with the row's cells, written: the vector-approximation file and the vectors beside it."""
    schema = StructType([*vectors.schema.fields, StructField("codes", BinaryType())])

    def run(batches):
        for b in batches:
            codes = cells.of(_matrix(b.column("vector"), dims, np.int32).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in codes], type=pa.binary())], names=schema.names)

    return written(vectors.mapInArrow(run, schema), "negatives-cells")


def _scan(file: DataFrame, dims: int, begin, take, end, fields: StructType) -> DataFrame:
    """end(state) after take(state, block) for all blocks of ROWS rows of a task, with state = begin()."""

    def run(batches):
        state, held, n = begin(), [], 0

        def block():
            whole = pa.Table.from_batches(held)
            numbers = [whole.column(c).to_numpy() for c in ("at", "vec_id", "label")]
            codes = _matrix(whole.column("codes"), dims, np.uint8).T.astype(np.intp)
            return *numbers, _matrix(whole.column("vector"), dims, np.int32), codes

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= ROWS:
                take(state, block())
                held, n = [], 0
        if n:
            take(state, block())
        columns = end(state)
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=fields.names)

    return file.select("at", "vec_id", "label", "vector", "codes").mapInArrow(run, fields)


def _longs(*names: str) -> StructType:
    return StructType([StructField(n, LongType()) for n in names])


def _first(rows: DataFrame, keys: list[str], k: int, place: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return rows.withColumn(place, F.row_number().over(order)).where(F.col(place) <= k)


def _positives(file: DataFrame, cells: Cells, group, dims: int, k: int) -> DataFrame:
    """anchor (its place in the group), place, id, score: the first ``k`` other rows of the anchor's label."""

    def take(state, block):
        for some, best in state:
            positives_of_block(block, cells, group.value, some, best, k)

    def end(state):
        parts = np.concatenate([np.zeros((0, 3), dtype=np.int64), *[best.rows + [some.start, 0, 0] for some, best in state]])
        return parts[:, 0].copy(), parts[:, 2].copy(), -parts[:, 1]

    found = _scan(file, dims, lambda: [(some, Best(k)) for some in group.value.blocks()], take, end, _longs("anchor", "id", "score"))
    return _first(found, ["anchor"], k, "place")


def _negatives(file: DataFrame, cells: Cells, group, dims: int, places: int, k: int, window: tuple[int, int]) -> DataFrame:
    """The first ``k`` rows in the window of each positive of the group."""

    def take(state, block):
        for some, best in state:
            negatives_of_block(block, cells, group.value, some, best, window)

    def end(state):
        parts = np.concatenate([np.zeros((0, 4), dtype=np.int64), *[np.column_stack([b.rows + [some.start, 0, 0], np.full(len(b.rows), j)]) for some, best in state for j, b in enumerate(best)]])
        anchor, place = parts[:, 0], parts[:, 3]
        g = group.value
        return g.at[anchor], g.ids[anchor], place.copy(), g.positives[anchor, place], g.scores[anchor, place], parts[:, 2].copy(), -parts[:, 1]

    fields = _longs("anchor", "anchor_id", "place", "positive_id", "positive_score", "id", "score")
    found = _scan(file, dims, lambda: [(some, [Best(k) for _ in range(places)]) for some in group.value.blocks()], take, end, fields)
    return _first(found, ["anchor", "place"], k, "rank")


def mine(rows: DataFrame, anchor, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, scale: int = SCALE, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Hard negatives of the rows for which ``anchor``, a condition on ``rows``, holds; written.

    A component x counts as floor(scale * x), a score is the integer inner product. For an anchor's first ``positives``
    other rows of its label, each with the first ``negatives`` rows of other labels whose score is between ``window``
    percent of the positive's (none if that is negative): anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score. Ties go to smaller ids. All rows are candidates for all anchors.

    Rows with a null id, label, vector or component, or one that isn't finite, take no part. Repeated rows are rows of
    their own: a repeated anchor has its results twice, and its copy is one of its positives. Vectors may differ in
    length; what the shorter one lacks is 0. Components beyond component_limit() count as that. No rows give no rows.
    """
    spark = rows.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    taken = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(usable, F.lit(False)))
    taken = taken.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), vector.alias("vector"))
    dims = max(1, taken.agg(F.max(F.size("vector")).alias("most")).first()["most"] or 0)
    vectors = prepared(taken, dims, scale)
    cells = Cells(dimensions(vectors, dims))
    file = approximations(vectors, cells, dims)
    anchors = vectors.where("anchor").select("at", "vec_id", "label", "vector")
    groups = max(1, math.ceil(2 * 4 * dims * anchors.count() / group_bytes))  # twice as many as would do: hashing doesn't deal evenly
    out = fresh_path(spark, "negatives")
    columns = ["anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")]
    for g in range(groups):
        group = Group(anchors.where(F.pmod(F.xxhash64("at"), F.lit(groups)) == g).collect(), dims, positives)  # group_bytes at most
        sent = spark.sparkContext.broadcast(group)
        group.put(_positives(file, cells, sent, dims, positives).collect())
        again = spark.sparkContext.broadcast(group)
        _negatives(file, cells, again, dims, positives, negatives, window).select(*columns).write.mode("append").parquet(out)
        sent.destroy()
        again.destroy()
    schema = StructType.fromDDL("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return spark.read.schema(schema).parquet(out)


def op12(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH usable AS (
  SELECT row_number() OVER () AS at, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.at AS anchor, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, a.at = b.at AS self, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0
),
positives AS (
  SELECT anchor, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS place
  FROM scored WHERE same AND NOT self QUALIFY place <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
  s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
