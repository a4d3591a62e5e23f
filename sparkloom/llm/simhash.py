"""SimHash near-duplicates: BK-trees over the distinct fingerprints of shards, then connected components.

Two 64-bit fingerprints at distance 3 or less agree in one of four 16-bit bands at least. So every distinct
fingerprint goes to four shards, one for each band and its value there, and no link is lost. A shard is
searched with a BK-tree (children keyed by their Hamming distance to the parent; a search follows only edges
within the radius) that is built while its fingerprints arrive; what a search finds is united, so a shard
returns a spanning forest, never all its pairs.

A shard with more than HOT fingerprints is dealt out again: members agree in 16 bits, so links inside it agree
in one of four bands of the other 48 as well, and once more in bands of what is left. Trees are built where
their queries are: broadcasting all trees to all queries would grow with the corpus, and this finds the same links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import table, written
from .components import star_components

#: Fingerprints of a shard beyond which it is dealt out by further bands, and how often that is done.
HOT, REFINEMENTS = 2000, 2
RADIUS = 3


def majority(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of each column of hashes: a bit is 1 if it is set in over half of them."""
    ones = np.zeros(64 * hashes.shape[1], dtype=np.int64)
    for begin in range(0, len(hashes), 1 << 12):  # bounds what one long text takes
        octets = np.ascontiguousarray(hashes[begin : begin + (1 << 12)]).view(np.uint8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def fingerprint_text(text: str | None, shingle: int, repeats: bool = True) -> int:
    """The SimHash of a text as an unsigned integer; of its distinct shingles only, unless ``repeats``."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    parts = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    parts = parts if repeats else list(dict.fromkeys(parts))
    hashes = np.fromiter((digest(p, 42) for p in parts), dtype=np.uint64, count=len(parts))
    return int(majority(hashes[:, None])[0])


def fingerprints(docs: DataFrame, shingle: int = 3, repeats: bool = True, text_col: str = "text", out: str = "fp") -> DataFrame:
    """``docs`` without ``text_col`` and with the fingerprint as a signed long in ``out``."""
    kept = [c for c in docs.columns if c not in (text_col, out)]
    schema = StructType([*[docs.schema[c] for c in kept], StructField(out, LongType())])

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint_text(t.as_py(), shingle, repeats) for t in b.column(text_col)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(fps)], names=[*kept, out])

    return docs.select(*[F.col(f"`{c}`") for c in [*kept, text_col]]).mapInArrow(run, schema)


class BKTree:
    """Fingerprints as nodes; ``children[i]`` maps a distance to the child of node i at it."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, q: int, radius: int) -> list[int]:
        """The nodes at most ``radius`` from q."""
        found, stack = [], [0] if self.values else []
        values, children = self.values, self.children
        while stack:
            i = stack.pop()
            d = (values[i] ^ q).bit_count()
            if d <= radius:
                found.append(i)
            low, high = d - radius, d + radius
            for edge, child in children[i].items():
                if low <= edge <= high:
                    stack.append(child)
        return found

    def add(self, q: int) -> int:
        self.values.append(q)
        self.children.append({})
        new = len(self.values) - 1
        i = 0
        while i != new:
            d = (self.values[i] ^ q).bit_count()
            i = self.children[i].setdefault(d, new)
        return new


def shard_forest(members: list[int], radius: int) -> list[tuple[int, int]]:
    """Links of distinct fingerprints within ``radius`` to the first of their group, by one BK-tree."""
    tree, root = BKTree(), []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for q in members:
        near = tree.within(q, radius)
        new = tree.add(q)
        root.append(new)
        for i in near:
            a, b = top(i), top(new)
            root[max(a, b)] = min(a, b)
    return [(members[i], members[top(i)]) for i in range(len(members)) if top(i) != i]


def band_masks(mask: int, bands: int = 4) -> list[int]:
    """Four masks that each add a share of the bits outside ``mask`` to it."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * k // bands for k in range(bands + 1)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shard_rows(fps: DataFrame) -> DataFrame:
    """mask, value, fp: each fingerprint of ``fps(fp)`` once for each shard that it belongs to."""

    def dealt(rows: DataFrame, masks: list[int]) -> DataFrame:
        mask = F.explode(F.array(*[F.lit(_signed(m)) for m in masks]))
        return rows.select("fp", mask.alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")

    parents = [0]
    done = None
    now = dealt(fps, band_masks(0))
    for _ in range(REFINEMENTS):
        parents = [m for p in parents for m in band_masks(p)]
        now = written(now, "simhash-shards")
        hot = written(now.groupBy("mask", "value").count().where(F.col("count") > HOT).select("mask", "value"), "simhash-hot")
        cool = now.join(hot, ["mask", "value"], "left_anti")
        done = cool if done is None else done.unionByName(cool)
        inside = now.join(hot, ["mask", "value"], "left_semi")
        children = F.create_map(*[F.lit(x) for p in parents for x in (_signed(p), F.array(*[F.lit(_signed(m)) for m in band_masks(p)]))])
        now = inside.select("fp", F.explode(F.element_at(children, F.col("mask"))).alias("mask"))
        now = now.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp").distinct()
    return done.unionByName(now.select("mask", "value", "fp"))


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """u, v: a spanning forest, by shard, of the links of distinct fingerprints ``fps(fp)``; radius 3 at most."""
    if not 0 <= radius <= RADIUS:
        raise ValueError("four bands find links up to distance 3")
    schema = StructType([StructField("u", LongType()), StructField("v", LongType())])

    def run(batches):
        shard, members = None, []

        def forest():
            return shard_forest(members, radius) if len(members) > 1 else []

        for b in batches:
            found = []
            masks, values = b.column("mask").to_pylist(), b.column("value").to_pylist()
            for key, fp in zip(zip(masks, values, strict=True), b.column("fp").to_pylist(), strict=True):
                if key != shard:
                    found += forest()
                    shard, members = key, []
                members.append(fp & 0xFFFFFFFFFFFFFFFF)
            if found:
                yield _links(found)
        if last := forest():
            yield _links(last)

    rows = shard_rows(fps)
    return rows.repartition("mask", "value").sortWithinPartitions("mask", "value", "fp").mapInArrow(run, schema)


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(found, dtype=np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["u", "v"])


def near_groups(keyed: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, first: for each fingerprint of ``keyed(key, fp)`` the smallest key of all rows that it reaches.

    Rows with one fingerprint are one node: copies are counted together before anything is compared.
    """
    nodes = written(keyed.groupBy("fp").agg(F.min("key").alias("first")), "simhash-nodes")
    roots = star_components(links(nodes.select("fp"), radius))
    labelled = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    labelled = written(labelled, "simhash-roots")
    least = labelled.groupBy("root").agg(F.min("first").alias("least"))
    return written(labelled.join(least, "root").select("fp", F.col("least").alias("first")), "simhash-groups")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id for each row of ``docs``.

    Null and empty texts have fingerprint 0, linked like any other; texts are read whole. A null id is no
    component's smallest unless all its ids are null. Repeated rows give repeated rows. No rows give no rows.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    slim = written(fingerprints(slim, shingle), "simhash-fingerprints")
    groups = near_groups(slim.select(F.col("doc_id").alias("key"), "fp"), radius)
    return slim.join(groups, "fp").select("doc_id", "fp", F.col("first").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 5, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates: that with the smallest doc_id, with all its columns.

    Fingerprints are of distinct shingles, so that their distance follows the texts' similarity as sets; RADIUS bits
    link what is well over a similarity of 0.8 and leave most pairs just above it.

    Of rows that share that id (or have none) the first as written stays. Documents without near-duplicates stay.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("at"),
        F.col("doc_id").alias("id"), F.col("text"),
    )
    rows = written(fingerprints(rows, shingle, repeats=False), "simhash-rows")  # from here on a row's number is fixed
    key = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("at"))
    keyed = rows.select(key.alias("key"), "fp")
    groups = near_groups(keyed, radius)
    return rows.join(groups, (rows["fp"] == groups["fp"]) & (rows["at"] == groups["first.at"])).select("row.*")


def op10(spark, sf_dir) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")
