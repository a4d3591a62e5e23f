"""Near copies by Jaccard similarity of word shingles: SimHash and BK-trees in shards, star contraction, exact verification.

Two texts are linked where the exact similarity of their sets of shingles (as 64-bit hashes) is LEAST or more, and
groups are the connected components of those links. Texts with equal sets are one node.

A node has PRINTS 64-bit SimHashes of its distinct shingles, under as many hash functions. Pairs at 0.8 differ in 15 % of
their bits, 19 % where sets are tiny: bands of the bits can't block at that distance. So shards are the values of BANDS
bands of BAND_ROWS minima: a pair at 0.8 shares none with a chance of (1 - 0.8^3)^21, about 3e-7. Nodes that are alone in a
shard leave it before anything else moves. A BK-tree over the fingerprints of a shard finds those within RADIUS bits
(a pair at 0.8 lies beyond it with a chance under 1e-14) and hands on a spanning forest of them, never all pairs.

What star contraction ties together is verified in two steps, neither of which gathers a group:
1. Each node's links to the nodes nearest to its fingerprints are verified. The stars of a shard have at their
   centre the text that is most like all others, so of texts that are near copies this ties most together.
2. What is still apart is compared in a grid of pieces: a cell has the sets of two pieces, counts what all its pairs
   share and hands on a spanning forest of what it links. Groups of more than a piece first meet by a prefix join: two sets
   of n shingles at LEAST share one of the n - LEAST n + 1 rarest of each. So texts with a common template and contents
   of their own, at 0.7 say, don't meet at all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .common import lean, split_by_bitmap, written
from .components import star_components
from .simhash import majority

LEAST = 0.8
BANDS, BAND_ROWS, MINIMA = 21, 3, 63
#: 64-bit SimHashes of a node, how many of their bits may differ in a candidate, and nodes that a leaf of a BK-tree holds.
PRINTS, RADIUS, LEAF = 8, 170, 1024
#: Texts that are compared, or verified, as one group, and bytes of their sets, on average.
PIECE, PIECE_BYTES = 256, 8 * 1024 * 1024
#: Candidates of a node that are verified before the rest is compared.
TRIED = 4

_ODD = np.random.default_rng(42).integers(0, 1 << 63, (2, MINIMA), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LINKS = StructType([StructField("u", LongType()), StructField("v", LongType())])
_ALIKE = StructType([*_LINKS.fields, StructField("like", LongType())])


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a text of fewer words is one shingle, an empty one has none."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(shingle, len(words))
    n = len(words) - width + 1
    out = hashes[:n].copy()
    for k in range(1, width):
        out = (out ^ (out >> np.uint64(29))) * _STEP + hashes[k : k + n]
    out = (out ^ (out >> np.uint64(32))) * _STEP
    return np.unique(out ^ (out >> np.uint64(29)))


def minima(hashes: np.ndarray) -> np.ndarray:
    """MINIMA minima of the hashes under as many orders."""
    out = np.full(MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    for begin in range(0, len(hashes), 1 << 12):  # bounds what one long text takes
        mixed = (hashes[None, begin : begin + (1 << 12)] ^ _ODD[0][:, None]) * _ODD[1][:, None]
        out = np.minimum(out, mixed.min(axis=1))
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP
    for k in range(BAND_ROWS):
        key = (key ^ (key >> np.uint64(29))) * _STEP + rows[:, k]
    return key


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Exact Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    """PRINTS SimHashes of the set."""
    x = hashes[:, None] + np.arange(PRINTS, dtype=np.uint64) * _STEP
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return majority(x ^ (x >> np.uint64(31)))


def distances(prints: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Bits in which each row differs from ``one``."""
    return np.bitwise_count(prints ^ one).sum(axis=1, dtype=np.int64)


class BKTree:
    """Fingerprints by their distance to the node above, in leaves of LEAF or fewer. What a search finds leaves the tree."""

    def __init__(self, prints: np.ndarray, members: np.ndarray):
        self.prints, self.left = prints, len(members)
        self.pivot, self.members, self.children = None, members, {}
        if len(members) > LEAF:
            self.pivot, rest = members[0], members[1:]
            self.members = members[:1]
            edge = distances(prints[rest], prints[self.pivot])
            if (edge == edge[0]).all():  # a tree of one child each would be as deep as it has members
                self.pivot, self.members = None, members
            else:
                self.children = {d: BKTree(prints, rest[edge == d]) for d in np.unique(edge).tolist()}

    def take(self, q: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Members at most ``radius`` from q that no search has found before, and their distances."""
        found = [self._own(q, radius)]
        if self.children:
            d = int(distances(self.prints[self.pivot][None], q)[0])
            found += [c.take(q, radius) for edge, c in self.children.items() if c.left and abs(edge - d) <= radius]
        members, far = (np.concatenate(x) for x in zip(*found, strict=True))
        self.left -= len(members)
        return members, far

    def _own(self, q, radius):
        far = distances(self.prints[self.members], q)
        near = far <= radius
        out = self.members[near], far[near]
        self.members = self.members[~near]
        return out


def forest(sketches: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int, int]]:
    """Links (from, to, bits that agree) that span the components of fingerprints (as bytes) at most ``radius`` apart.

    Stars begin with the member that has most of the bits that most members have.
    """
    prints = np.ascontiguousarray(sketches).view(np.uint64)
    common = majority(prints)
    order = np.argsort(distances(prints, common), kind="stable")
    tree, bits, out = BKTree(prints, order), 64 * prints.shape[1], []
    done = np.zeros(len(prints), dtype=bool)
    for first in order:
        if done[first]:
            continue
        edge, done[first] = [first], True
        while edge and tree.left:
            p = edge.pop(0)
            near, far = tree.take(prints[p], radius)
            new = ~done[near]  # the star's own centre is in the tree as well
            near, far = near[new], far[new]
            done[near] = True
            out += zip([p] * len(near), near, bits - far, strict=True)
            edge += list(near)
    return out


def _described(rows: DataFrame, shingle: int) -> DataFrame:
    """``rows(row, at, id, text)`` with the node's number, fingerprints and band keys in place of the text."""
    kept = ["row", "at", "id"]
    longs = ArrayType(LongType())
    schema = StructType([*[rows.schema[c] for c in kept], StructField("fp", LongType()), StructField("prints", longs), StructField("keys", longs)])

    def run(batches):
        import xxhash

        for b in batches:
            fps, prints, keys = [], [], []
            for t in b.column("text"):
                found = shingles(t.as_py(), shingle)
                least = minima(found)
                fps.append(xxhash.xxh64_intdigest(found.tobytes()) if len(found) else 0)
                prints.append(fingerprints(found).view(np.int64))
                keys.append(band_keys(least).view(np.int64) if len(found) else np.zeros(0, dtype=np.int64))
            added = [pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(prints, type=pa.list_(pa.int64())), pa.array(keys, type=pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *added], names=schema.names)

    return rows.mapInArrow(lean(run), schema)


def _groups(batches, by: list[str]):
    """The rows of each run of equal ``by`` values in sorted batches, as tables."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(c).to_numpy(zero_copy_only=False) for c in by]
        starts = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])
        for a, z in zip(starts, [*starts[1:], b.num_rows], strict=True):
            key = tuple(k[a] for k in keys)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, z - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _batch(links: list[np.ndarray]) -> pa.RecordBatch:
    both = np.concatenate([np.zeros((0, 2), dtype=np.int64), *links])
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["u", "v"])


def _shared(rows: DataFrame) -> DataFrame:
    """Those of ``rows(key, fp)``, distinct ones, whose key another has too."""

    def run(batches):
        held, tied = [np.zeros(0, dtype=np.int64)] * 2, False  # the last row, and whether the one before has its key
        for b in batches:
            if not b.num_rows:
                continue
            key, fp = (np.r_[h, b.column(c).to_numpy(zero_copy_only=False)] for h, c in zip(held, ("key", "fp"), strict=True))
            same = key[1:] == key[:-1]
            before = np.r_[tied, same]
            give = before[:-1] | same
            held, tied = [key[-1:], fp[-1:]], before[-1]
            yield pa.RecordBatch.from_arrays([pa.array(key[:-1][give]), pa.array(fp[:-1][give])], names=["key", "fp"])
        if tied:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["key", "fp"])

    schema = StructType([StructField("key", LongType()), StructField("fp", LongType())])
    return rows.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(lean(run), schema)


def _linked(rows: DataFrame, by: str) -> DataFrame:
    """u, v, like: a spanning forest of each shard of ``rows(by, fp, prints)``, by a BK-tree of its fingerprints."""

    def batch(found: list[np.ndarray]) -> pa.RecordBatch:
        whole = np.concatenate([np.zeros((0, 3), dtype=np.int64), *found])
        return pa.RecordBatch.from_arrays([pa.array(c.copy()) for c in whole.T], names=_ALIKE.names)

    def run(batches):
        out, n = [], 0
        for t in _groups(batches, [by]):
            if t.num_rows > 1:
                fps = t.column("fp").to_numpy()
                if found := forest(t.column("prints").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, PRINTS)):
                    p, i, like = np.array(found).T
                    out.append(np.stack([fps[p], fps[i], like], axis=1))
                    n += len(found)
            if n > 10_000:
                yield batch(out)
                out, n = [], 0
        yield batch(out)

    return rows.select(by, "fp", "prints").repartition(by).sortWithinPartitions(by, "fp").mapInArrow(lean(run), _ALIKE)


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``texts`` with n and the set's shingles as bytes in place of the column text, written."""
    kept = [c for c in texts.columns if c != "text"]
    schema = StructType([*[texts.schema[c] for c in kept], StructField("n", LongType()), StructField("shingles", BinaryType())])

    def run(batches):
        for b in batches:
            found = [shingles(t.as_py(), shingle) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array([len(x) for x in found], type=pa.int64()), pa.array([x.tobytes() for x in found], type=pa.binary())], names=schema.names)

    return written(texts.select(*kept, "text").mapInArrow(lean(run), schema), "nearcopies-sets")


def _dealt(links: DataFrame) -> DataFrame:
    """``links(u, v)`` with piece and pieces: the links of one u are cut into pieces of about PIECE."""
    many = links.groupBy("u").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    return links.join(many, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("pieces")).cast("int").alias("piece"), "pieces")


def _verified(first: DataFrame, each: DataFrame) -> DataFrame:
    """u, v: those of ``each(u, piece, v, shingles)`` whose sets have a similarity of LEAST or more to that of ``first(u, piece, shingles)``.

    The set of u stands first in each of its pieces and is the only one that is held.
    """

    def run(batches):
        mine = None
        for b in batches:
            out = []
            for u, v, raw in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), b.column("shingles"), strict=True):
                found = np.frombuffer(raw.as_buffer(), dtype=np.uint64)
                if v is None:
                    mine = found
                elif similarity(mine, found) >= LEAST:
                    out.append((u, v))
            yield _batch([np.array(out, dtype=np.int64).reshape(-1, 2)])

    columns = ["u", "piece", "v", "shingles"]
    both = first.withColumn("v", F.lit(None).cast("long")).select(columns).unionByName(each.select(columns))
    both = both.repartition("u", "piece").sortWithinPartitions("u", "piece", F.col("v").asc_nulls_first())
    return both.mapInArrow(lean(run), _LINKS)


def _verified_links(links: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``links(u, v)``, distinct ones, that hold; of ``sets`` only their ends move."""
    dealt = written(_dealt(links), "nearcopies-again")
    ends = written(dealt.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "nearcopies-ends")
    s, _ = split_by_bitmap(sets.select("fp", "shingles"), "fp", ends)
    first = dealt.select("u", "piece").distinct().join(s, F.col("u") == F.col("fp"))
    return _verified(first, dealt.join(s, F.col("v") == F.col("fp")))


def _met(sets: DataFrame, comps: DataFrame) -> DataFrame:
    """fp, distinct: those of ``comps(fp, root, comp)`` that share a prefix token with one of another component of their root.

    ``sets(fp, shingles)`` have them all and may have others. A prefix are the rarest shingles, as many as LEAST asks for.
    Rarity is counted over these sets; equally rare ones stand in order of their hashes.
    """
    schema = StructType([StructField("fp", LongType()), StructField("token", LongType())])

    def run(batches):
        for b in batches:
            for fp, raw in zip(b.column("fp").to_pylist(), b.column("shingles"), strict=True):
                found = np.frombuffer(raw.as_buffer(), dtype=np.int64)
                for i in range(0, len(found), 1 << 16):
                    part = found[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), fp)), pa.array(part)], names=schema.names)

    tokens = sets.select("fp", "shingles").mapInArrow(lean(run), schema)
    often = tokens.groupBy("token").agg(F.count("*").alias("often"))
    ranked = tokens.join(often, "token").groupBy("fp").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("all"))  # a text's own
    prefix = (F.size("all") - F.ceil(F.size("all") * F.lit(LEAST) - 1e-9) + 1).cast("int")
    chosen = ranked.select("fp", F.explode(F.slice("all", F.lit(1), prefix)).alias("t")).where("t.often > 1").select("fp", "t.token")
    rows = written(chosen.join(comps, "fp"), "nearcopies-prefixes")
    shared = rows.groupBy("root", "token").agg(F.min("comp").alias("a"), F.max("comp").alias("z")).where("a <> z").select("root", "token")
    return rows.join(shared, ["root", "token"], "left_semi").select("fp").distinct()


def overlaps(sets: list[np.ndarray], block: int = 4096) -> np.ndarray:
    """How many elements each two of the sets share."""
    whole = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, place, many = np.unique(whole, return_inverse=True, return_counts=True)
    column = np.cumsum(many > 1) - 1  # only what two sets have counts
    keep = many[place] > 1
    owner, place = owner[keep], column[place[keep]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)  # whole numbers below 2^24 in each block, and summed in blocks
    total = np.zeros_like(out, dtype=np.int64)
    for begin in range(0, int((many > 1).sum()), block):
        part = slice(*np.searchsorted(place, [begin, begin + block]))
        there = np.zeros((len(sets), block), dtype=np.float32)
        there[owner[part], place[part] - begin] = 1
        np.matmul(there, there.T, out=out)
        total += out.astype(np.int64)
    return total


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of a symmetric matrix of links."""
    left, out = np.arange(len(linked)), []
    while len(left):
        edge, left = [left[0]], left[1:]
        while edge and len(left):
            p = edge.pop()
            near = linked[p, left]
            out += [(p, i) for i in left[near]]
            edge += list(left[near])
            left = left[~near]
    return out


def _compared(sets: DataFrame) -> DataFrame:
    """u, v: spanning links of LEAST or more among ``sets(fp, root, n, shingles)`` with a common root."""
    sizes = sets.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / PIECE, F.sum("n") * 8 / PIECE_BYTES)).cast("int").alias("pieces"))
    many = F.broadcast(sizes.where("pieces > 1"))  # a row for each PIECE sets, or PIECE_BYTES of them, at most
    mine = F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
    grid = sets.select("fp", "root", "n", "shingles").join(many, "root", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1))).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    by = ["root", "i", "j"]
    cells = grid.select("root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp", "n", "shingles")

    def run(batches):
        for t in _groups(batches, by):
            fp, n = t.column("fp").to_numpy(), t.column("n").to_numpy()
            both = overlaps([np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in t.column("shingles")])
            linked = both >= LEAST * (n[:, None] + n - both) - 1e-9
            np.fill_diagonal(linked, False)
            yield _batch([np.stack([fp[p], fp[i]]).reshape(1, 2) for p, i in spanning(linked)])

    return cells.repartition(*by).sortWithinPartitions(*by, "fp").mapInArrow(lean(run), _LINKS)


def _components(sets: DataFrame, links: DataFrame) -> DataFrame:
    """fp, root, comp of ``sets``: the smallest node that ``links`` reach."""
    comps = star_components(links)
    return sets.select("fp", "root").join(comps.select(F.col("node").alias("fp"), F.col("root").alias("comp")), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))


def _tried(alike: DataFrame) -> DataFrame:
    """``alike(u, v, like)``, the TRIED nearest of each v, with place from 1."""
    place = F.row_number().over(Window.partitionBy("v").orderBy(F.col("like").desc(), "u"))  # a node has a parent in each shard at most
    return alike.withColumn("place", place).where(F.col("place") <= TRIED)


def _placed(members: DataFrame, tried: DataFrame) -> DataFrame:
    """``members(fp, ...)`` with u, piece (of the link to the nearest, if there is one) and pieces (of the links that have fp as u)."""
    dealt = _dealt(tried.where("place = 1").select("u", "v"))
    parents = dealt.select(F.col("v").alias("fp"), "u", "piece")
    return members.join(parents, "fp", "left").join(dealt.select(F.col("u").alias("fp"), "pieces").distinct(), "fp", "left")


def _links(sets: DataFrame, tried: DataFrame) -> DataFrame:
    """u, v: exact links that make the same components of ``sets`` (of _placed()) as all of them."""
    first = sets.where("pieces is not null").select(F.col("fp").alias("u"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "shingles")
    sure = written(_verified(first, sets.where("u is not null").withColumnRenamed("fp", "v")), "nearcopies-sure")
    comps = _components(sets, sure).select("fp", "comp")
    a, b = (comps.select(F.col("fp").alias(x), F.col("comp").alias(f"{x}_comp")) for x in "uv")
    again = tried.where("place > 1").select("u", "v").join(a, "u").join(b, "v").where("u_comp <> v_comp").select("u", "v")
    sure = sure.unionByName(written(_verified_links(again, sets), "nearcopies-sure"))
    comps = written(_components(sets, sure), "nearcopies-comps")
    open_ = comps.groupBy("root").agg(F.min("comp").alias("a"), F.max("comp").alias("z"), F.count("*").alias("many")).where("a <> z and many > 2").select("root", "many")
    rest = written(comps.join(open_, "root"), "nearcopies-open")  # two nodes have one link, which is verified
    large = rest.where(F.col("many") > PIECE).select("fp", "root", "comp")
    met = _met(split_by_bitmap(sets.select("fp", "shingles"), "fp", large.select(F.col("fp").alias("id")))[0], large)
    chosen = written(rest.where(F.col("many") <= PIECE).select(F.col("fp").alias("id")).unionByName(met.select(F.col("fp").alias("id"))), "nearcopies-chosen")
    return sure.unionByName(_compared(split_by_bitmap(sets, "fp", chosen)[0]))  # what else the bitmap lets through is compared too


def keep_one(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """One row of ``docs`` for each group of near copies: that with the smallest doc_id, with all its columns.

    Texts without words are one group. Of rows that share that id (or have none) the first as written stays; a null
    id comes last. Documents without near copies stay.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("at"),
        F.col("doc_id").alias("id"), F.col("text"),
    )
    rows = written(_described(rows, shingle), "nearcopies-rows")  # from here on a row's number is fixed
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at", "prints", "keys"))  # decided by at, at the latest
    nodes = written(rows.groupBy("fp").agg(first.alias("f")).select("fp", F.struct("f.none", "f.id", "f.at").alias("first"), "f.prints", "f.keys"), "nearcopies-nodes")
    shards = written(_shared(nodes.select(F.explode("keys").alias("key"), "fp")), "nearcopies-shards")
    alike = written(_linked(shards.join(nodes.select("fp", "prints"), "fp"), "key").distinct(), "nearcopies-alike")
    candidates = star_components(alike)
    tried = _tried(alike)
    members = nodes.join(candidates, nodes["fp"] == candidates["node"]).select("fp", "root", F.col("first.at").alias("own"))
    members = written(_placed(members, tried), "nearcopies-members")
    texts, _ = split_by_bitmap(rows.select("at", F.col("row.text").alias("text")), "at", members.select(F.col("own").alias("id")))
    sets = _sets(texts.join(members, texts["at"] == members["own"]).select("fp", "root", "u", "piece", "pieces", "text"), shingle)
    roots = star_components(_links(sets, tried))
    labelled = nodes.select("fp", "first").join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    least = labelled.groupBy("root").agg(F.min("first").alias("f")).select("root", F.col("f.at").alias("kept"))
    copies = labelled.join(least, "root").select("fp", "kept")
    ats = rows.select("at", "fp")
    gone = written(ats.join(copies, "fp").where("at <> kept").select(F.col("at").alias("id")), "nearcopies-gone")
    perhaps, clear = split_by_bitmap(rows.select("row", "at"), "at", gone)
    return clear.select("row.*").unionByName(perhaps.join(gone, perhaps["at"] == gone["id"], "left_anti").select("row.*"))
