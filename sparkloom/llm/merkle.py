"""Merkle manifest of a dataset: one digest for the whole, and a proof for each row.

Each row is a leaf. The leaves of a tree (rows of one language, say) stand in order of their ids; FAN consecutive
nodes become one node of the level above until one is left, the tree's subroot, and the subroots in order of the
trees' names become the root in the same way. Digests are SHA-256, hashed as lower-case hexadecimal text.

A tree is cut into aligned blocks of FAN ** LEVELS leaves, one row of a table each, so a large tree is many blocks and no task
sees more than one at a time. A block's root comes from a treehash stack. Block roots are nodes of a smaller tree of
the same kind, and so on up. Proofs come back down: in each block a traversal goes from leaf to leaf and holds, for
each level, the run of FAN nodes that the leaf lies under, and a treehash stack that works on the next run, one leaf
a step, so that it is ready when the leaf enters it. What lies above the block is the same for all its leaves and is
appended to each path.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import table, written

FAN = 8
#: Levels in a block, which so has 512 leaves: few enough for one row of a table.
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: bytes) -> bytes:
    """SHA-256 of the parts one after another, as lower-case hexadecimal text."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def leaf(*columns):
    """A row's digest: of each column ``-`` if null, else its UTF-8 length, a colon and its value."""

    def field(c):
        text = F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256)


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    levels, reach = 0, 1
    while reach < n:
        levels, reach = levels + 1, reach * FAN
    return levels


class Treehash:
    """The nodes of one level, from leaves that come one by one; it holds at most FAN nodes for each level below."""

    def __init__(self, level: int):
        self.level = level
        self.waiting: list[list[bytes]] = [[] for _ in range(level)]
        self.nodes: list[bytes] = []

    def add(self, node: bytes, at: int = 0) -> None:
        while at < self.level:
            run = self.waiting[at]
            run.append(node)
            if len(run) < FAN:
                return
            node, at = digest(*run), at + 1
            run.clear()
        self.nodes.append(node)

    def close(self) -> list[bytes]:
        """The nodes, when no more leaves come: open runs become nodes as they are."""
        for at in range(self.level):
            if self.waiting[at]:
                node = digest(*self.waiting[at])
                self.waiting[at].clear()
                self.add(node, at + 1)
        nodes, self.nodes = self.nodes, []
        return nodes


def subtree(leaves: list[bytes], levels: int) -> bytes:
    """The one node that ``levels`` levels leave of the leaves."""
    stack = Treehash(levels)
    for node in leaves:
        stack.add(node)
    (root,) = stack.close()
    return root


def traversal(leaves: list[bytes], levels: int):
    """For each leaf, from the first: (place in its run, the run's nodes) of each level below the root.

    The runs around the current leaf are held. For each level a stack takes one leaf a step, the one as many leaves
    ahead as the level's run covers, and so has the next run's nodes when that run begins.
    """
    spans = [FAN ** (k + 1) for k in range(levels)]
    runs, ahead = [], []
    for k, span in enumerate(spans):
        stack = Treehash(k)
        for node in leaves[:span]:
            stack.add(node)
        runs.append(stack.close())
        ahead.append(Treehash(k))
    for i in range(len(leaves)):
        for k, span in enumerate(spans):
            if i and i % span == 0:
                runs[k] = ahead[k].close()
            if i + span < len(leaves):
                ahead[k].add(leaves[i + span])
        yield [(i // (span // FAN) % FAN, runs[k]) for k, span in enumerate(spans)]


def packed(path: list[tuple[int, list[bytes]]]) -> bytes:
    """A path as bytes: for each level the leaf's place, the number of its siblings, and their digests."""
    out = bytearray()
    for place, run in path:
        out += bytes((place, len(run) - 1))
        for k, node in enumerate(run):
            if k != place:
                out += bytes.fromhex(node.decode())
    return bytes(out)


def unpacked(path: bytes) -> list[tuple[bytes, bytes]]:
    """Of each level of a path, the siblings before and after, as hexadecimal text."""
    out, at = [], 0
    while at < len(path):
        place, others = path[at], path[at + 1]
        text = path[at + 2 : at + 2 + 32 * others].hex().encode()
        out.append((text[: 64 * place], text[64 * place :]))
        at += 2 + 32 * others
    return out


def folded(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for before, after in path:
        node = digest(before, node, after)
    return node


def numbered(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """``rows`` with pos, the place from 0 among the rows of the same ``tree`` (null is a tree) by ``order``, nulls first, and
    n, how many the tree has.

    Rows are sorted by ranges of (tree, order), so a tree with most rows is many ranges. What is counted on the way is
    a number for each range and two for each tree. Rows equal in all of ``order`` stand as they were written, and that
    place splits a range that only they fill.
    """
    fixed = written(rows.withColumn("__at", F.monotonically_increasing_id()), "merkle-rows")
    keys = [F.col(c).asc_nulls_first() for c in (tree, *order, "__at")]
    ranged = fixed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__seq", F.monotonically_increasing_id())
    ranged = written(ranged.drop("__at").withColumn("__range", F.shiftright("__seq", 33)).withColumn("__in", F.col("__seq").bitwiseAND((1 << 33) - 1)), "merkle-ranges")
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__n")).collect()  # a number for each partition
    begins, total = [], 0
    for r in sorted(counts, key=lambda r: r["__range"]):
        begins.append((r["__range"], total))
        total += r["__n"]
    offsets = rows.sparkSession.createDataFrame(begins, "__range long, __begin long")
    placed = ranged.join(F.broadcast(offsets), "__range").withColumn("__place", F.col("__begin") + F.col("__in"))  # a row for each partition
    trees = placed.groupBy(tree).agg(F.min("__place").alias("__first"), F.count("*").alias("n")).withColumnRenamed(tree, "__tree")
    joined = placed.join(trees, F.col(tree).eqNullSafe(F.col("__tree")))
    return joined.select(*rows.columns, (F.col("__place") - F.col("__first")).alias("pos"), "n")


_PATH = StructType([StructField("path", BinaryType()), StructField("subroot", BinaryType()), StructField("top", BinaryType())])


def _with_roots(blocks: DataFrame) -> DataFrame:
    """``blocks(levels, nodes, ...)`` with each block's root."""
    schema = StructType([*blocks.schema.fields, StructField("root", BinaryType())])

    def run(batches):
        for b in batches:
            roots = []
            for nodes, levels in zip(b.column("nodes"), b.column("levels").to_pylist(), strict=True):
                roots.append(bytes.fromhex(subtree([n.hex().encode() for n in nodes.as_py()], levels).decode()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(roots, type=pa.binary())], names=schema.names)

    return blocks.mapInArrow(run, schema)


def _blocks(nodes: DataFrame, payload: list[str], most: int) -> DataFrame:
    """The aligned blocks of ``nodes(tree, pos, n, node, *payload)``, written: a row each, of FAN ** most nodes at most, with its root.

    ``first`` is the place of its first node, ``levels`` those that it has below its root: ``most`` where the tree has other
    blocks, else what it needs; ``whole`` says that it has none, and ``up`` how many blocks there are.
    """
    size = FAN**most
    each = F.struct("pos", "node", *payload)
    block = F.floor(F.col("pos") / size).cast("long")
    grouped = nodes.groupBy("tree", block.alias("block")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(each)).alias("each"))  # size entries at most
    need = F.lit(0)
    for k in range(most):
        need = F.when(F.col("n") > FAN**k, k + 1).otherwise(need)
    parts = [F.col(f"each.{c}").alias("nodes" if c == "node" else c) for c in ("node", *payload)]
    place = [(F.col("block") * size).alias("first"), (F.col("n") <= size).alias("whole"), F.ceil(F.col("n") / size).alias("up")]
    return written(_with_roots(grouped.select("tree", "block", *place, need.cast("long").alias("levels"), *parts)), "merkle-blocks")


def _arrow(fields: StructType) -> list:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    return [kinds[f.dataType.simpleString()] for f in fields.fields]


def _walk(blocks: DataFrame, above: DataFrame, make, fields: StructType) -> DataFrame:
    """``make(row, place, way)`` for each node of ``blocks``, where way is traversal()'s, in the block.

    ``above(tree, pos, path, subroot, top)`` has the way from each block's root on, and is part of ``row``. What ``make``
    returns is of ``fields``.
    """
    upper = above.select(F.col("tree").alias("__tree"), F.col("pos").alias("__pos"), "path", "subroot", "top")
    joined = blocks.drop("root").join(upper, F.col("tree").eqNullSafe(F.col("__tree")) & (F.col("block") == F.col("__pos"))).drop("__tree", "__pos")
    types = _arrow(fields)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                nodes = [n.hex().encode() for n in row["nodes"]]
                out = [make(row, k, way) for k, way in enumerate(traversal(nodes, row["levels"]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=fields.names)

    return joined.mapInArrow(run, fields)


_NODE_WAY = StructType([StructField("tree", StringType()), StructField("pos", LongType()), *_PATH.fields])


def _node_way(row, place, way):
    return row["tree"], row["first"] + place, packed(way) + row["path"], row["subroot"], row["top"]


def _ways(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """tree, pos, path, subroot, top of the roots of the lowest of ``levels``, which go from the leaves' blocks up.

    ``tops(tree, path, subroot, top)`` has the way from each tree's subroot on. A tree ends at the level where it has one block.
    """
    known = None
    for blocks in reversed(levels):
        whole = blocks.where("whole").select(F.col("tree").alias("__tree"))  # a row for each tree
        ends = tops.join(whole, F.col("tree").eqNullSafe(F.col("__tree")), "left_semi").select("tree", F.lit(0).cast("long").alias("pos"), "path", "subroot", "top")
        ways = ends if known is None else ends.unionByName(known)
        known = ways if blocks is levels[0] else written(_walk(blocks, ways, _node_way, _NODE_WAY), "merkle-ways")
    return known


def _climb(nodes: DataFrame, payload: list[str], most: int) -> list[DataFrame]:
    """Tables of blocks from the leaves up, until no tree has two. The number of tables grows with the logarithm of the nodes."""
    levels = [_blocks(nodes, payload, most)]
    while levels[-1].where("not whole").limit(1).count():
        up = levels[-1].where("not whole")
        levels.append(_blocks(up.select("tree", F.col("block").alias("pos"), F.col("up").alias("n"), F.col("root").alias("node")), [], most))
    return levels


def _subroots(levels: list[DataFrame]) -> DataFrame:
    """tree, node: what is left of each tree."""
    out = None
    for blocks in levels:
        whole = blocks.where("whole").select("tree", F.col("root").alias("node"))
        out = whole if out is None else out.unionByName(whole)
    return out


def manifest(leaves: DataFrame, make=None, fields: StructType | None = None, levels_in_block: int = LEVELS) -> DataFrame:
    """A proof for each row of ``leaves(tree, id, leaf, tampered)``: tree, id, leaf, path, subroot, root by default.

    ``tree`` is a string, null or not, ``id`` a number, ``leaf`` 32 bytes; ``tampered`` may be null. Leaves stand in
    order of id, a null first; equal ids in order of their leaves, so equal rows get proofs of their own. path is as
    packed() makes it, from the leaf's level to the root. ``make(row, place, way)`` and ``fields`` may give other rows.
    No rows give no rows, and no root.
    """
    placed = numbered(leaves, "tree", "id", "leaf").select("tree", "pos", "n", F.col("leaf").alias("node"), "id", "tampered")
    levels = _climb(placed, ["id", "tampered"], levels_in_block)
    subroots = numbered(_subroots(levels).withColumn("all", F.lit("")), "all", "tree")  # a row for each tree
    crown = _climb(subroots.select(F.col("all").alias("tree"), "pos", "n", "node", F.col("tree").alias("name")), ["name"], levels_in_block)
    root = _subroots(crown).select("tree", F.lit(b"").alias("path"), F.lit(None).cast("binary").alias("subroot"), F.col("node").alias("top"))
    tops = written(_walk(crown[0], _ways(crown, root), _top_way, _TOP_WAY), "merkle-tops")
    return _walk(levels[0], _ways(levels, tops), make or _proof, fields or PROOF)


_TOP_WAY = StructType([StructField("tree", StringType()), *_PATH.fields])


def _top_way(row, place, way):
    return row["name"][place], packed(way) + row["path"], row["nodes"][place], row["top"]


PROOF = StructType(
    [
        StructField("tree", StringType()), StructField("id", LongType()), StructField("leaf", StringType()), StructField("path", BinaryType()),
        StructField("subroot", StringType()), StructField("root", StringType()),
    ]
)


def _proof(row, place, way):
    return row["tree"], row["id"][place], row["nodes"][place].hex(), packed(way) + row["path"], row["subroot"].hex(), row["top"].hex()


#: What a check of the manifest returns for each row.
CHECKED = StructType(
    [
        StructField("doc_id", LongType()), StructField("leaf", StringType()), StructField("subroot", StringType()), StructField("root", StringType()),
        StructField("proof_sha256", StringType()), StructField("folded_root", StringType()),
    ]
)


class _Checker:
    """Makes CHECKED rows; what lies above a block is read once for all its leaves."""

    def __init__(self):
        self.path, self.above, self.others = None, [], b""

    def __call__(self, row, place, way):
        if self.path is not row["path"]:
            self.path, self.above = row["path"], unpacked(row["path"])
            self.others = b"".join(x for pair in self.above for x in pair)
        here = [(b"".join(run[:k]), b"".join(run[k + 1 :])) for k, run in way]
        siblings = hashlib.sha256(b"".join(x for pair in here for x in pair))
        siblings.update(self.others)
        node = row["tampered"][place] or row["nodes"][place]
        reached = folded(folded(node.hex().encode(), here), self.above)
        return row["id"][place], row["nodes"][place].hex(), row["subroot"].hex(), row["top"].hex(), siblings.hexdigest(), reached.decode()


def checked(docs: DataFrame, tampered, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", tree_col: str = "lang") -> DataFrame:
    """CHECKED and verified, for each row of ``docs``: its leaf and proof, and the root that its leaf gives with ``fields`` but
    for the columns that ``tampered`` (name -> (condition, column)) replaces where the condition holds.

    A null in any column is a value of its own; a null id is never tampered with by a condition on it and comes first in its
    tree. Texts are hashed whole where they are read; only digests move. Other columns aren't read. No rows give no rows.
    """
    other = F.unhex(leaf(*[tampered[c][1] if c in tampered else c for c in fields]))
    change = F.lit(False)
    for condition, column in tampered.values():
        change = change | F.coalesce(condition & column.isNotNull(), F.lit(False))
    rows = docs.select(F.col(tree_col).cast("string").alias("tree"), F.col(id_col).cast("long").alias("id"), F.unhex(leaf(*fields)).alias("leaf"), F.when(change, other).alias("tampered"))
    found = manifest(rows, _Checker(), CHECKED)
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11(spark, sf_dir) -> DataFrame:
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return checked(table(spark, sf_dir, "documents"), {"text": (third, F.translate("text", UPPER, LOWER))})


ORACLE = """
WITH RECURSIVE leaf_rows AS (
  SELECT doc_id, lang, crc,
    sha256(concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-'), coalesce(strlen(text) || ':' || text, '-'))) AS leaf,
    sha256(concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-'),
      coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-'))) AS lowered
  FROM (SELECT *, 4294967295 - list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
      lambda acc, x: list_reduce(list_concat([xor(acc, x)], [i::BIGINT FOR i IN range(8)]),
        lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END)) AS crc FROM documents)
),
ordered AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaf_rows),
nodes(tree, level, pos, node, n) AS (
  SELECT coalesce('x' || lang, ''), 0, pos, leaf, count(*) OVER (PARTITION BY lang) FROM ordered
  UNION ALL
  SELECT tree, level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), max(n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 8
),
subroots AS (SELECT tree, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM nodes WHERE n = 1),
crown(level, pos, node, n) AS (
  SELECT 0, pos, subroot, count(*) OVER () FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), max(n + 7) // 8 FROM crown WHERE n > 1 GROUP BY level, pos // 8
),
runs AS (SELECT tree, level, pos // 8 AS run, list(node ORDER BY pos) AS run_nodes FROM nodes WHERE n > 1 GROUP BY ALL),
crown_runs AS (SELECT level, pos // 8 AS run, list(node ORDER BY pos) AS run_nodes FROM crown WHERE n > 1 GROUP BY ALL),
up(doc_id, rn, tree, level, pos, proof, node) AS (
  SELECT doc_id, row_number() OVER (), coalesce('x' || lang, ''), 0, pos, '', CASE WHEN crc % 3 = 0 THEN lowered ELSE leaf END FROM ordered
  UNION ALL
  SELECT u.doc_id, rn, tree, level + 1, u.pos // 8,
    proof || array_to_string(run_nodes[1 : u.pos % 8] , '') || array_to_string(run_nodes[u.pos % 8 + 2 :], ''),
    sha256(array_to_string(run_nodes[1 : u.pos % 8], '') || node || array_to_string(run_nodes[u.pos % 8 + 2 :], ''))
  FROM up u JOIN runs r USING (tree, level) WHERE r.run = u.pos // 8
),
at_subroot AS (SELECT u.* FROM up u JOIN (SELECT rn, max(level) AS level FROM up GROUP BY rn) USING (rn, level)),
higher(doc_id, rn, tree, level, pos, proof, node) AS (
  SELECT doc_id, rn, tree, 0, s.pos, proof, node FROM at_subroot a JOIN subroots s USING (tree)
  UNION ALL
  SELECT u.doc_id, rn, tree, level + 1, u.pos // 8,
    proof || array_to_string(run_nodes[1 : u.pos % 8] , '') || array_to_string(run_nodes[u.pos % 8 + 2 :], ''),
    sha256(array_to_string(run_nodes[1 : u.pos % 8], '') || node || array_to_string(run_nodes[u.pos % 8 + 2 :], ''))
  FROM higher u JOIN crown_runs r USING (level) WHERE r.run = u.pos // 8
),
at_root AS (SELECT u.* FROM higher u JOIN (SELECT rn, max(level) AS level FROM higher GROUP BY rn) USING (rn, level)),
leaves AS (SELECT rn, u.tree, n.node AS leaf FROM up u JOIN nodes n ON n.tree = u.tree AND n.level = 0 AND n.pos = u.pos WHERE u.level = 0)
SELECT a.doc_id, l.leaf, s.subroot, c.node AS root, sha256(a.proof) AS proof_sha256, a.node AS folded_root, a.node = c.node AS verified
FROM at_root a JOIN leaves l USING (rn) JOIN subroots s ON s.tree = a.tree CROSS JOIN (SELECT node FROM crown WHERE n = 1) c
"""
