"""Byte-level BPE encoding and decoding by a pair occurrence index.

Each task collects the distinct pre-tokens of a block of its partition, lays their byte symbols out in one
array and maps every mergeable pair to all its positions there. Active ranks are taken from a heap in
ascending order; a rank's merges are applied at all its positions at once, and only the occurrence lists of
the pairs next to them get new entries. Pre-tokens met before in the task are not encoded again.

The vocabulary file is a parameter. It is read on the driver and broadcast; MAX_VOCAB_BYTES bounds it.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

MAX_VOCAB_BYTES = 64 << 20
#: Characters of text in one block, and distinct pre-tokens that a task remembers.
BLOCK_CHARS, KNOWN_WORDS = 2_000_000, 250_000
#: Rows whose texts are decoded and handed on together.
DECODED_ROWS = 500
# The pre-token pattern of byte-level BPE files with use_regex set, given the classes of letters,
# numbers and white space. The most frequent alternative stands first; they begin with different characters.
SPLIT = " ?[{L}]+|'(?:[stmd]|re|ve|ll)| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
# Letters and numbers of Latin-1, and its white space.
LATIN = {"L": "A-Za-zªµºÀ-ÖØ-öø-ÿ", "N": "0-9²³¹¼-¾", "S": "\t-\r\x20\x85\xa0"}
# Code points that became letters or numbers after Unicode 16, which the tokenizers library follows.
LATER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 "
    "10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 "
    "187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 "
    "1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E "
    "2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)


def splitters():
    """findall of the pre-token pattern, for texts within Latin-1 and for all others."""
    import regex

    later = "".join("-".join(f"\\U{int(x, 16):08X}" for x in part.split("-")) for part in LATER.split())
    known = {k: rf"[\p{{{k}}}--[{later}]]" for k in "LN"} | {"S": r"\s"}
    return re.compile(SPLIT.format(**LATIN)).findall, regex.compile(SPLIT.format(**known), flags=regex.V1).findall


def byte_letters() -> list[str]:
    """The character that stands for each byte in such files: itself if printable Latin-1, else from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Merges and token bytes of a byte-level BPE file in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        if os.path.getsize(path) > MAX_VOCAB_BYTES:
            raise ValueError(f"{path} is over {MAX_VOCAB_BYTES} bytes")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, letters = spec["model"]["vocab"], byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.base = np.array([ids[c] for c in letters], dtype=np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], dtype=np.int32)
        self.left, self.right = left.astype(np.int32), right.astype(np.int32)
        key = left << 32 | right
        self.rank_of = np.argsort(key, kind="stable").astype(np.int32)
        self.keys = key[self.rank_of]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in ids.items():
            self.token_bytes[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()


def ranks(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The merge rank of each pair, -1 where there is none."""
    if not len(v.keys):
        return np.full(len(a), -1, dtype=np.int32)
    key = a.astype(np.int64) << 32 | b.astype(np.int64)
    at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
    return np.where((v.keys[at] == key) & (a >= 0) & (b >= 0), v.rank_of[at], -1)


def merge_words(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words in one array, and how many each word has."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    n = int(lengths.sum()) + len(words) + 1
    sym = np.full(n, -1, dtype=np.int32)  # -1 stands before, between and after the words
    is_symbol = np.ones(n, dtype=bool)
    ends = np.cumsum(lengths + 1)
    is_symbol[0] = False
    is_symbol[ends] = False
    sym[is_symbol] = v.base[np.frombuffer(b"".join(words), dtype=np.uint8)]
    nxt, prv = np.arange(1, n + 1, dtype=np.int64), np.arange(-1, n - 1, dtype=np.int64)
    nxt[-1], prv[0] = n - 1, 0
    where: dict[int, list[np.ndarray]] = defaultdict(list)
    active: list[int] = []

    def record(left: np.ndarray) -> None:
        """Adds the pairs that begin at these positions to the occurrence lists."""
        r = ranks(v, sym[left], sym[nxt[left]])
        left, r = left[r >= 0], r[r >= 0]
        if not len(r):
            return
        order = np.argsort(r, kind="stable")
        left, r = left[order], r[order]
        cuts = np.flatnonzero(np.diff(r)) + 1
        for rank, positions in zip(r[np.r_[0, cuts]].tolist(), np.split(left, cuts), strict=True):
            if rank not in where:
                heapq.heappush(active, rank)
            where[rank].append(positions)

    record(np.flatnonzero(is_symbol))
    while active:
        rank = heapq.heappop(active)
        lists = where.pop(rank)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        a, b = v.left[rank], v.right[rank]
        at = at[(sym[at] == a) & (sym[nxt[at]] == b)]  # others were merged away meanwhile
        if a == b and len(at) > 1:
            at = _apart(np.sort(at), nxt)
        if not len(at):
            continue
        gone = nxt[at]
        sym[at], sym[gone] = v.made[rank], -2
        after = nxt[gone]
        nxt[at], prv[after] = after, at
        before = prv[at]
        record(np.unique(np.concatenate([before[sym[before] >= 0], at])))
    kept = sym >= 0
    word_of = np.cumsum(~is_symbol) - 1
    return sym[kept], np.bincount(word_of[kept], minlength=len(words))[: len(words)]


def _apart(at: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Of runs of overlapping positions every other one, from the left."""
    joined = np.r_[False, nxt[at[:-1]] == at[1:]]
    start = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
    return at[(np.arange(len(at)) - start) % 2 == 0]


def gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The slices values[start : start + count] one after another."""
    total = int(counts.sum())
    first = np.repeat(starts - np.r_[0, np.cumsum(counts)[:-1]], counts) if total else np.zeros(0, dtype=np.int64)
    return values[first + np.arange(total)]


class Encoder:
    """Encodes blocks of texts; knows the words of earlier blocks of its task."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.find_latin, self.find_any = splitters()
        self.special = re.compile("|".join(map(re.escape, sorted(v.special, key=len, reverse=True)))) if v.special else None
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        for token in self.v.special:
            self.index[token]  # noqa: B018  takes the next number
        self.ids = np.array(list(self.v.special.values()), dtype=np.int32)
        self.counts = np.ones(len(self.v.special), dtype=np.int64)

    def find(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.find_any(text)
        return self.find_latin(text)

    def words(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self.find(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*self.find(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.find(text[at:])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each has."""
        if len(self.index) > KNOWN_WORDS:
            self.forget()
        known, number, found, lengths = len(self.index), self.index.__getitem__, [], []
        for text in texts:
            numbers = np.fromiter(map(number, self.words(text)), dtype=np.int64)
            found.append(numbers)
            lengths.append(len(numbers))
        new = list(self.index)[known:] if len(self.index) > known else []
        if new:
            ids, counts = merge_words(self.v, [w.encode("utf-8") for w in new])
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        starts = np.cumsum(self.counts) - self.counts
        flat = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
        per_word = self.counts[flat]
        text_of = np.repeat(np.arange(len(texts)), lengths)
        return gather(self.ids, starts[flat], per_word), np.bincount(text_of, weights=per_word, minlength=len(texts)).astype(np.int64)


def blocks(batches, column: str, most: int):
    """Record batches cut and joined so that each holds about ``most`` bytes of ``column``, one row at least."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        begin = 0
        ends = np.cumsum(lengths)
        while begin < batch.num_rows:
            base = int(ends[begin - 1]) if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, base + most - size, side="right")))
            held.append(batch.slice(begin, stop - begin))
            size += int(ends[stop - 1]) - base
            begin = stop
            if size >= most or begin < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def encode(docs: DataFrame, vocab_path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` without ``text_col`` and with its token ids in ``out`` (array<int>; replaces a column of that name).

    Null and empty texts have no ids. Texts are encoded whole, whatever their length; rows stay as they are,
    repeated ones too. Strings of the file's special tokens become those tokens, as the tokenizers library has it.
    """
    v = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocab_path))
    kept = [c for c in docs.columns if c not in (text_col, out)]
    schema = StructType([*[docs.schema[c] for c in kept], StructField(out, ArrayType(IntegerType()))])

    def run(batches):
        encoder = Encoder(v.value)
        for block in blocks(batches, text_col, BLOCK_CHARS):
            ids, counts = encoder.encode([t or "" for t in block.column(text_col).to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids, type=pa.int32()))
            yield from pa.table([*[block.column(c) for c in kept], lists], names=[*kept, out]).to_batches()

    return docs.select(*[F.col(f"`{c}`") for c in [*kept, text_col]]).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocab_path: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """``encoded`` with the text of ``ids_col`` in ``out``; bytes that are not UTF-8 become U+FFFD. Null ids: empty text."""
    v = encoded.sparkSession.sparkContext.broadcast(Vocabulary(vocab_path))
    kept = [c for c in encoded.columns if c != out]
    schema = StructType([*[encoded.schema[c] for c in kept], StructField(out, StringType())])

    def run(batches):
        piece = v.value.token_bytes.__getitem__
        for batch in (b.slice(i, DECODED_ROWS) for b in batches for i in range(0, b.num_rows, DECODED_ROWS)):
            texts = []
            for ids in batch.column(ids_col):
                ids = ids.values.to_numpy(zero_copy_only=False).tolist() if ids.is_valid else []
                texts.append(b"".join(map(piece, ids)).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(texts, type=pa.string())], names=[*kept, out])

    return encoded.mapInArrow(run, schema)


def recode(docs: DataFrame, vocab_path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with token ids in ``out`` and ``text_col`` as decoded from them: encode() and decode() in one Python pass.

    One worker holds one vocabulary, and ids don't travel to the JVM and back in between. Rows as in both.
    """
    v = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocab_path))
    kept = [c for c in docs.columns if c not in (text_col, out)]
    schema = StructType([*[docs.schema[c] for c in kept], StructField(out, ArrayType(IntegerType())), StructField(text_col, StringType())])

    def run(batches):
        encoder, piece = Encoder(v.value), v.value.token_bytes.__getitem__
        for block in blocks(batches, text_col, BLOCK_CHARS):
            ids, counts = encoder.encode([t or "" for t in block.column(text_col).to_pylist()])
            ends = np.r_[0, np.cumsum(counts)]
            for begin in range(0, block.num_rows, DECODED_ROWS):
                cuts = ends[begin : begin + DECODED_ROWS + 1]
                part = ids[cuts[0] : cuts[-1]]
                numbers, own = part.tolist(), (cuts - cuts[0]).tolist()
                texts = [b"".join(map(piece, numbers[a:b])).decode("utf-8", "replace") for a, b in zip(own, own[1:], strict=False)]
                lists = pa.ListArray.from_arrays(pa.array(np.array(own, dtype=np.int32)), pa.array(part, type=pa.int32()))
                rows = block.slice(begin, DECODED_ROWS)
                yield from pa.table([*[rows.column(c) for c in kept], lists, pa.array(texts, type=pa.string())], names=schema.names).to_batches()

    return docs.select(*[F.col(f"`{c}`") for c in [*kept, text_col]]).mapInArrow(run, schema)


def op3(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    from .common import table

    path = public_tokenizers.path("byte_bpe_50k.json")
    return recode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
