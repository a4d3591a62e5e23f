"""Personal data: base detectors, and information-theoretic sanitisation of the words that reveal what they found.

Protected entities are the values that the base detectors find. The corpus says how strongly a term reveals one: with
texts as events, disclosure is PMI(entity; term) as a share of the entity's information content
IC(entity) = -log p(entity); 1 means that the term gives the entity away altogether. Terms at or above REMOVE are
removed, those at or above GENERALISE are replaced by their class, the shape of the word. A text is one observation
however often the corpus repeats it, so copies reveal nothing, and a pair needs SUPPORT different texts. All texts are
counted, whole. A revealing term is marked at all its places in the documents that hold the entity. Elsewhere it stays:
rare words would else go from documents that have nothing to do with it.

One pass over the texts writes base spans and, where there are any, entities and terms. Entities that the same texts
hold are one, and so are terms, so a pair of them is counted once for each text and not for all their members; terms too
frequent to reveal anything are left out before. How many other texts have a candidate term comes from a second pass.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import bitmap_bits, lean, split_by_bitmap, table, written

KINDS = ("email", "ip", "card", "phone", "general", "removed")
LABELS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", None, "")
#: Different texts that a pair must share.
SUPPORT = 2
GENERALISE, REMOVE = 0.8, 0.9
#: Distinct terms that a counting task holds before it hands its counts on.
HELD_TERMS = 400_000

TERM = re.compile(r"[^\W\d_]{3,}")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A number that failed fails from each later digit of its run too, so runs are tried at their first digit only.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        v = int(d) * (1 + place % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _emails(text: str):
    """From each @: the run of local characters before it, not before the last match's end, and a domain after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and _LOCAL_END.match(text, begin - 1):
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield begin, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every base span, by kind and start; code points, end exclusive."""
    spans = [(0, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                spans.append((1, *m.span()))
        for m in _CARD.finditer(text):
            if 13 <= m.end() - m.start() and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                spans.append((2, *m.span()))
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                spans.append((3, *m.span()))
    return spans


def entity_of(kind: int, value: str) -> int:
    """A number for an entity, the same for each way that it is written."""
    plain = value.lower() if kind < 2 else "".join(_DIGIT.findall(value))
    return int.from_bytes(hashlib.blake2b(f"{kind}:{plain}".encode(), digest_size=8).digest(), "big", signed=True)


def class_of(word: str) -> str:
    """What a term is generalised to: the shape of the word."""
    if word.isupper():
        return "[CAPITALS]"
    return "[Name]" if word[:1].isupper() else "[word]"


def terms_of(text: str, spans: list[tuple[int, int, int]]) -> dict[str, list[tuple[int, int]]]:
    """The places of each term outside of base spans."""
    starts, ends = np.array([(a, b) for _, a, b in sorted(spans, key=lambda s: s[1])], dtype=np.int64).reshape(-1, 2).T
    ends = np.maximum.accumulate(ends) if len(ends) else ends
    found: dict[str, list[tuple[int, int]]] = {}
    for m in TERM.finditer(text):
        before = int(np.searchsorted(starts, m.end())) if len(starts) else 0  # spans that begin before the term's end
        if not before or ends[before - 1] <= m.start():
            found.setdefault(m[0].lower(), []).append(m.span())
    return found


_SPAN = pa.struct([("kind", pa.int32()), ("begin", pa.int64()), ("end", pa.int64())])
_PLACE = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
_TERM = pa.struct([("term", pa.string()), ("places", pa.list_(_PLACE))])
FOUND = "at long, same long, base array<struct<kind:int,begin:long,end:long>>, entities array<long>, terms array<struct<term:string,places:array<struct<begin:long,end:long>>>>"


def _same(text):
    """A number for a text, the same for its copies."""
    return F.xxhash64(F.coalesce(text, F.lit("")), F.length(text))


def _scan(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``rows(at, text, ...)`` with same, base spans and, where there are any, distinct entities and terms; ``keep`` columns stay."""
    rows = rows.withColumn("same", _same(F.col("text")))
    kept = [c for c in rows.columns if c in keep]
    schema = StructType([*StructType.fromDDL(FOUND).fields, *[rows.schema[c] for c in kept]])

    def run(batches):
        for whole in batches:
            for b in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                base, entities, terms = [], [], []
                for t in b.column("text"):
                    text = t.as_py() or ""
                    spans = base_spans(text)
                    base.append([{"kind": k, "begin": s, "end": e} for k, s, e in spans])
                    entities.append(sorted({entity_of(k, text[s:e]) for k, s, e in spans}))
                    words = terms_of(text, spans) if spans else {}
                    terms.append([{"term": w, "places": [{"begin": s, "end": e} for s, e in p]} for w, p in words.items()])
                columns = [b.column("at"), b.column("same"), pa.array(base, type=pa.list_(_SPAN)), pa.array(entities, type=pa.list_(pa.int64())), pa.array(terms, type=pa.list_(_TERM)), *[b.column(c) for c in kept]]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(lean(run), schema)


def candidate_bitmap(terms: DataFrame) -> np.ndarray:
    """bitmap_bits() bits as bytes; those of the terms' CRC-32 are set. Put together by Spark in 4-KB pieces."""
    bits = bitmap_bits(terms.count())
    bit = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(bits)) + 1
    pieces = terms.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in pieces.collect():  # MOST_BITS / 32768 rows of 4 KB at most
        part = np.frombuffer(row["bits"], dtype=np.uint8)
        out[(row["piece"] - 1) * 4096 :][: len(part)] = part[: len(out) - (row["piece"] - 1) * 4096]
    return out


def each_once(texts: DataFrame, copied: DataFrame) -> DataFrame:
    """``texts(text)``, each different text once; ``copied(id)`` has the _same() of those that there are several of.

    Only texts that a bitmap of these can't rule out move, and of each task's copies one.
    """
    perhaps, single = split_by_bitmap(texts.select("text", _same(F.col("text")).alias("same")), "same", copied)
    return single.select("text").unionByName(perhaps.groupBy("same").agg(F.first("text").alias("text")).select("text"))


def document_counts(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: how many rows of ``texts(text)`` without base spans have each of ``terms(term)``; none: no row."""
    bitmap = texts.sparkSession.sparkContext.broadcast(candidate_bitmap(terms))

    def run(batches):
        counts: Counter = Counter()

        def handed_on():
            words = list(counts)
            bits = np.fromiter((zlib.crc32(w.encode()) % (8 * len(bitmap.value)) for w in words), dtype=np.int64, count=len(words))
            chosen = np.flatnonzero(bitmap.value[bits >> 3] >> (bits & 7) & 1) if words else []
            batch = [words[i] for i in chosen]
            return pa.RecordBatch.from_arrays([pa.array(batch, type=pa.string()), pa.array([counts[w] for w in batch], type=pa.int64())], names=["term", "n"])

        for b in batches:
            for t in b.column("text"):
                text = t.as_py() or ""
                if not base_spans(text):
                    counts.update({w.lower() for w in set(TERM.findall(text))})
                if len(counts) > HELD_TERMS:
                    yield handed_on()
                    counts.clear()
        yield handed_on()

    seen = texts.select("text").mapInArrow(lean(run), StructType([StructField("term", StringType()), StructField("n", LongType())]))
    return seen.groupBy("term").agg(F.sum("n").alias("n"))


def _sets(members: DataFrame, name: str) -> DataFrame:
    """``name``, set, n: for each member of ``members(name, at)`` with SUPPORT rows or more, a number for the set of its ``at``."""
    marks = [F.bit_xor(F.xxhash64("at", F.lit(k))).alias(f"x{k}") for k in (0, 1)]
    found = members.groupBy(name).agg(F.count("*").alias("n"), *marks).where(F.col("n") >= SUPPORT)
    return found.select(name, F.xxhash64("n", "x0", "x1").alias("set"), "n")


def _pairs(found: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """(entity, set) and (e_set, n_entity, n_both, term, n_with): what different texts with entities leave open.

    n_with are the texts with entities that have the term; there may be others, which only lower its disclosure.
    """
    held = found.where(F.size("entities") > 0)
    first = held.groupBy("same").agg(F.min("at").alias("at")).select("at")
    texts = written(held.select("at", "entities", F.col("terms.term").alias("words")).join(first, "at", "left_semi"), "pii-texts")
    entities = written(_sets(texts.select("at", F.explode("entities").alias("entity")), "entity"), "pii-entities")
    most = entities.agg(F.max("n").alias("n")).first()["n"] or 0
    reach = lambda n: F.pow(n, F.lit(GENERALISE)) * F.pow(F.lit(float(total)), F.lit(1 - GENERALISE)) * (1 + 1e-9)  # noqa: E731  of a term's texts, if it is to reveal
    words = texts.select("at", F.explode("words").alias("term"))
    terms = written(_sets(words, "term").where(F.col("n") <= reach(F.lit(float(most)))), "pii-terms")
    e = texts.select("at", F.explode("entities").alias("entity")).join(entities, "entity").select("at", F.col("set").alias("e_set"), F.col("n").alias("n_entity")).distinct()
    rare, _ = split_by_bitmap(words, "term", terms.select(F.col("term").alias("id")))
    t = rare.join(terms, "term").select("at", F.col("set").alias("t_set"), F.col("n").alias("n_with")).distinct()
    both = e.join(t, "at").where(F.col("n_with") <= reach(F.col("n_entity"))).groupBy("e_set", "n_entity", "t_set", "n_with").agg(F.count("*").alias("n_both"))
    both = both.where((F.col("n_both") >= SUPPORT) & (_disclosure("n_with", total) >= GENERALISE))
    pairs = both.join(terms.select("term", F.col("set").alias("t_set")), "t_set").select("e_set", "n_entity", "n_both", "term", "n_with")
    return entities.select("entity", "set"), written(pairs, "pii-pairs")


def _disclosure(n: str, total: int):
    pmi = F.log(F.col("n_both") * F.lit(float(total)) / (F.col("n_entity") * F.col(n)))
    content = F.log(F.lit(float(total)) / F.col("n_entity"))
    return F.when(content > 0, pmi / content).otherwise(F.lit(0.0))


def _revealing(found: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity, set) and (set, term, disclosure, kind): the terms whose disclosure of a set's entities is GENERALISE or more."""
    total = found.select("same").distinct().count()
    entities, pairs = _pairs(found, total)
    copied = written(found.where(F.size("base") == 0).groupBy("same").agg(F.count("*").alias("n")).where("n > 1").select(F.col("same").alias("id")), "pii-copied")
    others = document_counts(each_once(texts, copied), pairs.select("term").distinct())
    counted = pairs.join(others, "term", "left").withColumn("n", F.col("n_with") + F.coalesce("n", F.lit(0)))
    scored = counted.withColumn("disclosure", _disclosure("n", total)).where(F.col("disclosure") >= GENERALISE)
    kind = F.when(F.col("disclosure") >= REMOVE, KINDS.index("removed")).otherwise(KINDS.index("general"))
    return entities, written(scored.select(F.col("e_set").alias("set"), "term", "disclosure", kind.alias("kind")), "pii-disclosures")


def disclosures(found: DataFrame, texts: DataFrame) -> DataFrame:
    """entity, term, disclosure, kind: the pairs whose disclosure is GENERALISE or more. ``found`` is _scan()'s of ``texts(text)``."""
    entities, revealing = _revealing(found, texts)
    return entities.join(revealing, "set").drop("set")


def term_spans(found: DataFrame, entities: DataFrame, revealing: DataFrame) -> DataFrame:
    """at, terms: for rows that have any, the sorted spans of all places of terms that reveal an entity of the row."""
    held = found.where(F.size("entities") > 0).select("at", F.explode("entities").alias("entity"))
    marked = held.join(entities, "entity").select("at", "set").distinct().join(revealing, "set").groupBy("at", "term").agg(F.max("kind").alias("kind"))
    there = found.select("at", F.explode("terms").alias("t")).select("at", "t.term", "t.places")
    perhaps, _ = split_by_bitmap(there, "term", revealing.select(F.col("term").alias("id")))
    each = perhaps.join(marked, ["at", "term"]).select("at", "kind", F.explode("places").alias("p"))
    return each.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("kind", "p.begin", "p.end"))).alias("terms"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base, spans for each row: arrays of (kind number, begin, end), sorted; base spans are among all spans.

    Null and empty texts have no spans, and are one text. Texts are read whole. Repeated rows keep a row each and count as
    one text; ids may be null. Other columns aren't read. No rows give no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("at"))
    found = written(_scan(rows, ["doc_id"]), "pii-found")
    extra = term_spans(found, *_revealing(found, rows)).withColumnRenamed("terms", "extra")
    none = F.array().cast("array<struct<kind:int,begin:bigint,end:bigint>>")
    return found.join(extra, "at", "left").select("doc_id", "base", F.concat("base", F.coalesce("extra", none)).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with base spans replaced by their kind, revealing terms by their class or nothing; n_chars follows.

    All columns and rows stay; documents without personal data stay as they are.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"), F.monotonically_increasing_id().alias("at"))
    found = written(_scan(rows, ["row"]), "pii-rows")
    plain = found.where(F.size("base") == 0).select(F.col("row.text").alias("text"))
    extra = term_spans(found, *_revealing(found, plain)).withColumnRenamed("terms", "extra")
    clean = found.where(F.size("base") == 0).select("row.*")
    none = F.array().cast("array<struct<kind:int,begin:bigint,end:bigint>>")
    dirty = found.where(F.size("base") > 0).join(extra, "at", "left")
    spans = F.concat("base", F.coalesce("extra", none))
    text = _replace(F.col("row.text"), spans)
    edited = dirty.select("row", text.alias("safe")).select(F.col("row").withField("text", F.col("safe")).alias("row"))
    if "n_chars" in docs.columns:
        length = F.length("row.text").cast(docs.schema["n_chars"].dataType)
        edited = edited.select(F.col("row").withField("n_chars", length).alias("row"))
    return clean.unionByName(edited.select("row.*"))


def replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each span's label in its place; of overlapping spans the first label stands for all."""
    out, at = [], 0
    for begin, end, kind in sorted((b, e, k) for k, b, e in spans):
        if begin >= at:
            out += [text[at:begin], class_of(text[begin:end]) if LABELS[kind] is None else LABELS[kind]]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _replace(text, spans):
    @F.pandas_udf("string")
    def run(texts: pd.Series, all_spans: pd.Series) -> pd.Series:
        return pd.Series([replaced(t or "", [(s["kind"], s["begin"], s["end"]) for s in found]) for t, found in zip(texts, all_spans, strict=True)], dtype=object)

    return run(text, spans)


def op4(spark, sf_dir) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["begin"].cast("string"), s["end"].cast("string"))), ",")

    def of_kind(k):  # a lambda of two parameters would be given an element's place as its second
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [of_kind(k) for k in range(4)]
    return found.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
