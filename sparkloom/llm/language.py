"""Language identification: scripts narrow the candidates, Viterbi over word scores labels spans.

Each word has a log-likelihood under every language, from its character n-grams. The scripts that a language was
seen in decide for which words it is a candidate. The best sequence of labels for a document's words maximises the
sum of scores less SWITCH for each change of language, so spans of another language are found and stray words aren't.

Words are runs of letters of one script, with the marks that follow them, so text without spaces is cut where its
script changes. The model is fitted on a bounded sample (about SAMPLE documents of each language, by a hash of the id) and
has FEATURES numbers (a quarter of a megabyte) for each language; every language that is there is learnt.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .common import table

FEATURES = 1 << 16
#: Documents of each language that a fit reads, about.
SAMPLE = 1500
LONGEST_GRAM = 4
#: What a change of language costs, in nats; a language is a candidate for scripts with this share of its words.
SWITCH, SCRIPT_SHARE = 12.0, 0.01
#: Word scores that are held at once (words times languages), and distinct words that a task remembers.
BLOCK_SCORES, KNOWN_WORDS = 4_000_000, 400_000
UNKNOWN = "und"
#: Of the hash that samples documents: fine enough for any number of them.
HASH_BITS = 62

# First code points of script ranges, in order; each runs to the next.
SCRIPT_STARTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "other"), (0x08A0, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"),
    (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
    (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other"),
)
_STARTS = [a for a, _ in SCRIPT_STARTS]
SCRIPTS = sorted({s for _, s in SCRIPT_STARTS})
_SCRIPT_NUMBER = [SCRIPTS.index(s) for _, s in SCRIPT_STARTS]



@cache
def word_pattern() -> re.Pattern:
    """A run of letters of one script, with the marks that follow them."""
    letters, marks = defaultdict(list), []
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L":
            letters[_script_at(c)].append(c)
        elif kind[0] == "M":
            marks.append(c)

    def ranges(points: list[int]) -> str:
        cuts = [i for i in range(len(points)) if i == 0 or points[i] != points[i - 1] + 1]
        ends = [*cuts[1:], len(points)]
        return "".join(f"\\U{points[a]:08x}-\\U{points[z - 1]:08x}" for a, z in zip(cuts, ends, strict=True))

    latin_first = sorted(letters, key=lambda k: (SCRIPTS[k] != "latin", k))
    return re.compile("|".join(f"[{ranges(letters[k])}][{ranges(sorted(letters[k] + marks))}]*" for k in latin_first))


def words_of(text: str) -> list[str]:
    return word_pattern().findall(text)


def _script_at(point: int) -> int:
    return _SCRIPT_NUMBER[bisect_right(_STARTS, point) - 1]


def script_of(word: str) -> int:
    """Number of the script of a word's first letter, -1 if it has none."""
    letter = next((c for c in word if c.isalpha()), None)
    return -1 if letter is None else _script_at(ord(letter))


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all words' n-grams, ends marked and letter case aside, and the number of each one's word."""
    marked = [f"^{w.lower()}$" for w in words]
    letters = np.frombuffer("".join(marked).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), np.fromiter(map(len, marked), dtype=np.int64, count=len(words)))
    found, owner, rolled = [], [], np.zeros(len(letters), dtype=np.uint64)
    for n in range(1, LONGEST_GRAM + 1):
        m = max(0, len(letters) - n + 1)
        rolled = rolled[:m] * np.uint64(1_000_003) + letters[n - 1 :]
        whole = of[:m] == of[n - 1 :]
        found.append(((rolled[whole] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64) % FEATURES)
        owner.append(of[:m][whole])
    return np.concatenate(found), np.concatenate(owner)


class LanguageModel:
    """Log-likelihoods by feature and language, and the candidates of each script."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        total = counts.sum(axis=1, keepdims=True)
        self.table = np.log((counts + 0.1) / (total + 0.1 * FEATURES)).T.astype(np.float32)  # features by languages
        seen = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        seen &= scripts > 0
        self.candidates = np.where(seen.any(axis=0), seen, True).T  # scripts by languages; unknown scripts: all

    def word_scores(self, words: list[str]) -> np.ndarray:
        """One row of log-likelihoods for each word; languages that aren't candidates get far less. NaN: no letter."""
        out = np.zeros((len(words), len(self.languages)), dtype=np.float32)
        for begin in range(0, len(words), 50_000):  # bounds what the n-grams take
            features, of = grams(words[begin : begin + 50_000])
            n = min(50_000, len(words) - begin)
            for k in range(len(self.languages)):
                out[begin : begin + n, k] = np.bincount(of, weights=self.table[features, k], minlength=n)
        script = np.array([script_of(w) for w in words], dtype=np.int64)
        best = out.max(axis=1, keepdims=True)
        out = np.maximum(out - best, -30.0)  # no single word outweighs many
        out = np.where(self.candidates[np.maximum(script, 0)], out, -60.0).astype(np.float32)
        out[script < 0] = np.nan
        return out


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word. ``scores`` has the words of all documents one after another.

    Documents advance together, longest first, one word at a time: best(l) = max(best(l), best of all - switch) + score.
    """
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = (np.cumsum(lengths) - lengths)[order], lengths[order]
    labels = np.zeros(len(scores), dtype=np.int16)
    if not len(scores):
        return labels
    back = np.zeros(scores.shape, dtype=np.int16)
    value = np.zeros((len(sizes), scores.shape[1]), dtype=np.float64)
    own = np.arange(scores.shape[1])[None, :]
    active = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")  # documents with more than t words
    for t, n in enumerate(active.tolist()):
        at, v = starts[:n] + t, value[:n]
        top = v.argmax(axis=1)[:, None]
        changed = np.take_along_axis(v, top, axis=1) - switch
        stay = v >= changed
        back[at] = np.where(stay, own, top)
        value[:n] = np.where(stay, v, changed) + scores[at]
    now = value.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        n = int(active[t])
        at = starts[:n] + t
        labels[at] = now[:n]
        now[:n] = back[at, now[:n]]
    return labels


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learnt from. A null id isn't held out, and isn't learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def hash_bound(count: int, most: int) -> int:
    """Hashes of HASH_BITS bits below it are about ``most`` of ``count``; all of them where there aren't more."""
    return (1 << HASH_BITS) if count <= most else max(1, (most << HASH_BITS) // count)


def train(docs: DataFrame, most: int = SAMPLE) -> LanguageModel:
    """A model from text and lang of documents that aren't held out; counts, not texts, reach the driver."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    sizes = known.groupBy("lang").count().collect()  # a row for each language
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return LanguageModel([UNKNOWN], np.zeros((1, FEATURES)), np.zeros((1, len(SCRIPTS))))
    bounds = [(r["lang"], hash_bound(r["count"], most)) for r in sizes]
    bounds = F.broadcast(docs.sparkSession.createDataFrame(bounds, "lang string, bound long"))
    chosen = known.join(bounds, "lang").where(F.xxhash64("doc_id").bitwiseAND(F.lit((1 << HASH_BITS) - 1)) < F.col("bound"))
    schema = StructType([StructField("lang", StringType()), StructField("feature", LongType()), StructField("n", LongType())])

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column("text"), b.column("lang").to_pylist(), strict=True):
                words = Counter(words_of(text.as_py() or ""))
                into = counts.setdefault(lang, np.zeros(FEATURES + len(SCRIPTS), dtype=np.int64))
                times = np.fromiter(words.values(), dtype=np.int64, count=len(words))
                features, of = grams(list(words))
                np.add.at(into, features, times[of])
                scripts = np.array([script_of(w) for w in words], dtype=np.int64)
                np.add.at(into, FEATURES + scripts[scripts >= 0], times[scripts >= 0])
        for lang, c in counts.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), type=pa.string()), pa.array(some), pa.array(c[some])], names=schema.names)

    summed = chosen.select("text", "lang").mapInArrow(run, schema).groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    row = {lang: i for i, lang in enumerate(languages)}
    counts = np.zeros((len(languages), FEATURES + len(SCRIPTS)))
    if summed.num_rows:
        counts[[row[x] for x in summed.column("lang").to_pylist()], summed.column("feature").to_numpy()] = summed.column("n").to_numpy()
    return LanguageModel(languages, counts[:, :FEATURES], counts[:, FEATURES:])


SPAN = StructType([StructField("lang", StringType()), StructField("begin", LongType()), StructField("end", LongType())])
_SPAN_ARROW = pa.list_(pa.struct([("lang", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` without ``text_col`` and with lang_pred, score and spans (lang, begin, end in code points, in order).

    lang_pred has the most letters of the whole text, score is its share of them; ties go to the first by name. A
    null text and one without a letter is ``und`` with score 0 and no spans. Columns of these names are replaced;
    rows stay, repeated ones too. A model without languages says ``und`` everywhere.
    """
    names = ["lang_pred", "score", "spans"]
    kept = [c for c in docs.columns if c not in [text_col, *names]]
    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("spans", ArrayType(SPAN))]
    schema = StructType([*[docs.schema[c] for c in kept], *added])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        labeller = _Labeller(shared.value)
        for b in batches:
            parts = list(labeller.batch(b.column(text_col)))
            langs, scores, spans = (sum((p[i] for p in parts), []) for i in range(3))
            columns = [pa.array(langs, type=pa.string()), pa.array(scores, type=pa.float64()), pa.array(spans, type=_SPAN_ARROW)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *columns], names=schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in [*kept, text_col]]).mapInArrow(run, schema)


class _Labeller:
    """Labels texts in blocks; remembers the scores of words met before."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.sizes = np.zeros(0, dtype=np.int64)
        self.scores = np.zeros((0, len(self.model.languages)), dtype=np.float32)

    def batch(self, texts):
        block, held = [], 0
        most = BLOCK_SCORES // len(self.model.languages)
        for t in texts:
            text = t.as_py() or ""
            words = words_of(text)
            block.append((text, words))
            held += len(words)
            if held > most:
                yield self.label(block)
                block, held = [], 0
        if block:
            yield self.label(block)

    def label(self, block: list) -> tuple[list, list, list]:
        languages, known = self.model.languages, len(self.number)
        lengths = np.array([len(words) for _, words in block], dtype=np.int64)
        numbers = map(self.number.__getitem__, chain.from_iterable(words for _, words in block))
        flat = np.fromiter(numbers, dtype=np.int64, count=int(lengths.sum()))
        if len(self.number) > known:
            new = list(self.number)[known:]
            self.scores = np.concatenate([self.scores, self.model.word_scores(new)])
            self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, new), dtype=np.int64, count=len(new))])
        letters = self.sizes[flat]
        lettered = ~np.isnan(self.scores[:, 0])[flat]
        of = np.repeat(np.arange(len(block)), lengths)
        of, flat, letters, place = of[lettered], flat[lettered], letters[lettered], np.flatnonzero(lettered)
        counts = np.bincount(of, minlength=len(block))
        labels = viterbi(self.scores[flat], counts, SWITCH)
        n = len(languages)
        by = np.bincount(of * n + labels, weights=letters, minlength=len(block) * n).reshape(len(block), n)
        best, total = by.argmax(axis=1), by.sum(axis=1)
        told = (total > 0) & (languages != [UNKNOWN])
        names = [languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), told.tolist(), strict=True)]
        shares = np.where(told, by[np.arange(len(block)), best] / np.maximum(total, 1), 0.0).tolist()
        ends = np.cumsum(counts)
        starts = ends - counts
        first = np.cumsum(lengths) - lengths
        spans = []
        for i, ok in enumerate(told.tolist()):
            found = labels[starts[i] : ends[i]]
            spans.append(self.spans(block[i][0], place[starts[i] : ends[i]] - first[i], found) if ok else [])
        if len(self.number) > KNOWN_WORDS:
            self.forget()
        return names, shares, spans

    def spans(self, text: str, places: np.ndarray, labels: np.ndarray) -> list[dict]:
        """Runs of one label, from their first word's begin to their last word's end."""
        cuts = np.flatnonzero(np.diff(labels)) + 1
        firsts, lasts = np.r_[0, cuts], np.r_[cuts - 1, len(labels) - 1]
        end = len(text)
        while not (unicodedata.category(text[end - 1])[0] in "LM"):
            end -= 1
        if not len(cuts) and text[end - 1].isalpha():  # one language: no need to count words
            return [{"lang": self.model.languages[labels[0]], "begin": word_pattern().search(text).start(), "end": end}]
        edges = self.edges(text, set(places[np.r_[firsts, lasts]].tolist()))
        return [{"lang": self.model.languages[labels[a]], "begin": edges[int(places[a])][0], "end": edges[int(places[b])][1]} for a, b in zip(firsts, lasts, strict=True)]

    @staticmethod
    def edges(text: str, wanted: set[int]) -> dict[int, tuple[int, int]]:
        """Begin and end of the wanted words, by their number in the text."""
        return {i: m.span() for i, m in enumerate(word_pattern().finditer(text)) if i in wanted}


def op2(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
