"""Small tables with what real ones have: nulls in every column, empty and long texts, ties, repeats, odd columns."""

from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType(
    [
        StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
        StructField("source", StringType()), StructField("n_chars", LongType()),
    ]
)
#: Columns whose names operators use themselves.
CLASHES = ["row", "at", "fp", "ids", "size", "h", "score", "spans", "base", "k", "copy", "times", "digest", "toxic", "term", "a b"]

_PLAIN = "the quick brown fox jumps over the lazy dog while seven wizards quietly boil a large pot of green tea"
ROWS = [
    (1, _PLAIN, "en", "a", len(_PLAIN)),
    (2, _PLAIN, "en", "a", len(_PLAIN)),
    (2, _PLAIN, "en", "a", len(_PLAIN)),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (None, "eine Zeile ohne Nummer über Straßen und Gärten", "de", "b", 46),
    (None, None, None, None, None),
    (5, " \t\n ", "en", None, 4),
    (6, "漢字かな交じり文 mixed with English words 🙂\x00 end", "en", "c", 40),
    (7, "x" * 200_000, "en", "c", 200_000),
    (8, ("one two three four five six seven " * 9_000).strip(), "fr", "c", 1),
    (9, "mail john.smith@example.com or call +1 (984) 555-5227 from 10.0.0.1 card 4111 1111 1111 1111", "en", "a", 90),
    (9, "mail john.smith@example.com or call +1 (984) 555-5227 from 10.0.0.1 card 4111 1111 1111 1111", "en", "a", 90),
    (10, "<|endoftext|> is ordinary here, aaaaaaaaaaaaaaaaaaa 'll we've     x", "en", "a", 60),
    (11, _PLAIN.replace("green", "black"), "en", "b", 90),
]


def documents(spark, rows=None, clashes=False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS if rows is None else rows, DOCS).repartition(3)
    if clashes:
        df = df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    return df


def long_rows(n=300):
    """Documents with ids far apart, near copies, and a group of equal texts that has a third of all rows."""
    import random

    r = random.Random(5)
    words = ["".join(r.choice("abcdeilnorst") for _ in range(r.randint(2, 7))) for _ in range(300)]
    rows = []
    for i in range(n):
        if i % 3 == 0:
            text = "every third document says the very same thing about rivers and the towns along them"
        elif i % 10 == 1:
            parts = rows[r.randrange(len(rows))][1].split(" ")
            parts[r.randrange(len(parts))] = "edited"
            text = " ".join(parts)
        else:
            text = " ".join(r.choice(words) for _ in range(r.randint(1, 80)))
        rows.append((i * 7, text, r.choice(["en", "de"]), r.choice(["a", "a", "b", None]), len(text)))
    return rows


LABELS = "doc_id long, quality int, toxic int"
