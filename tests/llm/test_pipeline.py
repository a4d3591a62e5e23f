"""The pipeline's stages against brute force, and what they keep."""

import collections

import corpus_pipeline

from .fixtures import CLASHES, LABELS, ROWS, documents, long_rows
from .test_nearcopies import plain_kept


def _tables(spark, path, rows, labels=()):
    documents(spark, rows, clashes=True).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), LABELS).write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    rows = long_rows(120)
    rows = [(i, t + (" vilewretch" if k % 8 == 4 else ""), lang, s, n) for k, (i, t, lang, s, n) in enumerate(rows)]
    labels = [(r[0], 1, int("vilewretch" in r[1])) for r in rows[:100]]
    sf = _tables(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf)
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        out = spark.read.parquet(path)
        if name != "encoding":
            assert out.columns == docs.columns
        if name == "toxicity":
            assert {r["doc_id"] for r in out.collect()} == {r[0] for r in rows if "vilewretch" not in r[1]}
        if name == "near_duplicates":
            assert sorted(r["doc_id"] for r in out.collect()) == plain_kept([(r["doc_id"], r["text"]) for r in now.collect()])
        if name == "personal_data":
            assert out.count() == now.count()
        if name == "encoding":
            assert {r["text"] for r in out.collect()} == {r["text"] for r in now.collect()} and set(CLASHES) <= set(out.columns)
        now = out
    again = corpus_pipeline.run(spark, sf).collect()
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in again) == collections.Counter((r["doc_id"], tuple(r["ids"])) for r in now.collect())


def test_odd_and_empty_tables(spark, tmp_path):
    """Nulls in every column, empty, blank and long texts, repeated rows: what each stage keeps of them."""
    sf = _tables(spark, tmp_path / "odd", ROWS)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = corpus_pipeline.toxicity(spark, docs, sf)
    assert clean.count() == len(ROWS)  # without labels nothing is rejected
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, clean, sf).collect()]
    # Texts without words are one group, whose smallest id stays; a null id only stays where no other row is alike.
    assert sorted((i for i, _ in kept if i is not None)) == [1, 3, 6, 7, 8, 9, 10, 11] and sum(i is None for i, _ in kept) == 1
    safe = corpus_pipeline.personal_data(spark, docs, sf)
    assert safe.count() == len(ROWS) and not [r for r in safe.where("doc_id = 9").collect() if "@" in r["text"]]
    mixed = corpus_pipeline.mixing_sources(spark, docs, sf)
    times = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == docs.columns and max(times.values()) <= 4  # twice at most, ids 2 and 9 are there twice
    coded = corpus_pipeline.encoding(spark, docs, sf)
    assert {r["n_tokens"] for r in coded.where("doc_id in (3, 4)").collect()} == {0} and coded.count() == len(ROWS)
    empty = _tables(spark, tmp_path / "empty", [])
    assert corpus_pipeline.run(spark, empty).count() == 0
