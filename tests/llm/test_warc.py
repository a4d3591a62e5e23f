"""WARC archives: round trips of payloads, which page is the response, and damage."""

import base64
import collections
import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import common, warc

PAGES = "page_id long, url string, html string"
_PAGE = "<html><body>" + "Grüße aus Köln. " * 40 + "</body></html>"
ROWS = [
    (5, "http://a.example/1", _PAGE),
    (2, "http://a.example/2", _PAGE),
    (2, "http://a.example/2", _PAGE),
    (2, "http://a.example/0", _PAGE),
    (None, "http://a.example/n", _PAGE),
    (9, None, None),
    (8, "http://b.example/line\r\nbreak ü", ""),
    (7, "http://b.example/7", "x" * 300_000),
    (6, "http://b.example/6", "x" * 300_000),
    (1, "http://c.example/", "\r\n\r\nWARC/1.1\r\n\r\n\x00"),
    (None, None, "only here"),
    (3, "http://c.example/a", "same id"),
    (3, "http://c.example/b", "other text"),
    (-4, "http://c.example/c", "below zero"),
]


def pages(spark, rows, clashes=False):
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    return df.withColumns({c: F.lit("own") for c in ("payload", "sha1", "pair", "at", "first", "n", "chunk", "id", "a b")}) if clashes else df


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def plain(rows, least=0):
    groups = collections.defaultdict(list)
    for i, _, html in rows:
        groups[html or ""].append(i)
    out = collections.Counter()
    for html, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        for k, i in enumerate(ids):
            again = k > 0 and len(html.encode()) >= least
            out[i, len(html.encode()), digest(html), "revisit" if again else "response", ids[0] if again else None] += 1
    return out


def stored(spark, rows, tmp_path, least=0, chunk=1000, **more):
    folder = f"file://{tmp_path}/warc"
    archives = warc.write(warc.records(pages(spark, rows, **more), least_bytes=least, chunk=chunk), folder, "2020-01-01T00:00:00Z")
    return archives, folder


def found(chunks):
    refers = F.when(F.col("record_type") == "revisit", warc.page_of(F.col("refers_to")))
    ends = chunks.where("last").select(warc.page_of(F.col("record_id")), "n_bytes", "digest", "record_type", refers)
    return collections.Counter(tuple(r) for r in ends.collect())


def test_odd_rows_repeats_and_clashing_columns(spark, tmp_path):
    archives, folder = stored(spark, ROWS, tmp_path, clashes=True)
    rows = warc.read(archives, folder, chunk=700).collect()
    assert collections.Counter((r["record_id"], r["chunk"]) for r in rows).most_common(1)[0][1] == 1
    assert found(warc.read(archives, folder, with_data=False)) == plain(ROWS)
    texts = {digest(h): (h or "").encode() for _, _, h in ROWS}
    by_record = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r["chunk"]):
        if r["record_type"] == "response":
            by_record[r["record_id"]].append(r)
    for parts in by_record.values():
        whole = b"".join(p["data"] for p in parts)
        assert whole == texts[parts[-1]["digest"]] and [p["last"] for p in parts] == [False] * (len(parts) - 1) + [True]
        at = 0
        for p in parts:  # digests and lengths are those of what has been read so far
            at += len(p["data"])
            assert (p["n_bytes"], p["digest"]) == (at, base64.b32encode(hashlib.sha1(whole[:at]).digest()).decode()) and len(p["data"]) <= 700
    assert {r["refers_to"] for r in rows if r["record_type"] == "revisit"} <= set(by_record)
    (line,) = {r["url"] for r in rows if r["url"].startswith("http://b.example/line")}
    assert line == "http://b.example/line%0D%0Abreak%20%C3%BC"
    assert sum(r["records"] for r in archives.collect()) == len(ROWS)


def test_small_payloads_are_all_responses(spark, tmp_path):
    rows = [*ROWS, (11, "u", "same id"), (12, "u", "same id"), (12, "u", "same id")]
    archives, folder = stored(spark, rows, tmp_path, least=20)
    chunks = warc.read(archives, folder)
    assert found(chunks) == plain(rows, 20)
    assert len({r["record_id"] for r in chunks.collect()}) == len(rows)


def test_no_rows(spark, tmp_path):
    archives, folder = stored(spark, [], tmp_path)
    assert archives.count() == 0 and warc.read(archives, folder).count() == 0


def test_a_third_of_all_rows_is_one_payload(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "bitmap_bits", lambda n: 1 << 12)  # so that many other pages share a bit with a revisit
    r = random.Random(3)
    rows = [(i, f"http://x.example/{i}", _PAGE if i % 3 == 0 else f"page {r.randrange(1500)}") for i in r.sample(range(10**6), 3000)]
    archives, folder = stored(spark, rows, tmp_path)
    assert found(warc.read(archives, folder, with_data=False)) == plain(rows)


def test_files_are_plain_warc(spark, tmp_path):
    archives, _ = stored(spark, ROWS, tmp_path)
    for a in archives.collect():
        with gzip.open(f"{tmp_path}/warc/{a['archive']}") as f:
            text = f.read()
        at, kinds = 0, []
        while at < len(text):  # records by their lengths alone
            head, _, rest = text[at:].partition(b"\r\n\r\n")
            fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
            assert head.startswith(b"WARC/1.1\r\n") and {b"WARC-Record-ID", b"WARC-Date", b"WARC-Type"} <= set(fields)
            n = int(fields[b"Content-Length"])
            assert rest[n : n + 4] == b"\r\n\r\n"
            kinds.append(fields[b"WARC-Type"])
            at += len(head) + 4 + n + 4
        assert kinds[0] == b"warcinfo" and len(kinds) == a["records"] + 1


def test_damage_is_an_error():
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1:x>\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: 5\r\n\r\n"
    good = gzip.compress(head % digest("hello").encode() + b"hello\r\n\r\n")
    (row,) = warc.read_archive(io.BytesIO(good))
    assert (row["n_bytes"], row["digest"], row["last"]) == (5, digest("hello"), True)
    for bad in (head % digest("hallo").encode() + b"hello\r\n\r\n", head % digest("hello").encode() + b"hel", b"no record"):
        with pytest.raises(ValueError):
            list(warc.read_archive(io.BytesIO(gzip.compress(bad))))


def test_folders_by_scheme():
    with pytest.raises(ValueError, match="dbfs"):
        common.file_system("dbfs://x/y")
    assert common.file_system("file:///tmp/x")[1] == "/tmp/x" == common.file_system("/tmp/x")[1]
    s3, path = common.file_system("s3a://bucket/some/key?region=eu-west-1")
    assert s3.type_name == "s3" and path == "bucket/some/key"
