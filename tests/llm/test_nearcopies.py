"""Near copies against brute-force Jaccard similarity, with planted copies on both sides of 0.8."""

import random

from sparkloom.llm import nearcopies

from .fixtures import ROWS, documents, long_rows


def plain_kept(rows):
    def cut(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [cut(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if (a == sets[j] or len(a & sets[j]) >= 0.8 * len(a | sets[j])) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return sorted(min(rows[i][0] for i in range(len(rows)) if label[i] == g) for g in set(label))


def planted():
    r = random.Random(3)
    words = ["".join(r.choice("abcdeilnorst") for _ in range(6)) for _ in range(900)]
    rows = []
    for k in range(40):
        text = [r.choice(words) for _ in range(r.randint(60, 200))]
        for copy in range(4):
            rows.append((k * 10 + copy, " ".join(text), "en", "a", 1))
            for _ in range(r.randint(1, 3)):
                text[r.randrange(len(text))] = f"other{k}{copy}"
    return rows


def test_keeps_one_of_each_group_at_08(spark):
    for rows in (planted(), long_rows(300)):
        got = nearcopies.keep_one(documents(spark, rows, clashes=True))
        assert sorted(r["doc_id"] for r in got.collect()) == plain_kept(rows)
    assert len(plain_kept(planted())) < 130


def test_odd_rows(spark):
    docs = documents(spark, ROWS, clashes=True)
    got = nearcopies.keep_one(docs)
    assert got.columns == docs.columns
    ids = sorted((r["doc_id"] for r in got.collect()), key=lambda i: (i is None, i))
    assert ids == [1, 3, 6, 7, 8, 9, 10, 11, None]
    assert nearcopies.keep_one(documents(spark, [])).count() == 0


def test_templates_below_08_stay_apart_and_small_pieces_lose_nothing(spark, monkeypatch):
    """Pages of one template, two thirds alike: linked by none of their pairs. Near them, chains of real links."""
    r = random.Random(6)
    words = ["".join(r.choice("abcdeilnorst") for _ in range(6)) for _ in range(3000)]
    template = [r.choice(words) for _ in range(120)]
    rows = [(i, " ".join(template + [r.choice(words) for _ in range(34)]), "en", "a", 1) for i in range(150)]
    text = list(template) + [r.choice(words) for _ in range(34)]
    for i in range(40):  # a chain: the ends are far apart
        rows.append((1000 + i, " ".join(text), "en", "a", 1))
        text[i * 3] = f"step{i}"
    want = plain_kept(rows)
    assert 151 <= len(want) < 160
    monkeypatch.setattr(nearcopies, "PIECE", 8)
    got = nearcopies.keep_one(documents(spark, rows))
    assert sorted(x["doc_id"] for x in got.collect()) == want


def test_overlaps_and_forests():
    import numpy as np

    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, r.integers(0, 50)).astype(np.uint64)) for _ in range(30)]
    got = nearcopies.overlaps(sets, block=7)
    assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)
    sketches = r.integers(0, 256, (40, 64)).astype(np.uint8)
    sketches[1:30] = sketches[0]
    for i in range(1, 30):  # copies of the first, each with a third of its bytes changed
        sketches[i, r.choice(64, 21, replace=False)] ^= 255
    links = nearcopies.forest(sketches)
    assert len(links) == 29 and {p for p, _, _ in links} == {0}
    assert sorted(nearcopies.spanning(np.eye(4, k=1, dtype=bool) | np.eye(4, k=-1, dtype=bool))) == [(0, 1), (1, 2), (2, 3)]
