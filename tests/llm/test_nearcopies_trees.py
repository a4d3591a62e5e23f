"""Near copies: SimHashes in BK-trees against brute force, and what leaves a shard before fingerprints move."""

import collections

import numpy as np

from sparkloom.llm import nearcopies


def clusters(seed, n):
    r = np.random.default_rng(seed)
    centres = r.integers(0, 1 << 63, (6, nearcopies.PRINTS), dtype=np.uint64)
    prints = centres[r.integers(0, 6, n)].view(np.uint8)
    prints ^= np.packbits(r.random((n, 8 * prints.shape[1])) < r.choice([0.0, 0.1, 0.2, 0.3], (n, 1)), axis=1)
    return prints


def test_trees_give_the_components_of_brute_force(monkeypatch):
    for leaf in (1, 3, 1024):
        monkeypatch.setattr(nearcopies, "LEAF", leaf)
        prints = clusters(leaf, 150)
        far = (np.unpackbits(prints[:, None] ^ prints[None], axis=2)).sum(axis=2)
        for radius in (0, 60, 170):
            label = list(range(150))
            for i, j, like in nearcopies.forest(prints, radius):
                assert far[i, j] <= radius and like == 512 - far[i, j]
                label = [label[i] if x == label[j] else x for x in label]
            want = nearcopies.spanning((far <= radius) & ~np.eye(150, dtype=bool))
            assert len(set(label)) == 150 - len(want)
            assert all(label[i] == label[j] for i, j in want)


def test_fingerprints_are_majorities_and_keep_pairs_at_08_within_the_radius():
    r = np.random.default_rng(2)
    for n in (4, 8, 40, 400):
        for _ in range(50):
            a = r.integers(0, 1 << 63, n, dtype=np.uint64)
            b = np.concatenate([a, r.integers(0, 1 << 63, n // 4, dtype=np.uint64)])  # similarity 0.8
            x, y = nearcopies.fingerprints(a), nearcopies.fingerprints(b)
            assert nearcopies.distances(x[None], y)[0] <= nearcopies.RADIUS
    ones = np.unpackbits(a.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
    assert (np.unpackbits(nearcopies.majority(a[:, None]).view(np.uint8), bitorder="little") == (2 * ones > len(a))).all()


def test_nodes_alone_in_a_shard_leave_it(spark):
    r = np.random.default_rng(3)
    rows = [(int(k), i) for i, k in enumerate(r.integers(-40, 40, 90))]
    many = collections.Counter(k for k, _ in rows)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for batch in ("1", "7", old):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = nearcopies._shared(spark.createDataFrame(rows, "key long, fp long")).collect()
        assert sorted(map(tuple, got)) == sorted(x for x in rows if many[x[0]] > 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert nearcopies._shared(spark.createDataFrame([], "key long, fp long")).count() == 0
