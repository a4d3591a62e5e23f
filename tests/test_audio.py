"""Rhythm on click tracks, and each step against a plain computation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import audio as A

TRACKS = "name string, part int, samples array<float>, level int"


def click_track(bpm, seconds=20.0, seed=0):
    """Bursts of a quiet 1 kHz tone, 30 ms long, over noise, and where they begin."""
    t = np.arange(int(seconds * A.RATE)) / A.RATE
    x = np.sin(2 * np.pi * 1000 * t) * (np.mod(t, 60 / bpm) < 0.03) / 16 + np.random.default_rng(seed).uniform(-0.005, 0.005, len(t))
    return x.astype(np.float32), np.arange(0, seconds, 60 / bpm)


def chunks(spark, tracks, size=A.CHUNK):
    rows = [(name, k, x[i : i + size].tolist(), k) for name, x in tracks.items() for k, i in enumerate(range(0, max(1, len(x)), size))]
    return spark.createDataFrame(rows, TRACKS).repartition(4)


@pytest.fixture(scope="module")
def clicks():
    return {f"{bpm}": click_track(bpm, seed=bpm) for bpm in (90, 128, 150)}


def test_click_tracks_within_a_percent_and_a_window(spark, clicks):
    reports = {r["track"]: r for r in A.track_reports(chunks(spark, {k: x for k, (x, _) in clicks.items()}), "name", "part", "samples").collect()}
    assert set(reports) == set(clicks)
    for name, (_, at) in clicks.items():
        r = reports[name]
        assert abs(r["bpm"] - float(name)) <= 0.01 * float(name) + 0.05 and r["length_s"] == 20.0 and 0 <= r["energy"] <= 1
        off = [min(abs(b - t) for t in at) for b in r["beats"]]
        assert abs(np.mean([b - min(at, key=lambda t, b=b: abs(b - t)) for b in r["beats"]])) <= 0.015
        assert len(r["beats"]) >= 0.9 * len(at) and float(np.median(off)) <= 0.0175 and np.mean(np.array(off) <= 0.03) > 0.9  # windows are 23 ms apart
        assert len(r["course"]) >= 19 and all(0 <= c <= 1 for c in r["course"])


def test_flux_doesn_t_depend_on_chunks(spark, clicks):
    x = clicks["128"][0]
    spectrum = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x.astype(np.float64), A.SIZE)[:: A.HOP] * np.hanning(A.SIZE), axis=1))
    want = np.concatenate([[0.0], np.maximum(0, np.diff(np.log1p(100 * spectrum), axis=0)).sum(axis=1)])
    got = A.spectral_flux(chunks(spark, {"a": x, "b": x[: A.CHUNK + 100], "c": x[:700], "d": x[:0]}), "name", "part", "samples").orderBy("track", "frame").collect()
    mine = [r["value"] for r in got if r["track"] == "a"]
    assert [r["frame"] for r in got if r["track"] == "a"] == list(range(len(want))) and np.allclose(mine, want, atol=1e-6)
    assert np.allclose([r["value"] for r in got if r["track"] == "b"], want[: 1 + (A.CHUNK + 100 - A.SIZE) // A.HOP], atol=1e-6)
    assert [(r["frame"], r["value"]) for r in got if r["track"] == "c"] == [(0, 0.0)] and not [r for r in got if r["track"] == "d"]


def test_envelope_and_tempo_equal_plain_ones(spark):
    r = np.random.default_rng(2)
    series = {"a": r.random(400) * (np.arange(400) % 21 == 3) + r.random(400) * 0.1, "b": r.random(300), "c": np.ones(60), "d": r.random(172), "e": r.random(173)}
    df = spark.createDataFrame([(k, i, float(v)) for k, s in series.items() for i, v in enumerate(s)], "k string, i long, v double").repartition(3)
    env = A.onset_envelope(df, "k", "i", "v")
    got = {k: [x["v"] for x in env.where(F.col("k") == k).orderBy("i").collect()] for k in series}
    bpm = {x["k"]: x["bpm"] for x in A.tempos(env, "k", "i", "v").collect()}
    for k, s in series.items():
        smooth = np.convolve(s, np.ones(43) / 43, mode="same")
        risen = np.maximum(0, s - smooth)
        want = risen / risen.std() if risen.std() > 0 else risen
        assert np.allclose(got[k], want, atol=1e-9)
        h = want - want.mean()
        lags = np.arange(12, 44)
        w = np.array([float((h[: len(h) - n] * h[n:]).sum()) for n in lags]) * np.exp(-0.5 * np.log2(60 * A.FPS / lags / 120) ** 2)
        i = int(np.argmax(w))
        bend = w[i - 1] - 2 * w[i] + w[i + 1] if 0 < i < len(w) - 1 else 0
        tempo = 60 * A.FPS / (lags[i] + (0.5 * (w[i - 1] - w[i + 1]) / bend if bend else 0.0))
        assert abs(bpm[k] - (tempo if len(s) >= 4 * A.FPS else 0.0)) < 1e-6, k
    assert bpm["d"] == 0.0 < bpm["e"]


def test_beats_are_the_best_chain():
    """Against all chains of a short envelope."""
    r = np.random.default_rng(3)
    for _ in range(30):
        env, period = r.random(13) * 3, float(r.uniform(2.5, 4.5))
        near, far = round(period / 2), round(2 * period)

        def best(t, env=env, period=period, near=near, far=far):
            options = [best(t - d) for d in range(near, far + 1) if t - d >= 0]
            options = [(w - A.TIGHTNESS * math.log((t - c[-1]) / period) ** 2, c) for w, c in options]
            w, c = max(options, key=lambda x: x[0], default=(0.0, []))
            return env[t] + w, [*c, t]

        ends = [best(t) for t in range(13 - max(1, int(period)), 13)]
        chain = max(ends, key=lambda x: x[0])[1]
        least = A.LEAST_ONSET * np.median(env[chain])
        assert A.beat_frames(env, period) == [f for f in chain if env[max(0, f - 2) : f + 3].max() >= least]
    assert A.beat_frames(np.zeros(0), 4.0) == [] == A.beat_frames(np.ones(9), 0.0)


def test_folding_and_no_rows(spark):
    values = [0.0, 20.0, 74.9, 75.0, 185.0, 185.1, 740.0, 1000.0]
    got = [x[0] for x in spark.createDataFrame([(v,) for v in values], "b double").select(A.folded_tempo(F.col("b"))).collect()]
    assert got == [0.0, 80.0, 149.8, 75.0, 185.0, 92.55, 185.0, 125.0]
    assert A.track_reports(spark.createDataFrame([], TRACKS), "name", "part", "samples").count() == 0
