"""Rhythm of audio tracks: onset envelopes, tempo, beats and energy.

A track is a number of rows (track, chunk, samples) of CHUNK samples each but the last. Spectra are taken chunk by chunk, so
a long track is many tasks' work; only the ends of the neighbouring chunks go along. From there on a track is a series
of about 43 values a second: smoothing, spread and autocorrelation are windows and sums. Only the choice of the beats
depends on all before it, and takes a track's series as one group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Samples a second, samples from window to window, samples of a window, and so values of an envelope a second.
RATE, HOP, SIZE = 22_050, 512, 2_048
FPS = RATE / HOP
# Tempi that are looked for, the one that is likeliest, and where tempi are folded to.
SLOWEST, FASTEST, LIKELY, FOLD = 60.0, 200.0, 120.0, (75.0, 185.0)
# How much beats keep to the tempo, and the share of a usual onset below which the first ones are no beats.
TIGHTNESS, LEAST_ONSET = 100.0, 0.3
# Parts of tempo, dense onsets and loudness in the energy; an onset that counts as dense, and its full share; ranges.
ENERGY, DENSE, DENSE_FULL, BPM_RANGE, DB_RANGE = (0.40, 0.35, 0.25), 1.5, 0.12, (70.0, 170.0), (-40.0, -8.0)
#: Samples of a chunk: a multiple of HOP, some 12 s.
CHUNK = HOP * 512


def _magnitudes(samples: np.ndarray) -> np.ndarray:
    """Log magnitudes of each whole window; windows are taken in blocks."""
    n = 1 + (len(samples) - SIZE) // HOP
    windows = np.lib.stride_tricks.sliding_window_view(samples, SIZE)[::HOP][:n]
    return np.concatenate([np.log1p(100 * np.abs(np.fft.rfft(windows[i : i + 256] * np.hanning(SIZE), axis=1))) for i in range(0, n, 256)])


def _chunks(tracks: DataFrame, track: str, chunk: str, samples: str) -> DataFrame:
    """Each chunk with the last HOP samples before it and the first SIZE after it."""
    order = Window.partitionBy(track).orderBy(chunk)
    before = F.lag(F.slice(samples, -HOP, HOP)).over(order)
    after = F.lead(F.slice(samples, 1, SIZE)).over(order)
    return tracks.select(F.col(track).alias("track"), F.col(chunk).cast("long").alias("chunk"), F.col(samples).cast("array<float>").alias("samples"), before.cast("array<float>").alias("before"), after.cast("array<float>").alias("after"))


def spectral_flux(tracks: DataFrame, track: str, chunk: str, samples: str) -> DataFrame:
    """track, frame, value: how much the log spectrum rises from window to window, 0 for the first; frame 0 begins with the track.

    Chunks are numbered from 0 and have CHUNK samples each but the last. A window that the track's end cuts off is none,
    but a track shorter than one window has one, filled up with silence. A null or empty chunk is an end.
    """
    kind = tracks.schema[track].dataType

    def run(batches):
        for b in batches:
            for t, c, now, before, after in zip(b.column("track"), b.column("chunk").to_pylist(), *(b.column(x) for x in ("samples", "before", "after")), strict=True):
                parts = [np.asarray(x.values if x.is_valid else [], dtype=np.float64) for x in (before, now, after)]
                if not len(parts[1]):
                    continue
                own, first = len(parts[1]), len(parts[0]) == 0
                x = np.concatenate(parts)
                if first and len(x) < SIZE:
                    x = np.pad(x, (0, SIZE - len(x)))
                if len(x) < SIZE:
                    continue
                flux = np.maximum(0.0, np.diff(_magnitudes(x), axis=0)).sum(axis=1)
                flux = np.concatenate([[0.0], flux]) if first else flux
                flux = flux[: -(-own // HOP)]  # windows that begin in the next chunk are its own
                begin = c * (CHUNK // HOP)
                yield pa.RecordBatch.from_arrays([pa.array([t.as_py()] * len(flux), type=b.column("track").type), pa.array(np.arange(begin, begin + len(flux))), pa.array(flux)], names=["track", "frame", "value"])

    return _chunks(tracks, track, chunk, samples).mapInArrow(run, f"track {kind.simpleString()}, frame long, value double")


def loudness(tracks: DataFrame, track: str, chunk: str, samples: str) -> DataFrame:
    """track, second, db: root mean square of each whole second, -120 dB at least."""
    at = F.col("chunk").cast("long") * CHUNK
    each = tracks.select(F.col(track).alias("track"), F.col(chunk).alias("chunk"), F.posexplode(F.col(samples)).alias("i", "x")).select("track", F.floor((at + F.col("i")) / RATE).alias("second"), (F.col("x").cast("double") ** 2).alias("p"))
    whole = each.groupBy("track", "second").agg(F.count("*").alias("n"), F.avg("p").alias("p")).where(F.col("n") == RATE)
    return whole.select("track", "second", (20 * F.log10(F.greatest(F.sqrt("p"), F.lit(1e-6)))).alias("db"))


def onset_envelope(series: DataFrame, track: str, place: str, value: str, fps: float = FPS) -> DataFrame:
    """track, place, value: ``value`` less its mean over the second around it (0 at least), by its spread over the track.

    Beyond the ends a series is 0. A series without spread stays as it is. Null values are 0, null tracks one track.
    """
    width = int(fps)
    order = Window.partitionBy(track).orderBy(place).rowsBetween(-(width // 2), (width - 1) // 2)
    filled = series.select(track, place, F.coalesce(F.col(value), F.lit(0.0)).cast("double").alias("__v"))
    risen = filled.withColumn("__r", F.greatest(F.lit(0.0), F.col("__v") - F.sum("__v").over(order) / width))
    spread = F.stddev_pop("__r").over(Window.partitionBy(track))
    return risen.withColumn("__s", spread).select(track, place, F.when(F.col("__s") > 0, F.col("__r") / F.col("__s")).otherwise(F.col("__r")).alias(value))


def tempos(envelope: DataFrame, track: str, place: str, value: str, fps: float = FPS, slowest: float = SLOWEST, fastest: float = FASTEST, likely: float = LIKELY) -> DataFrame:
    """track, bpm: the lag at which the envelope is most like itself, likelier tempi first, refined between lags; 0 under 4 seconds.

    Lags are whole steps from ``fastest`` to ``slowest``; of equal ones the shortest counts. A tempo weighs less by a bell over
    octaves around ``likely``.
    """
    lags = range(int(60 * fps / fastest), int(60 * fps / slowest) + 1)
    order, whole = Window.partitionBy(track).orderBy(place), Window.partitionBy(track)
    centred = envelope.select(track, place, (F.col(value) - F.avg(value).over(whole)).alias("__h"))
    moved = centred.select(track, "__h", *[F.lead("__h", lag).over(order).alias(f"__{lag}") for lag in lags])
    sums = moved.groupBy(track).agg(F.count("*").alias("__n"), *[F.coalesce(F.sum(F.col("__h") * F.col(f"__{lag}")), F.lit(0.0)).alias(f"__{lag}") for lag in lags])
    bell = {lag: float(np.exp(-0.5 * np.log2(60 * fps / lag / likely) ** 2)) for lag in lags}
    like = F.array(*[F.col(f"__{lag}") * bell[lag] for lag in lags])
    best = sums.select(track, "__n", like.alias("__w")).withColumn("__i", F.array_position("__w", F.array_max("__w")).cast("int"))
    a, b, c = (F.try_element_at("__w", F.col("__i") + k) for k in (-1, 0, 1))
    a = F.when(F.col("__i") > 1, a)
    bend = a - 2 * b + c
    shift = F.coalesce(F.when(bend != 0, 0.5 * (a - c) / bend), F.lit(0.0))
    bpm = 60 * fps / (F.col("__i") - 1 + lags[0] + shift)
    return best.select(track, F.when(F.col("__n") >= fps * 4, bpm).otherwise(0.0).alias("bpm"))


def folded_tempo(bpm, low: float = FOLD[0], high: float = FOLD[1]):
    """A tempo doubled until it is ``low`` or more, and halved until it is ``high`` at most; 0 stays."""
    ups = F.greatest(F.lit(0.0), F.ceil(F.log2(low / bpm)))
    raised = F.when(bpm > 0, bpm * F.pow(F.lit(2.0), ups))
    downs = F.greatest(F.lit(0.0), F.ceil(F.log2(raised / high)))
    return F.coalesce(raised / F.pow(F.lit(2.0), downs), F.lit(0.0))


def beat_frames(envelope: np.ndarray, period: float, tightness: float = TIGHTNESS) -> list[int]:
    """The places of an envelope that best hit its onsets and keep a distance of ``period``.

    A place's worth is its own value and that of the best place before it, less the squared log of how far their distance
    is off. The chain that ends best within the last period counts, without a weak beginning.
    """
    n = len(envelope)
    if period <= 0 or not n:
        return []
    near, far = round(period / 2), round(2 * period)
    loss = tightness * np.log(np.arange(near, far + 1) / period) ** 2
    worth, came = envelope.astype(np.float64).copy(), np.full(n, -1)
    for t in range(near, n):
        reach = min(far, t)
        before = worth[t - reach : t - near + 1][::-1] - loss[: reach - near + 1]  # nearest first
        k = int(np.argmax(before))
        worth[t], came[t] = envelope[t] + before[k], t - near - k
    last = worth[max(0, n - max(1, int(period))) :]
    t = n - 1 - int(np.argmax(last[::-1]))
    chain = []
    while t >= 0:
        chain.append(t)
        t = int(came[t])
    chain.reverse()
    least = LEAST_ONSET * float(np.median(envelope[chain]))
    return [f for f in chain if envelope[max(0, f - 2) : f + 3].max() >= least]


def beats(envelope: DataFrame, found: DataFrame, track: str, place: str, value: str, fps: float = FPS, shift_s: float = SIZE / (2 * RATE)) -> DataFrame:
    """track, beat (from 1), place, at_s: the beats of each track of ``envelope`` by the tempi ``found(track, bpm)``; none without a tempo.

    ``place`` counts up from 0 without gaps. An onset shows most in the middle of its window, so ``shift_s`` is added.
    """
    kind = envelope.schema[track].dataType.simpleString()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(place)
        bpm = float(part["bpm"].iloc[0])
        chosen = beat_frames(part[value].to_numpy(), 60 * fps / bpm if bpm > 0 else 0.0)
        at = np.array(chosen, dtype=np.int64)
        return pd.DataFrame({track: part[track].iloc[0], "beat": np.arange(1, len(at) + 1), place: part[place].to_numpy()[at] if len(at) else at, "at_s": at / fps + shift_s})

    both = envelope.select(track, place, value).join(found.select(track, "bpm"), track)
    return both.groupBy(track).applyInPandas(run, f"`{track}` {kind}, beat long, `{place}` long, at_s double")


def track_reports(tracks: DataFrame, track: str, chunk: str, samples: str) -> DataFrame:
    """track, length_s, bpm, energy (0 to 1), beats (seconds), course (0 to 1 for each second) of each track of a second or more.

    Energy mixes tempo, the share of strong onsets and the median loudness; a course mixes each second's loudness and its
    onsets, by the most that the track has.
    """
    envelope = onset_envelope(spectral_flux(tracks, track, chunk, samples), "track", "frame", "value")
    found = tempos(envelope, "track", "frame", "value").withColumn("bpm", folded_tempo(F.col("bpm")))
    loud = loudness(tracks, track, chunk, samples)
    span = lambda x, low, high: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low)))
    sizes = tracks.where(F.size(samples) > 0).groupBy(F.col(track).alias("track")).agg(F.sum(F.size(samples)).alias("n")).where(F.col("n") >= RATE)
    middle = loud.groupBy("track").agg(F.median("db").alias("db"))
    dense = envelope.groupBy("track").agg(F.avg((F.col("value") > DENSE).cast("double")).alias("dense"))
    mixed = ENERGY[0] * span(F.col("bpm"), *BPM_RANGE) + ENERGY[1] * span(F.col("dense"), 0.0, DENSE_FULL) + ENERGY[2] * span(F.col("db"), *DB_RANGE)
    per = int(FPS)
    seconds = envelope.groupBy("track", F.floor(F.col("frame") / per).alias("second")).agg(F.count("*").alias("k"), F.avg("value").alias("v")).where(F.col("k") == per)
    seconds = seconds.join(loud, ["track", "second"], "left").withColumn("most", F.max("v").over(Window.partitionBy("track")))
    share = 0.5 * span(F.coalesce("db", F.lit(-60.0)), *DB_RANGE) + 0.5 * F.coalesce(F.try_divide("v", "most"), F.lit(0.0))
    course = seconds.groupBy("track").agg(F.transform(F.array_sort(F.collect_list(F.struct("second", F.round(share, 2).alias("c")))), lambda x: x["c"]).alias("course"))
    hits = beats(envelope, found, "track", "frame", "value").groupBy("track").agg(F.array_sort(F.collect_list(F.round("at_s", 3))).alias("beats"))
    report = sizes.join(found, "track").join(dense, "track").join(middle, "track").join(course, "track", "left").join(hits, "track", "left")
    return report.select("track", F.round(F.col("n") / RATE, 2).alias("length_s"), F.round("bpm", 1).alias("bpm"), F.round(mixed, 2).alias("energy"), F.coalesce("beats", F.array().cast("array<double>")).alias("beats"), F.coalesce("course", F.array().cast("array<double>")).alias("course"))
