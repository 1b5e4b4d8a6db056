"""Modulation spectra: the Fourier transform of feature trajectories along time.

A transform of n = n1 * n2 places takes two steps, each of them one shuffle.
Places t = n2 * t1 + t2 of one t2 meet and become n1 sums over t1, which are turned
by t2 * k1 / n; those of one k1 meet and become n2 sums over t2. Bin k1 + n1 * k2
results. A task never holds more of an utterance than n1 or n2 frames.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonoframe.operators.grouping import kind as type_of

#: Numbers that a task transforms at once, about.
STACK = 1 << 20
#: Numbers of all trajectories, each as long as the transform, that a task adds up as rows, about.
SUMMED = 1 << 19


def factors(n: int) -> tuple[int, int]:
    """n1 * n2 = n, as equal as n's divisors allow."""
    first = next(k for k in range(math.isqrt(n), 0, -1) if n % k == 0)
    return first, n // first


def tasks_for(trajectories: int, n: int, least: int = 1) -> int:
    """How many tasks ``modspec_rows`` takes so that what one holds doesn't grow with their number; frames dealt by utterance to as many stay there."""
    return max(least, -(-trajectories * n // SUMMED))


def modspec_rows(df: DataFrame, n: int, ortho: bool = False, utt: str = "utt") -> DataFrame:
    """(utt, dim, frame, value) -> (utt, dim, bin, power, re, im) for bins 0 to n / 2, by sums of cosines and sines.

    Frames from n on are cut off. A frame meets n1 / 2 bins and n2 of the sums that
    follow, not all n / 2 bins: as values are real, sums for k1 and n1 - k1 mirror
    each other, and bins beyond n / 2 those before.
    """
    n1, n2 = factors(n)
    turned = lambda re, im, angle: (re * F.cos(angle) + im * F.sin(angle), im * F.cos(angle) - re * F.sin(angle))
    columns = df.where(F.col("frame") < n).select(utt, "dim", (F.col("frame") % n2).alias("t2"), F.floor(F.col("frame") / n2).alias("t1"), "value", F.explode(F.sequence(F.lit(0), F.lit(n1 // 2))).alias("k1"))
    angle = F.col("t1") * F.col("k1") % n1 * (2 * np.pi / n1)
    inner = columns.groupBy(utt, "dim", "t2", "k1").agg(F.sum(F.col("value") * F.cos(angle)).alias("a"), (-F.sum(F.col("value") * F.sin(angle))).alias("b"))
    re, im = turned(F.col("a"), F.col("b"), F.col("t2") * F.col("k1") % n * (2 * np.pi / n))
    own = (F.col("k1") == 0) | (F.col("k1") * 2 == n1)  # sums that are their own mirror images: their bins beyond n / 2 come twice
    last = F.when(own, F.floor((F.lit(n // 2) - F.col("k1")) / n1)).otherwise(n2 - 1).cast("int")
    rows = inner.where(F.col("k1") <= n // 2).select(utt, "dim", "k1", "t2", re.alias("a"), im.alias("b"), F.explode(F.sequence(F.lit(0), last)).alias("k2"))
    re, im = turned(F.col("a"), F.col("b"), F.col("t2") * F.col("k2") % n2 * (2 * np.pi / n2))
    unit = 1 / np.sqrt(n) if ortho else 1.0
    sums = rows.groupBy(utt, "dim", "k1", "k2").agg((F.sum(re) * unit).alias("re"), (F.sum(im) * unit).alias("im"))
    place = F.col("k1") + n1 * F.col("k2")
    beyond = place > n // 2
    mirrored = sums.select(utt, "dim", F.when(beyond, n - place).otherwise(place).cast("int").alias("bin"), "re", F.when(beyond, -F.col("im")).otherwise(F.col("im")).alias("im"))
    return mirrored.withColumn("power", F.col("re") * F.col("re") + F.col("im") * F.col("im"))


def _lists(values: np.ndarray) -> pa.Array:
    """A list for each row of a matrix."""
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).ravel()))


def _step(df: DataFrame, size: int, sign: int, finish) -> DataFrame:
    """(utt, lane, place, re, im) -> (utt, lane, place, re, im): sums over a lane's places, `size` at most, then finish(lane, sum) -> (factors, new lanes, new places), null places left out."""
    fields = ["place", *(c for c in ("re", "im") if c in df.columns)]
    met = df.groupBy("utt", "lane").agg(F.collect_list(F.struct(*fields)).alias("rows"))
    turn = np.exp(sign * 2j * np.pi * (np.outer(np.arange(size), np.arange(size)) % size) / size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.asarray(batch.column(2).offsets)
            place, *parts = batch.column(2).flatten().flatten()
            row, place = np.repeat(np.arange(len(batch)), np.diff(ends)), place.to_numpy()
            values = [p.flatten().to_numpy().reshape(len(place), -1) for p in parts]
            lane, width = batch.column(1).to_numpy(), values[0].shape[1] if len(place) else 0
            some = max(1, STACK // (size * max(width, 1)))
            for i in range(0, len(batch), some):
                j = min(i + some, len(batch))
                own = slice(ends[i] - ends[0], ends[j] - ends[0])
                x = np.zeros((j - i, size, width), complex)
                x[row[own] - i, place[own]] = values[0][own] if len(values) == 1 else values[0][own] + 1j * values[1][own]
                factor, lanes, places = finish(lane[i:j, None], np.arange(size)[None])
                y = (turn @ x) * factor[:, :, None]
                keep = (places >= 0).ravel()
                y, at = y.reshape(-1, width)[keep], np.repeat(np.arange(i, j), size)[keep]
                yield pa.record_batch([batch.column(0).take(pa.array(at)), pa.array(lanes.ravel()[keep]), pa.array(places.ravel()[keep]), _lists(y.real), _lists(y.imag)], names=["utt", "lane", "place", "re", "im"])

    return met.mapInArrow(run, f"utt {type_of(df, 'utt')}, lane long, place long, re array<double>, im array<double>")


def transform(df: DataFrame, n: int, at: str = "frame", sign: int = -1, keep: int | None = None, scale: float = 1.0) -> DataFrame:
    """(utt, at, re, im) -> (utt, bin, re, im): sums over places of e^(sign 2 pi i place bin / n), for the first `keep` bins (default: all). Places that are missing count 0; im may be missing."""
    n1, n2 = factors(n)
    keep = n if keep is None else keep
    parts = [c for c in ("re", "im") if c in df.columns]
    laned = df.select("utt", (F.col(at) % n2).cast("long").alias("lane"), F.floor(F.col(at) / n2).cast("long").alias("place"), *parts)

    def twiddled(t2: np.ndarray, k1: np.ndarray):
        return np.exp(sign * 2j * np.pi * (t2 * k1 % n) / n), np.broadcast_to(k1, (len(t2), n1)), np.broadcast_to(t2, (len(t2), n1))

    def placed(k1: np.ndarray, k2: np.ndarray):
        bins = k1 + n1 * k2
        return np.full(bins.shape, scale), bins, np.where(bins < keep, bins, -1)

    return _step(_step(laned, n1, sign, twiddled), n2, sign, placed).select("utt", F.col("place").alias("bin"), "re", "im")


def _scale(n: int, norm: str | None, back: bool) -> float:
    """What sums are multiplied by: all on the way back, half and half ("ortho"), or all on the way forth ("forward")."""
    if norm not in (None, "backward", "ortho", "forward"):
        raise ValueError(f"unknown norm {norm!r}")
    return n**-0.5 if norm == "ortho" else 1 / n if (norm == "forward") != back else 1.0


def _arrays(f, *columns) -> Column:
    """f over the elements of arrays side by side."""
    if len(columns) == 1:
        return F.transform(columns[0], f)
    if len(columns) == 2:
        return F.zip_with(*columns, f)
    return F.transform(F.arrays_zip(*[c.alias(f"e{k}") for k, c in enumerate(columns)]), lambda e: f(*[e[f"e{k}"] for k in range(len(columns))]))


def _real(half: DataFrame, n: int, scale: float, weight: bool = True) -> DataFrame:
    """(utt, bin, re, im) of bins 0 to n / 2 -> (utt, frame, features): the real trajectory of n frames; weight: other bins than the ends stand for their mirror images too."""
    if weight:
        twice = F.when((F.col("bin") == 0) | (F.col("bin") * 2 == n), 1.0).otherwise(2.0)
        half = half.withColumns({c: F.transform(c, lambda v: v * twice) for c in ("re", "im")})
    return transform(half, n, "bin", 1, scale=scale).select("utt", F.col("bin").alias("frame"), F.col("re").alias("features"))


def _within(trajectories: DataFrame, frames: DataFrame) -> DataFrame:
    """Trajectories without what lies beyond their utterances' ends."""
    ends = frames.groupBy("utt").agg(F.max("frame").alias("_last")).withColumnRenamed("utt", "_utt")
    return trajectories.join(ends, F.col("utt").eqNullSafe(F.col("_utt")) & (F.col("frame") <= F.col("_last"))).select("utt", "frame", "features")


def _spectrum(frames: DataFrame, n: int, norm: str | None) -> DataFrame:
    x = frames.select("utt", "frame", F.col("features").cast("array<double>").alias("re"))
    return transform(x, n, keep=n // 2 + 1, scale=_scale(n, norm, False))


def modspec(frames: DataFrame, n: int = 4096, norm: str | None = None) -> DataFrame:
    """(utt, frame, features) -> (utt, bin, power, re, im): power and the unit phasor (1 where there is no power) of each dimension, for bins 0 to n / 2. Frames from n on are cut off."""
    z = _spectrum(frames.where(F.col("frame") < n), n, norm).withColumn("power", _arrays(lambda a, b: a * a + b * b, F.col("re"), F.col("im")))
    unit = lambda c, least: F.zip_with(c, "power", lambda v, p: F.when(p > 0, v / F.sqrt(p)).otherwise(least))
    return z.select("utt", "bin", "power", unit("re", 1.0).alias("re"), unit("im", 0.0).alias("im"))


def inv_modspec(spectra: DataFrame, norm: str | None = None, n: int | None = None) -> DataFrame:
    """(utt, bin, power, re, im) -> (utt, frame, features), n = 2 * (bins - 1) frames; without n a look at the bins finds it, which is one for all utterances."""
    if n is None:
        n = 2 * (spectra.agg(F.max("bin")).first()[0] or 0)
    if n < 1:
        return spectra.where("false").select("utt", F.col("bin").cast("long").alias("frame"), F.col("re").alias("features"))
    part = lambda c: F.zip_with("power", c, lambda p, v: F.sqrt(p) * v)
    return _real(spectra.select("utt", "bin", part("re").alias("re"), part("im").alias("im")), n, _scale(n, norm, True))


def smoothed(frames: DataFrame, rate: float, n: int = 4096, cutoff: float | None = 50, norm: str | None = None, log_domain: bool = True) -> DataFrame:
    """Trajectories without modulation above `cutoff` Hz (None: as they are): powers beyond are 1 (log domain) or 0. Utterances of more than n frames fail."""
    if cutoff is None:
        return frames.select("utt", "frame", "features")
    if cutoff > rate // 2:
        raise ValueError("the cutoff is above half the rate")
    first = int(n * cutoff / rate) + 1
    fail = F.raise_error(F.lit("an utterance is longer than the transform")).cast("long")
    x = frames.select("utt", F.when(F.col("frame") < n, F.col("frame")).otherwise(fail).alias("frame"), "features")
    z = _spectrum(x, n, norm)
    if log_domain:
        size = _arrays(lambda a, b: F.sqrt(a * a + b * b), F.col("re"), F.col("im"))
        unit = lambda c, least: F.zip_with(c, "_size", lambda v, s: F.when(s > 0, v / s).otherwise(least))
        z = z.withColumn("_size", size)
        beyond = {"re": unit("re", 1.0), "im": unit("im", 0.0)}
        z = z.select("utt", "bin", *(F.when(F.col("bin") < first, F.col(c)).otherwise(v).alias(c) for c, v in beyond.items()))
    else:
        z = z.where(F.col("bin") < first)
    return _within(_real(z, n, _scale(n, norm, True)), frames)


def modspec_gradient(frames: DataFrame, n: int = 2048, norm: str | None = None) -> DataFrame:
    """(utt, frame, features, gradient), gradient by the power per bin (in the rows of the bins) -> (utt, frame, features)."""
    z = _spectrum(frames.where(F.col("frame") < n), n, norm)
    g = frames.select(F.col("utt").alias("_utt"), F.col("frame").alias("_bin"), F.col("gradient").cast("array<double>").alias("_g"))
    met = z.join(g, F.col("utt").eqNullSafe(F.col("_utt")) & (F.col("bin") == F.col("_bin")))
    full = met.select("utt", "bin", *(F.zip_with(c, "_g", lambda v, w: 2 * v * w).alias(c) for c in ("re", "im")))
    back = _real(full, n, n**-0.5 if norm == "ortho" else 1.0, weight=False)
    return _within(back, frames)
