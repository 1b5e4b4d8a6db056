"""Operators along the frames of an utterance.

Frames are rows (utt, frame, ...); `utt` may be several columns. Everything is
a window per utterance, so one shuffle by utterance serves a whole chain.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonoframe.functions.windows import DeltaWindow
from phonoframe.operators.grouping import tasks_of
from phonoframe.operators.ranges import bounds, part

Keys = Sequence[str]


def along(utt: Keys, frame: str = "frame"):
    return Window.partitionBy(*utt).orderBy(frame)


def whole(utt: Keys):
    return Window.partitionBy(*utt)


def preemphasis(df: DataFrame, value: str, out: str, coef: float = 0.97, utt: Keys = ("utt",), frame: str = "frame") -> DataFrame:
    """x[t] - coef * x[t - 1]."""
    return df.withColumn(out, F.col(value) - coef * F.coalesce(F.lag(value).over(along(utt, frame)), F.lit(0.0)))


def inv_preemphasis(df: DataFrame, value: str, out: str, coef: float = 0.97, utt: Keys = ("utt",), frame: str = "frame", spread: bool = False) -> DataFrame:
    """df with the recursion y[t] = x[t] + coef * y[t - 1] along each utterance, by a scan of affine maps.

    A block of frames maps the y before it to the y at its end: y = b + coef^n * y0.
    Blocks are summed apart, b of the blocks before gives each its y0, and both
    meet. spread: the blocks of one utterance are dealt to several tasks too, by
    bounds over (utt, frame); df is then read more often. A null counts as NaN and
    makes all that follows NaN.
    """
    x = F.coalesce(F.col(value).cast("double"), F.lit(float("nan")))
    if coef == 0:
        return df.withColumn(out, x)
    fades = abs(coef) < 1
    # After `reach` frames a value counts less than e^-500 of itself, which no sum of doubles can tell.
    reach = int(500 / -math.log(abs(coef))) + 1 if fades else 1 << 20
    size = max(1, reach // 8)
    keys = [*utt, "_g", "_q"]
    power = lambda n: F.pow(F.lit(float(coef)), n)
    order = [*utt, frame]
    place = part(df.select(*order), bounds(df, *order, parts=tasks_of(df)), *order) if spread else F.lit(0)
    row = F.row_number().over(Window.partitionBy(*utt, "_g").orderBy(frame)) - 1
    placed = df.withColumn("_g", place).withColumn("_r", row).withColumn("_q", F.floor(F.col("_r") / size)).withColumn("_i", F.col("_r") % size)
    # Of a block's frames the latest has the largest weight, or all have about one: nothing cancels.
    inner = F.sum(x * power(-F.col("_i"))).over(Window.partitionBy(*keys).orderBy(frame).rowsBetween(Window.unboundedPreceding, 0)) * power(F.col("_i"))
    alone = placed.withColumn("_z", inner)
    blocks = alone.groupBy(*keys).agg(F.max_by("_z", "_i").alias("_b"), F.count("*").alias("_n"))
    along_blocks = Window.partitionBy(*utt).orderBy("_g", "_q")
    ended = blocks.withColumn("_end", F.sum("_n").over(along_blocks.rowsBetween(Window.unboundedPreceding, 0)))
    start, before = F.col("_end") - F.col("_n"), along_blocks.rowsBetween(Window.unboundedPreceding, -1)
    if fades:
        near = F.collect_list(F.struct("_b", "_end")).over(Window.partitionBy(*utt).orderBy("_end").rangeBetween(-(size + reach), -1))
        faded = F.aggregate("_near", F.lit(0.0), lambda y, e: y + e["_b"] * power(F.col("_start") - e["_end"]))
        ended = ended.withColumn("_start", start).withColumn("_near", near)
        entering = F.when(F.max(F.isnan("_b")).over(before), float("nan")).otherwise(faded)
    else:
        entering = F.coalesce(F.sum(F.col("_b") * power(-F.col("_end"))).over(before), F.lit(0.0)) * power(start)
    known = ended.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], entering.alias("_y0"))
    same = reduce(operator.and_, (F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)))
    joined = alone.join(known, same).withColumn(out, F.col("_z") + power(F.col("_i") + 1) * F.col("_y0"))
    return joined.select(*df.columns, *([out] if out not in df.columns else []))


def delta(df: DataFrame, value: str, out: str, window: DeltaWindow, utt: Keys = ("utt",), frame: str = "frame") -> DataFrame:
    """Correlation of a frame's neighbourhood with the window's coefficients; frames beyond the ends are zero."""
    w, middle, terms = along(utt, frame), len(window.taps) // 2, []
    for k, tap in enumerate(window.taps):
        at = k - middle
        if tap:
            there = F.col(value) if at == 0 else F.lead(value, at).over(w) if at > 0 else F.lag(value, -at).over(w)
            terms.append(F.lit(tap) * F.coalesce(there, F.lit(0.0)))
    total = terms[0] if terms else F.lit(0.0)
    for t in terms[1:]:
        total = total + t
    return df.withColumn(out, total)


def energy(features: Column) -> Column:
    """Sum of absolute values of a feature array."""
    return F.aggregate(features, F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))


def trim_zeros(df: DataFrame, size: Column, ends: str = "b", eps: float = 1e-7, utt: Keys = ("utt",), frame: str = "frame") -> DataFrame:
    """Drop leading (f) and trailing (b) frames whose `size` is under eps. Utterances of silence only vanish."""
    if not ends or set(ends) - {"f", "b"}:
        raise ValueError("ends is 'f', 'b' or both")
    loud = F.when(size >= eps, F.col(frame))
    marked = df.withColumn("_first", F.min(loud).over(whole(utt))).withColumn("_last", F.max(loud).over(whole(utt)))
    if "f" in ends:
        marked = marked.where(F.col(frame) >= F.col("_first"))
    if "b" in ends:
        marked = marked.where(F.col(frame) <= F.col("_last"))
    return marked.where("_last is not null").drop("_first", "_last")


def remove_zeros(df: DataFrame, size: Column, eps: float = 1e-7, utt: Keys = ("utt",), frame: str = "frame") -> DataFrame:
    """Keep frames whose `size` is over eps, numbered anew from 0."""
    return df.where(size > eps).withColumn(frame, (F.row_number().over(along(utt, frame)) - 1).cast("long"))


def _rounded(n: Column, by: int, up: bool) -> Column:
    return (F.ceil(n / by) if up else F.floor(n / by)) * by


#: Ways to fill frames beyond the end; see `padding`.
FILLS = ("zero", "edge", "reflect", "symmetric", "wrap", "maximum", "minimum", "mean", "median", "linear_ramp")


def padding(fill: str, at: Column, n: Column, values: Column, to: Column | None = None) -> Column:
    """The value of frame `at` (n or later) behind the n `values` of an utterance.

    zero; edge: the last one; reflect and symmetric: mirrored at the last frame,
    without and with it; wrap: from the start; maximum, minimum, mean, median: of
    all; linear_ramp: down to zero in frame `to`, the last.
    """
    item = lambda k: F.element_at(values, (k + 1).cast("int"))
    if fill == "zero":
        return F.lit(0.0)
    if fill == "edge":
        return item(n - 1)
    if fill == "wrap":
        return item(at % n)
    if fill == "symmetric":
        k = at % (2 * n)
        return item(F.when(k < n, k).otherwise(2 * n - 1 - k))
    if fill == "reflect":
        k = at % F.greatest(2 * n - 2, F.lit(1))
        return item(F.when(k < n, k).otherwise(2 * n - 2 - k))
    if fill == "linear_ramp":
        return item(n - 1) * (to - at) / (to - n + 1)
    if fill == "median":
        s = F.array_sort(values)
        return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / 2
    whole_ = {"maximum": F.array_max(values), "minimum": F.array_min(values), "mean": F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / n}
    return whole_[fill]


def adjust_length(df: DataFrame, value: str, by: int, pad: bool = True, fill: str = "zero", utt: Keys = ("utt",), frame: str = "frame") -> DataFrame:
    """Frames 0 .. T - 1 with T a multiple of `by`: values of `padding` appended, or the end cut off. Other columns stay; they are null in appended frames."""
    if fill not in FILLS:
        raise ValueError(f"unknown fill {fill!r}")
    n = F.count("*").over(whole(utt))
    if not pad:
        return df.withColumn("_t", _rounded(n, by, False)).where(F.col(frame) < F.col("_t")).drop("_t")
    # Only fills that look at more than the last frame gather an utterance's values.
    all_values = F.transform(F.array_sort(F.collect_list(F.struct(F.col(frame), F.col(value).cast("double").alias("v")))), lambda x: x["v"])
    values = {"zero": F.array(F.lit(0.0)), "edge": F.array(F.max_by(F.col(value).cast("double"), frame))}.get(fill, all_values)
    length = df.groupBy(*utt).agg(F.count("*").alias("_n"), values.alias("_values"))
    short = length.withColumn("_t", _rounded(F.col("_n"), by, True)).where("_t > _n")
    extra = short.withColumn(frame, F.explode(F.sequence(F.col("_n"), F.col("_t") - 1)))
    filled = F.element_at("_values", -1) if fill in ("zero", "edge") else padding(fill, F.col(frame), F.col("_n"), F.col("_values"), F.col("_t") - 1)
    return df.unionByName(extra.select(*utt, frame, filled.alias(value)), allowMissingColumns=True)


def adjust_pair(x: DataFrame, y: DataFrame, pad: bool = True, by: int = 1, utt: Keys = ("utt",), frame: str = "frame") -> DataFrame:
    """x (value) and y (value) of equal lengths as x_value and y_value: padded by zeros to the longer, or cut to the shorter, in multiples of `by`."""
    both = x.select(*utt, frame, F.col("value").alias("x_value")).join(y.select(*utt, frame, F.col("value").alias("y_value")), [*utt, frame], "full" if pad else "inner")
    full = both.select(*utt, frame, F.coalesce("x_value", F.lit(0.0)).alias("x_value"), F.coalesce("y_value", F.lit(0.0)).alias("y_value"))
    if by == 1:
        return full
    if not pad:
        t = _rounded(F.count("*").over(whole(utt)), by, False)
        return full.withColumn("_t", t).where(F.col(frame) < F.col("_t")).drop("_t")
    end = full.groupBy(*utt).agg((F.max(frame) + 1).alias("_n")).withColumn("_t", _rounded(F.col("_n"), by, True)).where("_t > _n")
    return full.unionByName(end.select(*utt, F.explode(F.sequence("_n", F.col("_t") - 1)).alias(frame), F.lit(0.0).alias("x_value"), F.lit(0.0).alias("y_value")))


def interpolate(df: DataFrame, value: str, out: str, kind: str = "linear", utt: Keys = ("utt",), frame: str = "frame") -> DataFrame:
    """Fill frames whose value isn't positive: linear, previous (or zero), next, nearest, or splines: quadratic, cubic.

    Ends hold the nearest voiced value; without any, values stay. Splines pass
    through the ends and all voiced values; with too few of them they fail.
    """
    kind = {"zero": "previous", "slinear": "linear"}.get(kind, kind)
    if kind in ("quadratic", "cubic"):
        return _splined(df, value, out, {"quadratic": 2, "cubic": 3}[kind], utt, frame)
    if kind not in ("linear", "previous", "next", "nearest"):
        raise ValueError(f"unknown kind {kind}")
    voiced = F.col(value) > 0
    w = along(utt, frame)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    here, at = F.when(voiced, F.col(value)), F.when(voiced, F.col(frame))
    marked = df.withColumns({
        "_v0": F.last(here, ignorenulls=True).over(back), "_t0": F.last(at, ignorenulls=True).over(back),
        "_v1": F.first(here, ignorenulls=True).over(ahead), "_t1": F.first(at, ignorenulls=True).over(ahead),
    })
    t, v0, v1, t0, t1 = (F.col(c) for c in (frame, "_v0", "_v1", "_t0", "_t1"))
    between = {
        "linear": v0 + (v1 - v0) * (t - t0) / (t1 - t0),
        "previous": v0,
        "next": v1,
        "nearest": F.when(t - t0 <= t1 - t, v0).otherwise(v1),
    }[kind]
    filled = F.when(voiced, F.col(value)).when(v0.isNull(), v1).when(v1.isNull(), v0).otherwise(between)
    return marked.withColumn(out, F.coalesce(filled, F.col(value))).drop("_v0", "_t0", "_v1", "_t1")


def _splined(df: DataFrame, value: str, out: str, degree: int, utt: Keys, frame: str) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(frame)
        y = pdf[value].to_numpy(float).copy()
        voiced = np.flatnonzero(y > 0)
        if len(voiced):
            y[0], y[-1] = y[voiced[0]], y[voiced[-1]]
            at = np.flatnonzero(y > 0)
            rest = np.flatnonzero(~(y > 0))
            if len(rest):
                y[rest] = spline(at.astype(float), y[at], rest.astype(float), degree)
        return pdf.assign(**{out: y})

    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, T.DoubleType())])
    return df.drop(*({out} - {value})).repartition(tasks_of(df), *utt).groupBy(*utt).applyInPandas(lambda pdf: run(pdf)[schema.names], schema)


def reshape_means(df: DataFrame, static_dim: int, utt: Keys = ("utt",)) -> DataFrame:
    """(frame, dim, value) with dims of window blocks side by side -> (row, dim, value) with the blocks one below the other."""
    n = F.max("frame").over(whole(utt)) + 1
    block = F.floor(F.col("dim") / static_dim)
    return df.withColumn("row", (block * n + F.col("frame")).cast("long")).withColumn("dim", (F.col("dim") % static_dim).cast("long")).select(*utt, "row", "dim", "value")


def _must_fit(n: Column, width: int, step: int) -> Column:
    """n, failing where windows of `width` every `step` don't fill n frames exactly."""
    return F.when((n >= width - step) & ((n + step - width) % step == 0), n).otherwise(F.raise_error(F.concat(F.lit(f"windows of {width} every {step} don't fit "), n.cast("string"), F.lit(" frames"))).cast("long"))


def sliding(df: DataFrame, value: str, width: int, step: int = 1, utt: Keys = ("utt",), frame: str = "frame", exact: bool = False) -> DataFrame:
    """(window, offset, value): windows of `width` frames every `step` frames, those that fit; exact: frames left over at the end are an error."""
    if step < 1 or width < step:
        raise ValueError("a step is 1 at least and no longer than a window")
    n = F.count("*").over(whole(utt))
    n = _must_fit(n, width, step) if exact else n
    # Each frame lies in the windows that start within the last `width` frames.
    first = F.greatest(F.ceil((F.col(frame) - width + 1) / step), F.lit(0))
    last = F.least(F.floor(F.col(frame) / step), F.floor((F.col("_n") - width) / step))
    marked = df.withColumn("_n", n).withColumn("_a", first).withColumn("_b", last).where("_a <= _b")
    return marked.select(*utt, F.explode(F.sequence("_a", "_b")).alias("window"), frame, value).withColumn("offset", F.col(frame) - F.col("window") * step).select(*utt, "window", "offset", value)


def overlap_add(df: DataFrame, value: str, step: int = 1, utt: Keys = ("utt",), onto: DataFrame | None = None) -> DataFrame:
    """(frame, value): windows (window, offset, value) added up where they overlap, and added to `onto` (frame, value) if given.

    Windows may come in any number of parts: the sums are partial ones per task first.
    """
    laid = df.select(*utt, (F.col("window") * step + F.col("offset")).alias("frame"), F.col(value).alias(value))
    laid = laid if onto is None else laid.unionByName(onto.select(*utt, "frame", value))
    return laid.groupBy(*utt, "frame").agg(F.sum(value).alias(value))


def chunked(windows: DataFrame, size: int) -> DataFrame:
    """windows with chunk, start and end: consecutive windows, `size` at a time (the last chunk may be shorter)."""
    if size < 1:
        raise ValueError("a chunk has one window at least")
    chunk = F.floor(F.col("window") / size)
    last = F.max("window").over(Window.partitionBy("utt")) + 1
    return windows.withColumn("chunk", chunk).withColumn("start", F.col("chunk") * size).withColumn("end", F.least(F.col("start") + size, last))


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray, degree: int) -> np.ndarray:
    """The interpolating spline of degree 2 or 3 through (x, y), x ascending, at places between the ends.

    Knots are the places themselves without the second and the last but one
    (cubic: "not a knot"), or the middles between them (quadratic). The collocation
    matrix is banded and totally positive, so elimination needs no pivots.
    """
    n, k = len(x), degree
    if n <= k:
        raise ValueError(f"a spline of degree {k} needs {k + 1} values at least")
    inner = x[2:-2] if k == 3 else ((x[1:] + x[:-1]) / 2)[1:-1]
    knots = np.concatenate([[x[0]] * (k + 1), inner, [x[-1]] * (k + 1)])

    def basis(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place the first of its k + 1 B-splines that aren't zero, and their values."""
        span = np.clip(np.searchsorted(knots, t, "right") - 1, k, n - 1)
        b = np.zeros((len(t), k + 1))
        b[:, 0] = 1
        for d in range(1, k + 1):
            saved = np.zeros(len(t))
            for r in range(d):
                right, left = knots[span + r + 1] - t, t - knots[span + 1 - d + r]
                term = b[:, r] / (right + left)
                b[:, r] = saved + right * term
                saved = left * term
            b[:, d] = saved
        return span - k, b

    first, b = basis(x)
    rows = [dict(zip(range(f, f + k + 1), v.tolist(), strict=True)) for f, v in zip(first.tolist(), b, strict=True)]
    right = y.astype(float).copy()
    for i in range(n):
        for j in range(i + 1, min(i + k + 1, n)):
            if factor := rows[j].get(i, 0.0) / rows[i][i]:
                for c, v in rows[i].items():
                    if c > i:
                        rows[j][c] = rows[j].get(c, 0.0) - factor * v
                right[j] -= factor * right[i]
    coef = np.zeros(n)
    for i in range(n - 1, -1, -1):
        coef[i] = (right[i] - sum(v * coef[c] for c, v in rows[i].items() if c > i)) / rows[i][i]
    first, b = basis(at)
    return (coef[first[:, None] + np.arange(k + 1)] * b).sum(1)
