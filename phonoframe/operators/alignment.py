"""Alignment of paired utterances by dynamic time warping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonoframe.operators.grouping import each, kind, over_utterances

_INF = float("inf")
Distance = Callable[[np.ndarray, np.ndarray], np.ndarray]


def euclidean(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows."""
    return np.sqrt(((x - y) ** 2).sum(-1))


#: Cells whose distances are taken at once; rows up to this width are walked cell by cell, wider ones as arrays.
CELLS, NARROW = 1 << 18, 40


def _distances(x: np.ndarray, y: np.ndarray, dist: Distance, spans: list[tuple[int, int]]) -> Iterator[np.ndarray]:
    """The distances of each row's cells, many rows at a time."""
    sizes = np.array([b - a for a, b in spans], np.int64)
    ends = np.cumsum(sizes)
    i = 0
    while i < len(spans):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - sizes[i] + CELLS, "right")))
        n = sizes[i:j]
        rows = np.repeat(np.arange(i, j), n)
        cols = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + np.repeat([a for a, _ in spans[i:j]], n)
        yield from np.split(dist(x[rows], y[cols]), np.cumsum(n)[:-1])
        i = j


def _narrow(d: list[float], a: int, above: list[float], c: int) -> list[float]:
    """A row's costs from its distances (from column a on) and the costs of the row above (from column c on)."""
    out, left, e = [], _INF, c + len(above)
    before = above[a - 1 - c] if c < a <= e else _INF
    for k, step in enumerate(d):
        j = a + k
        over = above[j - c] if c <= j < e else _INF
        best = before if before < over else over
        left = step + (best if best < left else left)
        before = over
        out.append(left)
    return out


def _wide(d: np.ndarray, a: int, above: np.ndarray, c: int) -> list[float]:
    """The same by a running minimum: left[k] = d[k] + min(best[k], left[k - 1])."""
    padded = np.full(len(d) + 1, np.inf)  # columns a - 1 to the end
    lo, hi = max(a - 1, c), min(a + len(d), c + len(above))
    if lo < hi:
        padded[lo - a + 1 : hi - a + 1] = above[lo - c : hi - c]
    total = np.cumsum(d)
    return (np.minimum.accumulate(np.minimum(padded[:-1], padded[1:]) - (total - d)) + total).tolist()


def warp(x: np.ndarray, y: np.ndarray, dist: Distance = euclidean, cells: list[tuple[int, int]] | None = None) -> tuple[float, list[tuple[int, int]]]:
    """The least total distance and its path; cells[i]: the first column of row i that a path may use, and the one after the last (default: all).

    The costs of all cells are kept (some 32 bytes each) until the path is known.
    """
    n, m = len(x), len(y)
    if not n or not m:
        return (0.0 if n == m else _INF), []
    spans = [(0, m)] * n if cells is None else cells
    rows: list[list[float]] = []
    above, c = [0.0], -1  # the start, before the first column of a row above the first
    for (a, _), d in zip(spans, _distances(x, y, dist, spans), strict=True):
        above = _narrow(d.tolist(), a, above, c) if len(d) <= NARROW else _wide(d, a, np.asarray(above), c)
        c = a
        rows.append(above)
    i, j, path = n - 1, m - 1, []
    while i >= 0 and j >= 0:
        path.append((i, j))
        a = spans[i][0]
        up, b = (rows[i - 1], spans[i - 1][0]) if i else ([0.0], -1)
        k = j - b
        over = up[k] if 0 <= k < len(up) else _INF
        across = up[k - 1] if 0 < k <= len(up) else _INF
        left = rows[i][j - 1 - a] if j > a else _INF
        if across <= over and across <= left:
            i, j = i - 1, j - 1
        elif over <= left:
            i -= 1
        else:
            j -= 1
    return rows[-1][m - 1 - spans[-1][0]], path[::-1]


def _last_row(x: np.ndarray, y: np.ndarray, dist: Distance) -> np.ndarray:
    """The least costs from the first cell to each cell of the last row; two rows are held at a time."""
    above = None
    for d in _distances(x, y, dist, [(0, len(y))] * len(x)):
        upto = np.cumsum(d)
        if above is None:
            above = upto
            continue
        best = above.copy()
        np.minimum(best[1:], above[:-1], out=best[1:])
        above = np.minimum.accumulate(best - (upto - d)) + upto
    return above


def linear_warp(x: np.ndarray, y: np.ndarray, dist: Distance = euclidean, cells: int = 1 << 20) -> tuple[float, list[tuple[int, int]]]:
    """The least total distance and a path of it, as ``warp`` finds them, in memory for two rows and `cells` cells.

    Costs from the start to the cells of the middle row, and from those to the end,
    tell a cell that the path goes through; both halves follow in the same way, along
    the longer sequence. Each cell's distance is taken about four times.
    """
    if not len(x) or not len(y):
        return warp(x, y, dist)
    path: list[tuple[int, int]] = []
    parts = [(0, len(x), 0, len(y))]  # still to do, the last first
    while parts:
        a, b, c, d = parts.pop()
        p, q = x[a:b], y[c:d]
        if len(p) * len(q) <= max(cells, 64):
            some = [(a + i, c + j) for i, j in warp(p, q, dist)[1]]
            path += some[1:] if path else some  # the parts share a cell
            continue
        turned = len(p) < len(q)
        if turned:
            p, q = q, p
        way: Distance = (lambda u, v: dist(v, u)) if turned else dist
        middle = len(p) // 2
        to = _last_row(p[: middle + 1], q, way)
        on = _last_row(p[middle:][::-1], q[::-1], way)[::-1]
        j = int(np.argmin(to + on - way(np.broadcast_to(p[middle], q.shape), q)))
        row, col = (a + j, c + middle) if turned else (a + middle, c + j)
        parts += [(row, b, col, d), (a, row + 1, c, col + 1)]
    i, j = np.array(path).T
    return float(dist(x[i], y[j]).sum()), path


def fast_warp(x: np.ndarray, y: np.ndarray, radius: int = 1, dist: Distance = euclidean) -> tuple[float, list[tuple[int, int]]]:
    """Approximate warping: the path of halved sequences, widened by `radius`, bounds the search at each finer level."""
    if min(len(x), len(y)) <= radius + 2:
        return warp(x, y, dist)
    half = lambda a: (a[: len(a) // 2 * 2 : 2] + a[1::2]) / 2
    _, coarse = fast_warp(half(x), half(y), radius, dist)
    low, high = np.full(len(x), len(y)), np.full(len(x), -1)
    for i, j in coarse:
        a, b = max(0, 2 * (i - radius)), min(len(x), 2 * (i + radius) + 2)
        low[a:b] = np.minimum(low[a:b], max(0, 2 * (j - radius)))
        high[a:b] = np.maximum(high[a:b], min(len(y) - 1, 2 * (j + radius) + 1))
    # What halving left over at the ends.
    low[-1], high[-1] = min(low[-1], low[-2]), len(y) - 1
    if len(x) % 2:
        low[-1] = min(low[-1], low[-2], len(y) - 1)
    high = np.maximum.accumulate(high)
    return warp(x, y, dist, [(int(a), int(b) + 1) for a, b in zip(low, high, strict=True)])


def _trimmed(x: np.ndarray, eps: float = 1e-7) -> np.ndarray:
    loud = np.flatnonzero(np.abs(x).sum(1) >= eps)
    return x[: loud[-1] + 1] if len(loud) else x[:0]


def paths(x: DataFrame, y: DataFrame, radius: int = 1, dist: Distance = euclidean, exact: bool = False, tasks: int | None = None) -> DataFrame:
    """(utt, step, x_frame, y_frame, distance) of frames (utt, frame, features) that both have; distance is over both lengths. Trailing silence is left out. Exact paths take memory in proportion to the lengths, not to their product."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        def table(i: np.ndarray, j: np.ndarray, d: float) -> pd.DataFrame:
            return pd.DataFrame({"utt": pd.Series([pdf["utt"].iloc[0]] * len(i), dtype=object), "step": np.arange(len(i)), "x_frame": i, "y_frame": j, "distance": np.full(len(i), d)})

        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        none = table(np.zeros(0, np.int64), np.zeros(0, np.int64), 0.0)
        if not len(a) or not len(b):
            return none
        p, q = (_trimmed(np.stack(f["features"].to_numpy()).astype(float)) for f in (a, b))
        if not len(p) or not len(q):
            return none
        d, path = linear_warp(p, q, dist) if exact else fast_warp(p, q, radius, dist)
        i, j = np.array(path).T
        return table(a["frame"].to_numpy()[i], b["frame"].to_numpy()[j], d / (len(p) + len(q)))

    side = lambda df, k: df.select("utt", F.lit(k).alias("side"), "frame", F.col("features").cast("array<double>").alias("features"))
    return over_utterances(side(x, 0).unionByName(side(y, 1)), each(run), f"utt {kind(x, 'utt')}, step long, x_frame long, y_frame long, distance double", tasks=tasks)


def aligned(path: DataFrame, x: DataFrame, y: DataFrame) -> DataFrame:
    """(utt, step, x, y): the features of both along a path."""
    a, b = (df.select("utt", F.col("frame").alias(f"{n}_frame"), F.col("features").alias(n)) for df, n in ((x, "x"), (y, "y")))
    return path.join(a, ["utt", "x_frame"]).join(b, ["utt", "y_frame"]).select("utt", "step", "x", "y")


def padded_pairs(x: DataFrame, y: DataFrame, radius: int = 1, dist: Distance = euclidean, exact: bool = False, tasks: int | None = None) -> DataFrame:
    """(utt, frame, x, y): the features of both along their path, then zeros up to one length: that of the longest utterance or path. Utterances of silence only are all zeros."""
    path = paths(x, y, radius, dist, exact, tasks)
    pairs = aligned(path, x, y).withColumnRenamed("step", "frame")
    width = lambda df: df.agg(F.coalesce(F.max(F.size("features")), F.lit(0))).scalar()
    longest = lambda df, c: df.agg(F.coalesce(F.max(c) + 1, F.lit(0)).cast("long")).scalar()
    ends = x.select("utt").distinct().join(y.select("utt").distinct(), "utt").join(path.groupBy("utt").agg((F.max("step") + 1).alias("_n")), "utt", "left")
    first, length = F.coalesce("_n", F.lit(0)).cast("long"), F.greatest(longest(x, "frame"), longest(y, "frame"), longest(path, "step"))
    rest = ends.withColumn("_a", first).withColumn("_t", length).where("_a < _t").withColumn("frame", F.explode(F.sequence("_a", F.col("_t") - 1)))
    zeros = rest.select("utt", "frame", F.array_repeat(F.lit(0.0), width(x)).alias("x"), F.array_repeat(F.lit(0.0), width(y)).alias("y"))
    return pairs.select("utt", "frame", *(F.col(c).cast("array<double>").alias(c) for c in "xy")).unionByName(zeros)


def iterative(x: DataFrame, y: DataFrame, n_iter: int = 3, components: int = 16, radius: int = 1, seed: int = 0, max_iter: int = 100, dist: Distance = euclidean) -> DataFrame:
    """Paths between x and y refined over n_iter rounds: align the x converted so far, fit a joint mixture on the aligned frames, convert the converted x once more by it.

    Each round's tables are cut by a checkpoint (in ``spark.checkpoint.dir``), as
    the next round reads them several times.
    """
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector

    from phonoframe.operators.gmm import JointMixture, mapped

    if n_iter < 1:
        raise ValueError("at least one round is needed")
    now = x.select("utt", "frame", F.col("features").cast("array<double>").alias("features"))
    for k in range(n_iter):
        path = paths(now, y, radius, dist).checkpoint()
        if k + 1 == n_iter:
            return path
        joint = aligned(path, now, y).select(array_to_vector(F.concat("x", F.col("y").cast("array<double>"))).alias("features"))
        model = GaussianMixture(k=components, maxIter=max_iter, seed=seed).fit(joint)
        now = mapped(now, JointMixture.of(model)).checkpoint()
    return path
