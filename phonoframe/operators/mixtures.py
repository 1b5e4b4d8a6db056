"""Gaussian mixtures fitted by expectation maximisation: a round is one aggregate of sufficient statistics.

Tasks weigh their frames by each component's share and hand on sums of ones, values
and products, as many as the mixture has numbers; these sums are added up and turned
into the next mixture. Nothing else leaves a task, however many frames there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phonoframe.operators.gmm import JointMixture

#: Frames that a task weighs at once, and what is added to the diagonals of covariances.
ROWS, FLOOR = 1 << 14, 1e-6


def start(frames: DataFrame, components: int) -> JointMixture:
    """A start that only the frames' means and variances decide: components along the line of one deviation on both sides of the mean, all as wide as the whole."""
    by_dim = frames.select(F.posexplode(F.col("features").cast("array<double>")).alias("dim", "value")).groupBy("dim").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v")).orderBy("dim").collect()
    if not by_dim:
        raise ValueError("there are no frames to fit")
    mean, variance = np.array([r["m"] for r in by_dim]), np.array([r["v"] for r in by_dim])
    places = (2 * np.arange(components) + 1) / components - 1
    return JointMixture(np.full(components, 1 / components), mean + np.sqrt(variance) * places[:, None], np.repeat(np.diag(variance + FLOOR)[None], components, 0))


def shares(x: np.ndarray, mixture: JointMixture) -> tuple[np.ndarray, np.ndarray]:
    """Each component's share of each frame (T, M), and the frames' log densities."""
    factor = np.linalg.cholesky(mixture.covariances)
    z = np.linalg.solve(factor[None], (x[:, None] - mixture.means)[..., None])[..., 0]
    with np.errstate(divide="ignore"):
        log = np.log(mixture.weights) - 0.5 * (z**2).sum(-1) - np.log(np.einsum("mii->mi", factor)).sum(-1) - 0.5 * x.shape[1] * np.log(2 * np.pi)
    top = log.max(1, keepdims=True)
    total = np.exp(log - top).sum(1, keepdims=True)
    return np.exp(log - top) / total, (top + np.log(total))[:, 0]


def stepped(frames: DataFrame, mixture: JointMixture, floor: float = FLOOR) -> DataFrame:
    """component, weight, mean, covariance (by rows) and log_density (of all frames under `mixture`) after one round over frames (features). A component that no frame is left to keeps its place with weight 0."""
    m, d = mixture.means.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((m, 2 + d + d * d))
        for batch in batches:
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            for i in range(0, len(values), ROWS):
                x = values[i : i + ROWS]
                r, log = shares(x, mixture)
                sums[:, 0] += r.sum(0)
                sums[:, 1] += log.sum()
                sums[:, 2 : 2 + d] += r.T @ x
                sums[:, 2 + d :] += np.einsum("tm,ti,tj->mij", r, x, x, optimize=True).reshape(m, -1)
        k, at = (v.ravel() for v in np.indices(sums.shape))
        yield pa.record_batch([pa.array(k), pa.array(at), pa.array(sums.ravel())], names=["component", "at", "value"])

    parts = frames.select(F.col("features").cast("array<double>").alias("features")).where("features is not null").mapInArrow(run, "component long, at long, value double")
    added = parts.groupBy("component", "at").agg(F.sum("value").alias("value")).groupBy("component").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("_v"))
    v = lambda i: F.col("_v")[i]["value"]
    n, mean = v(0), [v(2 + i) / v(0) for i in range(d)]
    own = added.withColumn("weight", n / F.sum(n).over(Window.partitionBy()))  # a row per component
    left = n > 1e-12
    old_mean = F.element_at(F.lit(mixture.means.tolist()), (F.col("component") + 1).cast("int"))
    old_cov = F.element_at(F.lit(mixture.covariances.reshape(m, -1).tolist()), (F.col("component") + 1).cast("int"))
    cov = [v(2 + d + i * d + j) / n - mean[i] * mean[j] + (floor if i == j else 0.0) for i in range(d) for j in range(d)]
    return own.select("component", "weight", F.when(left, F.array(*mean)).otherwise(old_mean).alias("mean"), F.when(left, F.array(*cov)).otherwise(old_cov).alias("covariance"), v(1).alias("log_density"))


def step(frames: DataFrame, mixture: JointMixture, floor: float = FLOOR) -> tuple[JointMixture, float]:
    """The mixture after one round, and the log density of all frames before it."""
    rows = stepped(frames, mixture, floor).orderBy("component").collect()  # a row per component
    d = mixture.means.shape[1]
    return replace(mixture, weights=np.array([r["weight"] for r in rows]), means=np.array([r["mean"] for r in rows]), covariances=np.array([r["covariance"] for r in rows]).reshape(-1, d, d)), rows[0]["log_density"]


def fit(frames: DataFrame, components: int, rounds: int = 100, close: float = 1e-6, begin: JointMixture | None = None) -> JointMixture:
    """A mixture of the frames' features, from `begin` (default: ``start``), until a round adds less than `close` of the log density. Frames are read once a round."""
    now, before = begin or start(frames, components), -np.inf
    for _ in range(rounds):
        now, log = step(frames, now)
        if log - before <= close * abs(log):
            break
        before = log
    return now
