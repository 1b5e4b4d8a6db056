"""Feature mapping by a joint Gaussian mixture of source and target."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from phonoframe.functions.windows import DeltaWindow
from phonoframe.operators.grouping import kind, over_utterances
from phonoframe.operators.paramgen import generate_many


@dataclass(frozen=True)
class JointMixture:
    """Weights (M), means (M, 2D) and covariances (M, 2D, 2D); diff: map to target less source; swap: from target to source."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    diff: bool = False
    swap: bool = False

    @classmethod
    def of(cls, model, diff: bool = False, swap: bool = False) -> JointMixture:
        """From a fitted pyspark.ml GaussianMixtureModel."""
        g = model.gaussians
        return cls(np.array(model.weights), np.stack([x.mean.toArray() for x in g]), np.stack([x.cov.toArray() for x in g]), diff, swap)

    def parts(self) -> dict[str, np.ndarray]:
        d = self.means.shape[1] // 2
        c = self.covariances
        x, y, xx, xy, yx, yy = self.means[:, :d], self.means[:, d:], c[:, :d, :d], c[:, :d, d:], c[:, d:, :d], c[:, d:, d:]
        if self.diff:
            y, yy, xy = y - x, xx + yy - xy - yx, xy - xx
            yx = xy.transpose(0, 2, 1)
        if self.swap:
            x, y, xx, yy, xy, yx = y, x, yy, xx, yx, xy
        try:
            np.linalg.cholesky(xx)
        except np.linalg.LinAlgError as e:
            raise ValueError("a covariance is ill-defined: use fewer components") from e
        return {"x": x, "y": y, "xx": xx, "xy": xy, "yx": yx, "yy": yy}

    def conditional(self, src: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """Log densities (T, M) with weights, conditional means (T, M, D), and the parts."""
        p = self.parts()
        gap = src[:, None] - p["x"]
        z = np.linalg.solve(p["xx"][None], gap[..., None])[..., 0]
        log = np.log(self.weights) - 0.5 * ((gap * z).sum(-1) + np.linalg.slogdet(p["xx"])[1] + src.shape[1] * np.log(2 * np.pi))
        return log, p["y"] + np.einsum("mij,tmj->tmi", p["yx"], z), p


def expected(src: np.ndarray, mixture: JointMixture) -> np.ndarray:
    """The mean of the target given the source, by frame."""
    log, mean, _ = mixture.conditional(src)
    share = np.exp(log - log.max(1, keepdims=True))
    return np.einsum("tm,tmd->td", share / share.sum(1, keepdims=True), mean)


def conditional_path(src: np.ndarray, mixture: JointMixture) -> tuple[np.ndarray, np.ndarray]:
    """Means and diagonal variances of the target, each frame under its likeliest component."""
    log, mean, p = mixture.conditional(src)
    m = log.argmax(1)
    diag = {k: np.einsum("mii->mi", p[k]) for k in ("xx", "xy", "yx", "yy")}
    variance = diag["yy"] - diag["yx"] / diag["xx"] * diag["xy"]
    return mean[np.arange(len(src)), m], variance[m]


def trajectory(src: np.ndarray, mixture: JointMixture, windows: Sequence[DeltaWindow]) -> np.ndarray:
    """The likeliest static trajectory of one utterance."""
    return generate_many(*([x] for x in conditional_path(src, mixture)), windows)[0]


def mapped(frames: DataFrame, mixture: JointMixture) -> DataFrame:
    """(utt, frame, features) with each frame's expected target features. Row by row: nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(features=list(expected(np.stack(pdf["features"].to_numpy()).astype(float), mixture)))

    return frames.select("utt", "frame", "features").mapInPandas(run, f"utt {kind(frames, 'utt')}, frame {kind(frames, 'frame')}, features array<double>")


def converted(frames: DataFrame, mixture: JointMixture, windows: Sequence[DeltaWindow], tasks: int | None = None) -> DataFrame:
    """(utt, frame, features) by trajectories; features hold static and dynamic parts as the mixture does."""

    def kernel(some: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        likeliest = [conditional_path(np.stack(pdf["features"].to_numpy()).astype(float), mixture) for pdf in some]
        out = generate_many([m for m, _ in likeliest], [v for _, v in likeliest], windows)
        yield pd.concat([pdf.assign(features=list(x)) for pdf, x in zip(some, out, strict=True)])

    return over_utterances(frames.select("utt", "frame", "features"), kernel, f"utt {kind(frames, 'utt')}, frame {kind(frames, 'frame')}, features array<double>", tasks=tasks)
