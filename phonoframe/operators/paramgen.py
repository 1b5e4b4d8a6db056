"""Maximum-likelihood parameter generation: the smoothest static trajectory under means and variances of dynamic features.

A task solves the bands of many utterances of similar lengths, and of all their
dimensions, in one loop over frames.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonoframe.functions.windows import DEFAULT, DeltaWindow
from phonoframe.operators import kernels
from phonoframe.operators.grouping import kind, over_utterances


def _precisions(variances: np.ndarray, shape: tuple[int, int], windows: tuple[DeltaWindow, ...]) -> list[np.ndarray]:
    if not (np.asarray(variances, float) > 0).all():
        raise ValueError("a variance isn't positive")
    return kernels.edge_zeroed(np.broadcast_to(1 / np.asarray(variances, float), shape).copy(), windows)


def generate_many(means: list[np.ndarray], variances: list[np.ndarray], windows: Sequence[DeltaWindow] = DEFAULT) -> list[np.ndarray]:
    """Trajectories (T, D) of the means (T, windows * D) of several utterances; variances alike, or one row for all frames."""
    windows = tuple(windows)
    out: list[np.ndarray] = [np.zeros(0)] * len(means)
    for some in kernels.by_length([len(m) for m in means]):
        bands, rights = [], []
        for i in some:
            tau = _precisions(variances[i], means[i].shape, windows)
            mu = np.split(np.asarray(means[i], float), len(windows), axis=1)
            rights.append(sum(kernels.apply_transposed(t * m, w) for t, m, w in zip(tau, mu, windows, strict=True)))
            bands.append(kernels.precision_band(tau, windows))
        for i, x in zip(some, kernels.solve_many(bands, rights), strict=True):
            out[i] = x
    return out


def generate(means: np.ndarray, variances: np.ndarray, windows: Sequence[DeltaWindow] = DEFAULT) -> np.ndarray:
    """The trajectory of one utterance."""
    return generate_many([means], [variances], windows)[0]


def gradient_many(variances: list[np.ndarray], grads: list[np.ndarray], windows: Sequence[DeltaWindow] = DEFAULT) -> list[np.ndarray]:
    """The gradients (T, windows * D) by the means, of the gradients (T, D) by the trajectories: one solve, then windows and precisions."""
    windows = tuple(windows)
    out: list[np.ndarray] = [np.zeros(0)] * len(grads)
    for some in kernels.by_length([len(g) for g in grads]):
        taus = [_precisions(variances[i], (len(grads[i]), grads[i].shape[1] * len(windows)), windows) for i in some]
        solved = kernels.solve_many([kernels.precision_band(t, windows) for t in taus], [grads[i] for i in some])
        for i, tau, x in zip(some, taus, solved, strict=True):
            out[i] = np.concatenate([t * kernels.apply_window(x, w) for t, w in zip(tau, windows, strict=True)], 1)
    return out


def gradient(variances: np.ndarray, grad: np.ndarray, n_frames: int, windows: Sequence[DeltaWindow] = DEFAULT) -> np.ndarray:
    """The gradient of one utterance of n_frames."""
    if len(grad) != n_frames:
        raise ValueError("the gradient has another number of frames")
    return gradient_many([variances], [grad], windows)[0]


def window_rows(windows: Sequence[DeltaWindow], n_frames: int) -> np.ndarray:
    """The (windows * T, T) matrix of all windows, one below the other."""
    eye = np.eye(n_frames)
    return np.concatenate([kernels.apply_window(eye, w) for w in windows])


def window_table(sizes: DataFrame, windows: Sequence[DeltaWindow] = DEFAULT) -> DataFrame:
    """(mat, n) -> (mat, row, col, value): the same for each length, a row of it per window and frame, zeros left out."""
    frame = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    taps = [(k, i - w.left, float(tap)) for k, w in enumerate(windows) for i, tap in enumerate(w.taps) if tap]
    tap = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("window"), F.lit(o).cast("long").alias("offset"), F.lit(v).alias("value")) for k, o, v in taps]))
    spread = sizes.where("n > 0").select("mat", F.col("n").cast("long").alias("n"), frame.alias("frame")).select("*", tap.alias("_t"))
    col = F.col("frame") + F.col("_t.offset")
    return spread.where((col >= 0) & (col < F.col("n"))).select("mat", (F.col("_t.window") * F.col("n") + F.col("frame")).alias("row"), col.alias("col"), F.col("_t.value").alias("value"))


def unit_variance_matrix(windows: Sequence[DeltaWindow], n_frames: int) -> np.ndarray:
    """The (T, windows * T) matrix R with trajectory = R @ means when all variances are 1."""
    windows = tuple(windows)
    eye = np.eye(n_frames)
    parts = kernels.edge_zeroed(np.ones((n_frames, len(windows))), windows)
    tau = [np.repeat(p, n_frames, 1) for p in parts]
    factor = kernels.cholesky(kernels.precision_band([t[:, :1] for t in tau], windows))
    stacked = [kernels.apply_transposed(t * eye, w) for t, w in zip(tau, windows, strict=True)]
    return np.concatenate([kernels.solve_factored(np.repeat(factor, n_frames, 2), s) for s in stacked], 1).astype(np.float32)


def _matrix(pdf: pd.DataFrame, column: str) -> np.ndarray:
    return np.stack(pdf[column].to_numpy()).astype(float)


def _written(some: list[pd.DataFrame], out: list[np.ndarray], column: str = "features") -> Iterator[pd.DataFrame]:
    yield pd.concat([pd.DataFrame({"utt": pdf["utt"].to_numpy(), "frame": pdf["frame"].to_numpy(), column: list(x)}) for pdf, x in zip(some, out, strict=True)], ignore_index=True)


def mlpg(frames: DataFrame, windows: Sequence[DeltaWindow] = DEFAULT, tasks: int | None = None) -> DataFrame:
    """(utt, frame, means, variances) -> (utt, frame, features)."""

    def kernel(some: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _written(some, generate_many([_matrix(p, "means") for p in some], [_matrix(p, "variances") for p in some], windows))

    return over_utterances(frames.select("utt", "frame", "means", "variances"), kernel, f"utt {kind(frames, 'utt')}, frame long, features array<double>", tasks=tasks)


def mlpg_gradient(frames: DataFrame, windows: Sequence[DeltaWindow] = DEFAULT, tasks: int | None = None) -> DataFrame:
    """(utt, frame, variances, gradient) -> (utt, frame, features): the gradient by the means."""

    def kernel(some: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _written(some, gradient_many([_matrix(p, "variances") for p in some], [_matrix(p, "gradient") for p in some], windows))

    return over_utterances(frames.select("utt", "frame", "variances", "gradient"), kernel, f"utt {kind(frames, 'utt')}, frame long, features array<double>", tasks=tasks)


def unit_variance_mlpg(frames: DataFrame, windows: Sequence[DeltaWindow] = DEFAULT, transposed: bool = False, tasks: int | None = None) -> DataFrame:
    """Trajectories under unit variances, each utterance at its own length; transposed: the gradient's way back.

    (utt, row, dim, value) of reshaped means -> (utt, frame, dim, value), or, transposed,
    (utt, frame, dim, value) of gradients -> (utt, row, dim, value). R = inverse(W' W) W' is
    never built: W' or W is applied and a band solved, so the cost is linear in the frames.
    """
    windows = tuple(windows)
    n_win = len(windows)
    key, out = ("frame", "row") if transposed else ("row", "frame")

    def kernel(some: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wide = [pdf.pivot_table(index=key, columns="dim", values="value", fill_value=0.0) for pdf in some]
        x = [w.to_numpy(float) for w in wide]
        ones = [np.ones((1, n_win * a.shape[1])) for a in x]
        if transposed:
            got = [np.concatenate(np.split(g, n_win, axis=1)) for g in gradient_many(ones, x, windows)]
        else:
            got = generate_many([np.concatenate(np.split(a, n_win), 1) for a in x], ones, windows)
        for pdf, w, y in zip(some, wide, got, strict=True):
            rows, dims = y.shape
            yield pd.DataFrame({"utt": [pdf["utt"].iloc[0]] * (rows * dims), out: np.repeat(np.arange(rows), dims), "dim": np.tile(w.columns.to_numpy(np.int64), rows), "value": y.ravel()})

    return over_utterances(frames.select("utt", key, "dim", "value"), kernel, f"utt {kind(frames, 'utt')}, {out} long, dim long, value double", order=key, tasks=tasks)
