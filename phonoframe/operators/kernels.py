"""Small NumPy kernels for one utterance: banded systems whose bands hold all dimensions side by side.

Bands are arrays (width + 1, T, D): band[k, t] is entry (t, t - k) of a symmetric
or lower triangular matrix, one matrix per dimension. Loops run over T and the
band only; dimensions are vectorised.
"""

from __future__ import annotations

import numpy as np

from phonoframe.functions.windows import DeltaWindow


def cholesky(band: np.ndarray) -> np.ndarray:
    """The lower factor, in the same layout. LinAlgError if a matrix isn't positive definite."""
    w, t_max = band.shape[0] - 1, band.shape[1]
    out = band.copy()
    for t in range(t_max):
        for k in range(min(w, t), -1, -1):
            # Entry (t, t - k): take away what earlier columns share.
            for m in range(k + 1, min(w, t) + 1):
                out[k, t] -= out[m, t] * out[m - k, t - k]
            if k:
                out[k, t] /= out[0, t - k]
            else:
                if (out[0, t] <= 0).any():
                    raise np.linalg.LinAlgError("a matrix isn't positive definite")
                out[0, t] = np.sqrt(out[0, t])
    return out


def solve_factored(factor: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solutions (T, D) of the systems whose lower factors are given."""
    w, x = factor.shape[0] - 1, b.astype(float).copy()
    n = len(x)
    for t in range(n):
        for k in range(1, min(w, t) + 1):
            x[t] -= factor[k, t] * x[t - k]
        x[t] /= factor[0, t]
    for t in range(n - 1, -1, -1):
        for k in range(1, min(w, n - 1 - t) + 1):
            x[t] -= factor[k, t + k] * x[t + k]
        x[t] /= factor[0, t]
    return x


def inverse_band(factor: np.ndarray, width: int) -> np.ndarray:
    """The band of the inverse, from the last row up."""
    w, n, d = factor.shape[0] - 1, factor.shape[1], factor.shape[2]
    wide = max(w, width)
    out = np.zeros((wide + 1, n, d))  # out[k, t]: entry (t, t - k)
    entry = lambda i, j: out[abs(i - j), max(i, j)] if abs(i - j) <= wide else 0.0
    for j in range(n - 1, -1, -1):
        for i in range(min(n - 1, j + wide), j - 1, -1):
            s = (1 / factor[0, j] if i == j else 0.0) - sum(factor[k, j + k] * entry(i, j + k) for k in range(1, min(w, n - 1 - j) + 1))
            out[i - j, i] = s / factor[0, j]
    return out[: width + 1]


def apply_window(x: np.ndarray, window: DeltaWindow) -> np.ndarray:
    """Window times x (T, D): row t is the sum of taps[k] * x[t + k - left]."""
    out = np.zeros_like(x, dtype=float)
    for k, tap in enumerate(window.taps):
        o = k - window.left
        a, b = max(0, -o), min(len(x), len(x) - o)
        if a < b:
            out[a:b] += tap * x[a + o : b + o]
    return out


def apply_transposed(x: np.ndarray, window: DeltaWindow) -> np.ndarray:
    out = np.zeros_like(x, dtype=float)
    for k, tap in enumerate(window.taps):
        o = k - window.left
        a, b = max(0, -o), min(len(x), len(x) - o)
        if a < b:
            out[a + o : b + o] += tap * x[a:b]
    return out


def precision_band(weights: list[np.ndarray], windows: tuple[DeltaWindow, ...]) -> np.ndarray:
    """The band of the sum of transpose(W) diag(weights) W over windows; weights are (T, D) each."""
    width = max(w.left + w.right for w in windows)
    n, d = weights[0].shape
    out = np.zeros((width + 1, n, d))
    for tau, w in zip(weights, windows, strict=True):
        for i, a in enumerate(w.taps):
            for j, b in enumerate(w.taps[: i + 1]):
                # Row t of W touches columns t + i - left and t + j - left.
                hi, lo = i - w.left, j - w.left
                s, e = max(0, -lo), min(n, n - hi)
                if s < e:
                    out[hi - lo, s + hi : e + hi] += a * b * tau[s:e]
    return out


def edge_zeroed(tau: np.ndarray, windows: tuple[DeltaWindow, ...]) -> list[np.ndarray]:
    """Precisions per window; those of dynamic windows are 0 on frames where the widest window leaves the utterance."""
    n_win = len(windows)
    parts = [p.copy() for p in np.split(tau, n_win, axis=1)]
    edge = max(max(w.left, w.right) for w in windows)
    if edge:
        for p in parts[1:]:
            p[:edge] = 0
            p[-edge:] = 0
    return parts


def stacked(arrays: list[np.ndarray], fill: float = 0.0) -> np.ndarray:
    """Arrays (..., T, D) of several utterances as one (..., longest T, sum of D): one loop over frames serves them all."""
    n = max(a.shape[-2] for a in arrays)
    out = np.full((*arrays[0].shape[:-2], n, sum(a.shape[-1] for a in arrays)), fill)
    at = 0
    for a in arrays:
        out[..., : a.shape[-2], at : at + a.shape[-1]] = a
        at += a.shape[-1]
    return out


def solve_many(bands: list[np.ndarray], rights: list[np.ndarray]) -> list[np.ndarray]:
    """Solutions of the banded positive definite systems of several utterances. Frames beyond an utterance's end get the unit matrix."""
    band, b = stacked(bands), stacked(rights)
    at = np.cumsum([0, *(r.shape[1] for r in rights)])
    for k, r in enumerate(rights):
        band[0, len(r) :, at[k] : at[k + 1]] = 1
    x = solve_factored(cholesky(band), b)
    return [x[: len(r), i:j] for r, i, j in zip(rights, at[:-1], at[1:], strict=True)]


def by_length(lengths: list[int], most: int = 1 << 16) -> list[list[int]]:
    """Groups of utterances of similar lengths, each padded to `most` frames in all at most (a longer utterance is alone)."""
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        if out and lengths[i] * 2 >= lengths[out[-1][0]] and lengths[out[-1][0]] * (len(out[-1]) + 1) <= most:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def solve_triangular(band: np.ndarray, b: np.ndarray, transposed: bool = False) -> np.ndarray:
    """x of L x = b, or of transpose(L) x = b, for a lower banded L. LinAlgError for a zero on the diagonal."""
    zero = np.flatnonzero((band[0] == 0).any(1))
    if len(zero):
        raise np.linalg.LinAlgError(f"the matrix is singular: zero at {zero[0]} of the diagonal")
    w, x = band.shape[0] - 1, b.astype(float).copy()
    n = len(x)
    for t in range(n - 1, -1, -1) if transposed else range(n):
        for k in range(1, min(w, n - 1 - t if transposed else t) + 1):
            x[t] -= band[k, t + k] * x[t + k] if transposed else band[k, t] * x[t - k]
        x[t] /= band[0, t]
    return x
