"""Post-filter of mel-cepstra: sharper formants at the same energy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def warp_matrix(order_in: int, order_out: int, alpha: float) -> np.ndarray:
    """The linear map of cepstra under an all-pass frequency warping by alpha, column by column of powers of the warped delay."""
    # Column m: coefficients of ((z^-1 - alpha) / (1 - alpha z^-1))^m, truncated.
    n = order_out + 1
    step = np.zeros(n)
    step[0] = -alpha
    step[1:] = (1 - alpha * alpha) * alpha ** np.arange(n - 1) if n > 1 else 0
    out = np.zeros((n, order_in + 1))
    column = np.zeros(n)
    column[0] = 1
    for m in range(order_in + 1):
        out[:, m] = column
        column = np.convolve(column, step)[:n]
    return out


def energy(cepstra: np.ndarray, n_fft: int) -> np.ndarray:
    """The autocorrelation at lag 0 of the spectra of minimum-phase cepstra (rows)."""
    log_spectrum = np.fft.rfft(cepstra, n_fft, axis=1).real
    power = np.exp(2 * log_spectrum)
    return (power[:, 0] + 2 * power[:, 1:-1].sum(1) + power[:, -1]) / n_fft


def to_filter(mc: np.ndarray, alpha: float) -> np.ndarray:
    """Mel-cepstra to the coefficients b of a synthesis filter: b[m] = c[m] - alpha * b[m + 1]."""
    b = mc.astype(float).copy()
    for m in range(mc.shape[1] - 2, -1, -1):
        b[:, m] -= alpha * b[:, m + 1]
    return b


def from_filter(b: np.ndarray, alpha: float) -> np.ndarray:
    c = b.astype(float).copy()
    c[:, :-1] += alpha * b[:, 1:]
    return c


def sharpened(mc: np.ndarray, alpha: float, minimum_phase_order: int = 511, n_fft: int = 1024, coef: float = 1.4, weight: np.ndarray | None = None) -> np.ndarray:
    """Coefficients from the third on times `coef` (or all by `weight`), and the first one so that the energy stays."""
    if weight is None:
        weight = np.full(mc.shape[1], float(coef))
        weight[:2] = 1
    if len(weight) != mc.shape[1]:
        raise ValueError("a weight per coefficient is needed")
    line = warp_matrix(mc.shape[1] - 1, minimum_phase_order, alpha)
    before, after = energy(mc @ line.T, n_fft), energy((mc * weight) @ line.T, n_fft)
    b = to_filter(mc * weight, alpha)
    b[:, 0] += np.log(before / after) / 2
    return from_filter(b, alpha)


def post_filter(frames: DataFrame, alpha: float, minimum_phase_order: int = 511, n_fft: int = 1024, coef: float = 1.4, weight: list[float] | None = None) -> DataFrame:
    """(utt, frame, features) frame by frame; nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["features"].to_numpy()).astype(float)
                yield pdf.assign(features=list(sharpened(x, alpha, minimum_phase_order, n_fft, coef, None if weight is None else np.array(weight))))

    kind = {c: frames.schema[c].dataType.simpleString() for c in ("utt", "frame")}
    return frames.select("utt", "frame", "features").mapInPandas(run, f"utt {kind['utt']}, frame {kind['frame']}, features array<double>")
