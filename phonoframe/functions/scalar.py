"""Elementwise functions: Column in, Column out, all inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mulaw(x: Column, mu: float = 256) -> Column:
    """Mu-law companding of values in [-1, 1]."""
    return F.signum(x) * F.log1p(mu * F.abs(x)) / F.log1p(F.lit(float(mu)))


def inv_mulaw(y: Column, mu: float = 256) -> Column:
    return F.signum(y) * (F.pow(F.lit(1.0 + mu), F.abs(y)) - 1) / mu


def mulaw_quantize(x: Column, mu: int = 256) -> Column:
    """Companded values as integers from 0 to mu, truncated."""
    return ((mulaw(x, mu) + 1) / 2 * mu).cast("int")


def inv_mulaw_quantize(y: Column, mu: int = 256) -> Column:
    return inv_mulaw(2 * y.cast("double") / mu - 1, mu)


def no_zero(scale: Column) -> Column:
    """A divisor: constant dimensions keep their values."""
    return F.when(scale == 0, F.lit(1.0)).otherwise(scale)


def scale(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / no_zero(std)


def inv_scale(x: Column, mean: Column, std: Column) -> Column:
    return std * x + mean


def minmax_params(low: Column, high: Column, to: tuple[float, float] = (0.0, 1.0)) -> tuple[Column, Column]:
    """(scale, shift) so that x * scale + shift maps [low, high] to `to`."""
    factor = (to[1] - to[0]) / no_zero(high - low)
    return factor, to[0] - low * factor


def minmax_scale(x: Column, factor: Column, shift: Column) -> Column:
    return x * factor + shift


def inv_minmax_scale(x: Column, factor: Column, shift: Column) -> Column:
    return (x - shift) / factor


def coarse_coding(position: Column, centre: float, sigma: float = 0.4) -> Column:
    """Normal density around `centre` at a relative position in a phone."""
    z = (position - centre) / sigma
    return F.exp(-0.5 * z * z) / (sigma * (2 * 3.141592653589793) ** 0.5)
