"""Distortion metrics over paired frames (utt, frame, x, y); weights are frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 10 / ln 10 * sqrt 2.
DECIBEL = 6.141851463713754


def squared_distance(x: Column, y: Column) -> Column:
    """Of two feature arrays."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0).cast("double"), lambda acc, v: acc + v.cast("double"))


def mel_cepstral_distortion(df: DataFrame, x: str = "x", y: str = "y", *by: str) -> DataFrame:
    return df.groupBy(*by).agg((DECIBEL * F.avg(F.sqrt(squared_distance(F.col(x), F.col(y))))).alias("melcd"))


def rmse(df: DataFrame, x: str = "x", y: str = "y", *by: str) -> DataFrame:
    gap = F.col(x) - F.col(y)
    return df.groupBy(*by).agg(F.sqrt(F.avg(gap * gap)).alias("rmse"))


def voiced_rmse(df: DataFrame, x: str, y: str, x_voiced: str, y_voiced: str, *by: str, linear: bool = False) -> DataFrame:
    """RMSE where both are voiced (null if nowhere); linear: of the exponentials."""
    a, b = (F.exp(x), F.exp(y)) if linear else (F.col(x), F.col(y))
    both = (F.col(x_voiced) + F.col(y_voiced)) >= 2
    return df.groupBy(*by).agg(F.sqrt(F.avg(F.when(both, (a - b) * (a - b)))).alias("rmse"))


def voicing_error(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(x) != F.col(y)).cast("double")).alias("error"))
