"""Dataset statistics: partial and final aggregation by dimension, and their merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonoframe.functions import scalar


def long(df: DataFrame, array: str, *keys: str) -> DataFrame:
    """(keys, dim, value) of feature arrays."""
    return df.select(*keys, F.posexplode(array).alias("dim", "value")).withColumn("dim", F.col("dim").cast("long")).withColumn("value", F.col("value").cast("double"))


def meanvar(df: DataFrame, by: str = "dim", value: str = "value") -> DataFrame:
    """count, mean and population variance."""
    return df.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var"))


def merge(a: DataFrame, b: DataFrame, by: str = "dim") -> DataFrame:
    """The statistics of two datasets together; what only one has stays as it is."""
    x, y = a.select(by, *(F.col(c).alias(f"{c}1") for c in ("n", "mean", "var"))), b.select(by, *(F.col(c).alias(f"{c}2") for c in ("n", "mean", "var")))
    both = x.join(y, by, "full").fillna(0, ["n1", "n2"]).fillna(0.0, ["mean1", "mean2", "var1", "var2"])
    n, gap = F.col("n1") + F.col("n2"), F.col("mean2") - F.col("mean1")
    spread = (F.col("n1") * F.col("var1") + F.col("n2") * F.col("var2")) / n + gap * gap * F.col("n1") * F.col("n2") / (n * n)
    return both.select(by, n.alias("n"), (F.col("mean1") + gap * F.col("n2") / n).alias("mean"), spread.alias("var"))


def meanstd(df: DataFrame, by: str = "dim", value: str = "value") -> DataFrame:
    return meanvar(df, by, value).select(by, "n", "mean", scalar.no_zero(F.sqrt("var")).alias("std"))


def minmax(df: DataFrame, by: str = "dim", value: str = "value") -> DataFrame:
    return df.groupBy(by).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def applied(df: DataFrame, stats: DataFrame, by: str = "dim") -> DataFrame:
    """Rows with the statistics of their dimension; a row per dimension is small, and Spark broadcasts it if it is."""
    return df.join(stats, by)
