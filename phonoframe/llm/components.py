"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonoframe.llm.common import Written

#: Far above what the algorithm needs: it takes a number of rounds in the logarithm of the largest component.
ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v. Large: hang each node's larger neighbours on its smallest; small: its smaller ones and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of `edges` (u, v); loops are ignored, order and repeats don't matter."""
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    at, before = Written(ordered, "components"), None
    for _ in range(ROUNDS):
        then = Written(_star(_star(at.df, True), False), "components")
        at.drop()
        at = then
        mark = tuple(at.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components of links aren't found after {ROUNDS} rounds")
    return at.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
