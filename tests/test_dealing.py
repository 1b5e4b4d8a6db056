"""Kernels get whole utterances, however adaptive execution merges or splits what their rows come from."""

import contextlib

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from phonoframe.operators import banded
from phonoframe.operators.grouping import over_utterances

#: Many small parts, which are merged by their bytes: rows of one kind into other parts than those of another.
MERGED = {
    "spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
}


@contextlib.contextmanager
def settings(spark, **more):
    conf = MERGED | {k.replace("__", "."): v for k, v in more.items()}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def numbered(spark, utts=200):
    """(utt, frame, value), dealt by utt as a window asks: utterances of 3 to 30 frames."""
    rows = spark.range(utts).select(F.col("id").alias("utt"), F.explode(F.sequence(F.lit(0), 2 + F.col("id") % 28)).alias("at")).repartition(7)
    frame = (F.row_number().over(Window.partitionBy("utt").orderBy("at")) - 1).cast("long")
    return rows.select("utt", frame.alias("frame"), ((F.col("utt") * 7 + F.col("at")) % 11).cast("double").alias("value"))


def counts(df):
    """(utt, n) of each list of frames that a kernel gets."""

    def kernel(some):
        assert all(list(pdf.columns) == ["utt", "frame", "value"] and pdf["frame"].is_monotonic_increasing for pdf in some)
        yield pd.DataFrame({"utt": [pdf["utt"].iloc[0] for pdf in some], "n": [len(pdf) for pdf in some]})

    return sorted(map(tuple, over_utterances(df.select("utt", "frame", "value"), kernel, "utt long, n long").collect()))


def test_sides_of_a_union_meet(spark):
    with settings(spark):
        e = numbered(spark)
        sizes = e.groupBy("utt").agg(F.count("*").alias("frame")).withColumn("value", F.lit(0.0))
        assert counts(e.unionByName(sizes)) == [(u, 4 + u % 28) for u in range(200)]


def test_sides_of_a_join_meet(spark, tmp_path):
    # The join turns into one by broadcast as it runs; the frames' side is then read where it lies, if nothing asks for more.
    at = f"file://{tmp_path}/frames"
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="12k", spark__sql__files__maxPartitionBytes="4k", spark__sql__files__openCostInBytes="1k"):
        numbered(spark).withColumn("value", F.rand(1)).repartition(7).write.parquet(at)
        e = spark.read.parquet(at)
        some = spark.read.parquet(at).where("utt % 8 = 0").groupBy("utt").agg(F.max("frame").alias("_n"))
        assert counts(e.join(some, "utt", "left_semi")) == [(u, 3 + u % 28) for u in range(0, 200, 8)]


def test_banded_systems_find_their_sizes(spark):
    with settings(spark):
        e = numbered(spark).withColumnRenamed("utt", "mat")
        diagonal = e.select("mat", F.col("frame").alias("row"), F.col("frame").alias("col"), (3 + F.col("value")).alias("value"))
        a = diagonal.unionByName(e.where("frame > 0").select("mat", F.col("frame").alias("row"), (F.col("frame") - 1).alias("col"), F.lit(-1.0).alias("value")))
        b, sizes = e.select("mat", F.col("frame").alias("idx"), "value"), e.groupBy("mat").agg(F.count("*").alias("n"))
        x, inverse = banded.solve(a, b, sizes, 1).toPandas(), banded.inverse_band(a, sizes, 1, 0).toPandas()
        factor = banded.cholesky(a, sizes, 1)
        half = banded.solve_triangular(factor, b, sizes, 1)
        both = banded.solve_triangular(factor, half, sizes, 1, transposed=True).toPandas()
    for m in range(0, 200, 9):
        n = 3 + m % 28
        value = np.array([(m * 7 + t) % 11 for t in range(n)], float)
        full = np.diag(3 + value) - np.diag(np.ones(n - 1), 1) - np.diag(np.ones(n - 1), -1)
        for got in (x, both):
            np.testing.assert_allclose(got[got["mat"] == m].sort_values("idx")["value"], np.linalg.solve(full, value), atol=1e-9)
        np.testing.assert_allclose(inverse[inverse["mat"] == m].sort_values("row")["value"], np.diag(np.linalg.inv(full)), atol=1e-9)
