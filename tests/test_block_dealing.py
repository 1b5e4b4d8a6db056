"""Rows of blocks move once for both passes over them, and no wider than they must: plans and exact results."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from phonoframe.functions.windows import DELTA, STATIC
from phonoframe.operators import longbands, sequence
from phonoframe.operators.grouping import stacks

ENTRY = "mat long, row long, col long, value double"


def final_plan(df) -> str:
    """As it ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def dealt(plan: str) -> tuple[int, int]:
    """Exchanges by block that wrote rows, and such that read rows of another one."""
    by = r"hashpartitioning\(utt#\d+L?, chunk#\d+L?, \d+\), REPARTITION_BY_NUM"
    return len(re.findall(rf"- Exchange {by}", plan)), len(re.findall(rf"ReusedExchange \[.*\], Exchange {by}", plan))


def system(spark, sizes):
    """Matrices with 3 + mat on the diagonal and -1 beside it, right sides idx + mat, and their sizes."""
    a = [(m, i, j, 3.0 + m if i == j else -1.0) for m, n in sizes for i in range(n) for j in (i - 1, i) if j >= 0]
    b = [(m, i, float(i + m)) for m, n in sizes for i in range(n)]
    return spark.createDataFrame(a, ENTRY).repartition(3), spark.createDataFrame(b, "mat long, idx long, value double"), spark.createDataFrame(sizes, "mat long, n long")


def expected(m, n):
    return np.linalg.solve(np.diag(np.full(n, 3.0 + m)) - np.diag(np.ones(n - 1), 1) - np.diag(np.ones(n - 1), -1), np.arange(n) + float(m))


def test_rows_of_systems_are_dealt_once(spark):
    sizes = [(1, 40), (2, 7), (3, 1), (4, 16), (5, 23)]
    got = longbands.solve(*system(spark, sizes), 1, block=8)
    assert dealt(final_plan(got)) == (2, 1)  # rows and borders; rows again
    assert "to_json" not in final_plan(got) and "StructsToJson" not in final_plan(got)
    rows = got.toPandas()
    for m, n in sizes:
        own = rows[rows.mat == m].sort_values("idx")
        assert own.idx.tolist() == list(range(n)) and np.allclose(own.value, expected(m, n))


def test_systems_of_odd_rows(spark):
    """Nulls in keys, entries above the band, a size that comes twice, entries that come twice, matrices without a size, rows without a right side."""
    a, b, sizes = system(spark, [(1, 40), (2, 9), (6, 20)])
    a = a.union(a.where("mat = 2")).union(spark.createDataFrame([(None, 0, 0, 1.0), (1, 0, 1, -1.0), (1, None, 0, 5.0), (1, 39, 2, 8.0)], ENTRY))
    b = b.where("mat <> 2 or idx <> 4").union(spark.createDataFrame([(None, 0, 1.0)], "mat long, idx long, value double"))
    sizes = sizes.where("mat <> 6").union(sizes.where("mat = 1")).union(spark.createDataFrame([(None, 3)], "mat long, n long"))
    rows = longbands.solve(a, b, sizes, 1, block=8).toPandas()
    assert sorted(rows.mat.unique()) == [1, 2] and len(rows) == 49
    assert np.allclose(rows[rows.mat == 1].sort_values("idx").value, expected(1, 40))
    full = np.diag(np.full(9, 5.0)) - np.diag(np.ones(8), 1) - np.diag(np.ones(8), -1)
    assert np.allclose(rows[rows.mat == 2].sort_values("idx").value, np.linalg.solve(full, np.where(np.arange(9) == 4, 0, np.arange(9) + 2.0)))


def test_a_missing_value_stays_in_its_matrix(spark):
    a, b, sizes = system(spark, [(1, 30), (2, 30)])
    b = b.withColumn("value", F.when(~((F.col("mat") == 1) & (F.col("idx") == 11)), F.col("value")))
    rows = longbands.solve(a, b, sizes, 1, block=8).toPandas()
    assert rows[rows.mat == 1].value.isna().all()
    assert np.allclose(rows[rows.mat == 2].sort_values("idx").value, expected(2, 30))


@pytest.mark.parametrize("at", [1, 2, 3, 5, 9])
def test_blocks_are_told_apart_by_both_columns(at):
    """Neighbours share a chunk's number or an utterance; batches end anywhere, and a null is a key too."""
    want = [("a", 0, 3), ("a", 1, 2), ("b", 1, 1), ("b", 2, 2), (None, 2, 2)]
    pdf = pd.DataFrame([(u, c, t) for u, c, n in want for t in range(n)], columns=["utt", "chunk", "t"])
    batches = (pdf.iloc[i : i + at] for i in range(0, len(pdf), at))
    got = [x for some in stacks(batches, 2, keys=2) for x in some]
    assert [(x.utt.iloc[0], x.chunk.iloc[0], len(x)) for x in got] == want
    assert all(x.t.tolist() == list(range(len(x))) for x in got)


def utterances(spark, lengths=((1, 50), (2, 9), (3, 1), (4, 32), (None, 20)), lost=()):
    """(utt, frame, means, variances, gradient), numbered by a window, with a null utterance; values of (utt, at) in `lost` are null."""
    rows = [(u, t, None if (u, t) in lost else float((7 * (u or 0) + 3 * t) % 11)) for u, n in lengths for t in range(n)]
    e = spark.createDataFrame(rows, "utt long, at long, value double").repartition(3)
    frame = (F.row_number().over(Window.partitionBy("utt").orderBy("at")) - 1).cast("long")
    e = sequence.delta(e.select("utt", frame.alias("frame"), "value"), "value", "d", DELTA)
    return e.select("utt", "frame", F.array("value", "d").alias("means"), F.array(F.lit(1.0), 0.2 + F.col("frame") % 3).alias("variances"), F.array("value").alias("gradient"))


def same_rows(x, y):
    x, y = (df.toPandas().sort_values(["utt", "frame"]) for df in (x, y))
    assert x.utt.tolist() == y.utt.tolist() and x.frame.tolist() == y.frame.tolist()
    np.testing.assert_array_equal(np.stack(x.features), np.stack(y.features))
    return x


def joins_and_scans(plan: str) -> tuple[int, int]:
    return len(re.findall(r"- \w*Join ", plan)), len(re.findall(r"Scan ExistingRDD", plan))


@pytest.mark.parametrize("operator", [longbands.mlpg, longbands.mlpg_gradient])
def test_gathered_frames_are_made_once(spark, operator):
    df = utterances(spark)
    got, joined = operator(df, (STATIC, DELTA), 9, gathered=True), operator(df, (STATIC, DELTA), 9)
    plan = final_plan(got)
    assert joins_and_scans(plan) == (0, 1) and dealt(plan) == (2, 1)
    assert len(re.findall(r"- Exchange hashpartitioning\(utt#\d+L?, \d+\), ENSURE", plan)) == 1
    x = same_rows(got, joined)
    assert x.groupby("utt").size().to_dict() == {1: 50, 2: 9, 3: 1, 4: 32}
    # Frames that lie anywhere give the same.
    same_rows(operator(df.repartition(5, "frame"), (STATIC, DELTA), 9, gathered=True), joined)


@pytest.mark.parametrize("operator", [longbands.mlpg, longbands.mlpg_gradient])
def test_gathered_frames_with_odd_rows(spark, operator):
    """A value that is missing, no utterance at all, a frame that is null."""
    df = utterances(spark, ((1, 40), (2, 40), (3, 12)), lost={(2, 17)})
    same_rows(operator(df, (STATIC, DELTA), 9, gathered=True), operator(df, (STATIC, DELTA), 9))
    none = df.where("utt is null")
    assert operator(none, (STATIC, DELTA), 9, gathered=True).count() == operator(none, (STATIC, DELTA), 9).count() == 0
    null_frame = df.where("utt = 1 and frame = 0").withColumn("frame", F.lit(None).cast("long"))
    errors = []
    for gathered in (True, False):
        try:
            errors.append(len(operator(df.union(null_frame), (STATIC, DELTA), 9, gathered=gathered).collect()))
        except Exception as e:
            errors.append(type(e).__name__)
    assert errors[0] == errors[1]
