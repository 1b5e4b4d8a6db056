"""Banded systems and trajectories in blocks, against the kernels that take them whole."""

import numpy as np
import pytest

from phonoframe.functions.windows import DEFAULT, DELTA, STATIC, DeltaWindow
from phonoframe.operators import banded, kernels, longbands, paramgen

WIDE = DeltaWindow(2, 0, (0.2, -0.5, 0.3)), DeltaWindow(0, 2, (0.1, 0.4, -0.5))


def systems(rng, n, width):
    """A positive definite band (width + 1, n, 1)."""
    low = rng.normal(size=(width + 1, n, 1)) * 0.4
    low[0] = np.abs(low[0]) + 1
    dense = np.zeros((n, n))
    for k in range(width + 1):
        dense[np.arange(k, n), np.arange(n - k)] = low[k, k:, 0]
    dense = dense @ dense.T
    return dense


def entries(mat, dense, width):
    return [(mat, i, j, float(dense[i, j])) for i in range(len(dense)) for j in range(max(0, i - width), i + 1)]


@pytest.mark.parametrize("width, block", [(1, 3), (2, 5), (3, 16), (2, 500)])
def test_solutions_and_factors(spark, width, block):
    rng = np.random.default_rng(width)
    mats = {m: systems(rng, n, width) for m, n in (("a", 1), ("b", 7), ("c", 61), ("d", 128), (None, 20))}
    mats = {m: x for m, x in mats.items() if m}
    rights = {m: rng.normal(size=len(x)) for m, x in mats.items()}
    a = spark.createDataFrame([r for m, x in mats.items() for r in entries(m, x, width)], "mat string, row long, col long, value double").repartition(5)
    b = spark.createDataFrame([(m, i, float(v)) for m, x in rights.items() for i, v in enumerate(x)], "mat string, idx long, value double")
    sizes = spark.createDataFrame([(m, len(x)) for m, x in mats.items()], "mat string, n long")
    got = longbands.solve(a, b.where("idx <> 3"), sizes, width, block).toPandas()
    for m, x in mats.items():
        own = got[got.mat == m].sort_values("idx")
        right = rights[m].copy()
        right[3:4] = 0
        assert own.idx.tolist() == list(range(len(x))) and np.allclose(own.value, np.linalg.solve(x, right))
    factors = longbands.cholesky(a, sizes, width, block).toPandas()
    for m, x in mats.items():
        own, out = factors[factors.mat == m], np.zeros_like(x)
        assert not own.duplicated(["row", "col"]).any()
        out[own.row, own.col] = own.value
        assert np.allclose(out, np.linalg.cholesky(x))


@pytest.mark.parametrize("width, block", [(0, 4), (1, 1), (2, 5), (3, 16), (2, 500)])
def test_triangular_systems(spark, width, block):
    rng = np.random.default_rng(width)
    mats = {m: np.tril(np.triu(rng.normal(size=(n, n)), -width)) * 0.5 + np.eye(n) * 2 for m, n in (("a", 1), ("b", 7), ("c", 61), ("d", 100))}
    rights = {m: rng.normal(size=len(x)) for m, x in mats.items()}
    a = spark.createDataFrame([r for m, x in mats.items() for r in entries(m, x, width)], "mat string, row long, col long, value double").repartition(5)
    b = spark.createDataFrame([(m, i, float(v)) for m, x in rights.items() for i, v in enumerate(x)], "mat string, idx long, value double")
    sizes = spark.createDataFrame([(m, len(x)) for m, x in mats.items()], "mat string, n long")
    for transposed in (False, True):
        got = longbands.solve_triangular(a, b, sizes, width, transposed, block).toPandas()
        for m, x in mats.items():
            own = got[got.mat == m].sort_values("idx")
            assert own.idx.tolist() == list(range(len(x))) and np.allclose(own.value, np.linalg.solve(x.T if transposed else x, rights[m]))
    with pytest.raises(Exception, match="singular"):
        longbands.solve_triangular(a.where("mat <> 'c' or row <> 40 or col <> 40"), b, sizes, width, block=block).collect()


def test_matrices_that_are_not_positive_definite(spark):
    x = np.diag(np.ones(40)) * 2 - np.eye(40, k=1) - np.eye(40, k=-1)
    x[25, 25] = -1
    a = spark.createDataFrame(entries("a", x, 1), "mat string, row long, col long, value double")
    sizes = spark.createDataFrame([("a", 40)], "mat string, n long")
    for at in (6, 40):
        with pytest.raises(Exception, match="positive definite"):
            longbands.cholesky(a, sizes, 1, at).collect()
    with pytest.raises(ValueError):
        longbands.cholesky(a, sizes, 3, 6)
    assert longbands.cholesky(a.where("row < 0"), sizes.where("n < 0"), 1).count() == 0
    assert longbands.solve(a, a.selectExpr("mat", "row as idx", "value"), sizes.where("n < 0"), 1).count() == 0


@pytest.mark.parametrize("windows, block", [(DEFAULT, 9), (DEFAULT, 30), ((STATIC,), 4), ((STATIC, *WIDE), 11), ((STATIC, DELTA), 1000)])
def test_trajectories_and_gradients(spark, windows, block):
    rng = np.random.default_rng(block)
    rows, whole = [], {}
    for utt, n in (("u", 1), ("v", 12), ("w", 95), ("x", 140)):
        means, variances, grad = rng.normal(size=(n, 2 * len(windows))), rng.uniform(0.2, 2, (n, 2 * len(windows))), rng.normal(size=(n, 2))
        rows += [(utt, t, means[t].tolist(), variances[t].tolist(), grad[t].tolist()) for t in range(n)]
        whole[utt] = paramgen.generate(means, variances, windows), paramgen.gradient(variances, grad, n, windows)
    df = spark.createDataFrame(rows, "utt string, frame long, means array<double>, variances array<double>, gradient array<double>").repartition(5)
    for k, operator in enumerate((longbands.mlpg, longbands.mlpg_gradient)):
        got = operator(df, windows, block).toPandas().sort_values(["utt", "frame"])
        assert len(got) == len(rows)
        for utt, pdf in got.groupby("utt"):
            assert pdf.frame.tolist() == list(range(len(pdf))) and np.allclose(np.stack(pdf.features), whole[utt][k])


def test_a_variance_that_is_not_positive(spark):
    df = spark.createDataFrame([("u", t, [1.0], [float(t != 3)]) for t in range(5)], "utt string, frame long, means array<double>, variances array<double>")
    with pytest.raises(Exception, match="isn't positive"):
        longbands.mlpg(df, (STATIC,)).collect()


def test_blocks_run_in_several_tasks(spark):
    """One utterance of 30 000 frames: its blocks are dealt over the tasks, and the result is the kernel's."""
    from pyspark.sql import functions as F

    n = 30_000
    df = spark.range(n).select(F.lit("u").alias("utt"), F.col("id").alias("frame"), F.array(*[F.sin(F.col("id") * k / 9) for k in (1, 2, 3)]).alias("means"), F.array(F.lit(1.0), F.lit(0.3), F.lit(0.1)).alias("variances"))
    got = longbands.mlpg(df, block=1000).withColumn("p", F.spark_partition_id()).toPandas().sort_values("frame")
    t = np.arange(n)[:, None] * np.array([1, 2, 3]) / 9
    want = paramgen.generate(np.sin(t), np.tile([1.0, 0.3, 0.1], (n, 1)))
    assert np.allclose(np.stack(got.features), want) and got.p.nunique() > 1


def test_kernel_of_one_block():
    rng = np.random.default_rng(3)
    x = systems(rng, 30, 2)
    band = np.stack([np.concatenate([np.zeros(k), np.diagonal(x, -k)]) for k in range(3)])[:, :, None]
    block = longbands.Block("u", 1, 0, 2, 3, band, rng.normal(size=(30, 1)))
    s, g = longbands.eliminated([block])[0]
    inner, ends = np.arange(2, 27), np.r_[0:2, 27:30]
    own = x[np.ix_(ends, ends)].copy()
    own[2:] = own[:, 2:] = 0
    z = np.linalg.solve(x[np.ix_(inner, inner)], np.c_[x[np.ix_(inner, ends)], block.b[inner]])
    assert np.allclose(s[:, :, 0], own - x[np.ix_(ends, inner)] @ z[:, :5])
    assert np.allclose(kernels.cholesky(band)[0, :, 0], np.diag(np.linalg.cholesky(x))) and hasattr(banded, "solve")


@pytest.mark.parametrize("columns", [3, 128])
def test_inverses_by_blocks_of_columns(spark, columns):
    rng = np.random.default_rng(columns)
    mats = {m: systems(rng, n, 2) for m, n in (("a", 1), ("b", 7), ("c", 40))}
    a = spark.createDataFrame([r for m, x in mats.items() for r in entries(m, x, 2)], "mat string, row long, col long, value double").repartition(3)
    sizes = spark.createDataFrame([(m, len(x)) for m, x in mats.items()], "mat string, n long")
    got = banded.inverse(a, sizes, 2, columns=columns).toPandas()
    for m, x in mats.items():
        own = got[got.mat == m]
        assert len(own) == len(x) * (len(x) + 1) // 2 and (own.row >= own.col).all()
        assert np.allclose(own.value, np.linalg.inv(x)[own.row, own.col])
