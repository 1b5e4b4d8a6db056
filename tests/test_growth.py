"""What moves and meets in a task follows from the rows themselves: plans and exact results of steps that grew too fast."""

import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from phonoframe.operators import banded
from phonoframe.sources import corpora, formats

SCHEMA = "mat long, row long, col long, value double"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def entries(spark, seed, n=9, mats=3):
    r = random.Random(seed)
    rows = [(m, i, j, r.uniform(-1, 1)) for m in range(mats) for i in range(n) for j in range(max(0, i - 2), min(n, i + 3)) if r.random() < 0.8]
    full = np.zeros((mats, n, n))
    for m, i, j, v in rows:
        full[m, i, j] += v
    return spark.createDataFrame(rows, SCHEMA), full


def filled(df, mats=3, n=9):
    out = np.zeros((mats, n, n))
    for r in df.collect():
        out[r.mat, r.row, r.col] += r.value
    return out


def test_sums_are_dealt_by_the_entries(spark):
    (a, x), (b, y) = entries(spark, 1), entries(spark, 2)
    got = banded.add(a, banded.transpose(b), -2.0)
    assert "REPARTITION_BY_COL" in plan(got)
    np.testing.assert_allclose(filled(got), x - 2 * y.transpose(0, 2, 1), atol=1e-12)
    blocks = a.withColumn("window", a.mat * 0 + 1)
    laid = banded.overlap_add(blocks, 2)
    assert "REPARTITION_BY_COL" in plan(laid)
    np.testing.assert_allclose(filled(laid, n=11)[:, 2:, 2:], x, atol=1e-12)


def test_products_are_added_up_where_they_are_made(spark):
    (a, x), (b, y) = entries(spark, 3), entries(spark, 4)
    d = spark.createDataFrame([(m, i, 0.5 + i) for m in range(3) for i in range(9) if i != 4], "mat long, idx long, value double")
    dense = np.array([0.5 + i if i != 4 else 0 for i in range(9)])
    got = banded.dot_mm(a, b)
    text = plan(got)
    assert "Join" not in text and text.count("Exchange hashpartitioning") == 2
    np.testing.assert_allclose(filled(got), x @ y, atol=1e-12)
    both = banded.dot_mm(a, b, d, (1, 1))
    band = np.abs(np.subtract.outer(np.arange(9), np.arange(9))) <= 1
    np.testing.assert_allclose(filled(both), ((x * dense) @ y) * band, atol=1e-12)
    assert all(abs(r.row - r.col) <= 1 for r in both.collect())


def test_zeros_of_a_dense_layout_do_not_move(spark):
    a = spark.createDataFrame([(0, 0, 1, 2.0), (0, 0, 1, 3.0), (0, 2, 0, 4.0), (0, 2, 2, None), (0, 1, 7, 9.0), (0, -1, 0, 9.0), (5, 0, 0, 9.0), (1, 0, 0, 6.0)], SCHEMA)
    sizes = spark.createDataFrame([(0, 3), (1, 1), (2, 2), (3, 0)], "mat long, n long")
    got = banded.dense(a, sizes)
    assert not re.search(r"hashpartitioning\([^)]*\bcol#", plan(got))
    want = [(0, 0, 0, 0.0), (0, 0, 1, 2.0), (0, 0, 1, 3.0), (0, 0, 2, 0.0), (0, 1, 0, 0.0), (0, 1, 1, 0.0), (0, 1, 2, 0.0), (0, 2, 0, 4.0), (0, 2, 1, 0.0), (0, 2, 2, 0.0), (1, 0, 0, 6.0)]
    assert sorted(map(tuple, got.collect())) == want + [(2, i, j, 0.0) for i in range(2) for j in range(2)]


def test_files_are_read_by_few_tasks(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/corpus"
    contents = spark.range(300).select(F.format_string("s%d/wav/f%03d.wav", F.col("id") % 3, "id").alias("name"), F.lit("RIFF").cast("binary").alias("content"))
    assert corpora.write_files(contents, root) == 300
    found = corpora.files(spark, root, "*.wav")
    assert found.rdd.getNumPartitions() == 1 and found.count() == 300
    want = {(f"file:{tmp_path}/corpus/s{i % 3}/wav/f{i:03d}.wav", f"f{i:03d}", f"file:{tmp_path}/corpus/s{i % 3}/wav") for i in range(300)}
    assert set(map(tuple, found.collect())) == want
    assert set(map(tuple, corpora.files(spark, f"{root}/s*", "*.wav").collect())) == want  # a glob is Spark's
    corpora.write_files(spark.range(5).select(F.format_string("t/%d.txt", "id").alias("name"), F.lit("a\r\n").cast("binary").alias("content")), root)
    texts = corpora.text_files(spark, root)
    assert texts.rdd.getNumPartitions() == 1 and {(r.path, r.name, r.text) for r in texts.collect()} == {(f"file://{tmp_path}/corpus/t/{i}.txt", str(i), "a") for i in range(5)}
    monkeypatch.setattr(formats, "MOST_PARTITIONS", 10)
    assert len(formats.shares(range(1000), [1] * 1000, 4)) == 10 and len(formats.shares(range(30), [1] * 30, 4)) == 8


def test_a_callers_frames_come_in_few_batches():
    class Ones(formats.Corpus):
        def items(self):
            return [(f"u{i}", i) for i in range(50)]

        def features(self, item):
            return np.full((item % 3, 1 + item % 2), item, float)

    reader = formats.source_of("ones", Ones)({}).reader(None)
    (part,) = reader.partitions()
    (batch,) = reader.read(part)
    want = [(f"u{i}", t, [float(i)] * (1 + i % 2)) for i in range(50) for t in range(i % 3)]
    assert [tuple(r.values()) for r in batch.to_pylist()] == want


def test_blocks_of_a_stack_are_one_table(spark):
    from phonoframe.operators import longbands

    assert [len(x) for x in longbands._together(iter([pd.DataFrame({"a": [1, 2]}), pd.DataFrame({"a": [3]})]))] == [3] and not list(longbands._together(iter([])))
    n = 40
    full = np.diag(np.full(n, 3.0)) + np.diag(np.full(n - 1, -1.0), -1) + np.diag(np.full(n - 1, -1.0), 1)
    a = spark.createDataFrame([(m, i, j, float(full[i, j])) for m in range(4) for i in range(n) for j in (i - 1, i) if j >= 0], SCHEMA)
    b = spark.createDataFrame([(m, i, float(i + m)) for m in range(4) for i in range(n)], "mat long, idx long, value double")
    sizes = spark.createDataFrame([(m, n) for m in range(4)], "mat long, n long")
    for got, want in ((longbands.solve(a, b, sizes, 1, block=8), lambda m: np.linalg.solve(full, np.arange(n) + m)), (longbands.solve_triangular(longbands.cholesky(a, sizes, 1, block=8), b, sizes, 1, block=8), lambda m: np.linalg.solve(np.linalg.cholesky(full), np.arange(n) + m))):
        rows = got.collect()
        assert len(rows) == 4 * n
        for r in rows:
            assert abs(r.value - want(r.mat)[r.idx]) < 1e-9
