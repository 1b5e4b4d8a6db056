"""Parts of an order, and numbering and running sums over them, on tables beyond the sample of bounds."""

import duckdb
import pytest
from pyspark.sql import functions as F

from phonoframe.operators import datasets, ranges


@pytest.fixture(scope="module")
def million(spark, tmp_path_factory):
    """(name, utt, n, note): a third of the rows share a name, some have none; utt is unique."""
    at = f"{tmp_path_factory.mktemp('million')}/t.parquet"
    i = F.col("id")
    name = F.when(i % 3 == 0, "hot").when(i % 101 == 0, F.lit(None)).otherwise(F.concat(F.lit("n"), F.pmod(F.xxhash64("id"), F.lit(50_000))))
    spark.range(0, 1_000_000, 1, 7).select(name.alias("name"), (i * 7919 % 1_000_003).alias("utt"), (i % 5).alias("n"), F.repeat(F.lit("x"), (i % 40).cast("int")).alias("note")).write.parquet(at)
    return spark.read.parquet(at), f"'{at}/*.parquet'"


def test_ordinals_equal_sql(spark, million):
    df, at = million
    got = datasets.numbered(df, "name", "utt").selectExpr("count(*)", "sum(ordinal)", "sum(cast((ordinal * utt) % 1000003 as long))", "count(note)").first()
    want = duckdb.sql(f"SELECT count(*), sum(o), sum((o * utt) % 1000003), count(note) FROM (SELECT *, row_number() OVER (ORDER BY name NULLS FIRST, utt) - 1 AS o FROM {at})").fetchall()[0]
    assert tuple(got) == want


def test_ties_take_each_number_once(spark, million):
    df, at = million
    got = datasets.numbered(df, "name").groupBy("name").agg(F.min("ordinal"), F.max("ordinal"), F.count_distinct("ordinal")).collect()
    want = duckdb.sql(f"SELECT name, min(o), max(o), count(o) FROM (SELECT name, row_number() OVER (ORDER BY name NULLS FIRST) - 1 AS o FROM {at}) GROUP BY name").fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_offsets_equal_sql(spark, million):
    df, at = million
    places = datasets.offsets(df.withColumn("n", F.when(F.col("n") < 4, F.col("n"))).drop("note"), "utt")
    got = places.selectExpr("count(*)", "sum(first)", "sum(end)", "sum(cast((coalesce(first, 0) * utt) % 1000003 as long))").first()
    want = duckdb.sql(f"""SELECT count(*), sum(e - n), sum(e), sum((coalesce(e - n, 0) * utt) % 1000003)
    FROM (SELECT utt, n, sum(n) OVER (ORDER BY utt) AS e FROM (SELECT utt, CASE WHEN n < 4 THEN n END AS n FROM {at}))""").fetchall()[0]
    assert tuple(got) == want


def test_rows_move_once_and_hot_keys_are_dealt(spark, million):
    df, _ = million
    cuts = ranges.bounds(df, "name", parts=12)
    assert len(cuts) == 11 and sum(r.name == "hot" for r in cuts) >= 3
    parts = df.withColumn("p", ranges.part(df, cuts, "name")).groupBy("p").agg(F.count("*").alias("n"), F.min("name").alias("low"), F.max("name").alias("high")).orderBy("p").collect()
    assert max(r.n for r in parts) < 160_000
    assert all(a.high is None or a.high <= b.low for a, b in zip(parts, parts[1:], strict=False))
    plan = datasets.numbered(df, "name", "utt")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and plan.count("Exchange hashpartitioning") == 2  # the rows, and the partial totals


def test_bounds_of_small_and_empty_tables(spark):
    none = spark.createDataFrame([], "utt string, n long")
    assert ranges.bounds(none, "utt", parts=8) == [] and datasets.numbered(none, "utt").count() == 0
    same = spark.range(50_000).select(F.lit(None).cast("string").alias("utt"), F.col("id").alias("n"))
    cuts = ranges.bounds(same, "utt", parts=5)
    assert len(cuts) == 4
    got = datasets.numbered(same, "utt", tasks=5).agg(F.count_distinct("ordinal"), F.min("ordinal"), F.max("ordinal")).first()
    assert tuple(got) == (50_000, 0, 49_999)
