"""Every query with SQL against DuckDB on the same small tables."""

import datetime
import random

import duckdb
import pytest

from phonoframe.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at, r = f"{tmp_path_factory.mktemp('tables')}", random.Random(0)
    start = datetime.datetime(2024, 1, 1)
    kinds = ["view", "click", "purchase", "error"]
    events = [(i, start + datetime.timedelta(seconds=r.randint(0, 10**6)), r.randint(0, 7), r.choice(kinds), round(r.uniform(1, 490), 2)) for i in range(900)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{at}/events.parquet")
    spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(64)], i % 10) for i in range(60)], "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    spark.createDataFrame([(i, "text", r.choice(["en", "fr", "de", "es"]), f"s{i % 5}") for i in range(120)], "doc_id long, text string, lang string, source string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    db = duckdb.connect()
    for t in ("events", "embeddings", "documents", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet/*.parquet'")
    return at, db


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    at, db = tables
    got = QUERIES[name](spark, at)
    if name not in ORACLE_SQL:
        assert got.count() > 0
        return
    want = db.sql(ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key = lambda row: tuple((x is None, str(x)) for x in row)
    a = sorted(map(tuple, got.select(*columns).collect()), key=key)
    b = sorted(want.project(", ".join(f'"{c}"' for c in columns)).fetchall(), key=key)
    assert len(a) == len(b) and all(x == y or x == pytest.approx(y, abs=2e-4) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))
