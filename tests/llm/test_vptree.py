import math

import numpy as np

from phonoframe.llm import vptree


def brute(vectors, queries, k=5):
    good = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = min(good.get(i, v), v)
    out = {}
    for q in queries:
        if q in good:
            a = np.array(good[q], float)
            cos = [(-(a * (b := np.array(v, float))).sum() / np.sqrt((a * a).sum() * (b * b).sum()), i) for i, v in good.items() if i != q and len(v) == len(a)]
            out[q] = [i for _, i in sorted(cos)[:k]]
    return out


def test_query_equals_brute_force(spark, sf_dir):
    got = vptree.op1_vantage_point_search(spark, sf_dir).collect()
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found == brute(vectors, {i for i, _ in vectors if i is not None and i % 50 == 0})


def test_tree_is_exact_at_factor_one_and_prunes_below():
    rng = np.random.default_rng(0)
    points = vptree.unit(rng.normal(size=(2000, 4)))
    queries = vptree.unit(rng.normal(size=(50, 4)))
    exact = np.sort(np.sqrt(np.maximum(2 - 2 * queries @ points.T, 0)), 1)[:, :5]
    tree = vptree.VPTree(points)
    best, _ = tree.search(queries, 5)
    assert np.allclose(np.sort(best, 1), exact)
    all_pairs, visits = len(points) * len(queries), [tree.measured]
    assert visits[0] < 0.8 * all_pairs
    recalls = []
    for factor in (0.9, 0.7, 0.5):
        relaxed, _ = tree.search(queries, 5, factor)
        assert (np.sort(relaxed, 1) >= exact - 1e-12).all()
        visits.append(tree.measured)
        recalls.append(np.mean([np.isclose(e, r).any() for ex, re in zip(exact, relaxed, strict=True) for e in ex for r in [re]]))
    # Measured: fewer distances for each smaller factor, and what that costs in recall.
    assert visits == sorted(visits, reverse=True) and visits[-1] < 0.7 * visits[0]
    assert recalls[0] >= 0.9 and recalls == sorted(recalls, reverse=True)
    # A limit that the true neighbours meet changes nothing.
    near, _ = tree.search(queries, 5, 1.0, exact[:, -1] + 1e-9)
    assert np.allclose(np.sort(near, 1), exact) and tree.measured < visits[0]


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vptree.nearest(none, none).count() == 0


def test_many_vectors_of_equal_score(spark):
    # Axes (score 0 with all others), and one direction at 60 lengths: far more than k different vectors tie, and small ids win.
    axes = [(3 * i, [float(j == i) for j in range(64)]) for i in range(64)]
    lengths = [(2000 - i, [2.0 ** (i - 30)] * 64) for i in range(60)]
    vectors = axes[::-1] + lengths
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    found = {}
    for r in sorted(vptree.nearest(df, df).collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found[0] == [1941, 1942, 1943, 1944, 1945] and found[2000] == [1941, 1942, 1943, 1944, 1945]
    only = spark.createDataFrame(axes[::-1], "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(vptree.nearest(only, only).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    ids = [i for i, _ in axes]
    assert got == {i: [j for j in ids if j != i][:5] for i in ids}


def test_leaves_out_of_reach_are_skipped(spark, monkeypatch):
    """Tight clusters: with upper levels, the result is that of brute force, and most leaves are never visited."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(20, 8))
    vectors = [(i, [float(x) for x in centres[i % 20] + 0.01 * rng.normal(size=8)]) for i in range(2000)] + [(3000 + i, [float(x) for x in rng.normal(size=3)]) for i in range(3)]
    monkeypatch.setattr(vptree, "SHARD_ROWS", 100)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    queries = df.where("vec_id % 50 = 0")
    top = vptree.tops(df)
    assert top[8].depth == 4
    trees = vptree.packed_trees(vptree.dealt(df, top), top).cache()
    asked = vptree.dealt(queries, top).withColumnRenamed("vec_id", "query_id").where("dim = 8").selectExpr("*", "0.1D as limit")
    assert 0 < asked.count() * trees.where("dim = 8").select("leaf").distinct().count()
    assert vptree.in_reach(asked, trees, top, 1.0).count() <= 4 * asked.count()
    found = {}
    for r in sorted(vptree.nearest(df, queries).collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found == brute(vectors, {i for i, _ in vectors if i % 50 == 0})


def test_repeated_ids_and_very_long_vectors(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 0.0]), (3, [1e-200, 1e-200]), (4, [0.0, 1.0]), (4, [-1.0, 0.0]), (5, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r.vec_id, round(r.score, 12)) for r in vptree.nearest(df, df.where("vec_id = 1")).orderBy("rank").collect()]
    assert got == [(1, 3, 1.0), (2, 2, round(0.5**0.5, 12)), (3, 4, round(-(0.5**0.5), 12))]
