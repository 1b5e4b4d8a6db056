import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from phonoframe.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, orders):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(small)
    return len(w), [" ".join(w[i : i + k]) for k in range(1, orders + 1) for i in range(len(w) - k + 1)]


def plain(rows, targets, percent=25, least_words=20, orders=2, buckets=10_000, seed=7):
    """(doc_id, n_features, weight, score, rank) from (doc_id, text) and target texts."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in texts for f in runs(text, orders)[1]) for texts in ([x for _, x in rows], targets))
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets)))) for b in s | t}
    out = []
    for i, text in rows:
        n, own = runs(text, orders)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    may = sorted((r for r in out if r[5] >= least_words), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for k, r in enumerate(may[: percent * len(may) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.fixture(scope="module")
def benchmark(spark, sf_dir, rows):
    texts = [" ".join(rows[i][1].split()[5:30]) for i in (2, 8, 60)] + [None, "", "ÉA éa 12-b"]
    df = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    df.write.mode("overwrite").parquet(f"{sf_dir}/benchmark.parquet")
    return df, texts


def test_query(spark, sf_dir, rows, benchmark):
    got = resampling.op11_importance_resampling(spark, sf_dir)
    assert [t for _, t in got.dtypes] == ["bigint"] * 5
    # A doc_id that stands twice has equal scores: its rows may change places.
    assert sorted(map(tuple, got.collect()), key=str) == plain([r[:2] for r in rows], benchmark[1])


@pytest.mark.parametrize("percent, least, orders, buckets, seed", [(50, 1, 3, 97, 1), (100, 0, 1, 10, 7), (0, 5, 2, 1000, 7)])
def test_parameters(spark, docs, rows, benchmark, percent, least, orders, buckets, seed):
    got = resampling.resampled(docs, benchmark[0], percent, least, orders, buckets, seed).collect()
    assert sorted(map(tuple, got), key=str) == plain([r[:2] for r in rows], benchmark[1], percent, least, orders, buckets, seed)


def test_nulls_repeats_and_long_texts(spark, benchmark):
    rows = [(None, "a b c " * 9), (None, None), (3, "x" * 100_000 + " y" * 30), (4, "É é E e " * 8), (5, "...")] + [(6, "same words " * 15)] * 30 + [(i, f"w{i} " * 25) for i in range(10, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "pos", "word", "b1", "gain", "rank", "n")})
    got = resampling.resampled(df, benchmark[0]).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, benchmark[1])


def test_empty(spark, no_docs, docs, rows, benchmark):
    assert resampling.resampled(no_docs, benchmark[0]).count() == 0
    got = resampling.resampled(docs, benchmark[0].where("item_id < 0")).collect()
    assert sorted(map(tuple, got), key=str) == plain([r[:2] for r in rows], [])


def test_texts_move_once(spark, sf_dir):
    plan = resampling.features(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" in plan and "Python" not in plan
