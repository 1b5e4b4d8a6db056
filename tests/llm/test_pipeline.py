from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from phonoframe.llm import secrets
from tests.llm.test_jaccard import brute
from tests.llm.test_mixing import targets
from tests.llm.test_packing import check


def test_stages(spark, docs, sf_dir):
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "packing"]
    now = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, schema = now.columns, now.schema

    kept = stage["language ID"](spark, now, sf_dir).cache()
    assert kept.columns == columns
    gone = {r.doc_id for r in now.collect()} - {r.doc_id for r in kept.collect()}
    assert {99, 100, 101, 104} <= gone <= {99, 100, 101, 104, 102, 103, 106, 107}

    before = [(r.doc_id, r.text) for r in kept.collect()]
    one_each = stage["n-gram Jaccard join"](spark, kept, sf_dir).cache()
    assert one_each.columns == columns
    assert {r.doc_id for r in one_each.collect()} == {i for i, (_, c) in brute(before).items() if i == c}

    clean = stage["secret scans"](spark, one_each, sf_dir).cache()
    assert clean.columns == columns and clean.schema.simpleString() == schema.simpleString()
    assert not [r for r in secrets.scanned(clean, secrets.default_vocabulary()).collect() if r.spans]
    assert clean.where("n_chars <> length(text)").count() == 0 and clean.count() == one_each.count()

    mixed = stage["mixing sources to target weights"](spark, clean, sf_dir).cache()
    assert mixed.columns == columns
    words = lambda df: Counter({r.source: r.n for r in df.select("source", F.size(F.split(F.trim("text"), r"\s+")).alias("w")).groupBy("source").agg(F.sum("w").alias("n")).collect()})
    want, got = targets(words(clean)), words(mixed)
    # Document 105 is longer than its source's target, and all other copies of that source don't make up for it.
    for s, t in want.items():
        assert abs(got[s] - t) <= 0.05 * t + 3 * 160, (s, got[s], t)
    held, took = Counter((r.doc_id, r.text) for r in clean.collect()), Counter((r.doc_id, r.text) for r in mixed.collect())
    assert all(n <= 3 * held[k] for k, n in took.items())

    some = mixed.dropDuplicates(["doc_id"]).cache()
    check(stage["packing"](spark, some, sf_dir).collect(), {r.doc_id: r.text for r in some.collect()}, 4096)


def test_run_is_its_stages_one_after_the_other(spark, docs, sf_dir):
    now = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf_dir).cache()
    piece = lambda df: sorted((r.doc_id, r.start, r.length, r.doc_tokens) for r in df.collect() if r.doc_tokens < 4096)
    got = corpus_pipeline.run(spark, sf_dir).cache()
    total = lambda df: Counter(r.doc_id for r in df.where("start = 0").collect())
    assert total(got) == total(now) and got.agg(F.sum("length")).first() == now.agg(F.sum("length")).first()
    assert {x[0] for x in piece(got)} == {x[0] for x in piece(now)}


def test_repeated_rows_keep_the_mix(spark):
    """Rows that share doc_id, source and size are taken by their own numbers, so targets hold."""
    rows = [(i % 30, "en", "abc"[i % 3], f"{'w ' * (5 + i % 4)}x{i}") for i in range(360)] + [(None, None, None, "a b c")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    taken = corpus_pipeline.source_mixing(spark, docs, "")
    assert taken.columns == docs.columns
    got, sizes = Counter(), Counter()
    for r in taken.collect():
        got[r.source] += len(r.text.split())
    for _, _, s, t in rows:
        sizes[s] += len(t.split())
    for s, t in targets(sizes).items():
        assert abs(got[s] - t) <= 9, (s, got[s], t)


def test_empty(spark, no_docs, tmp_path):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
