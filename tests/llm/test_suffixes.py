import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phonoframe.llm import common, suffixes


def brute(rows, n=50):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for k in range(len(b) - n + 1):
            first.setdefault(b[k : k + n], i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        cut = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if first[b[k : k + n]] < i:
                cut[k : k + n] = b"\1" * n
        kept = bytes(x for x, c in zip(b, cut, strict=True) if not c)
        out[i] = (len(b), sum(cut), len([x for x in bytes(cut).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("settings", [{}, {"BUCKET_TEXT": 2000, "BUCKET_ROWS": 1, "GATHERED": 0}, {"BUCKET_BYTES": 100, "GATHERED": 0}])
def test_query_equals_brute_force(spark, sf_dir, rows, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(suffixes, k, v)
    over = []
    for name in ("refined", "equal_strings"):
        monkeypatch.setattr(suffixes, name, lambda large, name=name, fn=getattr(suffixes, name): over.append(name) or fn(large))
    if settings:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # groups are cut between batches only
    try:
        got = suffixes.op6_suffix_dedup(spark, sf_dir).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert over == (["refined", "equal_strings"] if settings else [])
    assert len(got) == len(rows)
    want = brute([(i, t) for i, t, _, _ in rows])
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id


@pytest.mark.parametrize("gathered", [1 << 17, 3])
def test_few_letters_and_small_slices(spark, monkeypatch, gathered):
    """Texts full of repeats, with boundaries everywhere, gathered and over the cluster."""
    monkeypatch.setattr(suffixes, "GATHERED", gathered)
    rng = np.random.default_rng(5)
    rows = [(i, "".join(rng.choice(list("ab"), rng.integers(0, 140)))) for i in range(40)] + [(40, "a" * 300), (41, "a" * 49), (42, "a" * 50), (43, "ba" * 100)]
    whole = "".join(rng.choice(list("abc"), 400))
    rows += [(44 + k, whole[k * 13 : k * 13 + rng.integers(40, 120)]) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for r in suffixes.without_repeats(docs).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id


def test_refinement_equals_comparison():
    text = b"abracadabra" * 12 + b"xyz" + b"abracadabra" * 3
    raw, at = np.frombuffer(text, np.uint8), np.array([0, 70, len(text)])
    b = suffixes.refine(raw, at, 20)
    for i in range(len(text)):
        end = 70 if i < 70 else len(text)
        assert (b[i] == -1) == (i + 20 > end)
    good = np.flatnonzero(b >= 0)
    assert all((b[i] == b[j]) == (text[i : i + 20] == text[j : j + 20]) for i in good for j in good)


def test_null_ids_and_empty(spark, no_docs):
    text = "x" * 60
    docs = spark.createDataFrame([(None, text), (1, text), (2, text)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in suffixes.without_repeats(docs).select("doc_id", F.col("n_removed")).collect()} == {None: 0, 1: 0, 2: 60}
    assert suffixes.without_repeats(no_docs).count() == 0


def test_groups_are_whole_or_in_pieces():
    rng = np.random.default_rng(2)
    keys = np.sort(np.concatenate([rng.integers(0, 40, 200), np.full(90, 17)]))
    rows = pa.record_batch([pa.array(keys), pa.array(np.arange(len(keys)))], names=["k", "v"])
    for step in (1, 7, 50, 1000):
        batches = [rows.slice(i, step) for i in range(0, len(keys), step)]
        for most in (None, 20):
            got = list(common.groups(iter(batches), 1, 16, most))
            assert np.array_equal(np.concatenate([t.column(1).to_numpy() for t, _ in got]), np.arange(len(keys)))
            pieces = {int(x) for t, whole in got if not whole for x in t.column(0).to_numpy()}
            assert pieces == ({17} if most and step < 100 else set())
            whole = [set(t.column(0).to_pylist()) for t, w in got if w]
            assert sum(map(len, whole)) == len(set().union(*whole))


def test_texts_longer_than_a_slice(spark):
    rng = np.random.default_rng(12)
    big = "".join(map(chr, rng.integers(97, 123, 1_300_000)))
    rows = [(1, big), (2, "x" + big[600_000:700_000] + "y" * 40 + big[1_299_000:]), (3, big[1_048_500:1_048_700]), (4, big[:49])]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (0, 0), 2: (101_000, 2), 3: (200, 1), 4: (0, 0)}
