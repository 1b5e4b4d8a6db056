from collections import Counter, defaultdict

import numpy as np
import pytest

from phonoframe.llm import mixing


def targets(sizes, weights=(5, 2, 1), limit=3.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > limit * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = limit * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_query(spark, sf_dir, rows):
    got = mixing.op3_entropy_mixing(spark, sf_dir).collect()
    assert len(got) == len(rows)
    words = {i: len((t or "").split()) for i, t, _, _ in rows}
    source = {i: s for i, _, _, s in rows}
    sizes = defaultdict(int)
    for i, t, _, s in rows:
        sizes[s] += words[i]
    want, taken = targets(sizes), Counter()
    for r in got:
        assert r["size"] == words[r.doc_id] and r.source_size == sizes[source[r.doc_id]]
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
        taken[source[r.doc_id]] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 3), (s, taken[s], t)
    again = mixing.op3_entropy_mixing(spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_split_groups_and_empty(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED_TOGETHER", 7)
    rows = spark.createDataFrame([(i, "a" if i % 3 else None, 10) for i in range(100)], "doc_id long, source string, size long")
    got = mixing.mixed_copies(rows).collect()
    assert len(got) == 100 and sum(r.copies for r in got) == 100
    assert mixing.mixed_copies(rows.where("size < 0")).count() == 0


def test_copies_follow_the_tilt(spark):
    """The dual of each source solved by bisection: copies of every size are those that its rates give, but for rounding and repairs."""
    rng = np.random.default_rng(6)
    rows = [(i, "abc"[i % 3], int(rng.integers(1, 40))) for i in range(1500)]
    got = mixing.mixed_copies(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    want = targets(sizes)
    for s in "abc":
        x = np.array([n for _, t, n in rows if t == s], float)
        unit = x.mean()
        rates = lambda lam: 3 / (1 + 2 * np.exp(-lam * x / unit))
        low, high = -50.0, 50.0
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if (rates(middle) * x).sum() < want[s] else (low, middle)
        by_size, copies = Counter(), Counter()
        for n, r in zip(x, rates(low), strict=True):
            by_size[int(n)] += r
        for r in got:
            if r.source == s:
                copies[r["size"]] += r.copies
        assert all(abs(copies[n] - k) <= 1 + mixing.REPAIRS for n, k in by_size.items())
        assert sum(abs(copies[n] - k) for n, k in by_size.items()) <= len(by_size) + mixing.REPAIRS


def test_a_tilt_that_is_not_found_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 1)
    rows = spark.createDataFrame([(i, "ab"[i % 2], 1 + i * i % 40) for i in range(200)], "doc_id long, source string, size long")
    with pytest.raises(RuntimeError, match="no tilt"):
        mixing.mixed_copies(rows).collect()
