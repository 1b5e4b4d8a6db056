import re
from collections import defaultdict

import numpy as np
import pytest

from phonoframe.llm import jaccard

UPPER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """doc_id -> (sizes, component), all pairs."""
    sets = defaultdict(set)
    for i, t in rows:
        sets[i].add(shingles(t))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[i] for y in sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: ({len(x) for x in sets[i]}, find(i)) for i in sets}


@pytest.mark.parametrize("settings", [{}, {"COMMON": 3, "SMALL": 3, "LOCAL": 800}, {"COMMON": 3, "SMALL": 2, "LOCAL": 200, "PIVOTS": 2, "SALT_MEMBERS": 4}, {"COMMON": 3, "SMALL": 2, "LOCAL": 800, "GATHERED": 1, "REMEMBERED": 2}])
def test_query_equals_all_pairs(spark, sf_dir, rows, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(jaccard, k, v)
    if settings:
        monkeypatch.setattr(jaccard.common_shingles, "__defaults__", (settings["COMMON"], 1 << 18))
    if "GATHERED" in settings:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # cells are cut between batches only
    try:
        got = jaccard.op4_jaccard_join(spark, sf_dir).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    want = brute([(i, t) for i, t, _, _ in rows])
    for r in got:
        assert r.n_shingles in want[r.doc_id][0] and r.component_id == want[r.doc_id][1]


def test_region_links_connect_what_all_pairs_connect():
    rng = np.random.default_rng(4)
    sets = []
    for c in range(6):
        base = rng.choice(10_000, 60, replace=False)
        for _ in range(12):
            x = base.copy()
            x[rng.choice(60, rng.integers(0, 14), replace=False)] = rng.integers(20_000, 10**6, 1)
            sets.append(np.unique(x).astype(np.uint64))
    def groups(links):
        label = list(range(len(sets)))
        for a, b in links:
            label = [label[a] if x == label[b] else x for x in label]
        return {frozenset(i for i, x in enumerate(label) if x == y) for y in label}
    every = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard.join_pairs(sets[i], [sets[j]])[0]]
    assert groups(jaccard.Region(sets).links()) == groups(every)


def test_null_ids_link_with_nothing(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(None, text), (7, text), (None, text), (9, text + " more"), (2**60 + 1, "a b")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.joined_components(docs).collect()), key=str)
    assert got == sorted([(None, 26, None), (7, 26, 7), (None, 26, None), (9, 27, 7), (2**60 + 1, 1, 2**60 + 1)], key=str)


def test_empty(spark, no_docs):
    assert jaccard.joined_components(no_docs).count() == 0


def test_texts_longer_than_a_slice(spark):
    words = [f"w{k}" for k in range(220_000)]
    other = words[:200_000] + [f"v{k}" for k in range(20_000)]
    rows = [(5, " ".join(words)), (3, " ".join(other)), (8, " ".join(words[:100_000])), (9, " ".join(words[::-1]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.joined_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: (219_996, 3), 3: (219_996, 3), 8: (99_996, 8), 9: (219_996, 9)}


def test_rounds_of_a_region_without_links(spark, monkeypatch):
    """1500 texts share a passage that no order puts last, and hardly any link: few rounds over the cluster, and all pairs are the result."""
    rng = np.random.default_rng(8)
    passage = [f"p{k}" for k in range(18)]
    rows = [(i, " ".join([f"o{i}_{k}" for k in range(4)] + passage + [f"q{i}_{k}" for k in range(14)])) for i in range(1500)]
    for i in rng.choice(1500, 60, replace=False).tolist():  # and near copies of some
        words = rows[i][1].split()
        words[-1] = "edited"
        rows.append((len(rows), " ".join(words)))
    monkeypatch.setattr(jaccard, "LOCAL", 3000)
    monkeypatch.setattr(jaccard.common_shingles, "__defaults__", (10**9, 1 << 18))
    rounds, step = [], jaccard.step
    monkeypatch.setattr(jaccard, "step", lambda region: rounds.append(1) or step(region))
    got = {r.doc_id: r.component_id for r in jaccard.joined_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert 1 <= len(rounds) <= 10
    sets, want = [shingles(t) for _, t in rows], {i: i for i, _ in rows}
    for i in range(1500, len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                want[i] = want[j] = min(want[i], want[j])
    assert got == want and sum(i != c for i, c in want.items()) == 60


def test_rare_cells_lose_no_link(spark):
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(30):
        base = rng.choice(400, 40, replace=False)
        for _ in range(4):
            x = base.copy()
            x[rng.choice(40, rng.integers(0, 7), replace=False)] = rng.integers(0, 400, 1)
            sets.append(np.unique(x).astype(np.uint64))
    df = spark.createDataFrame([(7, i, i, s.tobytes()) for i, s in enumerate(sets)], "region long, b long, label long, tokens binary").repartition(3)
    cells = defaultdict(set)
    for r in jaccard.rare_cells(df).collect():
        cells[r.region].add(r.b)
    every = {(i, j) for j in range(len(sets)) for i in range(j) if jaccard.join_pairs(sets[i], [sets[j]])[0]}
    assert every and all(any({i, j} <= c for c in cells.values()) for i, j in every)
    same = df.selectExpr("region", "b", "1L as label", "tokens")
    assert jaccard.rare_cells(same).count() == 0 and jaccard.rare_cells(df.where("b < 0")).count() == 0


def test_components_that_are_not_finished_are_an_error(spark, monkeypatch):
    from phonoframe.llm import components

    monkeypatch.setattr(components, "ROUNDS", 1)
    chain = spark.range(50).selectExpr("id as u", "id + 1 as v")
    with pytest.raises(RuntimeError, match="rounds"):
        components.components(chain)
