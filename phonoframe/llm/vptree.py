"""Nearest neighbours by cosine with one vantage-point tree per shard.

Unit vectors make cosine order the order of Euclidean (chord) distance, a
metric. The upper levels of a vantage-point tree, grown on a bounded sample,
deal all vectors to leaves; a leaf's vectors are cut by a hash into shards of
bounded size, and each shard becomes one row that holds its tree. Every leaf
knows the rings around its vantage points that its members really occupy.

A query first searches its own leaf. The k-th best distance found there is a
bound, and the query then visits only leaves whose rings are within reach. In a
shard a subtree is skipped when its ring of distances around the vantage point
is farther from the query than ``factor`` times the k-th best distance so far.
Factor 1 is the triangle inequality itself, so the search is exact; smaller
factors skip more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phonoframe.llm.common import table, written

#: Vectors of a shard, queries of a block, vectors of a leaf.
SHARD_ROWS, BLOCK_ROWS, LEAF = 4096, 1024, 64
#: Levels of the tree above the shards at most, vectors drawn to grow them, and of these at least so many for each leaf.
TOP_DEPTH, TOP_SAMPLE, TOP_LEAST = 10, 16_384, 16
#: 1: exact.
FACTOR = 1.0
K = 5
#: Chord distances of equal vectors differ by rounding: what rings and squared distances are given besides; all candidates that aren't farther than the k-th by more are ranked by exact score.
SLACK, SLACK_SQUARED = 1e-6, 1e-12
#: Components of the vectors that are scored at once.
SCORED = 1 << 22


def usable(embedding: Column) -> Column:
    """True for vectors that take part: not null, not empty or zero, every component finite."""
    wide = embedding.cast("array<double>")
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(embedding.isNotNull() & finite & F.exists(wide, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by the largest component first, so nothing overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class VPTree:
    """Points are different unit vectors. Nodes in preorder: vantage point, the near half's size, and both halves' rings."""

    def __init__(self, points: np.ndarray, order: np.ndarray | None = None, nodes: np.ndarray | None = None):
        self.points = points
        if order is None:
            self.order, self.rows = np.arange(len(points)), []
            self._build(0, len(points))
            self.nodes = np.array(self.rows).reshape(-1, 5)
        else:
            self.order, self.nodes = order, nodes
        self.sorted = points[self.order]

    def _build(self, a: int, b: int) -> None:
        if b - a <= LEAF:
            return
        part = self.order[a:b]
        # The point farthest from the first one sees the others at the most different distances.
        far = int(np.argmax(((self.points[part] - self.points[part[0]]) ** 2).sum(1)))
        part[0], part[far] = part[far], part[0]
        d = np.sqrt(((self.points[part[1:]] - self.points[part[0]]) ** 2).sum(1))
        by = np.argsort(d, kind="stable")
        part[1:] = part[1:][by]
        d, half = d[by], len(d) // 2
        self.rows.append((half, d[0], d[half - 1], d[half], d[-1]))
        self._build(a + 1, a + 1 + half)
        self._build(a + 1 + half, b)

    def search(self, queries: np.ndarray, k: int, factor: float = FACTOR, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distances and points (-1: none) of the k nearest of each query, and of none that the factor lets skip; none farther than the limit is looked for."""
        self.q, self.k, self.factor, self.met, self.measured = queries, k, factor, [], 0
        self.limit = np.full(len(queries), np.inf) if limit is None else limit
        self.best, self.at = np.full((len(queries), k), np.inf), np.full((len(queries), k), -1)
        self._visit(0, len(self.order), 0, np.arange(len(queries)))
        return self.best, self.at

    def reached(self, queries: np.ndarray, k: int, factor: float = FACTOR, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Queries and points, by query, of all pairs whose distance isn't above the query's k-th or its limit, up to rounding: ties are whole."""
        self.search(queries, k, factor, limit)
        if not self.met:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        q, p, d = (np.concatenate(x) for x in zip(*self.met, strict=True))
        # Reaches only shrink, so a point within the last one was kept when it was met.
        keep = d <= self._reach(q)
        q, p = q[keep], p[keep]
        by = np.argsort(q, kind="stable")
        return q[by], p[by]

    def _kth(self, who: np.ndarray) -> np.ndarray:
        return np.minimum(self.best[who].max(1), self.limit[who])

    def _reach(self, who: np.ndarray) -> np.ndarray:
        return np.sqrt(self._kth(who) ** 2 + SLACK_SQUARED)

    def _take(self, who: np.ndarray, d: np.ndarray, points: np.ndarray) -> None:
        self.measured += d.size
        all_d = np.concatenate([self.best[who], d], 1)
        all_p = np.concatenate([self.at[who], np.broadcast_to(points, d.shape)], 1)
        by = np.argpartition(all_d, self.k - 1, 1)[:, : self.k] if all_d.shape[1] > self.k else np.tile(np.arange(self.k), (len(who), 1))
        self.best[who], self.at[who] = np.take_along_axis(all_d, by, 1), np.take_along_axis(all_p, by, 1)
        q, p = np.nonzero(d <= self._reach(who)[:, None])
        self.met.append((who[q], points[p], d[q, p]))

    def _nodes(self, n: int) -> int:
        """Nodes in a subtree of n points."""
        if n <= LEAF:
            return 0
        half = (n - 1) // 2
        return 1 + self._nodes(half) + self._nodes(n - 1 - half)

    def _far(self, who: np.ndarray, d: np.ndarray, low: float, high: float) -> np.ndarray:
        reach = self.factor * self._kth(who) + SLACK
        return (d - high > reach) | (low - d > reach)

    def _visit(self, a: int, b: int, node: int, who: np.ndarray) -> None:
        if not len(who) or a >= b:
            return
        if b - a <= LEAF:
            self._take(who, np.sqrt(np.maximum(2 - 2 * self.q[who] @ self.sorted[a:b].T, 0)), self.order[a:b])
            return
        half, low1, high1, low2, high2 = self.nodes[node]
        d = np.sqrt(((self.q[who] - self.sorted[a]) ** 2).sum(1))
        self._take(who, d[:, None], self.order[a : a + 1])
        mid = a + 1 + int(half)
        near = (a + 1, mid, node + 1), low1, high1
        far = (mid, b, node + 1 + self._nodes(int(half))), low2, high2
        inside = d <= (high1 + low2) / 2
        # Each query sees its own side first, so that the other side meets a smaller reach.
        for mine, (first, second) in ((inside, (near, far)), (~inside, (far, near))):
            for (x, y, n), low, high in (first, second):
                some = np.flatnonzero(mine)
                some = some[~self._far(who[some], d[some], low, high)]
                self._visit(x, y, n, who[some])


@dataclass(frozen=True)
class Top:
    """The upper levels of the tree of one dimension, a complete binary tree in heap order: vantage points, and the distance up to which a vector belongs to the left child."""

    vantage: np.ndarray
    radius: np.ndarray
    depth: int

    @classmethod
    def grown(cls, points: np.ndarray, depth: int) -> Top:
        vantage, radius, parts = [], [], [np.arange(len(points))]
        for _ in range(depth):
            below = []
            for part in parts:
                v = points[part[int(np.argmax(((points[part] - points[part[0]]) ** 2).sum(1)))]]
                d = np.sqrt(((points[part] - v) ** 2).sum(1))
                by = np.argsort(d, kind="stable")
                half = (len(part) + 1) // 2
                vantage.append(v)
                radius.append(d[by[half - 1]])
                below += [part[by[:half]], part[by[half:]]]
            parts = below
        return cls(np.array(vantage).reshape(-1, points.shape[1]), np.array(radius), depth)

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * x @ self.vantage.T, 0))

    def leaf(self, d: np.ndarray) -> np.ndarray:
        """The leaf of each vector by its distances to all vantage points."""
        at = np.zeros(len(d), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (d[np.arange(len(d)), at] > self.radius[at])
        return at - ((1 << self.depth) - 1)

    def above(self, leaf: int | np.ndarray) -> list:
        """The vantage points on the way to a leaf."""
        return [(1 << k) - 1 + (leaf >> (self.depth - k)) for k in range(self.depth)]


def tops(vectors: DataFrame) -> dict[int, Top]:
    """Upper levels for each dimension that a bounded sample, drawn by a hash of vec_id, shows often enough; other dimensions are one leaf."""
    drawn = vectors.orderBy(F.xxhash64("vec_id", F.lit("top")), "vec_id").limit(TOP_SAMPLE).select("embedding").toPandas()["embedding"]
    by_dim: dict[int, list] = {}
    for x in drawn:
        by_dim.setdefault(len(x), []).append(np.asarray(x, np.float64))
    often = {d: x for d, x in by_dim.items() if len(x) >= 2 * TOP_LEAST}
    if not often:
        return {}
    counts = vectors.where(F.size("embedding").isin(list(often))).groupBy(F.size("embedding").alias("dim")).count().collect()  # at most TOP_SAMPLE / (2 * TOP_LEAST) rows
    depth = {r["dim"]: min(TOP_DEPTH, max(r["count"] // SHARD_ROWS, 1).bit_length() - 1, (len(often[r["dim"]]) // TOP_LEAST).bit_length() - 1) for r in counts}
    return {d: Top.grown(unit(np.stack(often[d])), k) for d, k in depth.items() if k}


def dealt(vectors: DataFrame, top: dict[int, Top]) -> DataFrame:
    """vectors with dim and leaf."""
    sent = vectors.sparkSession.sparkContext.broadcast(top)

    @F.pandas_udf("int")
    def leaf(column: pd.Series) -> pd.Series:
        dims, out = column.map(len).to_numpy(), np.zeros(len(column), np.int32)
        for d, t in sent.value.items():
            at = np.flatnonzero(dims == d)
            for i in range(0, len(at), 2048):
                some = at[i : i + 2048]
                out[some] = t.leaf(t.distances(unit(np.stack(column.iloc[some].to_numpy()).astype(np.float64))))
        return pd.Series(out)

    return vectors.withColumn("dim", F.size("embedding")).withColumn("leaf", leaf("embedding"))


def in_parts(rows: DataFrame, most: int, key: str) -> DataFrame:
    """rows with part: those of a dimension and leaf cut by a hash of the key, about `most` each."""
    n = rows.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / most).alias("parts"))
    return rows.join(n, ["dim", "leaf"]).withColumn("part", F.pmod(F.xxhash64(key, F.lit("shard")), F.col("parts")).cast("int")).drop("parts")


def packed_trees(vectors: DataFrame, top: dict[int, Top]) -> DataFrame:
    """dim, leaf, part and a row per shard: ids, lengths of id lists, vectors, tree, and low and high, the rings of its leaf's vantage points."""
    sent = vectors.sparkSession.sparkContext.broadcast(top)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        ids = pdf["vec_id"].to_numpy(np.int64)
        # One point per vector, with its ids in order.
        _, at, n = np.unique(x + 0.0, axis=0, return_inverse=True, return_counts=True)
        by = np.lexsort((ids, at.ravel()))
        ids, points = ids[by], x[by][np.concatenate([[0], np.cumsum(n)[:-1]])]
        tree = VPTree(unit(points))
        dim, leaf, part = x.shape[1], int(pdf["leaf"].iloc[0]), int(pdf["part"].iloc[0])
        rings = np.zeros((2, 0))
        if dim in sent.value:
            d = sent.value[dim].distances(tree.points)[:, sent.value[dim].above(leaf)]
            rings = np.stack([d.min(0), d.max(0)])
        raw = {"ids": ids, "counts": n.astype(np.int64), "vectors": points, "tree_order": tree.order.astype(np.int64), "nodes": tree.nodes}
        return pd.DataFrame({"dim": [dim], "leaf": [leaf], "part": [part]} | {k: [v.tobytes()] for k, v in raw.items()} | {"low": [list(rings[0])], "high": [list(rings[1])]})

    dealt_ = in_parts(vectors.select("vec_id", "embedding", "dim", "leaf"), SHARD_ROWS, "vec_id")
    return dealt_.groupBy("dim", "leaf", "part").applyInPandas(pack, "dim int, leaf int, part int, ids binary, counts binary, vectors binary, tree_order binary, nodes binary, low array<double>, high array<double>")


def packed_blocks(queries: DataFrame) -> DataFrame:
    """dim, leaf and blocks of the queries (query_id, embedding, limit) that go there."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        return pd.DataFrame({"dim": [x.shape[1]], "leaf": [int(pdf["leaf"].iloc[0])], "query_ids": [pdf["query_id"].to_numpy(np.int64).tobytes()], "queries": [x.tobytes()], "limits": [pdf["limit"].to_numpy(np.float64).tobytes()]})

    dealt_ = in_parts(queries.select("query_id", "embedding", "dim", "leaf", "limit"), BLOCK_ROWS, "query_id")
    return dealt_.groupBy("dim", "leaf", "part").applyInPandas(pack, "dim int, leaf int, query_ids binary, queries binary, limits binary")


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in an order of additions that depends on the length alone; equal vectors give equal scores.

    Rows are scaled by powers of two first, which is exact, so that squares of very long vectors don't overflow.
    """
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) for x in (a, b))
    return (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))


def search_block(query_ids: np.ndarray, queries: np.ndarray, limits: np.ndarray, ids: np.ndarray, counts: np.ndarray, points: np.ndarray, order: np.ndarray, nodes: np.ndarray, k: int, factor: float) -> pd.DataFrame:
    """The k best rows of one shard for each query of a block."""
    # One more for the query's own row; whatever ties with the last one comes too.
    pairs_q, pairs_p = VPTree(unit(points), order, nodes).reached(unit(queries), min(k + 1, len(points)), factor, limits)
    starts = np.cumsum(counts) - counts
    found = []
    # Whole queries at a time, by about SCORED components.
    step = max(1, SCORED // max(1, points.shape[1]))
    last = np.searchsorted(pairs_q, np.arange(len(queries)), "right")
    at = 0
    while at < len(pairs_q):
        end = int(max(last[pairs_q[at]], last[np.searchsorted(last, at + step, "right") - 1] if last[0] <= at + step else 0))
        q, p = pairs_q[at:end], pairs_p[at:end]
        at = end
        # The smallest ids of a vector that many rows share: ties go to them.
        take = np.minimum(counts[p], k + 1)
        row = np.repeat(np.arange(len(p)), take)
        vec = ids[starts[p[row]] + np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take)]
        score = cosines(queries[q], points[p])[row]
        q = q[row]
        other = vec != query_ids[q]
        q, vec, score = q[other], vec[other], score[other]
        by = np.lexsort((vec, -score, q))
        q, vec, score = q[by], vec[by], score[by]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        found.append(pd.DataFrame({"query_id": query_ids[q[keep]], "vec_id": vec[keep], "score": score[keep]}))
    return pd.concat(found) if found else pd.DataFrame({"query_id": query_ids[:0], "vec_id": ids[:0], "score": np.zeros(0)})


def searched(blocks: DataFrame, trees: DataFrame, k: int, factor: float) -> DataFrame:
    """query_id, vec_id and score: the k best of each shard of its block's leaf for every query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = lambda raw, kind=np.float64: np.frombuffer(raw, kind)
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                yield search_block(f(r.query_ids, np.int64), f(r.queries).reshape(-1, r.dim), f(r.limits), f(r.ids, np.int64), f(r.counts, np.int64), f(r.vectors).reshape(-1, r.dim), f(r.tree_order, np.int64), f(r.nodes).reshape(-1, 5), k, factor)

    pairs = blocks.join(trees.drop("low", "high"), ["dim", "leaf"])
    return pairs.mapInPandas(run, "query_id long, vec_id long, score double")


def best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def in_reach(queries: DataFrame, trees: DataFrame, top: dict[int, Top], factor: float) -> DataFrame:
    """query_id, embedding, dim, leaf and limit of every query (leaf: its own, limit: a distance) for each other leaf whose rings are within `factor` times its limit."""
    # A row per leaf of the upper levels: bounded by TOP_DEPTH and the number of dimensions that have them.
    ring = lambda k: (F.min(F.get("low", F.lit(k))).alias(f"low{k}"), F.max(F.get("high", F.lit(k))).alias(f"high{k}"))
    rows = trees.where(F.col("dim").isin(list(top))).groupBy("dim", "leaf").agg(*[c for k in range(TOP_DEPTH) for c in ring(k)]).collect()
    leaves = {}
    for d, t in top.items():
        mine = [r for r in rows if r["dim"] == d]
        leaves[d] = np.array([r["leaf"] for r in mine], np.int64), *(np.array([[r[f"{w}{k}"] for k in range(t.depth)] for r in mine]).reshape(-1, t.depth) for w in ("low", "high"))
    sent = queries.sparkSession.sparkContext.broadcast((top, leaves))

    @F.pandas_udf("array<int>")
    def visits(embedding: pd.Series, own: pd.Series, limit: pd.Series) -> pd.Series:
        top, leaves = sent.value
        dims, out = embedding.map(len).to_numpy(), [[]] * len(embedding)
        for dim, t in top.items():
            leaf, low, high = leaves[dim]
            for i in np.flatnonzero(dims == dim):
                d = t.distances(unit(np.asarray(embedding.iloc[i], np.float64)[None]))[0]
                to = np.stack([d[v] for v in t.above(leaf)], 1)
                gap = np.maximum(to - high, low - to).max(1)
                out[i] = leaf[(gap <= factor * limit.iloc[i] + SLACK) & (leaf != own.iloc[i])].tolist()
        return pd.Series(out)

    return queries.withColumn("leaf", F.explode(visits("embedding", "leaf", "limit")))


def once(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding, of repeated ids the smallest vector."""
    twice = written(vectors.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"), "vp-twice")
    if twice.isEmpty():
        return vectors
    again = vectors.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return vectors.join(twice, "vec_id", "left_anti").unionByName(again)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k nearest by cosine, nearest first, ties to smaller ids.

    Both tables have vec_id and embedding. Vectors that are null, empty or zero
    or hold null or non-finite components take no part; nor do null ids. A query
    meets vectors of its own length only and never its own id. Rows of one id
    count once, by their smallest vector. Fewer candidates than k give fewer rows.
    """
    wide = F.col("embedding").cast("array<double>")
    good = lambda df: once(df.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", wide.alias("embedding")))
    points = good(vectors)
    top = tops(points)
    trees = written(packed_trees(dealt(points, top), top), "vp-trees")
    asked = written(dealt(good(queries), top).withColumnRenamed("vec_id", "query_id"), "vp-queries")
    own = written(best(searched(packed_blocks(asked.withColumn("limit", F.lit(float("inf")))), trees, k, factor), k), "vp-own")
    if not top:
        return own
    # The k-th score as a distance; a little more, for rounding.
    kth = own.where(F.col("rank") == k).select("query_id", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score")) + SLACK_SQUARED).alias("limit"))
    bounded = asked.where(F.col("dim").isin(list(top))).join(kth, "query_id", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
    others = searched(packed_blocks(written(in_reach(bounded, trees, top, factor), "vp-visits")), trees, k, factor)
    return best(own.drop("rank").unionByName(others), k)


def op1_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every embedding whose vec_id is divisible by 50, against all (the contract of ``nearest``)."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))
