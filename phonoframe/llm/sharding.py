"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a 64-bit ring. A key belongs to the arc
that ends at the next point clockwise and prefers the shards in the order in
which their points follow. Shards have a capacity; keys that meet a full shard
continue clockwise to the next one that has room.

Admission needs only the number of keys in each cell of the ring (an arc, cut
into ``CUTS`` parts by a second hash). These counts are bounded by the
parameters, never by the rows, so the driver decides how many keys of a cell
each shard takes; the keys of a cell follow in the order of their hash. One
shuffle of slim rows (no text) numbers them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonoframe.llm.common import table, written

#: Parts of an arc.
CUTS = 16


def ring_points(n_shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, clockwise. A shard's points don't depend on the other shards."""
    def place(shard: int, copy: int) -> int:
        return int.from_bytes(hashlib.sha256(f"{shard}/{copy}".encode()).digest()[:8], "big", signed=True)

    return sorted((place(s, c), s) for s in range(n_shards) for c in range(vnodes))


def preferences(points: list[tuple[int, int]], n_shards: int) -> list[list[int]]:
    """For each arc the shards in clockwise order of their first points."""
    out = []
    for i in range(len(points)):
        seen: dict[int, None] = {}
        for j in range(len(points)):
            seen.setdefault(points[(i + j) % len(points)][1])
            if len(seen) == n_shards:
                break
        out.append(list(seen))
    return out


def arc_of(points: list[tuple[int, int]]):
    bounds = np.array([p for p, _ in points], np.int64)

    @F.pandas_udf(T.IntegerType())
    def arc(position: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(bounds, position.to_numpy(np.int64)) % len(bounds)).astype(np.int32))

    return arc


def capacities(total: int, n_shards: int, load: float) -> list[int]:
    """Keys that a shard may hold. Load 1: counts are at most one apart, all shards end full."""
    if load <= 1:
        return [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    return [-int(-load * total // n_shards)] * n_shards


def admit(counts: dict[int, int], prefer: list[list[int]], capacity: list[int]) -> dict[int, list[tuple[int, int, int]]]:
    """cell -> (first rank, shard, first slot) of its parts, in order of rank.

    Round t offers what is left of each cell to its t-th shard. A full shard
    stays full, and capacities sum to the number of keys at least, so nothing
    is left after as many rounds as there are shards.
    """
    free, slot = list(capacity), [0] * len(capacity)
    left, rank, parts = dict(counts), dict.fromkeys(counts, 0), {c: [] for c in counts}
    for t in range(len(capacity)):
        for cell in sorted(left):
            shard = prefer[cell // CUTS][t]
            if n := min(left[cell], free[shard]):
                parts[cell].append((rank[cell], shard, slot[shard]))
                rank[cell] += n
                left[cell] -= n
                free[shard] -= n
                slot[shard] += n
    return parts


def ring_shards(df: DataFrame, key: str, n_shards: int = 8, *, vnodes: int = 128, load: float = 1.0, tie: list[str] | None = None) -> DataFrame:
    """df with the columns shard and slot (gapless from 0 within the shard).

    load: a shard holds at most load * rows / shards (rounded up; for 1 exactly
    even counts). tie: columns that order rows of one key. Null keys form one
    key. An empty table gives no rows. df is read twice, so give a written table.
    """
    clash = {"shard", "slot", "_cell", "_rank", "_order", "_parts"} & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are made here; rename them first")
    points = ring_points(n_shards, vnodes)
    prefer = preferences(points, n_shards)
    extra = [F.col(c) for c in tie or []]
    position, order = F.xxhash64(F.col(key), F.lit("ring")), F.xxhash64(F.col(key), *extra, F.lit("order"))
    placed = df.withColumn("_order", order).withColumn("_cell", arc_of(points)(position) * CUTS + F.pmod(F.col("_order"), F.lit(CUTS)).cast("int"))
    counts = {r[0]: r[1] for r in placed.groupBy("_cell").count().collect()}  # at most shards * vnodes * CUTS rows
    parts = admit(counts, prefer, capacities(sum(counts.values()), n_shards, load))
    spark = df.sparkSession
    small = spark.createDataFrame([(c, [list(p) for p in ps]) for c, ps in parts.items()], "_cell int, _parts array<array<bigint>>")
    ranked = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("_cell").orderBy("_order", key, *(tie or []))) - 1)
    joined = ranked.join(F.broadcast(small), "_cell")
    part = F.element_at(F.filter("_parts", lambda p: p[0] <= F.col("_rank")), -1)
    return joined.withColumn("_part", part).select(*df.columns, F.col("_part")[1].cast("int").alias("shard"), (F.col("_part")[2] + F.col("_rank") - F.col("_part")[0]).alias("slot"))


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def op10_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law ``rows``: counts are at most one apart.

    Null text: size 1 and the checksum of no bytes. Repeated doc_ids are placed
    one by one. Other columns of documents are not read.
    """
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = written(docs.select("doc_id", (text_bytes(F.col("text")) + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")), "sharding")
    out = ring_shards(slim, "doc_id", 8, tie=["text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
