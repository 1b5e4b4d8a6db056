"""Work on whole utterances in Python, and numbering of rows over the cluster."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phonoframe.operators.ranges import bounds, part

#: Parts that a task sorts, so that parts of uneven sizes even out.
PARTS_PER_TASK = 3
#: Frames of the utterances that a task hands to a kernel at once; a longer utterance comes alone.
STACK = 1 << 15


def tasks_of(df: DataFrame, tasks: int | None = None) -> int:
    """How many tasks run a kernel: a stated number, as adaptive execution would merge them by their bytes and leave a heavy kernel to one task."""
    return tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _codes(pdf: pd.DataFrame, keys: int) -> np.ndarray:
    """(rows, keys): numbers that tell the values of the first columns apart, nulls included."""
    return np.stack([pd.factorize(pdf.iloc[:, k], use_na_sentinel=False)[0] for k in range(keys)], axis=1)


def stacks(batches: Iterator[pd.DataFrame], most: int = STACK, keys: int = 1) -> Iterator[list[pd.DataFrame]]:
    """Whole utterances, several at a time, from rows that are sorted by their first column, or by as many as tell utterances apart."""
    held: list[pd.DataFrame] = []
    done: list[pd.DataFrame] = []
    rows = 0
    for pdf in batches:
        if not len(pdf):
            continue
        cuts = np.flatnonzero(np.diff(_codes(pdf, keys), axis=0).any(1)) + 1
        parts = [pdf.iloc[i:j] for i, j in zip([0, *cuts], [*cuts, len(pdf)], strict=True)]
        same = bool(held) and all(held[-1].iloc[0, k] == parts[0].iloc[0, k] or (pd.isna(held[-1].iloc[0, k]) and pd.isna(parts[0].iloc[0, k])) for k in range(keys))
        if held and not same:
            done.append(pd.concat(held) if len(held) > 1 else held[0])
            held = []
        for k, part in enumerate(parts):
            held.append(part)
            if k + 1 < len(parts):
                done.append(pd.concat(held) if len(held) > 1 else held[0])
                held = []
        rows += len(pdf)
        if rows >= most and done:
            yield done
            done, rows = [], sum(map(len, held))
    if held:
        done.append(pd.concat(held) if len(held) > 1 else held[0])
    if done:
        yield done


def over_utterances(frames: DataFrame, kernel: Callable[[list[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, order: str = "frame", tasks: int | None = None, key: str | Sequence[str] = "utt", only: str | None = None) -> DataFrame:
    """A kernel over lists of whole utterances (or what else `key`, the first column or columns of frames, tells apart), each with its frames in order.

    only: a condition on frames that the kernel gets. It is asked for once rows are dealt, so that
    kernels over some and over all of them share one dealing.
    Rows that a window or join has dealt by the key aren't dealt again. Only a window
    on top, unlike a map, then keeps adaptive execution from merging or splitting the
    parts of each side of a union or join on their own, which would tear utterances apart.
    """
    keys = [key] if isinstance(key, str) else [*key]
    dealt = frames.repartition(tasks_of(frames, tasks), *keys)
    placed = dealt.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).sortWithinPartitions(*keys, order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in stacks((pdf.drop(columns="_place") for pdf in batches), keys=len(keys)):
            yield from kernel(some)

    return (placed.where(only) if only else placed).mapInPandas(run, schema)


def each(fn: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[list[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A kernel that takes the utterances one by one."""

    def kernel(some: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = [fn(pdf) for pdf in some]
        yield pd.concat(out, ignore_index=True)

    return kernel


def kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def running_total(df: DataFrame, out: str, value, *order: str, tasks: int | None = None) -> DataFrame:
    """df with the sum of `value` over all rows up to each one, in order: sorted parts, and prefix sums over the parts' totals (a row per part).

    The parts' bounds are fixed first, so the plan of the totals and that of the
    sums cut alike; rows move once. df is read four times: write it first if it is
    costly or not the same in every read. Rows that are equal in `order` follow
    each other in no stated order. Null values count as 0.
    """
    cuts = bounds(df, *order, parts=PARTS_PER_TASK * tasks_of(df, tasks))
    within = F.sum("_v").over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    parts = df.withColumn("_p", part(df, cuts, *order)).withColumn("_v", F.coalesce(value, F.lit(0)))
    summed = parts.withColumn("_w", within)
    if not cuts:
        return summed.withColumn(out, F.col("_w").cast("long")).drop("_v", "_p", "_w")
    totals = parts.groupBy("_p").agg(F.sum("_v").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = summed.join(F.broadcast(totals.select("_p", before.alias("_b"))), "_p")
    return joined.withColumn(out, (F.col("_w") + F.col("_b")).cast("long")).drop("_v", "_p", "_w", "_b")
