"""Helpers that the operators of this subpackage share.

Intermediate tables go to the shared folder that ``spark.checkpoint.dir``
names, as Parquet, so a lost executor only costs the tasks it ran. A folder of
our own is used only where that setting is absent and Spark runs on one machine.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Bytes of an Arrow batch while a step is written: Spark's default holds whole texts several times over in each task.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; made once per session if the setting is absent on a local master, an error on a cluster."""
    at = spark.conf.get(CHECKPOINT_DIR, None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="phonoframe-")
        spark.conf.set(CHECKPOINT_DIR, at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/phonoframe-{name}-{uuid.uuid4().hex}"


def removed_at_exit(spark: SparkSession, path: str) -> None:
    """The driver removes a scratch folder, which is there, when it ends; until then plans may read it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


class Written:
    """A table cut from its lineage by writing it to the shared folder."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, name)
        before = self.spark.conf.get(BATCH_CONF)
        self.spark.conf.set(BATCH_CONF, str(min(BATCH_BYTES, int(before.rstrip("b")))) if before.rstrip("b").isdigit() else before)
        try:
            df.write.parquet(self.path)
        finally:
            self.spark.conf.set(BATCH_CONF, before)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        removed_at_exit(self.spark, self.path)

    def drop(self) -> None:
        """Remove the files; call only when no later plan reads them."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    return Written(df, name).df


def lean(spark: SparkSession) -> None:
    """Small Arrow batches for the rest of the session, for plans over whole texts that are written elsewhere: the setting counts when a plan runs, so it can't be taken back here."""
    spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


_KEPT: dict[str, object] = {}


def kept(name: str, build):
    """build(), made once per Python worker. A worker serves tasks of many steps, so it keeps the tables of one kind only."""
    if name not in _KEPT:
        _KEPT.clear()
        trimmed()
        _KEPT[name] = build()
    return _KEPT[name]


def trimmed() -> None:
    """Gives memory that this Python worker no longer uses back to the machine, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of finished steps, which otherwise stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column back to back and n + 1 offsets; nulls are empty. No copy of the text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, (at - at[0]) if len(at) else np.zeros(1, np.int64)


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cuts of consecutive documents, each of about `most` bytes; one document is never cut."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit words over all bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def binary_rows(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """values[cuts[i]:cuts[i + 1]] as row i of a binary column."""
    size = values.dtype.itemsize
    data = np.ascontiguousarray(values)
    if len(data) * size < 2**31:
        return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * size).astype(np.int32)), pa.py_buffer(data)])
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * size).astype(np.int64)), pa.py_buffer(data)])


def groups(batches: Iterator[pa.RecordBatch], keys: int, least_rows: int, most_rows: int | None = None) -> Iterator[tuple[pa.Table, bool]]:
    """Tables from rows sorted by their first `keys` columns, and True where a table holds whole groups; small groups come together.

    A group of more than `most_rows` rows comes in pieces, with False, so that no
    group has to fit into memory. Every row is looked at once.
    """
    done: list[pa.RecordBatch] = []
    tail: list[pa.RecordBatch] = []
    key, large = None, False
    rows = lambda some: sum(b.num_rows for b in some)
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        change[0] = key != [c[0] for c in columns]
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        key = [c[-1] for c in columns]
        if large:
            end = int(starts[0]) if len(starts) else batch.num_rows
            if end:
                yield pa.Table.from_batches([batch.slice(0, end)]), False
            if not len(starts):
                continue
            batch, starts, large = batch.slice(end), starts - end, False
        if len(starts):
            done += tail
            cut = int(starts[-1])
            if cut:
                done.append(batch.slice(0, cut))
            tail = [batch.slice(cut)]
        else:
            tail.append(batch)
        if most_rows is not None and rows(tail) > most_rows:
            if done:
                yield pa.Table.from_batches(done).combine_chunks(), True
            yield pa.Table.from_batches(tail), False
            done, tail, large = [], [], True
        elif rows(done) >= least_rows:
            yield pa.Table.from_batches(done).combine_chunks(), True
            done = []
    if done or tail:
        yield pa.Table.from_batches(done + tail).combine_chunks(), True


def by_key(batches: Iterator[pa.RecordBatch], keys: int, least_rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by their first `keys` columns; small groups come together."""
    for t, _ in groups(batches, keys, least_rows):
        yield t
