"""Statistics that resume: streams of frames merged into a table of counts, means and variances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoframe.operators import stats


def running(frames: DataFrame, by: str = "dim", value: str = "value") -> DataFrame:
    """Statistics of a stream so far, for output mode update or complete."""
    return stats.meanvar(frames, by, value)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the finished versions below a path, in order."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(n[8:]) for n in names if n.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(root, f"{n}/_SUCCESS")))


def resumed(path: str, by: str = "dim", value: str = "value"):
    """A foreachBatch function that merges each batch into the last finished statistics in `path`/version=N and writes the next version.

    A version is complete, and notes the run (the query's id, which its checkpoint
    keeps) and the batch it came from. A batch that is repeated after a failure is
    left out if its version was finished, and written again if not; a run with a
    new checkpoint goes on with all earlier statistics.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
        done = versions(spark, path)
        now = stats.meanvar(batch, by, value)
        if done:
            before = spark.read.parquet(f"{path}/version={done[-1]}")
            if not before.where((F.col("run") == run) & (F.col("batch") == number)).isEmpty():
                return
            now = stats.merge(before.drop("run", "batch"), now, by)
        noted = now.withColumn("run", F.lit(run)).withColumn("batch", F.lit(number).cast("long"))
        noted.write.mode("overwrite").parquet(f"{path}/version={done[-1] + 1 if done else 0}")

    return merge


def windows_in_time(events: DataFrame, width: str, step: str, value: str = "value", late: str = "10 minutes") -> DataFrame:
    """Sums over sliding windows of event time with late data up to `late`; an extension, as frames here have no event time of their own."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
