"""Label files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parse(files: DataFrame) -> DataFrame:
    """(utt, text) -> (utt, idx, start_time, end_time, context).

    # lines and blank lines are skipped. Three fields: start, end, context; one
    field: a context with times -1; anything else fails. A file that has a
    decimal point in a time is in seconds.
    """
    lines = files.select("utt", F.posexplode(F.split("text", "\r?\n")).alias("_at", "_line")).withColumn("_f", F.split(F.trim(F.regexp_replace("_line", r"\s+", " ")), " "))
    kept = lines.where((F.col("_f")[0] != "") & ~F.col("_f")[0].startswith("#"))
    n = F.size("_f")
    bad = F.raise_error(F.concat(F.lit("not a label: "), F.col("_line")))
    of_file = Window.partitionBy("utt")
    seconds = F.max((n == 3) & (F.col("_f")[0].contains(".") | F.col("_f")[1].contains("."))).over(of_file)
    time = lambda k: F.when(n == 1, F.lit(-1)).when(n == 3, F.when(F.col("_s"), F.col("_f")[k].cast("double") * 1e7).otherwise(F.col("_f")[k].cast("double"))).otherwise(bad.cast("double")).cast("long")
    marked = kept.withColumn("_s", seconds)
    idx = F.row_number().over(of_file.orderBy("_at")) - 1
    return marked.select("utt", idx.cast("long").alias("idx"), time(0).alias("start_time"), time(1).alias("end_time"), F.col("_f")[F.when(n == 3, 2).otherwise(0)].alias("context"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder or glob; utt is the file name without its extension."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    return parse(spark.read.text(path, wholetext=True).select(name.alias("utt"), F.col("value").alias("text")))


def from_contexts(contexts: DataFrame) -> DataFrame:
    """(utt, idx, context) as labels without times."""
    none = F.lit(-1).cast("long")
    return contexts.select("utt", "idx", none.alias("start_time"), none.alias("end_time"), "context")
