"""The driver's tables read as utterances, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str, tasks: int | None = None) -> DataFrame:
    """(utt, frame, value, voiced, f0): a user's events in time are an utterance; errors are unvoiced. tasks: how many share the utterances."""
    # Named before it is numbered by: what follows then knows that an utterance's frames are in one task.
    w = Window.partitionBy("utt").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select(F.col("user_id").alias("utt"), "ts", "event_id", "value", "event_type")
    e = e.repartition(tasks, "utt") if tasks else e
    voiced = (F.col("event_type") != "error").cast("int")
    return e.select("utt", (F.row_number().over(w) - 1).cast("long").alias("frame"), "value", voiced.alias("voiced")).withColumn("f0", F.when(F.col("voiced") == 1, F.col("value")).otherwise(0.0))


EVENTS = """e AS (SELECT user_id AS utt, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value,
  CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS voiced, CASE WHEN event_type <> 'error' THEN value ELSE 0.0 END AS f0 FROM events)"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(utt, frame, x, y, x_voiced, y_voiced): utterances and their successors, frame by frame."""
    e = events(spark, sf)
    y = e.select((F.col("utt") - 1).alias("utt"), "frame", F.col("value").alias("y"), F.col("voiced").alias("y_voiced"))
    return e.select("utt", "frame", F.col("value").alias("x"), F.col("voiced").alias("x_voiced")).join(y, ["utt", "frame"])


PAIRS = EVENTS + """, p AS (SELECT a.utt, a.frame, a.value AS x, b.value AS y, a.voiced AS x_voiced, b.voiced AS y_voiced
  FROM e a JOIN e b ON b.utt = a.utt + 1 AND a.frame = b.frame)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, label, dim, value) of the embeddings."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("dim", "value"))
    return e.select("vec_id", "label", F.col("dim").cast("long").alias("dim"), F.col("value").cast("double").alias("value"))


VECTORS = "v AS (SELECT vec_id, label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS value FROM embeddings)"


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """State-aligned labels: a user's events are states 2 to 6 in turn, lasting 1 to 4 frames; purchases are silence."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "value", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    idx = (F.row_number().over(w) - 1).cast("long")
    frames = (F.floor(F.col("value")) % 4 + 1).cast("long")
    base = e.select(F.col("user_id").alias("utt"), idx.alias("idx"), (frames * 50_000).alias("_d"), F.col("event_type"))
    end = F.sum("_d").over(Window.partitionBy("utt").orderBy("idx"))
    # The phone of five states is named after its first event.
    name = F.first("event_type").over(Window.partitionBy("utt", F.floor(F.col("idx") / 5)).orderBy("idx"))
    phone = F.when(name == "purchase", F.lit("sil")).otherwise(name)
    context = F.concat(F.lit("x^a-"), phone, F.lit("+b=c/N:"), (F.col("idx") % 7).cast("string"), F.lit("["), (F.col("idx") % 5 + 2).cast("string"), F.lit("]"))
    return base.withColumn("context", context).select("utt", "idx", (end - F.col("_d")).alias("start_time"), end.alias("end_time"), "context")


LABELS = """b AS (SELECT user_id AS utt, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
  (CAST(floor(value) AS BIGINT) % 4 + 1) * 50000 AS d, event_type FROM events),
n AS (SELECT *, first_value(event_type) OVER (PARTITION BY utt, idx // 5 ORDER BY idx) AS name, CAST(sum(d) OVER (PARTITION BY utt ORDER BY idx) AS BIGINT) AS e FROM b),
l AS (SELECT utt, idx, e - d AS start_time, e AS end_time,
  'x^a-' || CASE WHEN name = 'purchase' THEN 'sil' ELSE name END || '+b=c/N:' || (idx % 7) || '[' || (idx % 5 + 2) || ']' AS context FROM n)"""
