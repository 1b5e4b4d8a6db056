"""Importance resampling towards a target: documents whose n-grams look like those of target texts are drawn more often.

A table of word positions holds one row for each word of each document. A window
over a document's positions looks ahead with lead(), which joins the words that
follow to n-grams of each order; each is hashed to a bucket. Counts of buckets
over all documents and all target texts give every bucket's gain, a logarithm of
the ratio of its two smoothed shares. Gains are joined to the positions; a
document's weight is their mean, and Gumbel noise that only its id decides turns
weights into a draw without replacement: the highest scores.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phonoframe.llm.common import table, written
from phonoframe.operators.datasets import numbered
from phonoframe.operators.grouping import tasks_of

#: Words in a run at most, and buckets of their hashes (gains are sent to all tasks: a row each).
ORDERS, BUCKETS = 2, 10_000
#: Documents of so many words may be drawn; percent of them that are.
LEAST_WORDS, PERCENT = 20, 25
SEED = 7
#: Gains and noise are whole thousandths.
SCALE = 1000
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of digits, ASCII letters (small ones for capitals) and characters beyond ASCII."""
    text = F.coalesce(text, F.lit(""))
    # lower() changes letters beyond ASCII too, so it is for texts without them.
    small = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(small, _SEPARATORS), "")


def features(texts: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """texts (doc_id, text) -> row (a number of its own for every text), doc_id and b1 ... b<orders>: a row per word, with the bucket of the run of k words from there in bk, null where the text ends. A text without words has one row, all null."""
    # Texts are dealt by row once; positions stay where they arise, so their window needs no shuffle.
    own = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").repartition(tasks_of(texts), "row")
    positions = own.select("row", "doc_id", F.posexplode_outer(words(F.col("text"))).alias("pos", "word"))
    along = Window.partitionBy("row").orderBy("pos")
    following = positions.select("row", "doc_id", F.col("word").alias("w0"), *(F.lead("word", k).over(along).alias(f"w{k}") for k in range(1, orders)))

    def bucket(k: int) -> Column:
        run = F.col("w0")
        for i in range(1, k):
            run = F.concat(run, F.lit(" "), F.col(f"w{i}"))  # null beyond the end
        return F.pmod(F.crc32(run.cast("binary")), F.lit(buckets)).cast("int").alias(f"b{k}")

    return following.select("row", "doc_id", *(bucket(k) for k in range(1, orders + 1)))


def bucket_counts(found: DataFrame, orders: int = ORDERS) -> DataFrame:
    """bucket and n: how often it occurs, runs of all lengths together."""
    by_order = [found.where(f"b{k} is not null").groupBy(F.col(f"b{k}").alias("bucket")).agg(F.count("*").alias("n")) for k in range(1, orders + 1)]
    return reduce(DataFrame.unionByName, by_order).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and gain of every bucket, from the counts of the documents and those of the target texts; counts are smoothed by one."""
    every = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    met = every.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    total = lambda counts: F.coalesce(counts.agg(F.sum("n").cast("double")).scalar(), F.lit(0.0)) + float(buckets)
    ratio = (F.col("t") + 1.0) * total(raw) / ((F.col("s") + 1.0) * total(target))
    return met.select("bucket", F.floor(float(SCALE) * F.log(ratio)).alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in whole thousandths, from the id and the seed alone; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-float(SCALE) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """row, doc_id, n_words, n_features, weight and score of every document, written."""
    found = written(features(docs.select("doc_id", "text"), orders, buckets), "resampling-features")
    wanted = features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), orders, buckets)
    by_bucket = written(gains(bucket_counts(found, orders), bucket_counts(wanted, orders), buckets), "resampling-gains")
    joined = found
    for k in range(1, orders + 1):
        joined = joined.join(F.broadcast(by_bucket.select(F.col("bucket").alias(f"b{k}"), F.col("gain").alias(f"g{k}"))), f"b{k}", "left")
    own = reduce(Column.__add__, (F.coalesce(f"g{k}", F.lit(0)) for k in range(1, orders + 1)))
    n = reduce(Column.__add__, (F.count(f"b{k}") for k in range(1, orders + 1)))
    sums = joined.groupBy("row", "doc_id").agg(F.count("b1").alias("n_words"), n.alias("n_features"), F.sum(own).alias("_gain"))
    mean = F.when(F.col("n_features") > 0, F.call_function("div", F.col("_gain") - F.pmod("_gain", "n_features"), F.col("n_features"))).otherwise(0)
    return written(sums.select("row", "doc_id", "n_words", "n_features", mean.alias("weight"), (mean + noise(F.col("doc_id"), seed)).alias("score")), "resampling-scores")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, orders: int = ORDERS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null unless the document is drawn.

    Drawn are the `percent` percent (rounded down) of the documents of at least
    `least_words` words with the highest scores, ties to the smaller doc_id and a
    null one first. Null texts have no words, documents without words weight 0.
    Rows that share a doc_id are documents of their own with the same noise. Without
    target texts gains fall with how common a bucket is; an empty table gives no rows.
    """
    scores = scored(docs, target, orders, buckets, seed)
    may = scores.where(F.col("n_words") >= least_words)
    drawn = percent * may.count() // 100
    ordered = numbered(may.withColumn("_down", -F.col("score")), "_down", "doc_id", "row")
    ranked = ordered.withColumn("rank", F.when(F.col("ordinal") < drawn, F.col("ordinal") + 1))
    others = scores.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(others.select(*columns))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, drawn towards the texts of `benchmark` (the contract of ``resampled``)."""
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 bit by bit: a list of bytes, each followed by eight -1, folded from all ones.
ORACLE = r"""
WITH texts AS (SELECT 0 AS kind, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark),
d AS (SELECT row_number() OVER () AS r, kind, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM texts),
f AS (SELECT r, kind, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d),
n AS (SELECT f, hex(f) AS h, CAST(strlen(f) AS BIGINT) AS b FROM (SELECT DISTINCT f FROM f)),
c AS (SELECT f, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(b), lambda i: [CAST('0x' || substr(h, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384::BIGINT * (c & 1)) END)) % 10000 AS bucket FROM n),
s AS (SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM f JOIN c USING (f) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s),
m AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS gain FROM f JOIN c USING (f) JOIN g USING (bucket) WHERE kind = 0 GROUP BY r),
v AS (SELECT doc_id, len(w) AS words, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (gain - ((gain % n) + n) % n) // n ELSE 0 END AS weight,
  CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS noise
  FROM d LEFT JOIN m USING (r) WHERE kind = 0),
o AS (SELECT doc_id, n_features, weight, weight + noise AS score, words >= 20 AS may, row_number() OVER (PARTITION BY words >= 20 ORDER BY weight + noise DESC, doc_id NULLS FIRST) AS place, 25 * count(*) OVER (PARTITION BY words >= 20) // 100 AS most FROM v)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= most THEN place END AS rank FROM o
"""
