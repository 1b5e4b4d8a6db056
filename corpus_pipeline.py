"""The corpus pipeline: five stages, each of which calls one operator of phonoframe.llm.

A stage takes what its predecessor kept. All but the last return the columns of
documents; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phonoframe.llm import jaccard, langid, mixing, packing, secrets
from phonoframe.llm.common import lean, table, written


#: Ids (8 bytes each) up to which those of removed documents are sent to all tasks.
BROADCAST_IDS = 1_000_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter, and undecided ones, go."""
    lean(spark)
    return langid.accepted(docs, langid.train(docs.where(~langid.held_out(F.col("doc_id")))))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id. Rows without a doc_id stay."""
    groups = jaccard.joined_components(docs)
    others = written(groups.where("doc_id <> component_id").select("doc_id").distinct(), "stage-others")
    if others.count() <= BROADCAST_IDS:
        others = F.broadcast(others)  # so that texts stay where they are
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in their texts masked, and n_chars counted anew."""
    lean(spark)
    text = secrets.redact(F.col("text"), secrets.default_vocabulary())
    changed = docs.withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it (0 to 3 times). Rows that share doc_id, source and size get their own numbers, by the order of their texts."""
    words = mixing.words(F.col("text"))
    sizes = written(docs.select("doc_id", "source", words.alias("size")), "mixing-sizes")
    # Both sides hold the same (doc_id, source, size) as often, so the n-th row of a key there is the n-th here: texts move once, by the key.
    key = F.xxhash64("_doc_id", "_source", "_size")
    place = lambda order: F.row_number().over(Window.partitionBy("_key").orderBy("_doc_id", "_source", "_size", order))
    copies = mixing.mixed_copies(sizes).select(F.col("doc_id").alias("_doc_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("copies").cast("int").alias("_times"))
    times = copies.withColumn("_key", key).withColumn("_place", place(F.desc("_times"))).where("_times > 0").select("_key", "_place", "_times")
    own = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_doc_id"), F.col("source").alias("_source"), words.alias("_size"))
    ranked = own.withColumn("_key", key).withColumn("_place", place(F.col("_row.text"))).select("_row", "_key", "_place")
    same = (F.col("d._key") == F.col("t._key")) & (F.col("d._place") - F.col("t._place") == 0)
    taken = ranked.alias("d").join(times.alias("t"), same).select("_row", "_times")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 4096 tokens."""
    return packing.packed(docs, packing.default_tokenizer())


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", jaccard_join),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mixing),
    ("packing", packed_sequences),
]

#: No SQL: stages 1, 3 and 5 rest on models and tokenizers. The tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES one after the other over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
