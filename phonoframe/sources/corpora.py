"""Corpus folders as tables of files and transcripts.

Listings are Spark scans of file names (contents aren't read until asked for);
caps are per group, integrity checks are joins.
"""

from __future__ import annotations

import io
import os
from abc import ABC, abstractmethod
from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from phonoframe.operators.datasets import first_per_group, with_label
from phonoframe.sources.formats import FILES, register


def _in_few_tasks(spark: SparkSession, path: str, pattern: str, content: bool) -> DataFrame | None:
    """Files below a local or HDFS folder, many in a task; Spark's own sources count each as 4 MB, so a task reads a few dozen. None for other stores and for globs."""
    at = urlsplit(path)
    if at.scheme not in ("", "file", "hdfs") or any(c in path for c in "*?[]{}\\,%"):
        return None
    root = path if at.scheme else f"file://{os.path.abspath(path)}"
    root = f"file://{at.path}" if at.scheme == "file" else root
    try:
        fs, base = pafs.FileSystem.from_uri(root)
        if fs.get_file_info(base).type != pafs.FileType.Directory:
            return None
    except OSError:
        return None
    register(spark)
    found = spark.read.format(FILES).option("pattern", pattern).option("content", str(content).lower()).load(root)
    before = "file:" if root.startswith("file:") else f"hdfs://{at.netloc}"
    return found.withColumn("path", F.concat(F.lit(before), "path"))


def files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, name, folder): files under a folder or glob that match a glob of names; name is without its extension."""
    found = _in_few_tasks(spark, path, pattern, False) if not set(pattern) & set("[]{}\\") else None
    if found is None:
        found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1).alias("name"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"))


def write_files(contents: DataFrame, root: str) -> int:
    """Writes name (a path below root) and content (binary) as files; how many there are. Tasks write side by side; the files are there when all of them have been written, and none is if one fails."""
    register(contents.sparkSession)
    seen = Observation()
    contents.select("name", "content").observe(seen, F.count("*").alias("n")).write.format(FILES).mode("append").save(root)
    return seen.get["n"]


class Source(ABC):
    """A source of utterances that a caller may write: items, and how to make features of one.

    ``collect`` lists the items (name, and what else ``features`` wants);
    ``features`` turns one item into a matrix of frames. ``frames`` runs it over
    the cluster, item by item.
    """

    @abstractmethod
    def collect(self, spark: SparkSession) -> DataFrame:
        """The items: a table with the column name."""

    @abstractmethod
    def features(self, item: dict) -> np.ndarray:
        """(T, D) of one item, a row of ``collect`` as a dict."""

    def frames(self, spark: SparkSession, tasks: int | None = None) -> DataFrame:
        """(utt, frame, features) of all items."""
        items = self.collect(spark)
        own = self.features

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for item in pdf.to_dict("records"):
                    x = np.atleast_2d(np.asarray(own(item), float))
                    yield pd.DataFrame({"utt": [item["name"]] * len(x), "frame": np.arange(len(x)), "features": list(x)})

        dealt = items.repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), "name")
        return dealt.mapInPandas(run, "utt string, frame long, features array<double>")


def _grouped(spark: SparkSession, root: str, folder: str, groups: dict[str, Sequence[str]], max_files: int | None, pattern: str = "*.wav") -> DataFrame:
    """Files in folders named by all combinations of groups, e.g. folder "{speaker}_{emotion}"."""
    shape = folder
    for g in groups:
        shape = shape.replace("{" + g + "}", "([^/]+?)")
    found = files(spark, root, pattern)
    numbers = {g: i + 1 for i, g in enumerate(sorted(groups, key=lambda g: folder.index("{" + g + "}")))}
    out = found.withColumns({g: F.regexp_extract("folder", f"/{shape}$", n) for g, n in numbers.items()})
    total = 1
    for g, names in groups.items():
        out = out.where(F.col(g).isin(list(names)))
        total *= len(names)
    out = out.where(" and ".join(f"{g} <> ''" for g in groups))
    if max_files is not None:
        out = first_per_group(out, max_files // total, list(groups))
    return out


def _known(given: Sequence[str], known: Sequence[str] | None) -> list[str]:
    if known is not None and (bad := set(given) - set(known)):
        raise ValueError(f"unknown names: {sorted(bad)}")
    return list(given)


def speaker_folders(spark: SparkSession, root: str, speakers: Sequence[str], folder: str = "cmu_us_{speaker}_arctic/wav", max_files: int | None = None, known: Sequence[str] | None = None) -> DataFrame:
    """Waveforms in a folder per speaker, with speaker_label; `max_files` is shared out evenly."""
    return with_label(_grouped(spark, root, folder, {"speaker": _known(speakers, known)}, max_files), list(speakers))


def training_folders(spark: SparkSession, root: str, speakers: Sequence[str], training: bool = True, max_files: int | None = None, known: Sequence[str] | None = None) -> DataFrame:
    """Waveforms of the training or the evaluation set: {root}/vcc2016_training/{speaker} or {root}/evaluation_all/{speaker}."""
    at = "vcc2016_training" if training else "evaluation_all"
    return speaker_folders(spark, f"{root}/{at}", speakers, "{speaker}", max_files, known)


def emotion_folders(spark: SparkSession, root: str, speakers: Sequence[str], emotions: Sequence[str] = ("normal",), max_files: int | None = None) -> DataFrame:
    """Waveforms in folders speaker_emotion."""
    return with_label(_grouped(spark, root, "{speaker}_{emotion}", {"speaker": speakers, "emotion": emotions}, max_files), list(speakers))


def balanced_sentences(spark: SparkSession, path: str, column: str = "sentence", max_files: int | None = None) -> DataFrame:
    """(sentence_id, text) of a tab-separated file with a header, or of the files of a folder; max_files: the first lines of each file."""
    names = ["sentence_id", "sentence", "yomi", "monophone"]
    if column not in names:
        raise ValueError(f"column is one of {names}")
    rows = spark.read.csv(path, sep="\t", header=True, schema=", ".join(f"{n} string" for n in names), quote="").select("sentence_id", F.col(column).alias("text"))
    if max_files is None:
        return rows
    # Lines of a part of a file are read in order, and parts are told apart by where they start.
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("_line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    at = F.row_number().over(Window.partitionBy("path").orderBy("_block", "_id"))
    # Of a file only as many lines as are wanted leave the tasks that read them; empty ones don't count.
    first = lines.where("_line <> ''").withColumn("_at", at).where(F.col("_at") <= max_files + 1)
    place = {n: k for k, n in enumerate(names)}
    field = lambda n: F.get(F.split("_line", "\t"), F.lit(place[n]))
    return first.where("_at > 1").select(field("sentence_id").alias("sentence_id"), field(column).alias("text"))


def metadata_table(spark: SparkSession, root: str, normalized: bool = False) -> DataFrame:
    """(name, text, path) of metadata.csv (name|text|normalised text); other numbers of fields fail."""
    rows = spark.read.text(f"{root}/metadata.csv").withColumn("_f", F.split("value", r"\|"))
    field = lambda k: F.when(F.size("_f") == 3, F.col("_f")[k]).otherwise(F.raise_error(F.concat(F.lit("not three fields: "), F.col("value"))))
    return rows.select(field(0).alias("name"), field(2 if normalized else 1).alias("text")).withColumn("path", F.concat(F.lit(f"{root}/wavs/"), "name", F.lit(".wav")))


def subset_transcripts(spark: SparkSession, root: str, subsets: Sequence[str], patches: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """(subset, name, text) of the subsets' transcript_utf8.txt (name:text; other lines are skipped). patches: subset -> wrong name -> right name."""
    out = None
    for k, subset in enumerate(subsets):
        rows = spark.read.text(f"{root}/{subset}/transcript_utf8.txt").where(F.col("value").contains(":"))
        part = rows.select(F.lit(k).alias("subset_no"), F.lit(subset).alias("subset"), F.substring_index("value", ":", 1).alias("name"), F.expr("substring(value, instr(value, ':') + 1)").alias("text"))
        if fix := (patches or {}).get(subset):
            part = part.replace(fix, subset=["name"])
        out = part if out is None else out.unionByName(part)
    return out


def with_wav(transcripts: DataFrame, wavs: DataFrame, keys: Sequence[str] = ("name",)) -> tuple[DataFrame, DataFrame]:
    """Transcripts that have a waveform, and those that have none."""
    on = list(keys)
    return transcripts.join(wavs.select(*on), on, "left_semi"), transcripts.join(wavs.select(*on), on, "left_anti")


def subset_waveforms(spark: SparkSession, root: str, subsets: Sequence[str], patches: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """(subset, name, text, path): the transcripts of the subsets that have a waveform in {subset}/wav, with its path."""
    texts = subset_transcripts(spark, root, subsets, patches)
    wavs = files(spark, root, "*.wav").select(F.regexp_extract("path", r"/([^/]+)/wav/[^/]+$", 1).alias("subset"), "name", "path")
    return texts.join(wavs, ["subset", "name"]).select("subset", "name", "text", "path")


def speaker_number(names: Column | str) -> Column:
    """Speakers named 225 or p225 alike, as p225."""
    c = F.col(names) if isinstance(names, str) else names
    return F.when(c.startswith("p"), c).otherwise(F.concat(F.lit("p"), c))


def speaker_texts(spark: SparkSession, root: str, speakers: Sequence[str], max_files: int | None = None) -> DataFrame:
    """(speaker, name, text, path, speaker_label) of txt/p{speaker}/*.txt that have a waveform in wav48/p{speaker}; speakers may be given as 225 or p225."""
    named = [x if x.startswith("p") else f"p{x}" for x in speakers]
    of = lambda c: F.regexp_extract(c, r"/([^/]+)/[^/]+$", 1)
    texts = text_files(spark, f"{root}/txt").select(of("path").alias("speaker"), "name", "text").where(F.col("speaker").isin(named))
    wavs = files(spark, f"{root}/wav48", "*.wav").select(of("path").alias("speaker"), "name", "path")
    found = texts.join(wavs, ["speaker", "name"])
    if max_files is not None:
        found = first_per_group(found, max_files // len(named), ["speaker"])
    return with_label(found, named)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, folder, text) of one-text files, without the final line end."""
    found = _in_few_tasks(spark, path, "*.txt", True)
    if found is None:
        rows = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    else:
        rows = found.select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), F.col("content").cast("string").alias("value"))
    rows = rows.select("path", F.regexp_replace("value", r"\r?\n\z", "").alias("text"))
    return rows.select("path", F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1).alias("name"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), "text")


def pair_check(texts: DataFrame, wavs: DataFrame) -> DataFrame:
    """(name, missing) of names that only one side has."""
    a, b = texts.select("name", F.lit(True).alias("_t")), wavs.select("name", F.lit(True).alias("_w"))
    return a.join(b, "name", "full").where("_t is null or _w is null").select("name", F.when(F.col("_t").isNull(), "text").otherwise("wav").alias("missing"))


def category_transcripts(spark: SparkSession, root: str, speakers: Sequence[str], categories: Sequence[str], lost: DataFrame | None = None) -> DataFrame:
    """(speaker, category, name, text, path) of {speaker}/{category}/transcripts_utf8.txt that have a waveform and aren't in lost (speaker, name)."""
    if not categories:
        raise ValueError("at least one category is needed")
    rows = spark.read.text(f"{root}/*/*/transcripts_utf8.txt").select("value", F.col("_metadata.file_path").alias("_p"))
    at = lambda c, k: F.regexp_extract(c, r"/([^/]+)/([^/]+)/(?:wav24kHz16bit/[^/]+$|transcripts_utf8\.txt)", k)
    texts = rows.where(F.col("value").contains(":")).select(at("_p", 1).alias("speaker"), at("_p", 2).alias("category"), F.substring_index("value", ":", 1).alias("name"), F.expr("substring(value, instr(value, ':') + 1)").alias("text"))
    wavs = files(spark, root, "*.wav").select(at("path", 1).alias("speaker"), at("path", 2).alias("category"), "name", "path")
    found = texts.where(F.col("speaker").isin(list(speakers)) & F.col("category").isin(list(categories))).join(wavs, ["speaker", "category", "name"])
    return found if lost is None else found.join(lost, ["speaker", "name"], "left_anti")


def speaker_table(spark: SparkSession, path: str, columns: Sequence[str], last_is_rest: bool = False) -> DataFrame:
    """A table of words by white space, its header skipped; last_is_rest: the last column takes all that is left."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("_f"), F.trim("value").alias("_v"))
    body = rows.where((F.col("_v") != "") & (F.lower(F.col("_f")[0]) != columns[0].lower()) & ~F.lower(F.col("_f")[0]).isin("id", "speaker"))
    n = len(columns)
    one = [F.get("_f", F.lit(k)).alias(c) for k, c in enumerate(columns[: n - 1])]
    rest = F.array_join(F.slice("_f", n, F.greatest(F.size("_f") - n + 1, F.lit(0))), " ") if last_is_rest else F.get("_f", F.lit(n - 1))
    return body.select(*one, rest.alias(columns[-1]))


def feature_archives(spark: SparkSession, root: str, key: str = "data") -> DataFrame:
    """(utt, frame, features) of the matrices under `key` in *.npz files; files in any store that Spark reads."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with np.load(io.BytesIO(content)) as z:
                    x = np.atleast_2d(z[key]).astype(np.float32)
                yield pd.DataFrame({"utt": path.rsplit("/", 1)[-1].rsplit(".", 1)[0], "frame": np.arange(len(x)), "features": list(x)})

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(root)
    return found.select("path", "content").mapInPandas(run, "utt string, frame long, features array<float>")
