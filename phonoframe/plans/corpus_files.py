"""Queries over corpus folders: each writes a corpus from the driver's tables in the layout of its kind, below the shared folder, and reads it back."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoframe.operators import labels as L
from phonoframe.plans.registry import query
from phonoframe.plans.tables import EVENTS, LABELS, events, labels, table
from phonoframe.session import shared_folder
from phonoframe.sources import corpora
from phonoframe.sources import labels as label_files
from phonoframe.sources.formats import FILES, Corpus, listed, source_of

LANGS = ["de", "en", "es", "fr"]


def _docs(spark, sf) -> DataFrame:
    """name, doc_id, lang, source: a document is an utterance, a language a speaker."""
    return table(spark, sf, "documents").select(F.format_string("d%09d", "doc_id").alias("name"), "doc_id", "lang", "source")


_DOCS = "d AS (SELECT printf('d%09d', doc_id) AS name, doc_id, lang, source FROM documents)"


def _written(docs: DataFrame, path, content=None) -> str:
    """Files at path (a Column) below a new folder."""
    root = shared_folder(docs.sparkSession, "corpus")
    body = F.lit("RIFF") if content is None else content
    corpora.write_files(docs.select(path.alias("name"), body.cast("binary").alias("content")), root)
    return root


def _wav(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.col("name"), F.lit(".wav"))


@query(f"WITH {_DOCS} SELECT name, lang AS speaker, CAST(list_position(['fr', 'en', 'de', 'es'], lang) - 1 AS INTEGER) AS speaker_label FROM d")
def source_speaker_folders(spark, sf):
    docs = _docs(spark, sf)
    root = _written(docs, _wav("cmu_us_", F.col("lang"), "_arctic/wav/"))
    return corpora.speaker_folders(spark, root, ["fr", "en", "de", "es"], known=LANGS).select("name", "speaker", "speaker_label")


@query(f"WITH {_DOCS} SELECT name, lang AS speaker FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY name) AS r FROM d WHERE lang IN ('de', 'en')) WHERE r <= 5")
def source_speaker_folders_capped(spark, sf):
    """Ten files at most, shared out evenly over two speakers."""
    docs = _docs(spark, sf)
    root = _written(docs, _wav("cmu_us_", F.col("lang"), "_arctic/wav/"))
    return corpora.speaker_folders(spark, root, ["de", "en"], max_files=10).select("name", "speaker")


@query(f"WITH {_DOCS} SELECT name, lang AS speaker FROM d WHERE doc_id % 2 = 1")
def source_evaluation_folders(spark, sf):
    docs = _docs(spark, sf)
    root = _written(docs, _wav(F.when(F.col("doc_id") % 2 == 0, "vcc2016_training/").otherwise("evaluation_all/"), F.col("lang"), "/"))
    return corpora.training_folders(spark, root, LANGS, training=False).select("name", "speaker")


@query(f"WITH {_DOCS} SELECT name, lang AS speaker, CASE WHEN doc_id % 3 = 0 THEN 'normal' ELSE 'happy' END AS emotion FROM d WHERE doc_id % 3 < 2")
def source_emotion_folders(spark, sf):
    docs = _docs(spark, sf)
    emotion = F.element_at(F.array(F.lit("normal"), F.lit("happy"), F.lit("angry")), (F.col("doc_id") % 3 + 1).cast("int"))
    root = _written(docs, _wav(F.col("lang"), "_", emotion, "/"))
    return corpora.emotion_folders(spark, root, LANGS, ["normal", "happy"]).select("name", "speaker", "emotion")


@query(f"WITH {_DOCS} SELECT name AS sentence_id, upper(lang) AS text FROM d")
def source_balanced_sentences(spark, sf):
    path = shared_folder(spark, "corpus")
    _docs(spark, sf).select(F.col("name").alias("sentence_id"), F.col("source").alias("sentence"), F.upper("lang").alias("yomi"), F.lit("a b").alias("monophone")).write.csv(path, sep="\t", header=True, quote="")
    return corpora.balanced_sentences(spark, path, "yomi")


@query(f"WITH {_DOCS} SELECT name, upper(lang) AS text, name || '.wav' AS file FROM d")
def source_metadata_table(spark, sf):
    root = shared_folder(spark, "corpus")
    _docs(spark, sf).select(F.concat_ws("|", "name", F.coalesce("source", F.lit("none")), F.upper("lang"))).write.text(f"{root}/metadata.csv")
    return corpora.metadata_table(spark, root, normalized=True).select("name", "text", F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))


def _subsets(spark, sf) -> str:
    """A folder per language; a third of the transcripts have no waveform, and one in fifty a wrong name."""
    docs = _docs(spark, sf)
    root = _written(docs.where("doc_id % 3 <> 0"), _wav(F.col("lang"), "/wav/"))
    wrong = F.when(F.col("doc_id") == 7, F.lit("wrong")).otherwise(F.col("name"))
    for lang in LANGS:
        docs.where(F.col("lang") == lang).select(F.concat(wrong, F.lit(":a: "), F.coalesce("source", F.lit("none")))).write.text(f"{root}/{lang}/transcript_utf8.txt")
    return root


@query(f"WITH {_DOCS} SELECT name, lang AS subset, 'a: ' || coalesce(source, 'none') AS text, name || '.wav' AS file FROM d WHERE doc_id % 3 <> 0 AND lang <> 'de'")
def source_subset_waveforms(spark, sf):
    """Three of four subsets: transcripts, one name mended in whichever subset it is, that have a waveform."""
    patches = {lang: {"wrong": "d000000007"} for lang in LANGS}
    found = corpora.subset_waveforms(spark, _subsets(spark, sf), ["en", "es", "fr"], patches)
    return found.select("name", "subset", "text", F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))


@query(f"WITH {_DOCS} SELECT CASE WHEN doc_id = 7 THEN 'wrong' ELSE name END AS name, lang AS subset, 'a: ' || coalesce(source, 'none') AS text FROM d WHERE lang IN ('en', 'fr')")
def union_of_subsets(spark, sf):
    """The transcripts of two subsets as they are."""
    return corpora.subset_transcripts(spark, _subsets(spark, sf), ["en", "fr"]).select("name", "subset", "text")


@query(f"WITH {_DOCS} SELECT name, CASE lang WHEN 'de' THEN 'p225' ELSE 'p226' END AS speaker, CASE lang WHEN 'de' THEN 0 ELSE 1 END AS speaker_label, coalesce(source, 'none') AS text FROM d WHERE lang IN ('de', 'en') AND doc_id % 4 <> 0")
def source_speaker_texts(spark, sf):
    """Speakers named 225 and p226; a quarter of the texts have no waveform."""
    docs = _docs(spark, sf).withColumn("_s", F.when(F.col("lang") == "de", "p225").when(F.col("lang") == "en", "p226").otherwise("p227"))
    root = _written(docs, F.concat(F.lit("txt/"), "_s", F.lit("/"), "name", F.lit(".txt")), F.concat(F.coalesce("source", F.lit("none")), F.lit("\n")))
    wavs = docs.where("doc_id % 4 <> 0").select(_wav("wav48/", F.col("_s"), "/").alias("name"), F.lit("RIFF").cast("binary").alias("content"))
    corpora.write_files(wavs, root)
    return corpora.speaker_texts(spark, root, ["225", "p226"]).select("name", "speaker", "speaker_label", "text")


@query(f"WITH {_DOCS} SELECT name, lang AS speaker, CASE WHEN doc_id % 2 = 0 THEN 'parallel100' ELSE 'nonpara30' END AS category, coalesce(source, 'none') AS text FROM d WHERE lang IN ('de', 'en') AND doc_id % 10 <> 3")
def source_category_transcripts(spark, sf):
    """Two speakers and two categories; lost names are left out."""
    docs = _docs(spark, sf).withColumn("_c", F.when(F.col("doc_id") % 2 == 0, "parallel100").otherwise("nonpara30"))
    root = _written(docs, _wav(F.col("lang"), "/", F.col("_c"), "/wav24kHz16bit/"))
    for lang in ("de", "en"):
        for c in ("parallel100", "nonpara30"):
            docs.where((F.col("lang") == lang) & (F.col("_c") == c)).select(F.concat("name", F.lit(":"), F.coalesce("source", F.lit("none")))).write.text(f"{root}/{lang}/{c}/transcripts_utf8.txt")
    lost = docs.where("doc_id % 10 = 3").select(F.col("lang").alias("speaker"), "name")
    return corpora.category_transcripts(spark, root, ["de", "en"], ["parallel100", "nonpara30"], lost).select("name", "speaker", "category", "text")


@query(f"WITH {_DOCS} SELECT name AS \"ID\", CAST(20 + doc_id % 9 AS VARCHAR) AS \"AGE\", 'North ' || lang AS \"REGION\" FROM d")
def source_speaker_table(spark, sf):
    path = shared_folder(spark, "corpus")
    docs = _docs(spark, sf)
    head = spark.range(1).select(F.lit("ID  AGE  REGION").alias("value"))
    docs.select(F.concat("name", F.lit("   "), (20 + F.col("doc_id") % 9).cast("string"), F.lit(" North "), "lang").alias("value")).unionByName(head).write.text(path)
    return corpora.speaker_table(spark, path, ["ID", "AGE", "REGION"], last_is_rest=True)


@query(f"WITH {LABELS} SELECT CAST(utt AS VARCHAR) AS utt, idx, start_time, end_time, context FROM l")
def source_label_files(spark, sf):
    """Every utterance's labels as a file, read back."""
    root = shared_folder(spark, "labels")
    L.write_text(L.as_text(labels(spark, sf)), root)
    return label_files.load(spark, root)


@query(f"WITH {LABELS} SELECT utt, idx, CAST(-1 AS BIGINT) AS start_time, CAST(-1 AS BIGINT) AS end_time, context FROM l")
def labels_from_contexts(spark, sf):
    return label_files.from_contexts(labels(spark, sf))


@query(f"WITH {EVENTS} SELECT 'u' || utt AS utt, frame, CAST(round(value*100) AS BIGINT) AS a, CAST(round(f0*100) AS BIGINT) AS b FROM e")
def source_feature_archives(spark, sf):
    """A matrix of every utterance in a file of its own, read back."""
    from phonoframe.operators.grouping import over_utterances

    def archive(some: list[pd.DataFrame]):
        for pdf in some:
            out = io.BytesIO()
            np.savez(out, data=pdf[["value", "f0"]].to_numpy(np.float32))
            yield pd.DataFrame({"name": [f"u{pdf['utt'].iloc[0]}.npz"], "content": [out.getvalue()]})

    root = shared_folder(spark, "features")
    corpora.write_files(over_utterances(events(spark, sf).select("utt", "frame", "value", "f0"), archive, "name string, content binary"), root)
    x = corpora.feature_archives(spark, root)
    return x.select("utt", "frame", *[F.round(F.col("features")[k].cast("double") * 100).cast("long").alias(c) for k, c in enumerate("ab")])


class _Lengths(corpora.Source):
    """A caller's own source: a frame per letter of a document's source, with the letter's place and code."""

    def __init__(self, folder: str):
        self.folder = folder

    def collect(self, spark: SparkSession) -> DataFrame:
        return _docs(spark, self.folder).select("name", F.coalesce("source", F.lit("none")).alias("text"))

    def features(self, item: dict) -> np.ndarray:
        return np.array([[k, ord(c)] for k, c in enumerate(item["text"])], float).reshape(-1, 2)


@query(f"WITH {_DOCS}, t AS (SELECT name, coalesce(source, 'none') AS s FROM d), g AS (SELECT name, s, unnest(range(length(s))) AS frame FROM t) SELECT name AS utt, frame, CAST(frame AS DOUBLE) AS a, CAST(unicode(s[frame + 1]) AS DOUBLE) AS b FROM g")
def source_of_a_caller(spark, sf):
    x = _Lengths(sf).frames(spark)
    return x.select("utt", "frame", F.col("features")[0].alias("a"), F.col("features")[1].alias("b"))


@query(f"WITH {_DOCS} SELECT name, lang AS folder, strlen(source) AS size, source AS text FROM d")
def source_format_files(spark, sf):
    """Files written by the sink with commit and read by the registered data source, some in each partition."""
    docs = _docs(spark, sf)
    root = _written(docs, F.concat("lang", F.lit("/"), "name", F.lit(".txt")), F.col("source"))
    found = spark.read.format(FILES).option("pattern", "*.txt").option("partitionBytes", "400").load(root)
    return found.select("name", F.regexp_extract("folder", "([^/]*)$", 1).alias("folder"), "size", F.col("content").cast("string").alias("text"))


class _Ramps(Corpus):
    """A caller's corpus over a folder: a file's bytes are its frames, each with the one before it."""

    def items(self):
        return [(f.base_name.rsplit(".", 1)[0], f.path) for f in listed(self.options["path"])]

    def features(self, item):
        fs, _ = pafs.FileSystem.from_uri(self.options["path"])
        with fs.open_input_stream(item) as f:
            x = np.frombuffer(f.read(), np.uint8).astype(float)
        return np.stack([x, np.concatenate([[0.0], x[:-1]])], 1)


@query(f"""WITH {_DOCS}, b AS (SELECT name, source, unnest(range(1, len(source) + 1)) AS i FROM d), c AS (SELECT name AS utt, i - 1 AS frame, CAST(ascii(source[i]) AS DOUBLE) AS x FROM b)
SELECT utt, frame, x, coalesce(lag(x) OVER (PARTITION BY utt ORDER BY frame), 0.0) AS before FROM c""")
def source_format_caller(spark, sf):
    """A caller's corpus as a data source of its own."""
    root = _written(_docs(spark, sf), F.concat("name", F.lit(".bin")), F.col("source"))
    spark.dataSource.register(source_of("phonoframe_ramps", _Ramps))
    x = spark.read.format("phonoframe_ramps").option("path", root).load()
    return x.select("utt", "frame", F.col("features")[0].alias("x"), F.col("features")[1].alias("before"))
