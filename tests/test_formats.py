"""The data source of files, a caller's corpus as a source, and the sink with commit."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonoframe.sources import corpora, formats, labels


def names(root):
    return sorted(p.relative_to(root).as_posix() for p in Path(root).rglob("*") if p.is_file())


def test_files_come_and_go_by_partitions(spark, tmp_path):
    root = str(tmp_path / "corpus")
    contents = spark.range(40).select(F.format_string("s%d/f%03d.lab", F.col("id") % 3, "id").alias("name"), F.format_string("0 50000 a%d\n", "id").cast("binary").alias("content")).repartition(5)
    assert corpora.write_files(contents, f"file://{root}") == 40
    assert names(root) == sorted(f"s{i % 3}/f{i:03d}.lab" for i in range(40)) and corpora.write_files(contents.limit(0), f"file://{root}") == 0
    (Path(root) / "note.txt").write_text("x")
    got = spark.read.format(formats.FILES).option("pattern", "*.lab").option("partitionBytes", "60").load(f"file://{root}")
    assert got.rdd.getNumPartitions() > 5
    rows = got.collect()
    assert sorted(r.folder.rsplit("/", 1)[1] + "/" + r.name for r in rows) == sorted(f"s{i % 3}/f{i:03d}" for i in range(40)) and all(len(r.content) == r.size for r in rows)
    parsed = labels.parse(got.select(F.col("name").alias("utt"), F.col("content").cast("string").alias("text"))).collect()
    assert {(r.utt, r.context, r.end_time) for r in parsed} == {(f"f{i:03d}", f"a{i}", 50_000) for i in range(40)}
    listed = spark.read.format(formats.FILES).option("content", "false").load(f"file://{root}")
    assert listed.count() == 41 and listed.where("content is not null").count() == 0


def test_a_failing_task_leaves_no_file(spark, tmp_path):
    root = str(tmp_path / "corpus")
    formats.register(spark)
    contents = spark.range(30).repartition(4).select(F.format_string("f%d", "id").alias("name"), F.when(F.col("id") == 17, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).cast("binary").alias("content"))
    with pytest.raises(Exception, match="broken"):
        contents.write.format(formats.FILES).mode("append").save(f"file://{root}")
    assert not Path(root).exists() or names(root) == []
    for bad in ("../x", "/x", ""):
        with pytest.raises(Exception, match="not a path below"):
            corpora.write_files(spark.createDataFrame([(bad, b"x")], "name string, content binary"), f"file://{root}")
    with pytest.raises(Exception, match="name and content"):
        spark.range(1).write.format(formats.FILES).mode("append").save(f"file://{root}")


def test_appending_and_overwriting(spark, tmp_path):
    root = f"file://{tmp_path}/corpus"
    one = lambda name, text: spark.createDataFrame([(name, text)], "name string, content binary")
    corpora.write_files(one("a/b.txt", b"1"), root)
    corpora.write_files(one("a/b.txt", b"2"), root)
    corpora.write_files(one("c.txt", None), root)
    assert names(tmp_path / "corpus") == ["a/b.txt", "c.txt"] and (tmp_path / "corpus/a/b.txt").read_bytes() == b"2"
    one("d.txt", b"3").write.format(formats.FILES).mode("overwrite").save(root)
    assert names(tmp_path / "corpus") == ["d.txt"]


def test_a_callers_corpus(spark):
    class Ramps(formats.Corpus):
        def items(self):
            return [(f"u{i}", i) for i in range(int(self.options["n"]))]

        def features(self, item):
            return np.arange(2 * item, dtype=float).reshape(item, 2)

    spark.dataSource.register(formats.source_of("ramps", Ramps))
    got = spark.read.format("ramps").option("n", "7").option("share", "2").load()
    assert got.rdd.getNumPartitions() == 4 and got.dtypes == [("utt", "string"), ("frame", "bigint"), ("features", "array<double>")]
    rows = {(r.utt, r.frame): r.features for r in got.collect()}
    assert rows == {(f"u{i}", t): [2.0 * t, 2.0 * t + 1] for i in range(7) for t in range(i)}
    assert spark.read.format("ramps").option("n", "0").load().count() == 0
