"""Queries over feature vectors and files: statistics, scaling, distortion, corpus checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonoframe.functions import scalar
from phonoframe.operators import datasets, metrics, sequence, spectral, stats
from phonoframe.operators.grouping import tasks_of
from phonoframe.plans.registry import query
from phonoframe.plans.tables import EVENTS, VECTORS, events, table, vectors
from phonoframe.sources import corpora

R = lambda c, n=6: F.round(c, n)
_STATS = "s AS (SELECT dim, count(value) AS n, avg(value) AS mean, var_pop(value) AS var, min(value) AS low, max(value) AS high FROM v GROUP BY dim)"


@query(f"WITH {VECTORS}, {_STATS} SELECT vec_id, dim, round((value-mean)/CASE WHEN var = 0 THEN 1 ELSE sqrt(var) END, 5) AS y FROM v JOIN s USING (dim)")
def feat_meanvar_scale(spark, sf):
    """Dataset statistics, then every value scaled by them."""
    v = vectors(spark, sf)
    return stats.applied(v, stats.meanstd(v)).select("vec_id", "dim", R(scalar.scale(F.col("value"), F.col("mean"), F.col("std")), 5).alias("y"))


@query(f"WITH {VECTORS}, {_STATS} SELECT dim, n, round(mean, 6) AS mean, round(var, 6) AS var FROM s")
def meanvar(spark, sf):
    return stats.meanvar(vectors(spark, sf)).select("dim", "n", R("mean").alias("mean"), R("var").alias("var"))


@query(f"WITH {VECTORS}, {_STATS} SELECT dim, n, round(mean, 6) AS mean, round(var, 6) AS var FROM s")
def meanvar_merge(spark, sf):
    """Statistics of two halves, merged."""
    v = vectors(spark, sf)
    halves = (stats.meanvar(v.where(c)) for c in ("label < 5", "label >= 5 or label is null"))
    return stats.merge(*halves).select("dim", "n", R("mean").alias("mean"), R("var").alias("var"))


@query(f"WITH {VECTORS}, {_STATS} SELECT dim, n, round(mean, 6) AS mean, round(CASE WHEN var = 0 THEN 1 ELSE sqrt(var) END, 6) AS std FROM s")
def meanstd(spark, sf):
    return stats.meanstd(vectors(spark, sf)).select("dim", "n", R("mean").alias("mean"), R("std").alias("std"))


@query(f"WITH {VECTORS}, {_STATS} SELECT dim, round(low, 6) AS low, round(high, 6) AS high FROM s")
def minmax(spark, sf):
    return stats.minmax(vectors(spark, sf)).select("dim", R("low").alias("low"), R("high").alias("high"))


@query(f"WITH {VECTORS}, {_STATS} SELECT vec_id, dim, round(sqrt(var)*value+mean, 5) + 0.0 AS y FROM v JOIN s USING (dim)")
def inv_scale(spark, sf):
    v = vectors(spark, sf)
    return stats.applied(v, stats.meanvar(v)).select("vec_id", "dim", (R(scalar.inv_scale(F.col("value"), F.col("mean"), F.sqrt("var")), 5) + 0.0).alias("y"))


def _minmax(spark, sf, fn):
    v = vectors(spark, sf)
    factor, shift = scalar.minmax_params(F.col("low"), F.col("high"), (-1.0, 1.0))
    return stats.applied(v, stats.minmax(v)).select("vec_id", "dim", (R(fn(F.col("value"), factor, shift), 5) + 0.0).alias("y"))


_FACTOR = "2.0/CASE WHEN high = low THEN 1 ELSE high-low END"


@query(f"WITH {VECTORS}, {_STATS} SELECT vec_id, dim, round(value*({_FACTOR}) + (-1.0-low*({_FACTOR})), 5) + 0.0 AS y FROM v JOIN s USING (dim)")
def minmax_scale(spark, sf):
    return _minmax(spark, sf, scalar.minmax_scale)


@query(f"WITH {VECTORS}, {_STATS} SELECT vec_id, dim, round((value - (-1.0-low*({_FACTOR})))/({_FACTOR}), 5) + 0.0 AS y FROM v JOIN s USING (dim)")
def inv_minmax_scale(spark, sf):
    return _minmax(spark, sf, scalar.inv_minmax_scale)


@query("""WITH a AS (SELECT vec_id, label, embedding AS x FROM embeddings), p AS (SELECT a.label, a.vec_id, a.x, b.x AS y FROM a JOIN a b ON b.vec_id = a.vec_id + 1),
d AS (SELECT label, vec_id, sqrt(list_sum(list_transform(range(1, len(x)+1), lambda i: (x[i]::DOUBLE-y[i]::DOUBLE)*(x[i]::DOUBLE-y[i]::DOUBLE)))) AS d FROM p)
SELECT label, round(6.141851463713754*avg(d), 5) AS melcd FROM d GROUP BY label""")
def mel_cepstral_distortion(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    y = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return metrics.mel_cepstral_distortion(e.join(y, "vec_id"), "x", "y", "label").select("label", R("melcd", 5).alias("melcd"))


@query(f"""WITH {EVENTS}, n AS (SELECT CAST(greatest(64, pow(2, ceil(log2(max(frame) + 1)))) AS BIGINT) AS n FROM e), k AS (SELECT n, unnest(range(n // 2 + 1)) AS bin FROM n)
SELECT utt, bin, round(pow(sum(value*cos(frame*bin % n*(2*pi()/n))), 2) + pow(sum(value*sin(frame*bin % n*(2*pi()/n))), 2), 2) AS power FROM e, k GROUP BY utt, bin""")
def modulation_spectrum(spark, sf):
    users = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    longest, utterances = users.agg(F.coalesce(F.max("n"), F.lit(1)), F.count("*")).first()
    n = max(64, 1 << (longest - 1).bit_length())
    e = events(spark, sf, spectral.tasks_for(utterances, n, tasks_of(users))).withColumn("dim", F.lit(0))
    return spectral.modspec_rows(e, n).select("utt", F.col("bin").cast("long").alias("bin"), R("power", 2).alias("power"))


@query("SELECT doc_id, source, rank AS place FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 3")
def first_files_per_group(spark, sf):
    from pyspark.sql import Window

    docs = datasets.first_per_group(table(spark, sf, "documents").select("doc_id", "source"), 3, ["source"], "doc_id")
    return docs.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def transcripts_with_wav(spark, sf):
    have, _ = corpora.with_wav(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), ["doc_id"])
    return have


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def transcripts_without_wav(spark, sf):
    _, lack = corpora.with_wav(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), ["doc_id"])
    return lack


@query("SELECT doc_id, lang, list_position(['de', 'en', 'es', 'fr'], lang) - 1 AS speaker_label FROM documents")
def speaker_labels(spark, sf):
    return datasets.with_label(table(spark, sf, "documents").select("doc_id", "lang"), ["de", "en", "es", "fr"], "lang")


@query("SELECT coalesce(d.doc_id, l.doc_id) AS name, CASE WHEN d.doc_id IS NULL THEN 'text' ELSE 'wav' END AS missing FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def corpus_pair_check(spark, sf):
    names = lambda t: table(spark, sf, t).select(F.col("doc_id").alias("name"))
    return corpora.pair_check(names("documents"), names("labels"))


@query(f"""WITH {EVENTS}, u AS (SELECT utt, max(frame)+1 AS n FROM e GROUP BY utt), m AS (SELECT utt, frame, d AS dim, value*(d+1) AS value FROM e, (SELECT unnest(range(6)) AS d))
SELECT m.utt, dim // 2 * n + frame AS "row", dim % 2 AS dim, round(value, 6) AS value FROM m JOIN u USING (utt)""")
def reshape_means(spark, sf):
    m = events(spark, sf).withColumn("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long")))).withColumn("value", F.col("value") * (F.col("dim") + 1))
    return sequence.reshape_means(m.select("utt", "frame", "dim", "value"), 2).withColumn("value", R("value"))


@query("SELECT doc_id, ordinal FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents) WHERE ordinal >= 10 AND ordinal < 100 AND (ordinal - 10) % 7 = 0")
def dataset_slice(spark, sf):
    return datasets.at(datasets.numbered(table(spark, sf, "documents").select("doc_id"), "doc_id"), slice(10, 100, 7))


@query("SELECT doc_id, ordinal FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, count(*) OVER () AS n FROM documents) WHERE ordinal <= n - 3 AND ordinal > 20 AND (n - 3 - ordinal) % 4 = 0")
def dataset_slice_backwards(spark, sf):
    return datasets.at(datasets.numbered(table(spark, sf, "documents").select("doc_id"), "doc_id"), slice(-3, 20, -4))


@query("SELECT doc_id, ordinal FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, count(*) OVER () AS n FROM documents) WHERE ordinal = n - 2")
def dataset_index(spark, sf):
    return datasets.at(datasets.numbered(table(spark, sf, "documents").select("doc_id"), "doc_id"), -2)


@query(f"""WITH {EVENTS}, m AS (SELECT max(frame) + 1 AS t FROM e), u AS (SELECT utt, count(*) AS n FROM e GROUP BY utt), g AS (SELECT utt, n, t, unnest(range(t)) AS frame FROM u, m)
SELECT g.utt, g.n, t AS frames, string_agg(CAST(round(coalesce(value, 0)*100) AS BIGINT) || ',' || CAST(round(coalesce(f0, 0)*100) AS BIGINT), ',' ORDER BY g.frame) AS numbers FROM g LEFT JOIN e ON e.utt = g.utt AND e.frame = g.frame GROUP BY g.utt, g.n, t""")
def dataset_batch(spark, sf):
    """Utterances as rows of one length, floats."""
    x = events(spark, sf).select("utt", "frame", F.array("value", "f0").alias("features"))
    whole = F.transform(F.flatten("features"), lambda v: F.round(v.cast("double") * 100).cast("long").cast("string"))
    return datasets.batched(x).select("utt", "n", F.size("features").cast("long").alias("frames"), F.array_join(whole, ",").alias("numbers"))


@query("SELECT count(*) AS n FROM documents")
def dataset_length(spark, sf):
    return datasets.lengths(table(spark, sf, "documents").select("doc_id"))
