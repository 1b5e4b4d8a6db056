import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonoframe.functions import scalar
from phonoframe.functions.windows import DEFAULT, DELTA, DeltaWindow
from phonoframe.operators import alignment, banded, gmm, kernels, linguistic, paramgen, postfilter, sequence, spectral, stats
from phonoframe.sources import corpora, questions
from phonoframe.sources import labels as label_files


def frames(spark, xs, utt=1):
    return spark.createDataFrame([(utt, i, float(x)) for i, x in enumerate(xs)], "utt long, frame long, value double")


def values(df, column, by="frame"):
    return [r[column] for r in df.orderBy(by).collect()]


def test_quantisation_of_mulaw(spark):
    x = spark.createDataFrame([(i, v) for i, v in enumerate([-1.0, -0.5, -0.001, 0.0, 0.0001, 0.5, 0.99999, 1.0])], "frame int, x double")
    assert values(x.select("frame", scalar.mulaw_quantize(F.col("x"), 2).alias("q")), "q") == [0, 0, 0, 1, 1, 1, 1, 2]
    back = values(x.select("frame", scalar.inv_mulaw(scalar.mulaw(F.col("x"))).alias("y")), "y")
    assert np.allclose(back, [-1, -0.5, -0.001, 0, 0.0001, 0.5, 0.99999, 1])


def test_preemphasis_round_trip(spark):
    x = np.sin(np.arange(50.0))
    y = sequence.preemphasis(frames(spark, x), "value", "y")
    assert np.allclose(values(sequence.inv_preemphasis(y, "y", "z"), "z"), x)


@pytest.mark.parametrize("n", [1, 2, 7])
def test_deltas_equal_a_correlation(spark, n):
    x = np.arange(1.0, n + 1) ** 2
    got = values(sequence.delta(frames(spark, x), "value", "y", DELTA), "y")
    pad = np.concatenate([[0], x, [0]])
    assert np.allclose(got, (pad[2:] - pad[:-2]) / 2)
    with pytest.raises(ValueError):
        DeltaWindow(1, 1, (1.0,))


def test_trimming(spark):
    f = frames(spark, [0, 0, 1, 2, 0])
    kept = lambda ends: values(sequence.trim_zeros(f, F.abs("value"), ends), "value")
    assert (kept("b"), kept("f"), kept("fb")) == ([0, 0, 1, 2], [1, 2, 0], [1, 2])
    assert values(sequence.remove_zeros(f, F.abs("value")), "value") == [1, 2]
    assert sequence.trim_zeros(frames(spark, [0, 0]), F.abs("value"), "b").count() == 0


def test_length_adjustment(spark):
    f = frames(spark, [1, 2, 3])
    assert values(sequence.adjust_length(f, "value", 4), "value") == [1, 2, 3, 0]
    assert values(sequence.adjust_length(f, "value", 4, fill="edge"), "value") == [1, 2, 3, 3]
    assert values(sequence.adjust_length(f, "value", 2, pad=False), "value") == [1, 2]


def test_features_by_alignment(spark):
    rows = [("s", i, i * 100_000, (i + 1) * 100_000, f"x-a+b[{i % 5 + 2}]") for i in range(10)] + [("p", 0, 0, 125_000, "x-a+b"), ("p", 1, 125_000, 300_000, "x-b+c")]
    labels = spark.createDataFrame(rows, "utt string, idx long, start_time long, end_time long, context string")
    got = linguistic.frame_features(labels, "state_only", "minimal_phoneme").groupBy("utt").count().collect()
    assert {r.utt: r["count"] for r in got} == {"s": 20, "p": 6}
    d = {(r.utt, r.phone): r.frames for r in linguistic.durations(labels).collect()}
    assert d == {("s", 0): [2] * 5, ("s", 1): [2] * 5, ("p", 0): [2], ("p", 1): [3]}
    note = linguistic.note_numbers()
    assert (note["A0"], note["C4"], note["Bb4"], note["G9"], len(note)) == (21, 60, 70, 127, 107)


def test_interpolation(spark):
    f = frames(spark, [0, 0, 100, 0, 0, 130, 0])
    assert values(sequence.interpolate(f, "value", "y"), "y") == [100, 100, 100, 110, 120, 130, 130]
    assert values(sequence.interpolate(f, "value", "y", "next"), "y") == [100, 100, 100, 130, 130, 130, 130]
    assert values(sequence.interpolate(frames(spark, [0, 0]), "value", "y"), "y") == [0, 0]


def test_merged_statistics_are_those_of_all(spark):
    x = np.random.default_rng(0).normal(size=30)
    df = spark.createDataFrame([(0, float(v)) for v in x], "dim long, value double")
    r = stats.merge(stats.meanvar(df.where("value > 0.5")), stats.meanvar(df.where("value <= 0.5"))).first()
    assert (r.n, round(r["mean"], 9), round(r["var"], 9)) == (30, round(x.mean(), 9), round(x.var(), 9))


def dense_mlpg(means, variances, windows):
    n, d = len(means), means.shape[1] // len(windows)
    edge = max(max(w.left, w.right) for w in windows)
    out = np.zeros((n, d))
    for k in range(d):
        p, b = np.zeros((n, n)), np.zeros(n)
        for i, w in enumerate(windows):
            m = np.zeros((n, n))
            for t in range(n):
                for j, c in enumerate(w.taps):
                    if 0 <= t + j - w.left < n:
                        m[t, t + j - w.left] = c
            tau = 1 / variances[:, i * d + k]
            if i:
                tau[:edge] = tau[-edge:] = 0
            p += m.T @ np.diag(tau) @ m
            b += m.T @ (tau * means[:, i * d + k])
        out[:, k] = np.linalg.solve(p, b)
    return out


def test_parameter_generation_equals_a_dense_solution(spark):
    rng = np.random.default_rng(1)
    means, variances = rng.normal(size=(12, 6)), rng.uniform(0.2, 2, (12, 6))
    want = dense_mlpg(means, variances, DEFAULT)
    assert np.allclose(paramgen.generate(means, variances), want)
    df = spark.createDataFrame([("u", i, m.tolist(), v.tolist()) for i, (m, v) in enumerate(zip(means, variances, strict=True))], "utt string, frame long, means array<double>, variances array<double>")
    assert np.allclose(np.stack(values(paramgen.mlpg(df), "features")), want)
    # Utterances of several lengths are solved in one stack.
    many = [(rng.normal(size=(n, 6)), rng.uniform(0.2, 2, (n, 6))) for n in (3, 12, 7, 40, 1)]
    for got, (m, v) in zip(paramgen.generate_many([m for m, _ in many], [v for _, v in many]), many, strict=True):
        assert np.allclose(got, dense_mlpg(m, v, DEFAULT))
    rows = paramgen.window_rows(DEFAULT, 12)
    assert rows.shape == (36, 12) and np.allclose(rows[:12], np.eye(12)) and np.allclose(rows[12:24] @ np.arange(12.0), [0.5, *[1] * 10, -5])
    assert df.rdd.getNumPartitions() and paramgen.mlpg(df, tasks=7).rdd.getNumPartitions() == 7
    grad = rng.normal(size=(12, 2))
    step = np.zeros_like(means)
    step[4, 3] = 1e-5
    slope = ((dense_mlpg(means + step, variances, DEFAULT) - want) / 1e-5 * grad).sum()
    assert abs(paramgen.gradient(variances, grad, 12)[4, 3] - slope) < 1e-5


def test_unit_variance_matrix():
    # Fixed values, worked out by hand for three frames of static, delta and delta-delta.
    want = np.array([[0.690476, 0.285714, 0.023810, 0, -0.333333, 0, 0, 0.142857, 0], [0.285714, 0.428571, 0.285714, 0, 0, 0, 0, -0.285714, 0], [0.023810, 0.285714, 0.690476, 0, 0.333333, 0, 0, 0.142857, 0]])
    assert np.allclose(paramgen.unit_variance_matrix(DEFAULT, 3), want, atol=1e-6)


def test_banded_kernels():
    rng = np.random.default_rng(2)
    n, w = 9, 2
    low = np.tril(rng.normal(size=(n, n))) * (np.abs(np.subtract.outer(range(n), range(n))) <= w)
    full = low @ low.T + np.eye(n)
    band = np.zeros((w + 1, n, 1))
    for k in range(w + 1):
        for t in range(k, n):
            band[k, t, 0] = full[t, t - k]
    f = kernels.cholesky(band)
    b = rng.normal(size=(n, 1))
    assert np.allclose(kernels.solve_factored(f, b)[:, 0], np.linalg.solve(full, b[:, 0]))
    inverse = np.linalg.inv(full)
    got = kernels.inverse_band(f, 3)
    assert all(np.isclose(got[k, t, 0], inverse[t, t - k]) for k in range(4) for t in range(k, n))
    with pytest.raises(np.linalg.LinAlgError):
        kernels.cholesky(-band)
    factor = np.linalg.cholesky(full)
    assert np.allclose(kernels.solve_triangular(f, b)[:, 0], np.linalg.solve(factor, b[:, 0])) and np.allclose(kernels.solve_triangular(f, b, True)[:, 0], np.linalg.solve(factor.T, b[:, 0]))
    f[0, 4] = 0
    with pytest.raises(np.linalg.LinAlgError, match="zero at 4"):
        kernels.solve_triangular(f, b)
    assert np.allclose(kernels.inverse_band(kernels.cholesky(band), n - 1)[n - 1, n - 1], inverse[n - 1, 0])


def test_banded_tables(spark):
    rng = np.random.default_rng(3)
    a, b = (rng.normal(size=(5, 5)) * (np.abs(np.subtract.outer(range(5), range(5))) <= 1) for _ in range(2))
    table = lambda m: spark.createDataFrame([(0, i, j, float(m[i, j])) for i in range(5) for j in range(5) if m[i, j]], "mat int, row long, col long, value double")
    out = np.zeros((5, 5))
    for r in banded.dot_mm(table(a), banded.transpose(table(b))).collect():
        out[r.row, r.col] = r.value
    assert np.allclose(out, a @ b.T)


def test_modulation_spectra(spark):
    x = np.random.default_rng(4).normal(size=(20, 2))
    df = spark.createDataFrame([("u", i, r.tolist()) for i, r in enumerate(x)], "utt string, frame long, features array<double>")
    back = np.stack(values(spectral.inv_modspec(spectral.modspec(df, 64)), "features"))
    assert np.allclose(back[:20], x) and np.allclose(back[20:], 0)
    assert np.allclose(np.stack(values(spectral.smoothed(df, 100, 64, 50, log_domain=False), "features")).sum(), x.sum(), atol=1)
    with pytest.raises(ValueError):
        spectral.smoothed(df, 100, 64, 51)


def test_warping():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 2)).cumsum(0)
    y = np.repeat(x, rng.integers(1, 3, 30), axis=0)
    d, path = alignment.warp(x, y)
    assert d == 0 and path[0] == (0, 0) and path[-1] == (29, len(y) - 1)
    near, p = alignment.fast_warp(x, y, 3)
    assert p[0] == (0, 0) and p[-1] == (29, len(y) - 1) and d <= near < np.sqrt(((x - y[:30]) ** 2).sum(1)).sum()
    assert all((b[0] - a[0], b[1] - a[1]) in ((0, 1), (1, 0), (1, 1)) for a, b in zip(p, p[1:], strict=False))


def test_alignment_of_tables(spark):
    x = [("u", i, [float(i)]) for i in range(1, 10)]
    y = [("u", i, [float(i // 2 + 1)]) for i in range(18)] + [("u", 18, [0.0]), ("other", 0, [1.0])]
    schema = "utt string, frame long, features array<double>"
    a, b = spark.createDataFrame(x, schema), spark.createDataFrame(y, schema)
    both = alignment.aligned(alignment.paths(a, b, exact=True), a, b).collect()
    assert len(both) == 18 and all(r.x == r.y for r in both)


def test_mixture_mapping():
    rng = np.random.default_rng(6)
    cov = np.array([[[1.0, 0.8], [0.8, 1.0]]])
    one = gmm.JointMixture(np.array([1.0]), np.array([[1.0, 5.0]]), cov)
    x = rng.normal(size=(4, 1))
    assert np.allclose(gmm.expected(x, one), 5 + 0.8 * (x - 1))
    swapped = gmm.JointMixture(one.weights, one.means, cov, swap=True)
    assert np.allclose(gmm.expected(x, swapped), 1 + 0.8 * (x - 5))
    difference = gmm.JointMixture(one.weights, one.means, cov, diff=True)
    assert np.allclose(gmm.expected(x, difference), 4 - 0.2 * (x - 1))
    with pytest.raises(ValueError):
        gmm.expected(x, gmm.JointMixture(one.weights, one.means, -cov))


def test_post_filter_keeps_energy():
    rng = np.random.default_rng(7)
    mc = rng.normal(size=(5, 20)) * 0.8 ** np.arange(20)
    assert np.allclose(postfilter.from_filter(postfilter.to_filter(mc, 0.42), 0.42), mc)
    out = postfilter.sharpened(mc, 0.42)
    line = postfilter.warp_matrix(19, 511, 0.42)
    assert np.allclose(postfilter.energy(mc @ line.T, 1024), postfilter.energy(out @ line.T, 1024), rtol=1e-3)
    assert np.allclose(out[:, 2:], mc[:, 2:] * 1.4)
    # The warped series has the value of the other at the warped frequency.
    z = np.exp(-1j * 0.7)
    warped = (z - 0.42) / (1 - 0.42 * z)
    assert np.allclose((mc @ line.T) @ z ** np.arange(512), mc @ warped ** np.arange(20))


def test_question_patterns():
    import re

    java = lambda p: p.replace(r"\z", r"\Z")
    assert re.search(java(questions.pattern("*-a+*")), "x-a+b") and not re.search(java(questions.pattern("*-a")), "x-a+b")
    assert re.search(java(questions.pattern("x^*")), "x^a") and not re.search(java(questions.pattern("x^*")), "yx^a")
    assert re.search(questions.pattern(r"/A:([-\d]+)_", True), "/A:-12_").group(1) == "-12"
    assert re.search(questions.pattern(r"/E:(\NOTE)]", True), "/E:Bb4]").group(1) == "Bb4"
    binary, numeric = questions.parse('# c\n\nQS "LL-a" {a^*}\nQS LL-b {b^}\nCQS "p" {/D:([pm]\\d+)!}\n')
    assert binary[1].patterns == (r"^b\^",) and not numeric[0].signed
    for bad in ("XS a {b}", 'CQS "a" {b,c}'):
        with pytest.raises(ValueError):
            questions.parse(bad)


def test_label_files(spark, tmp_path):
    (tmp_path / "a.lab").write_text("# note\n0 3125000   silB\n\n 3125000 3525000 m\n")
    (tmp_path / "b.lab").write_text("0.0 0.3125 silB\n0.3125 0.35 m\n")
    (tmp_path / "c.lab").write_text("x^a-b\ny\n")
    got = {(r.utt, r.idx): (r.start_time, r.end_time, r.context) for r in label_files.load(spark, f"{tmp_path}/*.lab").collect()}
    assert got["a", 1] == (3125000, 3525000, "m") and got["b", 0] == (0, 3125000, "silB") and got["c", 0] == (-1, -1, "x^a-b")
    (tmp_path / "d.lab").write_text("0 1\n")
    with pytest.raises(Exception, match="not a label"):
        label_files.load(spark, f"{tmp_path}/d.lab").collect()


def test_corpora(spark, tmp_path):
    for s in ("awb", "slt"):
        (tmp_path / f"cmu_us_{s}_arctic/wav").mkdir(parents=True)
        for k in range(3):
            (tmp_path / f"cmu_us_{s}_arctic/wav/a{k}.wav").write_bytes(b"x")
    got = corpora.speaker_folders(spark, str(tmp_path), ["slt", "awb"], max_files=4).orderBy("path").collect()
    assert [(r.speaker, r.name, r.speaker_label) for r in got] == [("awb", "a0", 1), ("awb", "a1", 1), ("slt", "a0", 0), ("slt", "a1", 0)]
    with pytest.raises(ValueError):
        corpora.speaker_folders(spark, str(tmp_path), ["who"], known=["slt"])
    (tmp_path / "metadata.csv").write_text("L1|a b|A B\n")
    assert corpora.metadata_table(spark, str(tmp_path), normalized=True).first().text == "A B"
    (tmp_path / "basic").mkdir()
    (tmp_path / "basic/transcript_utf8.txt").write_text("N1:hello: there\nno colon\nN2:x\n")
    t = corpora.subset_transcripts(spark, str(tmp_path), ["basic"], {"basic": {"N2": "N3"}})
    assert {(r.name, r.text) for r in t.collect()} == {("N1", "hello: there"), ("N3", "x")}
    (tmp_path / "info.txt").write_text("ID AGE GENDER ACCENTS REGION\n225 23 F English Southern England\n226 22 M English\n")
    info = corpora.speaker_table(spark, f"{tmp_path}/info.txt", ["ID", "AGE", "GENDER", "ACCENTS", "REGION"], True).orderBy("ID").collect()
    assert (info[0].REGION, info[1].REGION, len(info)) == ("Southern England", "", 2)
    np.savez(tmp_path / "m.npz", data=np.arange(6.0).reshape(3, 2))
    assert [list(r.features) for r in corpora.feature_archives(spark, str(tmp_path)).orderBy("frame").collect()] == [[0, 1], [2, 3], [4, 5]]


def test_resumed_stream(spark, tmp_path):
    from phonoframe.streaming.stats import resumed

    for k in range(3):
        spark.createDataFrame([(0, float(k)), (0, 2.0 * k), (1, 5.0)], "dim long, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("dim long, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream.writeStream.foreachBatch(resumed(f"{tmp_path}/stats")).option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    q.awaitTermination(120)
    r = {x.dim: x for x in spark.read.parquet(f"{tmp_path}/stats/version=2").collect()}
    all_ = np.array([0, 0, 1, 2, 2, 4.0])
    assert (r[0].n, round(r[0]["mean"], 9), round(r[0]["var"], 9)) == (6, round(all_.mean(), 9), round(all_.var(), 9)) and r[1]["var"] == 0
    assert math.isclose(r[1]["mean"], 5.0)
    # A new checkpoint goes on from there, and a batch that is repeated counts once.
    q = stream.writeStream.foreachBatch(resumed(f"{tmp_path}/stats")).option("checkpointLocation", f"{tmp_path}/log2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    r = {x.dim: x for x in spark.read.parquet(f"{tmp_path}/stats/version=5").collect()}
    assert (r[0].n, round(r[0]["mean"], 9)) == (12, round(all_.mean(), 9))
    merge = resumed(f"{tmp_path}/again")
    batch = spark.createDataFrame([(0, 1.0), (0, 3.0)], "dim long, value double")
    for number in (0, 1, 1):
        merge(batch, number)
    assert spark.read.parquet(f"{tmp_path}/again/version=1").first().n == 4
    assert not (tmp_path / "again/version=2").exists()


def test_running_statistics_and_windows_of_a_stream(spark, tmp_path):
    from phonoframe.streaming import stats as streams

    rows = [(f"2024-01-01 00:00:{s:02d}", 0, float(s)) for s in range(0, 50, 10)]
    spark.createDataFrame(rows, "t string, dim long, value double").selectExpr("cast(t as timestamp) as ts", "dim", "value").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, dim long, value double").parquet(f"{tmp_path}/in")
    for name, df, mode in (("running", streams.running(stream), "complete"), ("in_time", streams.windows_in_time(stream, "20 seconds", "10 seconds"), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
    r = spark.table("running").first()
    assert (r.n, r["mean"]) == (5, 20.0)
    assert all(x.n <= 2 for x in spark.table("in_time").collect())


def test_iterative_alignment(spark):
    """y is x, slower and shifted: each round's conversion brings x nearer, so paths end nearer to the true one."""
    t = np.arange(60)
    x = np.stack([np.sin(t / 6), np.cos(t / 9)], 1) + 2
    slow = np.minimum(np.arange(90) * 2 // 3, 59)
    y = x[slow] * 0.7 + 1.5
    table = lambda v: spark.createDataFrame([(u, i, row.tolist()) for u in range(3) for i, row in enumerate(v)], "utt long, frame long, features array<double>")
    error = {}
    for rounds in (1, 3):
        path = alignment.iterative(table(x), table(y), rounds, components=2, radius=8).toPandas()
        error[rounds] = np.abs(path.x_frame - slow[path.y_frame]).mean()
        assert set(path.utt) == {0, 1, 2}
    assert error[3] < error[1] < 5
    with pytest.raises(ValueError):
        alignment.iterative(table(x), table(y), 0)


def test_warping_in_a_band_equals_the_full_matrix():
    rng = np.random.default_rng(8)
    for n, m in ((1, 1), (5, 9), (30, 22)):
        a, b = rng.normal(size=(n, 2)), rng.normal(size=(m, 2))
        cost = np.full((n + 1, m + 1), np.inf)
        cost[0, 0] = 0
        for i in range(n):
            for j in range(m):
                cost[i + 1, j + 1] = np.linalg.norm(a[i] - b[j]) + min(cost[i, j], cost[i, j + 1], cost[i + 1, j])
        d, path = alignment.warp(a, b)
        assert np.isclose(d, cost[n, m]) and np.isclose(sum(np.linalg.norm(a[i] - b[j]) for i, j in path), d)
        assert path[0] == (0, 0) and path[-1] == (n - 1, m - 1)
        band = [(max(0, i * m // n - 3), min(m, i * m // n + 4)) for i in range(n)]
        band[-1] = band[-1][0], m
        near, inside = alignment.warp(a, b, cells=band)
        assert near >= d - 1e-9 and all(band[i][0] <= j < band[i][1] for i, j in inside)


@pytest.mark.parametrize("kind,degree", [("quadratic", 2), ("cubic", 3)])
def test_spline_interpolation(spark, kind, degree):
    """Splines give back polynomials of their degree, and pass through all values."""
    t = np.arange(30.0)
    x = 5 + (t - 12) ** degree / 50 + 40
    gaps = x.copy()
    gaps[[3, 4, 5, 11, 12, 20, 27]] = 0
    got = values(sequence.interpolate(frames(spark, gaps), "value", "y", kind), "y")
    assert np.allclose(got, x)
    rng = np.random.default_rng(degree)
    at = np.sort(rng.choice(50, 12, replace=False)).astype(float)
    y = rng.normal(size=12)
    assert np.allclose(sequence.spline(at, y, at, degree), y)
    with pytest.raises(ValueError):
        sequence.spline(at[:2], y[:2], at[:1], degree)
    ends = values(sequence.interpolate(frames(spark, [0, 0, 100, 0, 90, 80, 0, 70, 0]), "value", "y", kind), "y")
    assert ends[0] == 100 and ends[-1] == 70 and min(ends) > 0


def test_long_recursion_is_linear(spark):
    x = np.random.default_rng(0).normal(size=80_000)
    y = sequence.preemphasis(frames(spark, x).withColumn("other", F.lit("kept")), "value", "y")
    back = sequence.inv_preemphasis(y, "y", "z")
    assert "other" in back.columns and np.allclose(values(back, "z"), x)


def test_windows_must_fit(spark):
    f = frames(spark, range(10))
    assert sequence.sliding(f, "value", 4, 3, exact=True).where("offset = 0").count() == 3
    with pytest.raises(Exception, match="don't fit"):
        sequence.sliding(f, "value", 4, 4, exact=True).collect()
    with pytest.raises(ValueError):
        sequence.sliding(f, "value", 2, 3)
    a = spark.createDataFrame([(0, i, i, 1.0) for i in range(6)], "mat long, row long, col long, value double")
    with pytest.raises(Exception, match="don't fit"):
        banded.sliding(a, spark.createDataFrame([(0, 6)], "mat long, n long"), 3, 2).collect()


def test_datasets(spark):
    from phonoframe.operators import datasets

    names = [f"n{i:03d}" for i in range(57)]
    table = datasets.numbered(spark.createDataFrame([(n,) for n in names[::-1]], "utt string").repartition(5), "utt", tasks=6)
    assert datasets.length(table) == 57
    for index in (0, 5, -1, -57, 56):
        assert [r.utt for r in datasets.at(table, index).collect()] == [names[index]]
    for cut in (slice(None), slice(3, 40, 7), slice(-5, None), slice(None, -50), slice(None, None, -9), slice(50, 2, -11), slice(100, 2, -1), slice(4, 2)):
        assert sorted(r.utt for r in datasets.at(table, cut).collect()) == sorted(names[cut])
    places = datasets.offsets(spark.createDataFrame([(n, i % 4) for i, n in enumerate(names)], "utt string, n long"), "utt")
    ends = np.cumsum([i % 4 for i in range(57)])
    assert {r.utt: (r.first, r.end) for r in places.collect()} == {n: (e - i % 4, e) for i, (n, e) in enumerate(zip(names, ends, strict=True))}
    x = spark.createDataFrame([("u", i, [float(i < 3)]) for i in range(5)] + [("v", 0, [0.0])], "utt string, frame long, features array<double>")
    got = {(r.utt, r.frame): r.features for r in datasets.each_matrix(x, lambda m: np.concatenate([m, m + 1], 1) if len(m) else np.zeros((0, 2))).collect()}
    assert got == {("u", i): [1.0, 2.0] if i < 3 else [0.0, 0.0] for i in range(5)} | {("v", 0): [0.0, 0.0]}
    summed = datasets.each_utterance(x, lambda pdf: pdf.assign(features=[[float(k)] for k in range(len(pdf))][::-1]), "utt string, frame long, features array<double>")
    assert {(r.utt, r.frame): r.features for r in summed.collect()} == {("u", i): [4.0 - i] for i in range(5)} | {("v", 0): [0.0]}
    with pytest.raises(Exception, match="has shape"):
        datasets.each_matrix(x, lambda m: np.ones((len(m) + 9, 1))).collect()
    with pytest.raises(Exception, match="longer than"):
        datasets.padded(frames(spark, [1, 2, 3]), length=2).collect()


def test_labels_that_must_be_contiguous(spark):
    from phonoframe.operators import labels as L

    good = spark.createDataFrame([("u", 0, 0, 100_000, "a"), ("u", 1, 100_000, 200_000, "b")], "utt string, idx long, start_time long, end_time long, context string")
    assert L.strict(good).count() == 2 and len(L.strict(good).collect()) == 2
    for second in ((150_000, 200_000), (100_000, 100_000)):
        with pytest.raises(Exception, match="contiguous"):
            L.strict(good.withColumn("start_time", F.when(F.col("idx") == 1, second[0]).otherwise(F.col("start_time"))).withColumn("end_time", F.when(F.col("idx") == 1, second[1]).otherwise(F.col("end_time")))).collect()
    question = questions.parse('CQS "x" {/A:([A-Z][b]?[0-9]+)_}')[1]
    with pytest.raises(Exception, match="finds no number"):
        linguistic.answered(spark.createDataFrame([("Z/A:H9_",)], "context string"), [], question).collect()


def test_mixtures_of_a_fitted_model(spark):
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 1))
    joint = np.concatenate([x, 2 * x + 1 + 0.1 * rng.normal(size=(400, 1))], 1)
    df = spark.createDataFrame([(Vectors.dense(r),) for r in joint], ["features"])
    m = gmm.JointMixture.of(GaussianMixture(k=2, seed=1).fit(df))
    src = np.array([[-1.0], [0.0], [2.0]])
    assert np.allclose(gmm.expected(src, m), 2 * src + 1, atol=0.05)
    assert np.allclose(gmm.expected(2 * src + 1, gmm.JointMixture(m.weights, m.means, m.covariances, swap=True)), src, atol=0.05)
    assert np.allclose(gmm.expected(src, gmm.JointMixture(m.weights, m.means, m.covariances, diff=True)), src + 1, atol=0.05)
    with pytest.raises(ValueError):
        gmm.JointMixture(np.ones(1), np.zeros((1, 2)), -np.eye(2)[None]).parts()


def test_distances_and_patterns_of_a_caller(spark):
    from phonoframe.operators import labels as L

    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(9, 2)), rng.normal(size=(7, 2))
    table = lambda v: spark.createDataFrame([("u", i, row.tolist()) for i, row in enumerate(v)], "utt string, frame long, features array<double>")
    blocks = lambda x, y: np.abs(x - y).sum(-1)
    got = alignment.paths(table(a), table(b), dist=blocks, exact=True).toPandas()
    d, path = alignment.warp(a, b, blocks)
    assert list(zip(got.x_frame, got.y_frame, strict=True)) == path and np.isclose(got.distance[0], d / 16)
    x = spark.createDataFrame([("u", i, i * 50_000, (i + 1) * 50_000, c) for i, c in enumerate(["a-sil+b", "a-pau+b", "a-k+b", "x-pau+y"])], "utt string, idx long, start_time long, end_time long, context string")
    assert sorted(r.idx for r in L.silence_labels(x, ".*-pau[+].*").collect()) == [1, 3]
    assert sorted(r.frame for r in L.without_silence(spark.createDataFrame([("u", i) for i in range(4)], "utt string, frame long"), x, ".*-pau[+].*").collect()) == [0, 2]


@pytest.mark.parametrize("coef, n, spread", [(0.97, 30_000, False), (0.97, 30_000, True), (-0.6, 500, False), (0.001, 200, False), (0.0, 20, False), (1.0, 3000, True), (-1.0, 3000, False), (1.01, 2000, False), (0.9999, 30_000, True)])
def test_inverse_filter_is_a_scan(spark, coef, n, spread):
    """One long utterance and some short ones, against the recursion; no Python worker takes part."""
    rng = np.random.default_rng(int(n))
    rows = {u: rng.normal(size=m) for u, m in (("a", n), ("b", 1), ("c", 777))}
    df = spark.createDataFrame([(u, "k", 3 * i, float(v)) for u, x in rows.items() for i, v in enumerate(x)], "utt string, kind string, frame long, x double").repartition(5)
    out = sequence.inv_preemphasis(df, "x", "y", coef, utt=("utt", "kind"), spread=spread)
    assert out.columns == ["utt", "kind", "frame", "x", "y"] and "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.toPandas().sort_values(["utt", "frame"])
    for u, x in rows.items():
        want, y = [], 0.0
        for v in x:
            y = v + coef * y
            want.append(y)
        assert np.allclose(got.y[got.utt == u], want, rtol=1e-9, atol=1e-9)


def test_inverse_filter_of_nulls_and_in_place(spark):
    df = spark.createDataFrame([(None, i, v) for i, v in enumerate([1.0, 2.0, None, 4.0])] + [("u", i, 1.0) for i in range(3)], "utt string, frame long, x double")
    got = {(r.utt, r.frame): r.x for r in sequence.inv_preemphasis(df, "x", "x", 0.5).collect()}
    assert [got["u", i] for i in range(3)] == [1.0, 1.5, 1.75] and (got[None, 0], got[None, 1]) == (1.0, 2.5) and all(np.isnan(got[None, i]) for i in (2, 3))
    tiny = sequence.inv_preemphasis(df, "x", "y", 1e-300)
    assert np.isnan(tiny.where("utt is null and frame = 3").first().y) and sequence.inv_preemphasis(df.where("frame < 0"), "x", "y").count() == 0


def test_all_forms_of_durations(spark):
    phones = [("p", i, 0, (i + 2) * 50_000, "a-b+c") for i in range(2)]
    phones = [("p", 0, 0, 125_000, "a-b+c"), ("p", 1, 125_000, 300_000, "a-b+c")]
    states = [("s", i, 50_000 * t, 50_000 * e, f"a-b+c[{i % 3 + 2}]") for i, (t, e) in enumerate([(0, 2), (2, 2), (2, 5), (5, 6), (6, 8), (8, 11)])]
    df = spark.createDataFrame(phones + states, "utt string, idx long, start_time long, end_time long, context string")
    got = lambda *how: sorted((r.utt, r.row, r.features) for r in linguistic.duration_features(df, *how).collect())
    assert got() == [("p", 0, [2]), ("p", 1, [3]), ("s", 0, [2, 0, 3]), ("s", 1, [1, 2, 3])]
    assert got("numerical", "phoneme") == [("p", 0, [2]), ("p", 1, [3]), ("s", 0, [5]), ("s", 1, [6])]
    frames = got("numerical", "state", "frame")
    assert [x for u, _, x in frames if u == "s"] == [[2, 0, 3]] * 5 + [[1, 2, 3]] * 6 and [x for u, _, x in frames if u == "p"] == [[2]] * 2 + [[3]] * 3
    assert [r for u, r, _ in frames if u == "s"] == list(range(11))
    marks = lambda unit, utt: [x[0] for u, _, x in got("binary", unit, "frame") if u == utt]
    assert marks("state", "s") == [0, 1, 0, 0, 1, 1, 0, 1, 0, 0, 1] and marks("phoneme", "s") == [0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 1]
    assert marks("phoneme", "p") == marks("state", "p") == [0, 1, 0, 0, 1]
    for how in (("x",), ("numerical", "x"), ("numerical", "state", "x"), ("binary", "state", "phoneme")):
        with pytest.raises(ValueError):
            linguistic.duration_features(df, *how)


def test_pairs_padded_to_one_length(spark):
    """A path with known answers: y is x with frames repeated, and one pair is silence."""
    table = lambda rows: spark.createDataFrame([(u, i, [float(v), 1.0 if v else 0.0]) for u, x in rows.items() for i, v in enumerate(x)], "utt string, frame long, features array<double>")
    x, y = table({"a": [1, 5, 9, 0], "b": [0, 0], "c": [3]}), table({"a": [1, 5, 5, 9, 9], "b": [4], "c": [3, 3], "d": [1]})
    got = {}
    for r in alignment.padded_pairs(x, y, exact=True).orderBy("frame").collect():
        got.setdefault(r.utt, []).append((r.frame, r.x[0], r.y[0]))
    assert got == {
        "a": [(0, 1, 1), (1, 5, 5), (2, 5, 5), (3, 9, 9), (4, 9, 9)],
        "b": [(i, 0, 0) for i in range(5)],
        "c": [(0, 3, 3), (1, 3, 3), *((i, 0, 0) for i in range(2, 5))],
    }


def test_first_sentences_of_each_file(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.tsv").write_text("sentence_id\tsentence\tyomi\tmonophone\r\n" + "".join(f"{name}{i}\tx{i}\ty\tz\r\n" + "\r\n" * (i == 2) for i in range(50)))
    got = corpora.balanced_sentences(spark, str(tmp_path / "*.tsv"), max_files=5)
    assert sorted(r.sentence_id for r in got.collect()) == [f"{n}{i}" for n in "ab" for i in range(5)] and got.where("text = 'x4'").count() == 2
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        got = corpora.balanced_sentences(spark, str(tmp_path / "a.tsv"), max_files=30)
        assert sorted(r.sentence_id for r in got.collect()) == sorted(f"a{i}" for i in range(30))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    none = np.array([[0.0, 1.0, 1.0]])
    with pytest.raises(ValueError, match="isn't positive"):
        paramgen.generate(np.zeros((4, 3)), none)


def test_batches_of_one_length(spark):
    from phonoframe.operators import datasets

    x = spark.createDataFrame([("a", i, [float(i), 2.0]) for i in (2, 0, 1)] + [("b", 0, [5.0, 6.0])], "utt string, frame long, features array<double>")
    got = {r.utt: (r.n, r.features) for r in datasets.batched(x).collect()}
    assert got == {"a": (3, [[0.0, 2.0], [1.0, 2.0], [2.0, 2.0]]), "b": (1, [[5.0, 6.0], [0.0, 0.0], [0.0, 0.0]])}
    assert datasets.batched(x, 4).schema["features"].dataType.simpleString() == "array<array<float>>" and all(len(r.features) == 4 for r in datasets.batched(x, 4).collect())
    with pytest.raises(Exception, match="longer than"):
        datasets.batched(x, 2).collect()
    assert datasets.batched(x.where("frame < 0")).count() == 0
