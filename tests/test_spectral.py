"""The two-step transform and what rests on it, against NumPy's transforms of whole utterances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonoframe.operators import spectral


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    whole = {u: rng.normal(size=(t, 3)) for u, t in (("a", 1), ("b", 20), ("c", 31))} | {None: np.zeros((4, 3))}
    df = spark.createDataFrame([(u, i, r.tolist()) for u, x in whole.items() for i, r in enumerate(x)], "utt string, frame long, features array<double>").repartition(4)
    return df, whole


def by_utterance(df, at, *columns):
    pdf = df.toPandas().sort_values(at)
    return {None if u != u else u: [np.stack(g[c]) for c in (at, *columns)] for u, g in pdf.groupby("utt", dropna=False)}


@pytest.mark.parametrize("n", [64, 60, 37, 16, 2])
@pytest.mark.parametrize("norm", [None, "ortho", "forward"])
def test_spectra(data, n, norm):
    df, whole = data
    got = by_utterance(spectral.modspec(df, n, norm), "bin", "power", "re", "im")
    for u, x in whole.items():
        if not len(x[:n]):
            continue
        bins, power, re, im = got[u]
        z = np.fft.rfft(x, n, axis=0, norm=norm)
        assert bins.tolist() == list(range(n // 2 + 1)) and np.allclose(power, np.abs(z) ** 2)
        assert np.allclose((re + 1j * im) * np.abs(z), z, atol=1e-9) and (u is not None or (re == 1).all())


@pytest.mark.parametrize("norm", [None, "ortho", "forward"])
def test_back_and_forth(data, norm):
    df, whole = data
    for n in (64, 36):
        got = by_utterance(spectral.inv_modspec(spectral.modspec(df, n, norm), norm), "frame", "features")
        for u, x in whole.items():
            assert np.allclose(got[u][1], np.concatenate([x, np.zeros((n - len(x), 3))]), atol=1e-9)
    assert spectral.inv_modspec(spectral.modspec(df.where("frame < 0"), 8)).count() == 0


@pytest.mark.parametrize("log_domain", [True, False])
@pytest.mark.parametrize("norm", [None, "ortho"])
def test_smoothing(data, log_domain, norm):
    df, whole = data
    n, rate, cutoff = 48, 100, 20
    got = by_utterance(spectral.smoothed(df, rate, n, cutoff, norm, log_domain), "frame", "features")
    for u, x in whole.items():
        z = np.fft.rfft(x, n, axis=0, norm=norm)
        above = z[int(n * cutoff / rate) + 1 :]
        above[:] = np.where(np.abs(above) > 0, above / np.maximum(np.abs(above), 1e-300), 1) if log_domain else 0
        assert got[u][0].tolist() == list(range(len(x))) and np.allclose(got[u][1], np.fft.irfft(z, n, axis=0, norm=norm)[: len(x)], atol=1e-9)
    with pytest.raises(Exception, match="longer than"):
        spectral.smoothed(df, rate, 30, cutoff).collect()


def test_gradient(data, spark):
    """By differences of the powers' weighted sum."""
    rng = np.random.default_rng(1)
    n, x, g = 16, rng.normal(size=(10, 2)), rng.normal(size=(9, 2))
    rows = [("u", i, (x[i] if i < 10 else [0, 0]).tolist() if i < 10 else [0.0, 0.0], g[i].tolist() if i < 9 else [0.0, 0.0]) for i in range(10)]
    got = by_utterance(spectral.modspec_gradient(spark.createDataFrame(rows, "utt string, frame long, features array<double>, gradient array<double>"), n), "frame", "features")["u"][1]
    value = lambda y: (np.abs(np.fft.rfft(y, n, axis=0)) ** 2 * g).sum()
    for i in range(10):
        for d in range(2):
            step = np.zeros((10, 2))
            step[i, d] = 1e-6
            assert abs((value(x + step) - value(x - step)) / 2e-6 - got[i, d]) < 1e-5


def test_rows(data):
    df, whole = data
    x = df.where("utt is not null").select("utt", F.posexplode("features").alias("dim", "value"), "frame")
    for n in (24, 13):
        got = {(r.utt, r.dim, r.bin): (r.re, r.im, r.power) for r in spectral.modspec_rows(x, n, ortho=True).collect()}
        z = {u: np.fft.rfft(v, n, axis=0, norm="ortho") for u, v in whole.items() if u}
        assert len(got) == 3 * 3 * (n // 2 + 1)
        assert all(np.isclose(re + 1j * im, z[u][b, d]) and np.isclose(p, abs(z[u][b, d]) ** 2) for (u, d, b), (re, im, p) in got.items())


def test_no_task_holds_an_utterance(spark):
    """A lane of a transform of 2^16 places holds 256 of them."""
    df = spark.range(60_000).select(F.lit("u").alias("utt"), F.col("id").alias("frame"), F.array(F.sin(F.col("id") / 7)).alias("features"))
    power = by_utterance(spectral.modspec(df, 1 << 16), "bin", "power")["u"][1][:, 0]
    assert np.allclose(power, np.abs(np.fft.rfft(np.sin(np.arange(60_000) / 7), 1 << 16)) ** 2, rtol=1e-6, atol=1e-5) and spectral.factors(1 << 16) == (256, 256)


@pytest.mark.parametrize("n", [1, 2, 9, 36, 37, 45, 64])
def test_rows_come_once_from_mirrored_sums(data, n):
    df, whole = data
    x = df.where("utt is not null").select("utt", F.posexplode("features").alias("dim", "value"), "frame")
    rows = spectral.modspec_rows(x, n).collect()
    assert len(rows) == len({(r.utt, r.dim, r.bin) for r in rows}) == 3 * 3 * (n // 2 + 1)
    z = {u: np.fft.rfft(v, n, axis=0) for u, v in whole.items() if u}
    assert all(np.isclose(r.re + 1j * r.im, z[r.utt][r.bin, r.dim]) and np.isclose(r.power, abs(z[r.utt][r.bin, r.dim]) ** 2) for r in rows)


def test_tasks_follow_from_the_trajectories(spark, tmp_path, monkeypatch):
    """What a task adds up doesn't grow with the number of utterances."""
    from phonoframe.plans.registry import QUERIES

    spark.range(3000).selectExpr("id as event_id", "timestamp_ntz '2024-01-01 00:00:00' as ts", "id % 50 as user_id", "'view' as event_type", "double(id % 7) as value").write.parquet(f"{tmp_path}/events.parquet")
    assert (spectral.tasks_for(100, 64, 8), spectral.tasks_for(10 * spectral.SUMMED, 64, 8)) == (8, 640)
    want = {(r.utt, r.bin): r.power for r in QUERIES["modulation_spectrum"](spark, f"{tmp_path}").collect()}
    monkeypatch.setattr(spectral, "SUMMED", 5 * 64)
    got = QUERIES["modulation_spectrum"](spark, f"{tmp_path}")
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(utt") == 1 and got.rdd.getNumPartitions() == 10
    assert {(r.utt, r.bin): r.power for r in got.collect()} == pytest.approx(want) and len(want) == 50 * 33
    spark.range(0).selectExpr("id as event_id", "timestamp_ntz '2024-01-01 00:00:00' as ts", "id as user_id", "'view' as event_type", "double(id) as value").write.parquet(f"{tmp_path}/none/events.parquet")
    assert QUERIES["modulation_spectrum"](spark, f"{tmp_path}/none").count() == 0
