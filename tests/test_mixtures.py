"""Mixtures fitted by aggregates, against expectation maximisation over all frames in one place."""

import numpy as np
import pytest

from phonoframe.operators import gmm, mixtures


def plain(x, m):
    d = x.shape[1]
    gap = x[:, None] - m.means
    q = np.einsum("tmi,mij,tmj->tm", gap, np.linalg.inv(m.covariances), gap)
    p = m.weights * np.exp(-0.5 * q) / np.sqrt((2 * np.pi) ** d * np.linalg.det(m.covariances))
    r = p / p.sum(1, keepdims=True)
    n = r.sum(0)
    means = r.T @ x / n[:, None]
    cov = np.einsum("tm,ti,tj->mij", r, x, x) / n[:, None, None] - np.einsum("mi,mj->mij", means, means) + 1e-6 * np.eye(d)
    return gmm.JointMixture(n / len(x), means, cov), np.log(p.sum(1)).sum()


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(300, 3)) @ rng.normal(size=(3, 3)) + c for c in ([0, 0, 0], [4, 4, 4])])
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(-1, None)], "id long, features array<double>").repartition(5), x


def test_rounds(data):
    df, x = data
    mine = want = mixtures.start(df, 3)
    assert np.allclose(mine.means.mean(0), x.mean(0)) and np.allclose(mine.covariances[0], np.diag(x.var(0) + 1e-6))
    logs = []
    for _ in range(3):
        mine, log = mixtures.step(df, mine)
        want, plain_log = plain(x, want)
        logs.append(log)
        assert np.isclose(log, plain_log) and all(np.allclose(getattr(mine, k), getattr(want, k)) for k in ("weights", "means", "covariances"))
    assert logs == sorted(logs)
    fitted = mixtures.fit(df, 2, rounds=30)
    assert np.allclose(sorted(fitted.weights), [0.5, 0.5], atol=0.1)


def test_components_without_frames(data):
    df, _ = data
    far = gmm.JointMixture(np.array([0.5, 0.5]), np.array([[0.0] * 3, [1e6] * 3]), np.stack([np.eye(3) * 9, np.eye(3)]))
    got, _ = mixtures.step(df, far)
    assert got.weights[1] == 0 and np.allclose(got.means[1], 1e6) and np.allclose(got.covariances[1], np.eye(3))
    again, log = mixtures.step(df, got)
    assert np.isfinite(log) and np.isclose(again.weights[0], 1)
    with pytest.raises(ValueError, match="no frames"):
        mixtures.start(df.where("id < -5"), 2)
