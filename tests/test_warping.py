"""Exact warping in linear memory against the form that keeps every cell."""

import numpy as np
import pytest

from phonoframe.operators import alignment


@pytest.mark.parametrize("n, m", [(1, 1), (1, 200), (200, 1), (2, 150), (37, 64), (200, 90), (64, 300)])
def test_the_same_least_cost(n, m):
    rng = np.random.default_rng(n + m)
    x, y = rng.normal(size=(n, 2)).cumsum(0), rng.normal(size=(m, 2)).cumsum(0)
    skew = lambda a, b: np.abs(a - 0.5 * b).sum(-1)
    for dist in (alignment.euclidean, skew):
        want, _ = alignment.warp(x, y, dist)
        for cells in (1, 500, 1 << 20):
            got, path = alignment.linear_warp(x, y, dist, cells)
            i, j = np.array(path).T
            steps = set(zip(np.diff(i).tolist(), np.diff(j).tolist(), strict=True))
            assert np.isclose(got, want) and steps <= {(0, 1), (1, 0), (1, 1)}
            assert path[0] == (0, 0) and path[-1] == (n - 1, m - 1) and np.isclose(dist(x[i], y[j]).sum(), want)


def test_ties_and_nothing():
    x = np.zeros((90, 1))
    assert alignment.linear_warp(x, x[:40], cells=64)[0] == 0
    assert alignment.linear_warp(x[:0], x[:0]) == (0.0, []) and alignment.linear_warp(x, x[:0])[0] == float("inf")


def test_memory_stays_linear():
    import tracemalloc

    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(1500, 1)).cumsum(0), rng.normal(size=(1500, 1)).cumsum(0)
    tracemalloc.start()
    alignment.linear_warp(x, y, cells=1 << 12)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 << 20  # all cells take about 72 MB as a list, and distances are taken 2^18 at a time
