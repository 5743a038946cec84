"""Arrays that a task of the neighbour join holds at a time."""

import tracemalloc

import numpy as np

from outvote.functions import kernels
from outvote.operators import knn_join

RNG = np.random.default_rng(0)


def peak(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_copies_are_not_spelled_out_beyond_the_list():
    points, k = np.arange(2_000), 50
    x = RNG.standard_normal((2_000, 2))
    row, col, dist = kernels.nearest_points(x, x, k + 1)
    copies = np.full(2_000, 1_000)
    found = []
    assert peak(lambda: found.append(knn_join._lists(points, points, copies, row, col, dist, k))) < 40e6
    lists = found[0]
    assert lists["nbrs"].to_pylist() == [[i] * k for i in range(2_000)]


def test_a_local_search_holds_little_more_than_its_result():
    x, k = RNG.standard_normal((12_000, 4)), 50
    found = []
    assert peak(lambda: found.append(kernels.nearest_points(x, x, k))) < 90e6
    row, col, dist = found[0]
    part = RNG.integers(0, len(x), 100)
    want = kernels.smallest(kernels.squared_distances(x[part], x), k)
    at = (row[None, :] == part[:, None]).nonzero()[1]
    assert np.array_equal(col[at], want[1]) and np.array_equal(dist[at], want[2])
