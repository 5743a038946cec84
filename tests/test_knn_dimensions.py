"""The neighbour join through its partition, in few and in many dimensions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from outvote.functions import kernels
from outvote.operators import knn_join
from outvote.operators.knn_join import Limits, nearest_others

K = 5


def brute(x, k):
    d = np.sqrt(kernels.squared_distances(x, x))
    np.fill_diagonal(d, np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d), axis=1)[:, :k]
    return order, np.take_along_axis(d, order, axis=1)


def near_a_plane(n, d, rank, noise, seed):
    """Points that vary in few directions, none of them along an axis."""
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n, rank)) @ rng.standard_normal((rank, d)) + noise * rng.standard_normal((n, d)) + 100


def lists(features, leaf_points):
    limits = Limits(broadcast_points=0, leaf_points=leaf_points, visitors_per_task=500)
    rows = sorted(nearest_others(features, K, limits).select("point", "nbrs", "dists").collect())
    return np.array([r["nbrs"] for r in rows]), np.array([r["dists"] for r in rows])


SHAPES = {
    "2 features": near_a_plane(1_500, 2, 2, 0.0, 0),
    "8 features": near_a_plane(1_200, 8, 3, 0.05, 1),
    "20 features": near_a_plane(1_200, 20, 3, 0.05, 2),
    "64 features": near_a_plane(1_200, 64, 3, 0.02, 3),
    "64 free features": np.random.default_rng(4).standard_normal((600, 64)),
    "20 features in clumps": np.repeat(near_a_plane(60, 20, 10, 1.0, 5), 10, axis=0) + np.random.default_rng(6).standard_normal((600, 20)) * 1e-3,
}


@pytest.mark.parametrize("name", SHAPES)
def test_lists_equal_all_pairs(frame, name):
    x = SHAPES[name]
    nbrs, dists = lists(frame(x), 100)
    order, want = brute(x, K)
    assert (nbrs == order).all()
    assert np.allclose(dists, want, rtol=1e-12)


@pytest.mark.parametrize("name, most", [("2 features", 2.0), ("8 features", 5.0), ("20 features", 5.0), ("64 features", 5.0)])
def test_points_near_a_plane_visit_few_leaves(frame, monkeypatch, name, most):
    """Of some sixteen leaves, whatever the number of features."""
    seen = []
    before = knn_join._search
    monkeypatch.setattr(knn_join, "_search", lambda visits, *rest: seen.append(visits.count()) or before(visits, *rest))
    lists(frame(SHAPES[name]), 100)
    assert sum(seen) / len(SHAPES[name]) <= most


def test_near_leaves_narrow_the_radius(frame, monkeypatch):
    """Second visits are made with the radius that the first ones left."""
    visits = []
    before = knn_join._search
    monkeypatch.setattr(knn_join, "_search", lambda v, *rest: visits.append(v.select("point", "leaf", "radius").toPandas()) or before(v, *rest))
    x = SHAPES["64 free features"]
    lists(frame(x), 40)
    first, second = visits
    assert (first.groupby("point").size() <= knn_join.NEAR).all()
    both = second.drop_duplicates("point").merge(first.drop_duplicates("point"), on="point")
    assert (both["radius_x"] <= both["radius_y"]).all() and (both["radius_x"] < both["radius_y"]).mean() > 0.5
    assert not second.merge(first, on=["point", "leaf"]).size


def test_leaves_keep_their_size_as_the_table_grows(frame):
    for n in (400, 1_600):
        x = near_a_plane(n, 3, 3, 0.0, 7)
        points = knn_join.distinct_points(frame(x)).toDF("x0", "x1", "x2", "point", "copies")
        leaves = knn_join._cut_oversized(points, ["x0", "x1", "x2"], Limits(0, 100, 500), n)
        assert leaves.groupBy("leaf").count().agg(F.max("count")).first()[0] <= 400


@pytest.mark.parametrize("d", [8, 64])
def test_products_find_what_differences_find(d):
    rng = np.random.default_rng(8)
    for x in (rng.standard_normal((300, d)), rng.standard_normal((300, d)) * 1e-6 + 1e6, np.round(rng.standard_normal((300, d)))):
        for limit in (np.full(300, np.inf), rng.uniform(0, 2 * np.sqrt(d), 300)):
            got = kernels.smallest_by_product(x, x, K, limit**2)
            want = kernels.smallest(kernels.squared_distances(x, x), K, limit**2)
            for a, b in zip(got, want):
                assert np.array_equal(a, b)
