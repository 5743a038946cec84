import numpy as np
import pytest
import shapes
from pyspark.sql import functions as F

from outvote.functions.ranks import cumulative_counts
from outvote.functions.lookup import lookup_join
from outvote.operators import neighbourhood as N
from outvote.operators import statistical as S
from outvote.operators.knn_join import Limits, nearest_others

INPUTS = shapes.inputs()
PLAIN = {
    "zscore": (S.zscore, shapes.zscore),
    "hbos": (S.hbos, shapes.hbos),
    "ecod": (S.ecod, shapes.ecod),
    "knn": (N.knn, shapes.knn),
    "lof": (N.lof, shapes.lof),
}


@pytest.mark.parametrize("shape", INPUTS)
def test_against_numpy(frame, mask, scores, shape):
    x = INPUTS[shape]
    features = frame(x)
    for name, (detector, reference) in PLAIN.items():
        flagged = detector(features, 0.1).cache()
        expected = reference(x)
        assert np.allclose(scores(flagged), expected, rtol=1e-7, atol=2e-9), name
        assert (mask(flagged) == shapes.top(expected, 0.1)).all(), name
    raw = shapes.copod(x)
    flagged = S.copod(features, 0.1).cache()
    assert (mask(flagged) == shapes.top(raw, 0.1)).all()
    mad = np.median(np.abs(raw - np.median(raw))) or 1.0
    assert np.allclose(scores(flagged), (raw - np.median(raw)) / mad, atol=1e-7)
    assert (mask(N.dbscan(features, 0.1)) == shapes.dbscan(x, 0.1)).all()
    assert (mask(S.hbos(features, 0.1, own_bin=True)) == shapes.top(shapes.hbos(x, own=True), 0.1)).all()


@pytest.mark.parametrize("c", [0.0, 0.01, 0.5])
def test_contamination_limits(frame, mask, c):
    x = INPUTS["planted"]
    features = frame(x)
    for name, (detector, reference) in PLAIN.items():
        assert (mask(detector(features, c)) == shapes.top(reference(x), c)).all(), name


def test_zscore_guards(frame, scores):
    x = np.column_stack([np.full(40, 3.0), 1e9 + np.arange(40) * 1e-7, np.arange(40.0)])
    assert np.allclose(scores(S.zscore(frame(x), 0.1)), np.abs(x[:, 2] - 19.5) / x[:, 2].std(), atol=1e-8)


def test_dbscan_needs_twenty_rows(frame):
    with pytest.raises(ValueError, match="at least 20 rows"):
        N.dbscan(frame(np.arange(19.0)[:, None]), 0.1)


def lists(table, k):
    return {r["point"]: (list(r["nbrs"]), list(r["dists"])) for r in table.collect()}


@pytest.mark.parametrize("shape", ["normal", "copies", "grid", "heavy"])
def test_partitioned_join_equals_brute_force(frame, shape):
    x = INPUTS[shape]
    k = 7
    d, order = shapes.neighbour_order(x)
    rep = shapes.smallest_copy(x)
    features = frame(x)
    small = lists(nearest_others(features, k), k)
    split = lists(nearest_others(features, k, Limits(broadcast_points=0, leaf_points=16, visitors_per_task=10)), k)
    assert set(small) == set(rep.tolist())
    assert split == small
    for i, (nbrs, dists) in small.items():
        assert nbrs == [rep[j] for j in order[i, :k]]
        assert np.array_equal(dists, d[i, order[i, :k]])


def test_partitioned_join_with_a_dense_ball(frame):
    """A third of all rows within a ball far smaller than the rest of the space."""
    rng = np.random.default_rng(9)
    x = np.vstack([rng.standard_normal((400, 2)) * 100, rng.standard_normal((200, 2)) * 1e-4])
    features = frame(x)
    small = lists(nearest_others(features, 5), 5)
    split = lists(nearest_others(features, 5, Limits(broadcast_points=0, leaf_points=20, visitors_per_task=15)), 5)
    assert split == small


def test_whole_table_as_neighbours(frame):
    x = np.array([[0.0], [1.0], [1.0], [5.0]])
    got = lists(nearest_others(frame(x), 10, Limits()), 10)
    assert got == {0: ([1, 1, 3], [1.0, 1.0, 5.0]), 1: ([1, 0, 3], [0.0, 1.0, 4.0]), 3: ([1, 1, 0], [4.0, 4.0, 5.0])}


def test_range_partitioned_ranks(frame):
    for x in (INPUTS["copies"], INPUTS["heavy"]):
        features = frame(x)
        small = cumulative_counts(features)[0].select("f", "v", "cnt", "cum").collect()
        large, distinct = cumulative_counts(features, window_rows=0)
        assert sorted(small) == sorted(large.select("f", "v", "cnt", "cum").collect())
        assert distinct == {j: len(np.unique(x[:, j])) for j in range(x.shape[1])}


def test_salted_lookup_keeps_every_row(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500 + 100).alias("k"))
    table = rows.groupBy("k").agg(F.count("*").alias("uses"), F.max("id").alias("top"))
    plain = rows.join(table, "k").select("id", "k", "top")
    salted = lookup_join(rows, table, "k", 10**9, 6000, "uses", F.col("id"), broadcast_rows=0)
    assert sorted(salted.select("id", "k", "top").collect()) == sorted(plain.collect())


def test_shuffled_tail_lookup_equals_broadcast(frame, scores, monkeypatch):
    x = INPUTS["copies"]
    expected = scores(S.ecod_scores(frame(x)))
    monkeypatch.setattr(S, "BROADCAST_VALUES", 0)
    assert np.array_equal(scores(S.ecod_scores(frame(x))), expected)


def test_wide_tail_lookup_equals_narrow(frame, scores):
    x = INPUTS["copies"]
    assert np.array_equal(scores(S.ecod_scores(frame(x), wide_features=1)), scores(S.ecod_scores(frame(x))))
