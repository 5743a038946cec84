"""What the neighbour join keeps: no lists where a distance will do."""

from pathlib import Path

import numpy as np
import pytest

from outvote.functions import kernels
from outvote.operators import knn_join, neighbourhood
from outvote.operators.clean import prepare
from outvote.operators.knn_join import Limits

LIMITS = Limits(broadcast_points=0, leaf_points=100, visitors_per_task=500)
RNG = np.random.default_rng(0)
SHAPES = {
    "plane": RNG.standard_normal((1_500, 2)) * [1, 50],
    "free": RNG.standard_normal((700, 5)),
    "many features": RNG.standard_normal((400, 14)),
    "copies": np.repeat(np.round(RNG.standard_normal((200, 2)), 1), 6, axis=0),
    "lattice": np.array([(i, j) for i in range(30) for j in range(30)], float),
}


def kth(x, k):
    d = np.sqrt(kernels.squared_distances(x, x))
    np.fill_diagonal(d, np.inf)
    return np.sort(d, axis=1)[:, k - 1]


@pytest.mark.parametrize("name", SHAPES)
@pytest.mark.parametrize("limits", [LIMITS, Limits()])
def test_kth_distances_are_those_of_all_pairs(frame, scores, name, limits, monkeypatch):
    x = SHAPES[name]
    features = frame(x)
    before = neighbourhood.kth_distance
    monkeypatch.setattr(neighbourhood, "kth_distance", lambda f, k: before(f, k, limits))
    assert np.allclose(scores(neighbourhood.knn_scores(features, 8)), kth(x, 7), rtol=1e-12)


def test_knn_alone_writes_no_lists(frame, monkeypatch):
    """Points settled in their own leaves leave a number, not a list."""
    staged = {}
    before = knn_join.stage
    monkeypatch.setattr(knn_join, "stage", lambda df, label: staged.setdefault(label, before(df, label)))
    monkeypatch.setattr(knn_join, "discard", lambda *tables: None)
    x = SHAPES["plane"]
    knn_join.kth_distance(frame(x), 7, LIMITS)
    rows = staged["knn-inside"].selectExpr("size(visits) as visits", "size(dists) as dists").collect()
    assert sum(r["visits"] == 0 for r in rows) > 300
    assert all((r["dists"] > 0) == (r["visits"] > 0) for r in rows)


def test_staged_points_go_when_leaves_are_written(spark, frame):
    features = frame(SHAPES["plane"])
    found = knn_join.kth_distance(features, 7, LIMITS)
    folder = Path(found.inputFiles()[0].split(":", 1)[1]).parent.parent
    before = {p.name.split("-")[0] for p in folder.iterdir()}
    assert found.count() == len(SHAPES["plane"])
    raw = prepare(features.df.select(*features.cols), assign_ids=True)
    assert raw.n == len(SHAPES["plane"])
    left = [p for p in folder.iterdir() if p.name.startswith("positions") and any(p.iterdir())]
    assert not left and "kth" in before
