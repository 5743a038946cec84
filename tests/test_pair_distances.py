"""Mean distances to all rows, and the shortest half, against numpy."""

import numpy as np
import pytest

from outvote.functions import kernels
from outvote.functions.frame import Features
from outvote.operators import pair_distances as P
from outvote.operators import robust
from outvote.operators.clean import prepare

TREES = (P.Level(3, 0.5), P.Level(6, 0.1))


def exact(x):
    return np.sqrt(kernels.squared_distances(x, x)).mean(axis=1)


def rounded(x):
    return x * 8193 - (x * 8193 - x)


def brute_flags(x, share):
    score = rounded(exact(x))
    limit = np.sort(score)[min(len(x) - 1, int((len(x) - 1) * (1 - share)))]
    return score > limit


def clouds(n, d, seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) * rng.uniform(0.1, 20, d)
    x[: n // 10] += 30
    x[-3:] *= 100
    return x


SHAPES = {
    "one feature": clouds(3_000, 1, 0),
    "two": clouds(3_000, 2, 1),
    "four": clouds(2_000, 4, 2),
    "twelve": clouds(800, 12, 3),
    "collinear": np.outer(np.random.default_rng(4).standard_normal(2_000), [1.0, -2.0, 0.5]) + 1e6,
    "copies": np.repeat(clouds(40, 2, 5), 50, axis=0),
    "lattice": np.array([(i, j) for i in range(40) for j in range(40)], float),
    "one place": np.ones((200, 2)),
    "two places": np.array([[0.0, 0.0]] * 190 + [[3.0, 4.0]] * 10),
}


@pytest.mark.parametrize("name", SHAPES)
@pytest.mark.parametrize("share", [0.0, 0.05, 0.4])
def test_flags_are_those_of_all_pairs(frame, mask, name, share):
    x = SHAPES[name]
    found = mask(P.mean_distance(frame(x), share, levels=TREES, cheap=0))
    assert (found == brute_flags(x, share)).all()


@pytest.mark.parametrize("depth", [1, 4, 8])
@pytest.mark.parametrize("name", ["two", "twelve", "collinear", "copies"])
def test_scores_lie_within_their_bounds(frame, name, depth):
    x = SHAPES[name]
    features = frame(x)
    boxes = P.build_boxes(Features(features.df, features.cols, None, features.profile), depth)
    assert boxes.weight[0] == len(x)
    for far in (0.5, 0.01):
        low, high = boxes.bounds(x, far, depth)
        true = exact(x)
        assert (low <= true * (1 + 1e-12)).all() and (true <= high * (1 + 1e-12)).all()
    if depth == 8 and name == "two":
        assert ((high - low) / true).mean() < 0.06


def test_every_score_is_exact_in_blocks(frame, scores, monkeypatch):
    x = clouds(700, 3, 6)
    monkeypatch.setattr(P, "BLOCK_CELLS", 300)
    assert np.allclose(scores(P.mean_distance(frame(x), 0.1, every_score=True)), exact(x), rtol=1e-11)


@pytest.mark.parametrize("name", ["one feature", "two", "copies", "lattice", "one place", "two places"])
def test_every_score_is_exact_by_boxes(frame, scores, name, monkeypatch):
    x = SHAPES[name]
    monkeypatch.setattr(P, "CHEAP_DISTANCES", 0)
    monkeypatch.setattr(P, "LEAF_PLACES", 40)
    assert np.allclose(scores(P.mean_distance(frame(x), 0.1, every_score=True)), exact(x), rtol=1e-13)


def test_every_score_takes_few_distances(frame, scores, monkeypatch):
    """Sums of all pairs grow with the square of the table, and partial sums of each task with them."""
    rng = np.random.default_rng(10)
    x = np.column_stack([rng.uniform(-1_000, 10_000, 6_000).round(2), rng.integers(0, 25, 6_000)])
    places, features = np.unique(x, axis=0), frame(x)
    monkeypatch.setattr(P, "LEAF_PLACES", 40)
    located, *tree = P._located(features.df.selectExpr("x0", "x1", "1L as copies").distinct(), features.cols, len(places))
    stands = P.build_stands(located, features.cols, *tree)
    inner, met = len(stands.feature), 0
    assert stands.first[1] <= P.orders(np.ones(2)).prod()
    leaf = P.partition_tree.leaf_of(places, stands.feature, stands.value, tree[-1])
    rows = np.bincount(leaf, minlength=inner + 1)
    for own in np.unique(leaf):
        far, near = stands.around(stands.low[own + inner], stands.high[own + inner])
        met += rows[own] * ((stands.first[far + 1] - stands.first[far]).sum() + rows[near].sum())
    assert met < 0.5 * len(places) ** 2


@pytest.mark.parametrize("shape", [(1.0, 1.0), (1.0, 0.1), (1.0, 1e-6), (1.0, 0.0)])
def test_condensed_rows_stand_for_all_rows_from_afar(shape):
    rng = np.random.default_rng(11)
    low, high = np.zeros(2), np.array(shape)
    x, weight = rng.uniform(low, high, (4_000, 2)), rng.integers(1, 9, 4_000).astype(float)
    places, stands = P.condensed(x, weight, low, high)
    assert len(places) <= P.orders((high - low) / 2).prod() < 400
    for angle in np.linspace(0, 2 * np.pi, 60):
        step = np.array([np.cos(angle), np.sin(angle)])
        # the nearest place on this ray that counts as far
        at = next(t for r in np.arange(0.5, 4, 0.001) if (np.maximum(np.maximum(low - (t := high / 2 + r * step), t - high), 0) ** 2).sum() >= (P.APART / 2) ** 2)
        true = np.sqrt(((x - at) ** 2).sum(1)) @ weight
        assert np.sqrt(((places - at) ** 2).sum(1)) @ stands == pytest.approx(true, rel=1e-14)


def test_few_rows_are_summed_against_all(frame, monkeypatch):
    """Most rows are settled by bounds; only the open ones reach the sums."""
    x = clouds(20_000, 2, 7)
    summed = []
    before = P.distance_sums
    monkeypatch.setattr(P, "distance_sums", lambda points, wanted, cols, n: summed.append(wanted.count()) or before(points, wanted, cols, n))
    P.mean_distance(frame(x), 0.05, levels=(P.Level(8, 0.05), P.Level(11, 0.005)), cheap=0)
    assert 0 < summed[0] < 0.05 * len(x)


def test_more_rows_are_settled_until_sums_are_cheap(frame, mask, monkeypatch):
    """Sums of a fixed share of the rows would grow with the square of the table."""
    x = clouds(4_000, 2, 9)
    summed = []
    before = P.distance_sums
    monkeypatch.setattr(P, "distance_sums", lambda points, wanted, cols, n: summed.append(wanted.count()) or before(points, wanted, cols, n))
    coarse = (P.Level(4, 0.5),)
    first = mask(P.mean_distance(frame(x), 0.05, levels=coarse, cheap=0))
    monkeypatch.setattr(P, "CHEAP_DISTANCES", len(x))
    second = mask(P.mean_distance(frame(x), 0.05, levels=coarse, cheap=0))
    assert (first == brute_flags(x, 0.05)).all() and (second == first).all()
    assert 0 < summed[1] < 0.3 * summed[0]


def test_any_names_and_no_id(spark):
    x = clouds(400, 2, 8)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "`a.b` double, `c``d` double")
    flagged = P.mean_distance(prepare(df), 0.1, levels=TREES, cheap=0)
    assert flagged.columns == ["a.b", "c`d", "is_outlier", "score"] or set(flagged.columns) == {"a.b", "c`d", "score", "is_outlier"}
    got = {(r[0], r[1]): r["is_outlier"] for r in flagged.collect()}
    assert [got[tuple(p)] for p in x.tolist()] == brute_flags(x, 0.1).tolist()


# --- shortest half ------------------------------------------------------------------------


def brute_half(x, h):
    x = np.sort(x)
    width = x[h:] - x[: len(x) - h]
    at = np.nonzero(width == width.min())[0]
    middle = (0.5 * (x[h + at] + x[at])).mean()
    half = x[np.argsort(rounded(np.abs(x - middle)), kind="stable")[:h]]
    return middle, half.var()


VALUES = {
    "normal": np.random.default_rng(0).standard_normal(4_001),
    "ties": np.random.default_rng(1).integers(0, 30, 5_000).astype(float),
    "all but one alike": np.array([1.0] * 99 + [5.0]),
    "even steps": np.arange(1_000, dtype=float),
    "skewed": np.exp(np.random.default_rng(2).standard_normal(3_000) * 2),
    "few": np.array([3.0, 1.0, 2.0, 10.0]),
}


@pytest.mark.parametrize("name", VALUES)
@pytest.mark.parametrize("share", [0.5, 0.75])
@pytest.mark.parametrize("window_rows", [1, 1_000_000])
def test_shortest_half(frame, name, share, window_rows, monkeypatch):
    x = VALUES[name]
    h = max(1, int(share * len(x)))
    counts = robust.cumulative_counts
    monkeypatch.setattr(robust, "cumulative_counts", lambda f: counts(f, window_rows))
    got = robust._shortest_half(frame(x[:, None]), h)
    middle, variance = brute_half(x, h)
    assert got.location[0] == pytest.approx(middle, rel=1e-12, abs=1e-12)
    assert got.cov[0, 0] == pytest.approx(variance, rel=1e-9, abs=1e-12)


def test_shortest_half_of_many_rows(spark):
    """More rows than were once sampled; the same half whatever the partitions."""
    df = spark.range(200_000).selectExpr("id", "round(pow((id * 7919) % 200003 / 2000.0, 1.5), 1) as x").repartition(5)
    features = prepare(df, "id")
    x = np.array([r[0] for r in df.select("x").collect()])
    middle, variance = brute_half(x, 100_000)
    got = robust._shortest_half(features, 100_000)
    assert got.location[0] == pytest.approx(middle, rel=1e-12)
    assert got.cov[0, 0] == pytest.approx(variance, rel=1e-9)
