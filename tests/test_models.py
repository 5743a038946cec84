"""Forest, subspace, robust covariance and one-class SVM."""

import math

import numpy as np
import pytest
import shapes
from pyspark.sql import functions as F

from outvote.functions.moments import chi2_quantile, covariance, moments, with_quadratic_form
from outvote.operators import forest, robust, subspace
from outvote.operators import svm as one_class

INPUTS = shapes.inputs()


def test_average_path():
    assert [forest.average_path(s) for s in (0, 1, 2)] == [0.0, 0.0, 1.0]
    harmonic = math.log(255) + 0.5772156649015329
    assert forest.average_path(256) == pytest.approx(2 * harmonic - 2 * 255 / 256)


def test_a_tree_separates_its_rows():
    x = np.random.default_rng(0).standard_normal((16, 2))
    feature, cut, depth = forest.grow_tree(x, 15, forest.hash_draws(0, 1))
    node = np.zeros(16, int)
    for _ in range(15):
        node = 2 * node + 1 + (x[np.arange(16), feature[node]] > cut[node])
    assert len(set(node)) == 16
    same = forest.grow_tree(np.ones((8, 2)), 3, forest.hash_draws(0, 1))[2]
    assert same[0] == forest.average_path(8)


def test_forest_scores_equal_a_direct_walk(frame, scores):
    x = INPUTS["planted"]
    features = frame(x)
    model = forest.fit_forest(features, 20, 64, seed=3)
    paths = np.zeros(len(x))
    for feature, cut, depth in zip(model.feature, model.cut, model.depth):
        for i, row in enumerate(x):
            node = 0
            for _ in range(model.height):
                node = 2 * node + 1 + int(row[int(feature[node])] > cut[node])
            paths[i] += depth[node - (2**model.height - 1)]
    expected = 2 ** (-paths / 20 / forest.average_path(64))
    assert np.allclose(scores(model.score(features.df)), expected)


def test_isoforest_finds_planted_rows_and_repeats(frame, mask):
    x = INPUTS["planted"]
    first = mask(forest.isoforest(frame(x), 0.1))
    assert first[270:].sum() >= 20 and first.sum() <= 30
    assert (mask(forest.isoforest(frame(x, parts=7), 0.1)) == first).all()


def test_isoforest_on_equal_rows_flags_none(frame, mask):
    assert mask(forest.isoforest(frame(np.tile([1.0, 2.0, 3.0], (50, 1))), 0.1)).sum() == 0


def test_contamination_estimates(frame):
    rng = np.random.default_rng(4)
    normal = rng.standard_normal((1000, 5))
    assert forest.estimate_contamination(frame(normal)) <= 0.2
    x = np.vstack([rng.standard_normal((950, 10)), rng.normal(3, math.sqrt(2), (50, 10))])
    assert 0.01 <= forest.estimate_contamination(frame(x)) <= 0.3


def test_inne_against_numpy(frame, scores):
    x = INPUTS["normal"][:200]
    features = frame(x)
    got = scores(subspace.inne_scores(features, rounds=3, subspaces=[[0], [1, 2], [0, 2]]))
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    k = max(1, min(10, int(math.log(200))))
    expected = np.mean([np.sort(shapes.distances(z[:, s]), axis=1)[:, :k].mean(axis=1) for s in ([0], [1, 2], [0, 2])], axis=0)
    assert np.allclose(got, expected, atol=2e-9)


def test_inne_needs_five_rows(frame, mask):
    assert not mask(subspace.inne(frame(np.arange(4.0)[:, None]), 0.3)).any()


@pytest.mark.parametrize("d,p,value", [(1, 0.975, 5.023886), (2, 0.5, 1.386294), (5, 0.975, 12.832502), (10, 0.5, 9.341818), (100, 0.975, 129.561197)])
def test_chi2_quantile(d, p, value):
    assert chi2_quantile(p, d) == pytest.approx(value, abs=1e-5)


def test_moments_of_a_wide_table(spark):
    from outvote.functions.moments import _blocks

    d = 150
    x = np.random.default_rng(0).standard_normal((300, d)) @ np.random.default_rng(1).standard_normal((d, d)) * 10 + 1e4
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"c{i} double" for i in range(d))).repartition(7)
    n, mean, cov = moments(df, df.columns, np.full(d, 1e4))
    assert n == 300 and np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x.T, ddof=0))
    assert len(_blocks(d)) == 6 and np.array_equal(cov, cov.T)
    assert moments(df.limit(0), df.columns, np.zeros(d))[0] == 0


@pytest.mark.parametrize("d", [3, 20])
def test_moments_and_distances_on_both_routes(frame, d):
    x = np.random.default_rng(d).standard_normal((120, d)) @ np.random.default_rng(1).standard_normal((d, d)) + 100
    features = frame(x)
    n, mean, cov = moments(features.df, features.cols, np.full(d, 99.0))
    assert n == 120 and np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x.T, ddof=0))
    inverse = np.linalg.inv(cov)
    rows = with_quadratic_form(features.df, features.cols, mean, inverse, "q").select("id", "q").collect()
    gap = x - x.mean(axis=0)
    assert np.allclose([r["q"] for r in sorted(rows)], np.einsum("ij,jk,ik->i", gap, inverse, gap))


def numpy_mcd(x, support, tries=400):
    """Exhaustive-ish random search, correction and reweighting."""
    rng = np.random.default_rng(0)
    n, d = x.shape
    h, best = int(support * n), (math.inf, None)
    for _ in range(tries):
        rows = rng.permutation(n)[: d + 1]
        for _ in range(50):
            mean, cov = x[rows].mean(axis=0), np.cov(x[rows].T, ddof=0).reshape(d, d)
            dist = np.einsum("ij,jk,ik->i", x - mean, np.linalg.pinv(cov), x - mean)
            following = np.argsort(dist)[:h]
            if set(following) == set(rows):
                break
            rows = following
        det = np.linalg.det(cov)
        if det < best[0]:
            best = (det, (mean, cov))
    mean, cov = best[1]
    dist = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    near = x[dist / (np.median(dist) / chi2_quantile(0.5, d)) < chi2_quantile(0.975, d)]
    mean, cov = near.mean(axis=0), np.cov(near.T, ddof=0)
    return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)


@pytest.mark.parametrize("detector,support", [(robust.mcd, 0.5), (robust.elliptic, 0.9)])
def test_robust_distances_against_numpy(frame, mask, scores, detector, support):
    x = INPUTS["planted"]
    flagged = detector(frame(x), 0.1).cache()
    expected = numpy_mcd(x, support)
    assert np.allclose(scores(flagged), expected, rtol=1e-6)
    assert (mask(flagged) == shapes.top(expected, 0.1)).all()


def test_full_table_concentration_agrees_with_the_sampled_one(frame, monkeypatch):
    features = frame(INPUTS["planted"])
    whole = robust.robust_scatter(features, 0.5, 0)
    monkeypatch.setattr(robust, "start_rows", lambda d: 150)
    sampled = robust.robust_scatter(features, 0.5, 0)
    assert np.allclose(whole.cov, sampled.cov, rtol=0.2, atol=0.05)
    assert np.allclose(whole.location, sampled.location, atol=0.1)


@pytest.mark.parametrize("open_rows", [0, 5, 2_000])
def test_several_estimates_take_steps_at_once(frame, monkeypatch, open_rows):
    monkeypatch.setattr(robust, "OPEN_ROWS", open_rows)
    x = np.random.default_rng(9).standard_normal((800, 3)) * [1, 10, 100] + 5
    features, h = frame(x), 430
    starts = [robust.Scatter(x[rows].mean(0), np.cov(x[rows].T, ddof=0)) for rows in (slice(0, 10), slice(10, 40), slice(0, 800))]
    for got, start in zip(robust.concentration_steps(features, starts, h), starts):
        gap = x - start.location
        dist = np.einsum("ij,jk,ik->i", gap, np.linalg.pinv(start.cov), gap)
        near = x[np.argsort(dist, kind="stable")[:h]]
        assert np.allclose(got.location, near.mean(0)) and np.allclose(got.cov, np.cov(near.T, ddof=0))


@pytest.mark.parametrize("open_rows", [0, 2, 2_000])
def test_rows_tied_with_the_last_are_in_a_step(frame, monkeypatch, open_rows):
    monkeypatch.setattr(robust, "OPEN_ROWS", open_rows)
    x = np.array([[-2.0, 0], [2, 0], [0, 1], [0, -1], [0, 0], [9, 9], [-9, 9], [9, -9]])
    (got,) = robust.concentration_steps(frame(x), [robust.Scatter(np.zeros(2), np.eye(2))], 4)
    assert np.allclose(got.location, 0) and np.allclose(got.cov, np.cov(x[:5].T, ddof=0))


def test_the_sample_that_starts_see_does_not_decide(frame, monkeypatch):
    """Candidates concentrate on all rows at every size."""
    features = frame(INPUTS["planted"])
    whole = robust.robust_scatter(features, 0.5, 0)
    monkeypatch.setattr(robust, "start_rows", lambda d: 60)
    assert robust.robust_scatter(features, 0.5, 0).log_det <= whole.log_det + 0.5
    monkeypatch.setattr(robust, "MAX_STEPS", 1)
    with pytest.raises(ArithmeticError):
        robust.concentrate(features, [robust.Scatter(np.zeros(features.d) + 3, np.eye(features.d) * 1e6)], 150, steps=1)


def test_shortest_half_of_one_feature(frame):
    x = np.sort(np.concatenate([np.random.default_rng(2).standard_normal(80), np.full(20, 50.0) + np.arange(20)]))
    h = 60
    start = min(range(len(x) - h), key=lambda i: x[i + h] - x[i])
    raw = robust._shortest_half(frame(x[:, None]), h)
    assert raw.location[0] == pytest.approx((x[start] + x[start + h]) / 2)
    nearest = x[np.argsort(np.abs(x - raw.location[0]), kind="stable")[:h]]
    assert raw.cov[0, 0] == pytest.approx(nearest.var())


def test_fallbacks(frame, mask, scores):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((60, 2))
    collinear = np.column_stack([base[:, 0], base[:, 0] * 2, base[:, 1]])
    expected = shapes.tied(shapes.distances(collinear).mean(axis=1))
    flagged = robust.elliptic(frame(collinear), 0.1).cache()
    assert np.allclose(scores(flagged), expected, atol=2e-9)
    assert (mask(flagged) == shapes.top(expected, 0.1)).all()
    wide = rng.standard_normal((4, 6))
    z = np.abs((wide - wide.mean(axis=0)) / wide.std(axis=0)).max(axis=1)
    assert np.allclose(scores(robust.mcd(frame(wide), 0.25)), z)
    assert np.allclose(scores(robust.elliptic(frame(wide), 0.25)), shapes.distances(wide).mean(axis=1), atol=2e-9)
    equal = frame(np.tile([1.0, 2.0], (50, 1)))
    assert not mask(robust.mcd(equal, 0.1)).any() and not mask(robust.elliptic(equal, 0.1)).any()
    # more than half of the rows on one point: no covariance, so mean distance
    half = np.vstack([np.zeros((60, 2)), rng.standard_normal((40, 2))])
    assert np.allclose(scores(robust.mcd(frame(half), 0.1)), shapes.distances(half).mean(axis=1), atol=2e-9)


def test_constant_features_add_no_distance(frame, mask):
    x = INPUTS["planted"]
    constant = np.column_stack([x, np.full(len(x), 4.0)])
    assert (mask(robust.mcd(frame(constant), 0.1)) == mask(robust.mcd(frame(x), 0.1))).all()


def test_svm_grid(frame):
    grid = one_class.candidates(frame(INPUTS["normal"]))
    assert len(grid) == 12
    assert [(c.kernel, c.nu) for c in grid[:4]] == [("rbf", 0.05), ("rbf", 0.1), ("rbf", 0.2), ("linear", 0.05)]


def test_svm_share_of_rows_outside_is_nu(frame):
    features = frame(INPUTS["normal"])
    decided, grid = one_class.decisions(features)
    flat = decided.select(F.posexplode("decision").alias("c", "v")).groupBy("c").agg(F.avg((F.col("v") < 0).cast("double")).alias("s"))
    for row in flat.collect():
        assert row["s"] == pytest.approx(grid[row["c"]].nu, abs=0.02)


def test_svm_approaches_the_exact_kernel_solution(frame):
    """Conditional gradient on the exact kernel matrix, many steps."""
    x = INPUTS["planted"]
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    kernel = np.exp(-shapes.distances(z) ** 2 / 3)
    n, k = len(x), 30
    a = np.full(n, 1 / n)
    for _ in range(3000):
        value = kernel @ a
        s = np.zeros(n)
        s[np.argsort(value)[:k]] = 1 / k
        move = a - s
        a = a - min(1, max(0, (move @ value) / (move @ kernel @ move + 1e-18))) * move
    exact = set(np.argsort(kernel @ a)[:k])
    decided, grid = one_class.decisions(frame(x))
    at = next(i for i, c in enumerate(grid) if abs(c.gamma - 1 / 3) < 1e-12 and c.nu == 0.1)
    rows = decided.select("id", F.col("decision")[at].alias("v")).orderBy("v").limit(k).collect()
    assert len(exact & {r["id"] for r in rows}) >= 24


def test_svm_passes_agree_with_tasks(frame, mask):
    x = INPUTS["planted"]
    features = frame(x)
    tasks, passes = mask(one_class.svm(features, 0.1)), mask(one_class.svm(features, 0.1, in_passes=True))
    assert (tasks & passes).sum() >= 0.8 * (tasks | passes).sum()
    assert 0.05 <= tasks.mean() <= 0.21 and tasks[270:].mean() > tasks[:270].mean()


@pytest.mark.parametrize("misled", [False, True])
def test_svm_takes_a_pass_a_step(frame, monkeypatch, misled):
    """A second pass is needed only where the sample misleads; weights are the same."""
    x = np.random.default_rng(12).standard_normal((3_000, 3))
    features, passes = frame(x), []
    phi, grid = one_class.CosineMap(3, [0.1, 0.5], 0), [(0, 0.05), (0, 0.2), (1, 0.1)]
    monkeypatch.setattr(one_class, "PASS_STEPS", 5)
    before = one_class.map_in_arrow
    monkeypatch.setattr(one_class, "map_in_arrow", lambda *a: passes.append(1) or before(*a))
    if misled:
        monkeypatch.setattr(one_class, "_likely_bins", lambda *a: np.zeros((3, 2), np.int64))
    w = one_class._train_in_passes(features, phi, grid)
    assert len(passes) == (11 if misled else 6)
    m = phi.phis((x - features.profile.mean) / features.profile.std)
    for c, (g, nu) in enumerate(grid):
        own = m[g].mean(0)
        for _ in range(5):
            reach = np.sqrt(2.0) * np.linalg.norm(own) + 1e-12
            at, wanted = one_class._bins_of(m[g] @ own, reach), nu * len(x)
            counts = np.bincount(at, minlength=one_class.HISTOGRAM_BINS)
            last = np.searchsorted(counts.cumsum(), wanted)
            share = (wanted - counts[:last].sum()) / counts[last]
            own = one_class.toward(own, (m[g][at < last].sum(0) + share * m[g][at == last].sum(0)) / wanted)
        assert np.allclose(w[c], own, rtol=0, atol=1e-12)


@pytest.mark.parametrize("reach", [1.0, 50.0, 1e4])
def test_cosines(reach):
    half = np.random.default_rng(13).uniform(-reach, reach, 10_000)
    assert np.allclose(one_class.cosine(half.copy()), np.cos(2 * half), rtol=0, atol=4e-15)


def test_svm_edges(frame, mask):
    x = INPUTS["normal"]
    assert not mask(one_class.svm(frame(x), 0.0)).any()
    assert not mask(one_class.svm(frame(np.tile([1.0, 2.0], (50, 1))), 0.1)).any()
    tiny = np.random.default_rng(8).standard_normal((50, 3)) * 0.001
    assert mask(one_class.svm(frame(tiny), 0.1)).mean() <= 0.5


def test_silhouette_terms():
    rng = np.random.default_rng(0)
    a, b = rng.standard_normal((20, 2)), rng.standard_normal((6, 2)) + 4
    x, label = np.vstack([a, b]), np.repeat([0, 1], [20, 6])
    d = shapes.distances(x)
    s = []
    for i in range(26):
        own = label == label[i]
        inner, outer = d[i, own].sum() / (own.sum() - 1), d[i, ~own].mean()
        s.append((outer - inner) / max(inner, outer))
    silhouette, compactness, isolation = one_class._shape_scores(a, b, 20, 6, 1.5)
    pairs = shapes.distances(a)[np.triu_indices(20, 1)]
    assert silhouette == pytest.approx(np.mean(s))
    assert compactness == pytest.approx(-pairs.mean() / pairs.std())
    assert isolation == pytest.approx(d[20:, :20].min(axis=1).mean() / 1.5)
