import numpy as np
import pytest
from pyspark.sql import functions as F

from outvote.operators import projection as P
from outvote.operators import votes as V
from outvote.plans import run as R
from outvote.plans.report import picture_tables, report_tables
from outvote.sources.tables import write_report


def planted(n=180, k=20, d=4, seed=3):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.standard_normal((n, d)), rng.normal(5, 1, (k, d))])


def test_invalid_input(frame):
    features = frame(planted())
    with pytest.raises(ValueError, match="Invalid algorithm"):
        R.run_all(features, ["zscore", "nope"], 0.1)
    for c in (-0.1, 0.6):
        with pytest.raises(ValueError, match="Contamination must be between"):
            R.run_all(features, ["zscore"], c)


@pytest.fixture(scope="module")
def everything(frame):
    return R.run_all(frame(planted()), None, 0.1)


def test_all_twelve_succeed(everything):
    assert everything.errors == {} and len(everything.successful) == 12
    stats = {r["detector"]: r for r in everything.stats().collect()}
    assert set(stats) == set(R.DETECTORS)
    for row in stats.values():
        assert row["n_outliers"] + row["n_inliers"] == 200
        assert row["actual_contamination"] <= 0.5 and row["error"] is None and row["execution_time"] > 0
        assert row["contamination_difference"] == pytest.approx(row["actual_contamination"] - 0.1)
    assert everything.flags.count() == 12 * 200
    row = everything.metadata().first()
    assert (row["n_rows"], row["n_features"], row["success_rate"]) == (200, 4, 1.0)
    timing = everything.timing_summary().first()
    assert timing["fastest_time"] <= timing["average_time"] <= timing["slowest_time"] <= timing["total_time"]


def test_votes_and_sweep(everything):
    votes = {r["row_id"]: r["n_votes"] for r in everything.votes.collect()}
    assert 20 <= len(votes) and all(1 <= v <= 12 for v in votes.values())
    sweep = {r["threshold"]: r["n_rows"] for r in V.threshold_sweep(everything.votes, 12).collect()}
    assert sweep == {t: sum(v >= t for v in votes.values()) for t in range(1, 13)}
    best = V.max_agreement(everything.votes).first()
    assert best["max_agreement"] == max(votes.values())
    assert best["n_rows"] == sum(v == max(votes.values()) for v in votes.values())


def test_consensus_is_precise(everything, spark):
    chosen = V.consensus(everything.votes, 6)
    labels = spark.range(200).select(F.col("id").alias("row_id"), (F.col("id") >= 180).alias("is_anomaly"))
    found = V.evaluate(chosen, labels).first()
    assert found["flagged"] > 0 and found["precision"] >= 0.8


def test_report_tables(everything, tmp_path):
    tables = report_tables(everything)
    chosen = V.consensus(everything.votes, 6).count()
    assert tables["consensus"].count() == chosen
    assert sum(r["n_rows"] for r in tables["agreement_distribution"].collect()) == chosen
    assert tables["top_consensus"].count() == V.shown_rows(chosen)
    assert tables["best_without_consensus"].count() == 0
    write_report({k: v for k, v in tables.items() if k != "metadata"}, str(tmp_path / "report"))
    pictures = picture_tables(everything)
    assert pictures["projection_2d"].count() == 200 and "projection_3d" in pictures and "projection_svm" in pictures
    assert pictures["hull_inliers"].count() >= 3
    assert pictures["picture_stats"].first()["outlier_rate_pct"] == pytest.approx(chosen / 2)


def test_no_consensus_lists_best_rows(spark):
    votes = spark.createDataFrame([(i, 3 if i % 2 else 1) for i in range(20)], "row_id bigint, n_votes bigint")
    assert [r["row_id"] for r in V.best_without_consensus(votes).collect()] == [1, 3, 5, 7, 9]
    ones = spark.createDataFrame([(i, 1) for i in range(20)], "row_id bigint, n_votes bigint")
    assert V.best_without_consensus(ones).count() == 0
    none = ones.filter("row_id < 0")
    assert tuple(V.max_agreement(none).first()) == (0, 0)
    assert V.best_without_consensus(none).count() == 0


def test_shown_rows_and_thresholds():
    assert [V.shown_rows(n) for n in (0, 20, 21, 100, 101)] == [0, 20, 10, 10, 5]
    assert [V.default_threshold(n) for n in (0, 1, 3, 12)] == [1, 1, 2, 6]
    assert V.check_threshold(5, 12) == 5
    for bad in (0, 13):
        with pytest.raises(ValueError, match="vote"):
            V.check_threshold(bad, 12)


def test_confidence_tiers(spark):
    votes = spark.createDataFrame([(i, i) for i in range(1, 11)], "row_id bigint, n_votes bigint")
    tiers = {r["row_id"]: r["confidence"] for r in V.confidence(votes, 10).collect()}
    assert [tiers[i] for i in (5, 6, 7, 8, 10)] == ["Moderate", "High", "High", "Very High", "Very High"]
    shares = {r["row_id"]: r["consensus_pct"] for r in V.confidence(votes, 8).collect()}
    assert (shares[1], shares[3]) == (12, 38)


def test_a_failing_detector_is_recorded(frame, monkeypatch):
    def broken(features, contamination, seed=0):
        raise RuntimeError("no such luck")

    monkeypatch.setitem(R.DETECTORS, "broken", broken)
    run = R.run_all(frame(np.arange(10.0)[:, None]), ["zscore", "dbscan", "broken"], 0.2)
    assert run.successful == ["zscore"] and set(run.errors) == {"dbscan", "broken"}
    stats = {r["detector"]: r for r in run.stats().collect()}
    assert stats["broken"]["error"] == "no such luck" and stats["broken"]["n_outliers"] is None
    assert run.metadata().first()["algorithms_failed"] == ["dbscan", "broken"]


def test_no_success_gives_an_empty_report(frame):
    run = R.run_all(frame(np.arange(10.0)[:, None]), ["dbscan"], 0.2)
    tables = report_tables(run)
    assert tables["consensus"].count() == 0 and tables["max_agreement"].first()["n_rows"] == 0


@pytest.mark.parametrize(
    "x,c,least",
    [
        (np.random.default_rng(0).standard_normal((100, 1)), 0.1, 12),
        (np.array([[1, 2], [2, 3], [100, 200]]), 0.33, 8),
        (np.random.default_rng(1).standard_normal((50, 40)), 0.05, 11),
        (np.random.default_rng(2).standard_normal((20, 5)), 0.4, 11),
    ],
)
def test_awkward_shapes(frame, x, c, least):
    run = R.run_all(frame(x), None, c)
    assert len(run.successful) >= least, run.errors
    for row in V.detector_stats(run.flags, c).collect():
        assert row["actual_contamination"] <= 0.8


def test_identical_rows(frame):
    run = R.run_all(frame(np.tile([1.0, 2.0, 3.0], (50, 1))), None, 0.1)
    few = [r for r in V.detector_stats(run.flags, 0.1).collect() if r["n_outliers"] <= 5]
    assert len(few) >= 6


def test_pipeline_from_csv(spark, tmp_path):
    x = planted()
    lines = ["a,b,c,d,kind"] + [",".join(f"{v:.6f}" for v in r) + ",x" for r in x] + ["NA,1,1,1,y"]
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n")
    out = str(tmp_path / "cleaned")
    found = R.detect_outliers(spark, str(tmp_path / "in.csv"), ["zscore", "ecod", "knn"], 0.1, 2, output=out)
    removed = found.consensus.count()
    back = spark.read.csv(out, header=True)
    assert back.columns == ["a", "b", "c", "d"] and back.count() == 200 - removed and 0 < removed <= 40
    with pytest.raises(ValueError, match="no columns named"):
        R.detect_outliers(spark, str(tmp_path / "in.csv"), ["zscore"], 0.1, columns=["a", "q"])
    narrow = R.detect_outliers(spark, str(tmp_path / "in.csv"), ["zscore"], None, columns=["a", "b"])
    assert narrow.cleaned.columns == ["a", "b"] and 0 <= narrow.run.contamination <= 0.5


def test_pipeline_keeping_all_columns(spark):
    x = planted()
    rows = [(i, *map(float, r), f"n{i}") for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "key bigint, a double, b double, c double, d double, label string")
    found = R.detect_outliers(spark, df, ["zscore", "ecod"], 0.1, 2, id_col="key", all_columns=True)
    assert found.cleaned.columns == df.columns
    assert found.cleaned.count() == 200 - found.consensus.count()


# ---- projections -----------------------------------------------------------------


def test_components(frame):
    x = planted()
    features = frame(x)
    components = P.Components(features)
    values, vectors = np.linalg.eigh(np.cov(x.T, ddof=0))
    assert np.allclose(components.explained(3), values[::-1][:3] / values.sum())
    rows = sorted(P.project(features, 2, components).collect())
    got = np.array([[r["pc1"], r["pc2"]] for r in rows])
    assert np.allclose(np.abs(got), np.abs((x - x.mean(axis=0)) @ vectors[:, ::-1][:, :2]))
    with pytest.raises(ValueError, match="Dimension must be 2 or 3"):
        P.project(features, 4)


def test_one_feature_has_no_pictures(frame):
    run = R.run_all(frame(np.arange(30.0)[:, None]), ["zscore"], 0.1)
    assert list(picture_tables(run)) == ["summary"]


def test_sample_keeps_every_outlier(spark):
    df = spark.range(500).withColumn("is_outlier", F.col("id") % 10 == 0)
    for target, size in ((200, 200), (10, 50), (1000, 500)):
        got = P.outlier_preserving_sample(df, "id", target).collect()
        assert len(got) == size and sum(r["is_outlier"] for r in got) == 50
    assert [P.sample_target(n, 7) for n in (50_000, 500_000, 600_000)] == [50_000, 50_000, 30_007]


def hull_by_brute_force(x):
    x = np.unique(x, axis=0)
    keep = set()
    for i in range(len(x)):
        for j in range(len(x)):
            if i != j:
                side = (x[j, 0] - x[i, 0]) * (x[:, 1] - x[i, 1]) - (x[j, 1] - x[i, 1]) * (x[:, 0] - x[i, 0])
                if (side >= 0).all() and (side == 0).sum() == 2:
                    keep |= {tuple(x[i]), tuple(x[j])}
    return keep


@pytest.mark.parametrize("shape", ["circle", "circle and a cloud", "far points"])
def test_hull_of_more_vertices_than_a_task_holds(spark, monkeypatch, shape):
    """Points on a curve are all vertices, and no task can take them together."""
    angle = np.linspace(0, 2 * np.pi, 3_000, endpoint=False)
    x = np.column_stack([np.cos(angle), np.sin(angle)]) * 1000
    rng = np.random.default_rng(0)
    if shape != "circle":
        x = np.vstack([x, rng.uniform(-600, 600, (2_000, 2))])
    if shape == "far points":
        x = np.vstack([x, [[0.0, 5_000.0], [40.0, -3_000.0]]])
    wanted = P.hull_vertices(x)
    monkeypatch.setattr(P, "HULL_GROUP", 300)
    df = spark.createDataFrame([tuple(map(float, r)) for r in rng.permutation(x)], "pc1 double, pc2 double").repartition(6)
    rows = P.convex_hull(df).orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(len(wanted)))
    assert np.array_equal(np.array([(r["x"], r["y"]) for r in rows]), wanted)


def test_hull_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    circle = np.array([(np.cos(t), np.sin(t)) for t in rng.uniform(0, 6.28, 60)])
    for x in (rng.standard_normal((300, 2)), circle):
        df = spark.createDataFrame([tuple(map(float, r)) for r in x], "pc1 double, pc2 double").repartition(5)
        rows = P.convex_hull(df).orderBy("position").collect()
        assert {(r["x"], r["y"]) for r in rows} == hull_by_brute_force(x)
        area = sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(rows, rows[1:] + rows[:1]))
        assert area > 0
        with monkeypatch.context() as m:
            m.setattr(P, "HULL_GROUP", 20)
            assert {(r["x"], r["y"]) for r in P.convex_hull(df).collect()} == hull_by_brute_force(x)
    line = spark.createDataFrame([(float(i), float(i)) for i in range(10)], "pc1 double, pc2 double")
    assert P.convex_hull(line).count() == 0 and P.convex_hull(line.limit(0)).count() == 0


def test_density_counts_every_point(spark):
    x = np.random.default_rng(2).standard_normal((400, 2))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "pc1 double, pc2 double")
    cells = P.hex_density(df).collect()
    assert sum(r["n"] for r in cells) == 400 and all(r["n"] > 0 for r in cells)
    width, height = np.ptp(x[:, 0]) / 30, np.ptp(x[:, 1]) / 17
    centres = np.array([(r["x"], r["y"]) for r in cells])
    gap = np.abs((x[:, None] - centres[None]) / [width, height])
    assert (gap.min(axis=1) <= 1).all()
    assert P.hex_density(df.limit(50)).count() == 0
