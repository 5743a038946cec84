"""Times of a run, and picture tables that are made when asked for."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from outvote.operators import knn_join
from outvote.operators import projection as P
from outvote.plans import run as R
from outvote.plans.report import picture_tables

X = np.random.default_rng(0).standard_normal((200, 3))


def sleeper(seconds):
    def detect(features, contamination, seed=0):
        time.sleep(seconds)
        return features.df.withColumn("score", F.lit(0.0)).withColumn("is_outlier", F.lit(False))

    return detect


def test_times_of_detectors_side_by_side(frame, monkeypatch):
    monkeypatch.setitem(R.DETECTORS, "slow", sleeper(3.0))
    monkeypatch.setitem(R.DETECTORS, "quick", sleeper(0.0))
    R.run_all(frame(X), ["quick"], 0.1)  # warm
    run = R.run_all(frame(X), ["slow", "quick"], 0.1)
    assert 3.0 <= run.seconds["slow"] < 5.0
    assert run.seconds["quick"] < 2.0
    assert run.total_seconds < 6.0


def test_the_shared_join_is_in_no_detectors_time(frame, monkeypatch):
    before = knn_join.nearest_others
    monkeypatch.setattr(knn_join, "nearest_others", lambda *args: time.sleep(4.0) or before(*args))
    features = frame(X)
    run = R.run_all(features, ["knn", "lof"], 0.1)
    assert features.shared_seconds >= 4.0
    assert run.timing_summary().first()["shared_time"] == pytest.approx(features.shared_seconds)
    assert run.total_seconds >= 4.0
    assert all(0 <= s < 4.0 for s in run.seconds.values())


def test_picture_tables_are_made_when_asked_for(frame, monkeypatch):
    run = R.run_all(frame(X), ["zscore", "hbos"], 0.1)
    fitted = []
    before = P.Components
    monkeypatch.setattr(P, "Components", lambda f: fitted.append(f) or before(f))
    tables = picture_tables(run)
    assert tables["summary"].count() == 2 and not fitted
    wanted = {"summary", "projection_2d", "projection_3d", "explained_variance_2d", "explained_variance_3d", "picture_stats"}
    assert set(tables) == wanted | {"density", "hull_inliers", "hull_outliers", "projection_zscore", "projection_hbos"}
    assert len(tables) == 11
    assert tables["projection_2d"].count() == 200 and tables["projection_zscore"].count() == 200
    assert len(fitted) == 1
