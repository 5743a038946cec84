"""Scales, column names, ids and quoting that tables come with."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from outvote.functions.frame import Features
from outvote.operators import neighbourhood, statistical
from outvote.operators.clean import clean, feature_profile, prepare, with_row_positions
from outvote.plans.run import DETECTORS, run_all
from outvote.sources.tables import read_csv

import shapes


@pytest.mark.parametrize("scale", [1e-10, 1e-4, 1.0, 1e7])
def test_neighbour_flags_do_not_depend_on_the_scale(frame, mask, scale):
    x = np.random.default_rng(3).standard_normal((400, 2)) * scale
    got = mask(neighbourhood.knn(frame(x), 0.05))
    assert got.sum() == 20 and (got == shapes.top(shapes.knn(x), 0.05)).all()


@pytest.mark.parametrize("n", [400, 1000])
def test_one_huge_value_hides_no_other_row(frame, mask, n):
    x = np.random.default_rng(4).standard_normal((n, 1))
    x[7] = 1e12
    z = np.abs(x - x.mean(axis=0)) / x.std(axis=0)
    got = mask(statistical.zscore(frame(x), 0.05))
    assert got.sum() == n // 20 and got[7]
    assert (got == shapes.top(z.max(axis=1), 0.05)).mean() > 0.99


def test_noise_beside_one_huge_value(frame, mask):
    x = np.random.default_rng(5).standard_normal((1000, 2))
    x[3] = 1e12
    got = mask(neighbourhood.dbscan(frame(x), 0.05))
    assert got[3] and got.sum() > 1


@pytest.mark.parametrize("name", ["sepal.length", "a b", "back`tick", "plain"])
def test_any_column_name(spark, name):
    draw = np.random.default_rng(6).standard_normal((60, 2))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(draw)], ["id.x", name, "other.one"])
    assert clean(df, "id.x").columns == ["id.x", name, "other.one"]
    assert {r["feature"] for r in feature_profile(prepare(df, "id.x")).collect()} == {name, "other.one"}
    placed = with_row_positions(df).collect()
    assert sorted(r["row_id"] for r in placed) == list(range(60))


def test_detectors_take_dotted_names(spark):
    draw = np.random.default_rng(7).standard_normal((80, 3))
    rows = [(i, *map(float, r)) for i, r in enumerate(draw)]
    dotted, plain = (spark.createDataFrame(rows, ["id", *names]) for names in (("a.b", "c.d", "e f"), ("a", "c", "e")))
    wanted = ["zscore", "hbos", "copod", "ecod", "knn", "lof", "dbscan", "mcd"]
    found = [run_all(df, wanted, 0.05, id_col="id") for df in (dotted, plain)]
    assert [sorted(r.successful) for r in found] == [sorted(wanted)] * 2
    flags = [sorted((r["detector"], r["row_id"], r["is_outlier"]) for r in x.flags.collect()) for x in found]
    assert flags[0] == flags[1]


@pytest.mark.parametrize("name", ["knn", "lof", "dbscan"])
def test_text_ids(spark, name):
    draw = np.random.default_rng(8).standard_normal((90, 2)).round(2)
    draw[:10] = draw[0]
    by_number = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(draw)], "id long, x double, y double")
    by_text = by_number.withColumn("id", F.format_string("row %03d", "id"))
    found = [DETECTORS[name](prepare(df, "id"), 0.05).select("id", "is_outlier", F.round("score", 9)) for df in (by_number, by_text)]
    a, b = (sorted(map(tuple, f.collect())) for f in found)
    assert [r[1:] for r in a] == [r[1:] for r in b] and b[0][0] == "row 000"


def test_numbering_keeps_the_profile(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, x double")
    inner, ids = Features(df, ["x"], "k").numbered
    assert inner.n == 2 and inner.df.columns == ["__number", "x"] and ids.count() == 2


def test_quotes_inside_quoted_fields(spark, tmp_path):
    (tmp_path / "t.csv").write_text('text,n\n"say ""hi"", ok",1\nplain,2\n"comma, only",3\n')
    df = read_csv(spark, str(tmp_path / "t.csv"))
    assert sorted(map(tuple, df.collect())) == [("comma, only", 3.0), ("plain", 2.0), ('say "hi", ok', 1.0)]
    (tmp_path / "m.csv").write_text('text,n\n"two\nlines",1\n')
    assert read_csv(spark, str(tmp_path / "m.csv"), multiLine=True).first()["text"] == "two\nlines"


def test_exact_offset_of_the_boundary(spark, frame):
    from outvote.operators.svm import svm

    x = np.random.default_rng(9).standard_normal((300, 2))
    assert svm(frame(x), 0.05).filter("is_outlier").count() > 0
