import math
import random

import pytest
from pyspark.sql import functions as F

from outvote.operators import clean as C
from outvote.sources.generate import sample_dataset
from outvote.sources.tables import read_csv, write_table

NAN, INF = float("nan"), float("inf")


HOLES = [None, NAN, INF, -INF]


@pytest.mark.parametrize("seed", range(4))
def test_rows_with_any_hole_go(spark, seed):
    draw = random.Random(seed)
    width = draw.randint(1, 5)
    rows = [[draw.choice(HOLES) if draw.random() < 0.1 else draw.gauss(0, 10**seed) for _ in range(width)] for _ in range(60)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, " + ", ".join(f"c{j} double" for j in range(width)))
    whole = {i for i, r in enumerate(rows) if all(v is not None and math.isfinite(v) for v in r)}
    assert {r["id"] for r in C.clean(df, "id").collect()} == whole


def test_types(spark):
    df = spark.sql("select 1 as i, 2L as l, 1.5F as f, cast(2.25 as decimal(9,2)) as d, true as b, 'x' as s, date'2020-01-01' as t")
    out = C.clean(df)
    assert out.columns == ["i", "l", "f", "d"]
    assert {f.dataType.simpleString() for f in out.schema.fields} == {"double"}


def test_errors(spark):
    empty = spark.createDataFrame([], "a double")
    text = spark.createDataFrame([("x",)], "t string")
    nulls = spark.createDataFrame([(None, 1.0)], "a double, b double")
    for call in (C.clean, C.prepare):
        with pytest.raises(ValueError, match="Input DataFrame is empty or None"):
            call(None)
        with pytest.raises(ValueError, match="Input DataFrame is empty or None"):
            call(empty)
        with pytest.raises(ValueError, match="No numeric columns with valid finite values found"):
            call(text)
        with pytest.raises(ValueError, match="No numeric columns with valid finite values found"):
            call(nulls)
    with pytest.raises(ValueError, match=r"no columns named \['z'\]"):
        C.select_columns(nulls, ["a", "z"])


def test_standardize_uses_population_std(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0)], "id bigint, a double, b double")
    got = {r["id"]: (r["a"], r["b"]) for r in C.standardize(C.prepare(df, "id")).collect()}
    assert got == {1: (-1.0, 0.0), 2: (1.0, 0.0)}


def test_row_positions_are_consecutive(spark):
    df = spark.range(0, 1000, 1, 7).withColumn("v", F.col("id") * 2)
    rows = C.with_row_positions(df).collect()
    assert sorted(r["row_id"] for r in rows) == list(range(1000))
    assert all(r["row_id"] == r["id"] for r in rows)


def test_csv_types_and_missing_words(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("a,b,c,flag,e\n1,x,1e3,True,NA\n NA,y,-inf,False,\n2.5,z,.5,True,null\n")
    path.write_text(path.read_text().replace(" NA", "NA"))
    df = read_csv(spark, str(path))
    kinds = dict(df.dtypes)
    assert kinds == {"a": "double", "b": "string", "c": "double", "flag": "string", "e": "double"}
    rows = df.collect()
    assert [r["a"] for r in rows] == [1.0, None, 2.5]
    assert [r["c"] for r in rows] == [1000.0, -INF, 0.5]
    assert [r["e"] for r in rows] == [None] * 3
    assert read_csv(spark, str(path), ["b", "a"]).columns == ["b", "a"]


def test_sinks_never_overwrite(spark, tmp_path):
    df = spark.range(3)
    for fmt in ("csv", "json", "parquet"):
        target = str(tmp_path / fmt)
        write_table(df, target, fmt)
        with pytest.raises(Exception, match="(?i)already exists"):
            write_table(df, target, fmt)
    with pytest.raises(ValueError):
        write_table(df, str(tmp_path / "x"), "xml")


@pytest.mark.parametrize("seed", range(3))
def test_sample_dataset_has_the_asked_share(spark, seed):
    draw = random.Random(100 + seed)
    n, share, width = draw.randint(5, 400), draw.uniform(0, 0.5), draw.randint(1, 6)
    df = sample_dataset(spark, n, width, share)
    assert df.count() == n
    assert abs(df.agg(F.sum("is_anomaly")).first()[0] - n * share) <= 1
    assert df.filter("integer_feature not between 1 and 99").isEmpty()


def test_sample_dataset_moments(spark):
    df = sample_dataset(spark, 20_000, 2, 0.5)
    rows = {r["is_anomaly"]: r for r in df.groupBy("is_anomaly").agg(F.avg("feature_0").alias("m"), F.var_pop("feature_0").alias("v")).collect()}
    assert abs(rows[0.0]["m"]) < 0.05 and abs(rows[0.0]["v"] - 1) < 0.08
    assert abs(rows[1.0]["m"] - 3) < 0.08 and abs(rows[1.0]["v"] - 2) < 0.15
