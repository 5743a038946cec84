import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from outvote.functions.selection import flag_top, order_statistics, percentiles, quantile_position


def column(spark, values, parts=4):
    rows = [(i, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id bigint, v double").repartition(parts).cache()


@pytest.mark.parametrize("limit", [20, 1_000_000])
def test_order_statistics_match_sorting(spark, limit):
    rng = np.random.default_rng(0)
    hot = np.where(rng.random(3000) < 0.4, 7.0, rng.standard_normal(3000))
    cases = {
        "plain": rng.standard_normal(3000),
        "ties": rng.integers(0, 3, 3000),
        "one third hot": hot,
        "two values": np.repeat([1.0, 2.0], 1500),
        "constant": np.full(3000, 2.5),
        "wide": np.exp(rng.standard_normal(3000) * 30),
    }
    for name, values in cases.items():
        n = len(values)
        positions = [0, 1, n // 3, n // 2, int(n * 0.95), n - 1]
        got = order_statistics(column(spark, values), "v", positions, n, exact_limit=limit)
        assert got == [np.sort(values)[p] for p in positions], name


def test_percentiles_interpolate(spark):
    values = np.random.default_rng(1).standard_normal(777)
    fractions = [0.0, 0.5, 0.8, 0.85, 0.9, 0.95, 0.98, 1.0]
    got = percentiles(column(spark, values), "v", fractions, len(values))
    assert np.allclose(got, np.percentile(values, [f * 100 for f in fractions]), rtol=0, atol=1e-12)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-4, 4), min_size=1, max_size=60), st.sampled_from([0.0, 0.01, 0.05, 0.1, 0.25, 0.4, 0.5]))
def test_lower_order_statistic_gives_the_percentile_mask(values, c):
    x = np.array(values, float)
    k = quantile_position(len(x), c)
    expected = x > np.percentile(x, (1 - c) * 100)
    assert ((x > np.sort(x)[k]) == expected).all()


def test_flags_are_strictly_above_and_bounded(spark):
    values = np.random.default_rng(2).integers(0, 50, 400).astype(float)
    for c in (0.0, 0.05, 0.5):
        flagged = flag_top(column(spark, values), c, 400, "v").filter("is_outlier").select("v").collect()
        assert len(flagged) == (values > np.percentile(values, (1 - c) * 100)).sum()
        assert len(flagged) <= 399 - math.floor(399 * (1 - c))


def test_mask_does_not_depend_on_order_or_partitions(spark):
    values = np.random.default_rng(3).standard_normal(500)
    df = column(spark, values)
    sets = [
        {r["id"] for r in flag_top(d, 0.1, 500, "v").filter("is_outlier").collect()}
        for d in (df, df.orderBy(F.rand(1)), df.repartition(9, "v"))
    ]
    assert sets[0] == sets[1] == sets[2]
