"""What the physical plans must and must not contain."""

import re

import numpy as np
import pytest

from outvote.operators import neighbourhood, statistical
from outvote.operators.votes import votes
from outvote.plans import queries as Q


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


FOLDER = "/root/testdata/sf0.001"


def test_scans_read_only_used_columns(spark):
    features = Q.lineitem_measures(spark, FOLDER)
    scan = plan(statistical.zscore(features.subset(["l_quantity", "l_tax"]), 0.05).select("l_quantity", "score"))
    assert "PushedFilters: [IsNotNull" not in scan or "l_shipdate" not in scan
    schema = re.findall(r"ReadSchema: struct<([^>]*)>", scan)[0]
    assert "l_returnflag" not in schema and "l_orderkey" not in schema


@pytest.mark.parametrize("detector", [statistical.zscore, statistical.hbos])
def test_row_wise_detectors_do_not_shuffle(spark, detector):
    text = plan(detector(Q.lineitem_measures(spark, FOLDER), 0.05))
    assert "Exchange" not in text and "Python" not in text and "Arrow" not in text


@pytest.mark.parametrize("detector", [statistical.copod, statistical.ecod, neighbourhood.knn, neighbourhood.lof, neighbourhood.dbscan])
def test_no_single_partition_or_cross_join(spark, detector):
    text = plan(detector(Q.part_features(spark, FOLDER), 0.05))
    assert "SinglePartition" not in text and "Cartesian" not in text and "NestedLoop" not in text


def test_large_rank_route_has_no_single_partition(frame):
    from outvote.functions.ranks import value_counts

    features = frame(np.random.default_rng(0).standard_normal((50, 2)))
    text = plan(value_counts(features).repartitionByRange("f", "v"))
    assert "rangepartitioning" in text and "SinglePartition" not in text
    assert "partial_count" in text


def test_votes_shuffle_only_flagged_rows(spark):
    flags = spark.createDataFrame([(1, "a", 0.1, True)], "row_id bigint, detector string, score double, is_outlier boolean")
    text = plan(votes(flags))
    assert text.index("Exchange") < text.index("is_outlier") and "partial_count" in text
