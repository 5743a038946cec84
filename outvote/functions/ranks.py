"""Per-feature value counts with running totals: ranks and empirical distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outvote.functions.frame import Features
from outvote.functions.text import name
from outvote.staging import stage

# Up to this many rows a feature's values are ordered in one window partition.
WINDOW_ROWS = 1_000_000


def value_counts(features: Features) -> DataFrame:
    """(feature index, value, cnt): pre-aggregated before the shuffle, so copies of a
    hot value never travel."""
    pairs = ", ".join(f"named_struct('f', {i}, 'v', {name(c)})" for i, c in enumerate(features.cols))
    return features.df.select(F.expr(f"explode(array({pairs})) as p")).groupBy("p.f", "p.v").agg(F.count(F.lit(1)).alias("cnt"))


def cumulative_counts(features: Features, window_rows: int = WINDOW_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """(f, v, cnt, cum) with cum = rows of that feature with a value <= v, staged, and
    the number of distinct values per feature.

    Large inputs are range-partitioned on (f, v); one running sum inside each range
    plus the preceding ranges' totals gives the global running sum. Values are unique
    after counting, so no range can be made heavy by a repeated value."""
    counts = value_counts(features)
    if features.n <= window_rows:
        order = Window.partitionBy("f").orderBy("v")
        table = stage(counts.withColumn("cum", F.sum("cnt").over(order)), "ranks")
    else:
        ranged = stage(
            counts.repartitionByRange("f", "v").withColumn("part", F.spark_partition_id()), "value-counts"
        )
        totals = ranged.groupBy("f", "part").agg(F.sum("cnt").alias("total"))
        # one row per (feature, range): bounded by the partition count, not by the data
        before = Window.partitionBy("f").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select("f", "part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
        inside = Window.partitionBy("f", "part").orderBy("v")
        table = stage(
            ranged.withColumn("__inside", F.sum("cnt").over(inside))
            .join(F.broadcast(offsets), ["f", "part"])
            .select("f", "v", "cnt", (F.col("before") + F.col("__inside")).alias("cum")),
            "ranks",
        )
    distinct = {r["f"]: r["count"] for r in table.groupBy("f").count().collect()}
    return table, distinct
