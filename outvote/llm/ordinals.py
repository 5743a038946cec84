"""Places of rows within their groups, however large a group is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from outvote.staging import stage


def numbered(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """rows, staged, with `__row` (unique), `__index` (0, 1, ... within the group, which is
    not null) and `__n` (rows of the group). A group may span any number of ranges: each
    range counts its own rows, and only the counts are added up."""
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    ranged = stage(
        ranged.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}), label
    )
    counts = ranged.groupBy(group, "__part").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__count"))
    # a row for each range and group that meet
    parts = Window.partitionBy(group).orderBy("__part")
    offsets = counts.select(
        group,
        "__part",
        (F.sum("__count").over(parts) - F.col("__count") - F.col("__first")).alias("__shift"),
        F.sum("__count").over(Window.partitionBy(group)).alias("__n"),
    )
    placed = ranged.join(offsets, [group, "__part"])
    return placed.withColumn("__index", F.col("__row") + F.col("__shift")).drop("__part", "__shift")
