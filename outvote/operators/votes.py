"""Vote counting, consensus and evaluation over a long (row_id, detector, is_outlier) table."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long_flags(flagged: dict[str, DataFrame], id_col: str) -> DataFrame:
    """One (row_id, detector, score, is_outlier) row per table row and detector."""
    parts = [
        df.select(F.col(id_col).alias("row_id"), F.lit(name).alias("detector"), "score", "is_outlier")
        for name, df in flagged.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def wide_flags(flags: DataFrame, detectors: list[str]) -> DataFrame:
    """One row per table row with a boolean column per detector."""
    return flags.groupBy("row_id").pivot("detector", detectors).agg(F.max("is_outlier"))


def votes(flags: DataFrame) -> DataFrame:
    """(row_id, n_votes) for rows flagged at least once. Only flagged rows shuffle."""
    return flags.filter("is_outlier").groupBy("row_id").agg(F.count(F.lit(1)).alias("n_votes"))


def default_threshold(n_detectors: int) -> int:
    return max(1, math.ceil(0.5 * n_detectors))


def check_threshold(threshold: int | None, n_detectors: int) -> int:
    if threshold is None:
        return default_threshold(n_detectors)
    if threshold < 1:
        raise ValueError("a row needs at least one vote: threshold >= 1")
    if threshold > n_detectors:
        raise ValueError(
            f"no row can get {threshold} votes from {n_detectors} detectors"
        )
    return threshold


def consensus(vote_table: DataFrame, threshold: int) -> DataFrame:
    return vote_table.filter(F.col("n_votes") >= threshold)


def consensus_mask(rows: DataFrame, vote_table: DataFrame, threshold: int) -> DataFrame:
    """Every row with is_consensus, false where no detector voted."""
    joined = rows.join(vote_table, "row_id", "left")
    return joined.withColumn("is_consensus", F.coalesce(F.col("n_votes"), F.lit(0)) >= threshold).drop("n_votes")


def remove_outliers(rows: DataFrame, consensus_rows: DataFrame, id_col: str = "row_id") -> DataFrame:
    named = consensus_rows.select(F.col("row_id").alias(id_col))
    return rows.join(named, id_col, "left_anti")


def restrict_flags(flags: DataFrame, kept: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Flags of the kept rows only, for counting votes again after a removal."""
    return flags.join(kept.select(F.col(id_col).alias("row_id")), "row_id", "left_semi")


def percent(n_votes: Column | str, n_detectors: int) -> Column:
    n_votes = F.col(n_votes) if isinstance(n_votes, str) else n_votes
    return F.bround(n_votes * F.lit(100.0) / F.lit(float(n_detectors)), 0).cast("bigint")


def confidence(consensus_rows: DataFrame, n_detectors: int) -> DataFrame:
    """(row_id, n_votes, consensus_pct, confidence), strongest agreement first in the sinks."""
    share = F.col("n_votes") / F.lit(float(n_detectors))
    # fixed values: the tier bounds and their names
    tier = F.when(share >= 0.8, "Very High").when(share >= 0.6, "High").otherwise("Moderate")
    return consensus_rows.select(
        "row_id", "n_votes", percent("n_votes", n_detectors).alias("consensus_pct"), tier.alias("confidence")
    )


def agreement_distribution(consensus_rows: DataFrame, n_detectors: int) -> DataFrame:
    return (
        consensus_rows.groupBy("n_votes")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("agreement_pct", percent("n_votes", n_detectors))
    )


def threshold_sweep(vote_table: DataFrame, n_detectors: int) -> DataFrame:
    """(threshold, n_rows): consensus size at every threshold, from one vote histogram."""
    spread = F.explode(F.sequence(F.lit(1), F.col("n_votes").cast("int"))).alias("threshold")
    histogram = vote_table.groupBy("n_votes").agg(F.count(F.lit(1)).alias("c"))
    counted = histogram.select("c", spread).groupBy("threshold").agg(F.sum("c").alias("n_rows"))
    every = vote_table.sparkSession.range(1, n_detectors + 1).select(F.col("id").cast("int").alias("threshold"))
    return every.join(counted, "threshold", "left").select("threshold", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def max_agreement(vote_table: DataFrame) -> DataFrame:
    """One row: the highest vote count and how many rows reach it (0, 0 without votes)."""
    histogram = vote_table.groupBy("n_votes").agg(F.count(F.lit(1)).alias("c"))
    top = histogram.agg(F.max(F.struct("n_votes", "c")).alias("m"))
    return top.select(
        F.coalesce("m.n_votes", F.lit(0)).alias("max_agreement"), F.coalesce("m.c", F.lit(0)).alias("n_rows")
    )


def shown_rows(count: int) -> int:
    """How many consensus rows a report lists: all up to 20, 10 up to 100, else 5."""
    return count if count <= 20 else 10 if count <= 100 else 5


def top_consensus(consensus_rows: DataFrame) -> DataFrame:
    """The report's list of strongest rows, ties by row_id."""
    return consensus_rows.orderBy(F.desc("n_votes"), "row_id").limit(shown_rows(consensus_rows.count()))


def best_without_consensus(vote_table: DataFrame) -> DataFrame:
    """When no row reaches the threshold: up to five rows at the highest agreement above one."""
    best = vote_table.agg(F.max("n_votes").alias("m")).first()["m"] or 0
    kept = vote_table.filter((F.col("n_votes") == best) & (F.col("n_votes") > 1))
    return kept.orderBy("row_id").limit(5)


def detector_stats(flags: DataFrame, contamination: float) -> DataFrame:
    """Per detector: flagged and unflagged rows, actual and expected share, difference, rate."""
    found = F.sum(F.col("is_outlier").cast("bigint"))
    rows = F.count(F.lit(1))
    counted = flags.groupBy("detector").agg(found.alias("n_outliers"), rows.alias("__n"))
    actual = F.col("n_outliers") / F.col("__n")
    return counted.select(
        "detector",
        "n_outliers",
        (F.col("__n") - F.col("n_outliers")).alias("n_inliers"),
        actual.alias("actual_contamination"),
        F.lit(float(contamination)).alias("expected_contamination"),
        (actual - F.lit(float(contamination))).alias("contamination_difference"),
        F.round(actual * 100, 2).alias("detection_rate_pct"),
    )


def total_outliers(stats: DataFrame) -> DataFrame:
    return stats.agg(F.coalesce(F.sum("n_outliers"), F.lit(0)).alias("total_outliers"))


def evaluate(consensus_rows: DataFrame, labels: DataFrame, label: str = "is_anomaly", id_col: str = "row_id") -> DataFrame:
    """Flagged rows, flagged rows whose label is true, and their ratio (null if none flagged).
    Rows without a label count as not anomalous."""
    truth = labels.select(F.col(id_col).alias("row_id"), F.col(label).cast("boolean").alias("__truth"))
    joined = consensus_rows.select("row_id").join(truth, "row_id", "left")
    hits = F.coalesce(F.sum(F.col("__truth").cast("bigint")), F.lit(0))
    return joined.agg(F.count(F.lit(1)).alias("flagged"), hits.alias("hits")).withColumn(
        "precision", F.when(F.col("flagged") > 0, F.col("hits") / F.col("flagged"))
    )
