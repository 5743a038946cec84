"""Queries over the driver's tables, one per operator. Each takes (spark, folder)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outvote.functions.frame import Features
from outvote.functions.parameters import histogram_bins, knn_neighbours
from outvote.functions.ranks import cumulative_counts
from outvote.functions.selection import percentiles
from outvote.operators import clean as C
from outvote.operators import forest, neighbourhood, pair_distances, projection, robust, statistical, subspace
from outvote.operators import svm as svm_
from outvote.operators import votes as V
from outvote.operators.knn_join import Limits, nearest_others
from outvote.plans.report import picture_tables, report_tables
from outvote.plans.run import detect_outliers, run_all
from outvote.sources.tables import read_csv, read_parquet, write_table
from outvote.staging import shared_folder, stage

SHARE = 0.05
INNE_SUBSPACES = [[0, 1], [1, 2], [2, 3], [0, 3], [1, 3]]
VOTERS = ["zscore", "hbos", "copod", "ecod"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{folder}/{name}.parquet")


# ---- feature tables -------------------------------------------------------------


def customer_profile(spark: SparkSession, folder: str) -> Features:
    """Order count, sum, mean and maximum per customer."""
    price = F.col("o_totalprice").cast("decimal(18,2)")
    total = F.sum(price).cast("double")
    orders = table(spark, folder, "orders")
    profile = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.round(total, 6).alias("total_price"),
        F.round(total / F.count(F.lit(1)), 6).alias("mean_price"),
        F.round(F.max("o_totalprice"), 6).alias("top_price"),
    )
    return C.prepare(profile, "o_custkey")


def events_features(spark: SparkSession, folder: str) -> Features:
    events = table(spark, folder, "events")
    return C.prepare(events.select("event_id", "value", F.hour("ts").alias("hour_of_day")), "event_id", staged=False)


def events_value(spark: SparkSession, folder: str) -> Features:
    return C.prepare(table(spark, folder, "events").select("event_id", "value"), "event_id", staged=False)


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lineitem_measures(spark: SparkSession, folder: str) -> Features:
    return C.prepare(table(spark, folder, "lineitem").select(*MEASURES), staged=False)


def lineitem_with_ids(spark: SparkSession, folder: str) -> Features:
    return C.prepare(table(spark, folder, "lineitem").select(*MEASURES), assign_ids=True)


def part_features(spark: SparkSession, folder: str) -> Features:
    return C.prepare(table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey")


def documents_features(spark: SparkSession, folder: str) -> Features:
    spaces = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    documents = table(spark, folder, "documents")
    return C.prepare(documents.select("doc_id", "n_chars", spaces.alias("n_spaces")), "doc_id")


def embeddings_8(spark: SparkSession, folder: str) -> Features:
    entries = [F.col("embedding")[i].alias(f"e{i}") for i in range(8)]
    return C.prepare(table(spark, folder, "embeddings").select("vec_id", *entries), "vec_id")


def embeddings_64(spark: SparkSession, folder: str) -> Features:
    entries = [F.col("embedding")[i].alias(f"e{i}") for i in range(64)]
    return C.prepare(table(spark, folder, "embeddings").select("vec_id", *entries), "vec_id")


def customer_accounts(spark: SparkSession, folder: str) -> Features:
    customers = table(spark, folder, "customer")
    return C.prepare(customers.select("c_custkey", "c_acctbal", "c_nationkey"), "c_custkey")


def orders_features(spark: SparkSession, folder: str) -> Features:
    days = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date"))
    return C.prepare(table(spark, folder, "orders").select("o_orderkey", "o_totalprice", days.alias("day")), "o_orderkey")


def parts_by_name(spark: SparkSession, folder: str) -> Features:
    """Parts under a text id, features with dots in their names."""
    parts = table(spark, folder, "part")
    key = F.format_string("part %09d", "p_partkey").alias("part.id")
    return C.prepare(parts.select(key, F.col("p_size").alias("p.size"), F.col("p_retailprice").alias("p.price")), "part.id")


def named_parts_query(detector):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        flagged = detector(parts_by_name(spark, folder), SHARE)
        return flagged.select(F.col("`part.id`").alias("part_id"), F.round("score", 6).alias("score"), "is_outlier")

    return run


# ---- shared shapes ---------------------------------------------------------------


def _shown(flagged: DataFrame, *keys: str) -> DataFrame:
    return flagged.select(*keys, F.round("score", 6).alias("score"), "is_outlier")


def detector_query(features_of, detector, **settings):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        features = features_of(spark, folder)
        keys = [features.id_col] if features.id_col and features_of is not lineitem_with_ids else features.cols
        return _shown(detector(features, SHARE, **settings), *keys)

    return run


def voters(spark: SparkSession, folder: str):
    return run_all(customer_profile(spark, folder), VOTERS, SHARE)


# ---- cleaning and statistics -----------------------------------------------------


def clean_finite(spark, folder):
    """Rows with a null, a NaN or an infinity in any numeric column are dropped."""
    lines = table(spark, folder, "lineitem")
    holed = lines.select(
        "l_orderkey",
        F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_extendedprice")).alias("price"),
        F.when(F.col("l_tax") == 0, F.lit(float("-inf"))).otherwise(F.col("l_tax")).alias("tax"),
        F.when(F.col("l_linenumber") != 7, F.col("l_linenumber")).alias("line"),
        "l_returnflag",
    )
    return C.clean(holed)


def numeric_projection(spark, folder):
    return C.clean(table(spark, folder, "part"))


def column_subset(spark, folder):
    return C.select_columns(table(spark, folder, "supplier"), ["s_suppkey", "s_acctbal"])


def standardize(spark, folder):
    features = customer_profile(spark, folder)
    return C.standardize(features).select("o_custkey", *[F.round(c, 6).alias(c) for c in features.cols])


def feature_profile(spark, folder):
    profile = C.feature_profile(lineitem_measures(spark, folder))
    return profile.select("feature", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")])


def row_positions(spark, folder):
    return C.with_row_positions(table(spark, folder, "nation").select("n_nationkey"))


def csv_scan(spark, folder):
    """Parts written as CSV with missing-value words, read back with types found again."""
    parts = table(spark, folder, "part")
    size = F.when(F.col("p_size") % 10 == 3, F.lit("NA")).otherwise(F.col("p_size").cast("string"))
    path = f"{shared_folder(spark)}/outvote/{spark.sparkContext.applicationId}/csv-{uuid.uuid4().hex}"
    write_table(parts.select("p_partkey", "p_name", size.alias("p_size"), "p_retailprice"), path, "csv")
    return read_csv(spark, path)


def percentile_prices(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_extendedprice")
    fractions = [0.5, 0.8, 0.85, 0.9, 0.95, 0.98]
    values = percentiles(lines, "l_extendedprice", fractions, lines.count())
    return spark.createDataFrame(list(zip(fractions, values)), "fraction double, value double").withColumn(
        "value", F.round("value", 6)
    )


def histogram_events(spark, folder):
    features = events_features(spark, folder)
    return statistical.histograms(features, histogram_bins(features.n))


def ranks_lineitem(spark, folder):
    """Average rank and empirical distribution of every distinct value."""
    features = lineitem_measures(spark, folder)
    counts, _ = cumulative_counts(features)
    return counts.select(
        "f", "v", "cnt", (F.col("cum") - (F.col("cnt") - 1) / 2.0).alias("avg_rank"),
        F.round(F.col("cum") / F.lit(float(features.n)), 9).alias("ecdf"),
    )


def neighbours_customers(spark, folder):
    features = customer_profile(spark, folder)
    lists = nearest_others(features, 10)
    entries = lists.select("point", F.posexplode(F.arrays_zip("nbrs", "dists")).alias("pos", "e"))
    return entries.select(
        F.col("point").alias("o_custkey"), (F.col("pos") + 1).alias("place"),
        F.col("e.nbrs").alias("neighbour"), F.round("e.dists", 6).alias("dist"),
    )


def knn_parts_partitioned(spark, folder):
    """The large-table route of the neighbour join, on a table small enough to check."""
    features = part_features(spark, folder)
    part = max(1, features.n // 16)
    limits = Limits(broadcast_points=0, leaf_points=part, visitors_per_task=part)
    k = knn_neighbours(features.n) - 1
    features._neighbours = (k, nearest_others(features, k, limits))
    return _shown(neighbourhood.knn(features, SHARE), "p_partkey")


def mean_distance_orders(spark, folder):
    """Flags alone: rows far from the threshold have bounds for a score."""
    flagged = pair_distances.mean_distance(orders_features(spark, folder), SHARE, cheap=0)
    return flagged.select("o_orderkey", "is_outlier")


# ---- votes and reports -----------------------------------------------------------


def votes(spark, folder):
    return voters(spark, folder).votes


def flags(spark, folder):
    return voters(spark, folder).flags.select("row_id", "detector", F.round("score", 6).alias("score"), "is_outlier")


def wide_flags(spark, folder):
    return V.wide_flags(voters(spark, folder).flags, VOTERS)


def consensus(spark, folder):
    return V.consensus(voters(spark, folder).votes, V.default_threshold(len(VOTERS)))


def consensus_mask(spark, folder):
    run = voters(spark, folder)
    rows = run.features.df.select(F.col("o_custkey").alias("row_id"))
    return V.consensus_mask(rows, run.votes, V.default_threshold(len(VOTERS)))


def remove_outliers(spark, folder):
    run = voters(spark, folder)
    chosen = V.consensus(run.votes, V.default_threshold(len(VOTERS)))
    return V.remove_outliers(run.features.df, chosen, "o_custkey")


def votes_after_removal(spark, folder):
    run = voters(spark, folder)
    kept = V.remove_outliers(run.features.df, V.consensus(run.votes, 2), "o_custkey")
    return V.votes(V.restrict_flags(run.flags, kept, "o_custkey"))


def confidence_tier(spark, folder):
    return V.confidence(V.consensus(voters(spark, folder).votes, 2), len(VOTERS))


def agreement_distribution(spark, folder):
    return V.agreement_distribution(V.consensus(voters(spark, folder).votes, 2), len(VOTERS))


def threshold_sweep(spark, folder):
    return V.threshold_sweep(voters(spark, folder).votes, len(VOTERS))


def max_agreement(spark, folder):
    return V.max_agreement(voters(spark, folder).votes)


def top_consensus(spark, folder):
    return V.top_consensus(stage(V.consensus(voters(spark, folder).votes, 2), "consensus"))


def best_without_consensus(spark, folder):
    return V.best_without_consensus(stage(voters(spark, folder).votes, "votes"))


def detector_stats(spark, folder):
    stats = V.detector_stats(voters(spark, folder).flags, SHARE)
    doubles = ["actual_contamination", "expected_contamination", "contamination_difference"]
    return stats.select(
        "detector", "n_outliers", "n_inliers", *[F.round(c, 9).alias(c) for c in doubles], "detection_rate_pct"
    )


def total_outliers(spark, folder):
    return V.total_outliers(V.detector_stats(voters(spark, folder).flags, SHARE))


def precision_vs_labels(spark, folder):
    features = documents_features(spark, folder)
    run = run_all(features, ["zscore", "ecod"], SHARE)
    labels = table(spark, folder, "labels").select("doc_id", (F.col("toxic") == 1).alias("bad"))
    found = V.evaluate(V.consensus(run.votes, 1), labels, "bad", "doc_id")
    return found.withColumn("precision", F.round("precision", 9))


def report_consensus(spark, folder):
    """The consensus table of the report, strongest agreement first."""
    return report_tables(voters(spark, folder), 2)["consensus"]


def run_all_customers(spark, folder):
    """All twelve detectors: the per-detector table of the report."""
    run = run_all(customer_profile(spark, folder), None, SHARE)
    return run.stats().drop("execution_time")


def run_metadata(spark, folder):
    metadata = voters(spark, folder).metadata()
    lists = ["algorithms_requested", "algorithms_successful", "algorithms_failed"]
    return metadata.select(*[F.array_join(c, ",").alias(c) if c in lists else c for c in metadata.columns])


def pipeline_events(spark, folder):
    """Scan to consensus with estimated contamination."""
    events = table(spark, folder, "events").select("event_id", "value", F.hour("ts").alias("hour_of_day"), "event_type")
    found = detect_outliers(spark, events, ["zscore", "hbos", "ecod", "isoforest", "mcd"], id_col="event_id")
    return found.report["consensus"]


def contamination_estimate(spark, folder):
    share = forest.estimate_contamination(events_features(spark, folder))
    return spark.createDataFrame([(share,)], "contamination double")


# ---- projections -----------------------------------------------------------------


def pca_projection(spark, folder):
    projected = projection.project(events_features(spark, folder), 2)
    return projected.select("event_id", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


def explained_variance(spark, folder):
    table_ = projection.explained_variance(events_features(spark, folder), 2)
    return table_.withColumn("ratio", F.round("ratio", 9))


def projection_table(spark, folder):
    """Projected rows with their flag, as a picture would show them."""
    features = customer_profile(spark, folder)
    flagged = statistical.zscore(features, SHARE)
    return projection.projection_table(features, flagged, 3)


def projection_table_events(spark, folder):
    """Projected events with their flag, on the two features there are."""
    features = events_features(spark, folder)
    shown = projection.projection_table(features, statistical.zscore(features, SHARE), 2)
    return shown.select("event_id", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"), "is_outlier")


def picture_stats(spark, folder):
    features = events_features(spark, folder)
    stats = projection.picture_stats(features, statistical.zscore(features, SHARE))
    return stats.select(*[F.round(c, 6).alias(c) for c in stats.columns])


def outlier_preserving_sample(spark, folder):
    """All flagged customers, and seeded unflagged ones up to half the table."""
    features = customer_profile(spark, folder)
    flagged = statistical.zscore(features, SHARE).select("o_custkey", "is_outlier")
    return projection.outlier_preserving_sample(flagged, "o_custkey", features.n // 2)


def hex_density(spark, folder):
    points = events_features(spark, folder).df
    cells = projection.hex_density(points, "value", "hour_of_day")
    return cells.select("lattice", "ix", "iy", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "n")


def convex_hull(spark, folder):
    return projection.convex_hull(events_features(spark, folder).df, "value", "hour_of_day")


def picture_summary(spark, folder):
    return picture_tables(voters(spark, folder))["summary"]


QUERIES = {
    "clean_finite": clean_finite,
    "numeric_projection": numeric_projection,
    "column_subset": column_subset,
    "standardize": standardize,
    "feature_profile": feature_profile,
    "row_positions": row_positions,
    "csv_scan": csv_scan,
    "percentile_prices": percentile_prices,
    "histogram_events": histogram_events,
    "ranks_lineitem": ranks_lineitem,
    "neighbours_customers": neighbours_customers,
    "zscore_lineitem": detector_query(lineitem_measures, statistical.zscore),
    "zscore_events": detector_query(events_features, statistical.zscore),
    "zscore_customers": detector_query(customer_profile, statistical.zscore),
    "max_abs_z_fallback": detector_query(customer_accounts, statistical.max_abs_z),
    "hbos_events": detector_query(events_features, statistical.hbos),
    "hbos_customers": detector_query(customer_profile, statistical.hbos),
    "hbos_lineitem": detector_query(lineitem_measures, statistical.hbos),
    "hbos_own_bin": detector_query(events_value, statistical.hbos, own_bin=True),
    "copod_customers": detector_query(customer_profile, statistical.copod),
    "copod_lineitem": detector_query(lineitem_measures, statistical.copod),
    "ecod_customers": detector_query(customer_profile, statistical.ecod),
    "ecod_lineitem": detector_query(lineitem_measures, statistical.ecod),
    "knn_customers": detector_query(customer_profile, neighbourhood.knn),
    "knn_parts": detector_query(part_features, neighbourhood.knn),
    "knn_parts_partitioned": knn_parts_partitioned,
    "knn_lineitem": detector_query(lineitem_with_ids, neighbourhood.knn),
    "knn_embeddings": detector_query(embeddings_8, neighbourhood.knn),
    "knn_embeddings_whole": detector_query(embeddings_64, neighbourhood.knn),
    "lof_customers": detector_query(customer_profile, neighbourhood.lof),
    "lof_documents": detector_query(documents_features, neighbourhood.lof),
    "dbscan_customers": detector_query(customer_profile, neighbourhood.dbscan),
    "dbscan_documents": detector_query(documents_features, neighbourhood.dbscan),
    "dbscan_parts": detector_query(part_features, neighbourhood.dbscan),
    "zscore_named_parts": named_parts_query(statistical.zscore),
    "knn_named_parts": named_parts_query(neighbourhood.knn),
    "lof_named_parts": named_parts_query(neighbourhood.lof),
    "dbscan_named_parts": named_parts_query(neighbourhood.dbscan),
    "inne_customers_t5": detector_query(customer_profile, subspace.inne, rounds=5, subspaces=INNE_SUBSPACES),
    "inne_customers": detector_query(customer_profile, subspace.inne),
    "mean_distance_fallback": detector_query(customer_accounts, pair_distances.mean_distance, every_score=True),
    "mean_distance_orders": mean_distance_orders,
    "elliptic_2d": detector_query(events_features, robust.elliptic, steps=3),
    "mcd_2d": detector_query(events_features, robust.mcd, steps=3),
    "elliptic_events": detector_query(events_features, robust.elliptic),
    "mcd_customers": detector_query(customer_profile, robust.mcd),
    "isoforest_events": detector_query(events_features, forest.isoforest),
    "isoforest_lineitem": detector_query(lineitem_with_ids, forest.isoforest),
    "isoforest_customers": detector_query(customer_profile, forest.isoforest),
    "svm_customers": detector_query(customer_profile, svm_.svm),
    "contamination_estimate": contamination_estimate,
    "flags": flags,
    "wide_flags": wide_flags,
    "votes": votes,
    "consensus": consensus,
    "consensus_mask": consensus_mask,
    "remove_outliers": remove_outliers,
    "votes_after_removal": votes_after_removal,
    "confidence_tier": confidence_tier,
    "agreement_distribution": agreement_distribution,
    "threshold_sweep": threshold_sweep,
    "max_agreement": max_agreement,
    "top_consensus": top_consensus,
    "best_without_consensus": best_without_consensus,
    "detector_stats": detector_stats,
    "total_outliers": total_outliers,
    "precision_vs_labels": precision_vs_labels,
    "report_consensus": report_consensus,
    "run_all_customers": run_all_customers,
    "run_metadata": run_metadata,
    "pipeline_events": pipeline_events,
    "pca_projection": pca_projection,
    "explained_variance": explained_variance,
    "projection_table": projection_table,
    "projection_table_events": projection_table_events,
    "picture_stats": picture_stats,
    "picture_summary": picture_summary,
    "outlier_preserving_sample": outlier_preserving_sample,
    "hex_density": hex_density,
    "convex_hull": convex_hull,
}
