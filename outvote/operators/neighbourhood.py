"""Detectors that read the neighbour table: knn, lof, dbscan."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outvote.functions import parameters
from outvote.functions.frame import Features
from outvote.functions.lookup import BROADCAST_ROWS, lookup_join
from outvote.functions.selection import flag_top, percentiles
from outvote.functions.text import name, significant
from outvote.operators.knn_join import kth_distance
from outvote.staging import stage

EPS_PERCENTILES = [0.80, 0.85, 0.90, 0.95, 0.98]  # fixed values: radii tried in this order


def any_id(detector):
    """Neighbours are told apart by whole numbers. Rows with other ids are numbered for the
    detector, and the result gets their ids back."""

    @wraps(detector)
    def run(features: Features, *args, **kwargs) -> DataFrame:
        if features.integer_id:
            return detector(features, *args, **kwargs)
        inner, ids = features.numbered
        found = detector(inner, *args, **kwargs)
        made = [c for c in found.columns if c not in inner.df.columns]
        back = found.join(ids, "__number")
        return back.select(*map(name, [*features.df.columns, *made]))

    return run


def _to_rows(features: Features, scored: DataFrame) -> DataFrame:
    """Give every table row the score of its point. scored: point, features..., rows, score."""
    own = [*map(name, features.df.columns), "score"]
    # a point of one row is that row; only rows that are equal to others look theirs up
    key = F.col("point").cast(features.df.schema[features.id_col].dataType).alias(features.id_col)
    single = scored.filter("rows = 1").select(key, *map(name, features.cols), "score").select(*own)
    table = scored.filter("rows > 1").select(*map(name, features.cols), "rows", "score")
    counted = table.agg(F.count(F.lit(1)).alias("points"), F.sum("rows").alias("rows")).first()
    if not counted["points"]:
        return single
    joined = lookup_join(
        features.df, table, features.cols, counted["points"], counted["rows"], "rows", F.col(name(features.id_col))
    )
    return stage(single.unionByName(joined.select(*own)), "point-scores")


def _nth_distance(others: int):
    return F.lit(0.0) if others < 1 else F.col("dists")[others - 1]


def knn_scores(features: Features, k: int | None = None) -> DataFrame:
    """Distance to the k-th nearest row, the row itself counting as the first."""
    others = (parameters.knn_neighbours(features.n) if k is None else k) - 1
    if 1 <= others < features.n and not features.lists_wanted:
        return _to_rows(features, kth_distance(features, others).withColumnRenamed("dist", "score"))
    table = features.neighbours(others)
    return _to_rows(features, table.withColumn("score", _nth_distance(others)))


@any_id
def knn(features: Features, contamination: float, seed: int = 0, k: int | None = None) -> DataFrame:
    return flag_top(knn_scores(features, k), contamination, features.n)


def _join_neighbour(edges: DataFrame, values: DataFrame, points: int, k: int) -> DataFrame:
    """Edges with a value of their neighbour. A point may be the neighbour of very many
    others, so a large join is salted by how often each neighbour occurs."""
    if points <= BROADCAST_ROWS:
        return lookup_join(edges, values, "nbr", points, 0)
    uses = edges.groupBy("nbr").agg(F.count(F.lit(1)).alias("uses"))
    return lookup_join(edges, values.join(uses, "nbr"), "nbr", points, points * k, "uses", F.col("point"))


def lof_scores(features: Features, k: int | None = None) -> DataFrame:
    """Local outlier factor: mean density of the k nearest other rows over the own density."""
    if features.n < 2:
        raise ValueError("lof needs at least two rows")
    k = parameters.lof_neighbours(features.n) if k is None else k
    table = features.neighbours(k)
    points = table.count()
    kdist = table.select(F.col("point").alias("nbr"), _nth_distance(k).alias("kdist"))
    pairs = F.explode(F.slice(F.arrays_zip("nbrs", "dists"), 1, k))
    edges = table.select("point", pairs.alias("e")).select(
        "point", F.col("e.nbrs").alias("nbr"), F.col("e.dists").alias("dist")
    )
    reach = F.avg(F.greatest("dist", "kdist"))
    density = _join_neighbour(edges, kdist, points, k).groupBy("point").agg((1 / (reach + F.lit(1e-10))).alias("lrd"))
    density = stage(density, "lof-density")
    around = _join_neighbour(edges.drop("dist"), density.withColumnRenamed("point", "nbr"), points, k)
    mean = around.groupBy("point").agg(F.avg("lrd").alias("mean"))
    factor = mean.join(density, "point").select("point", F.expr(significant("mean / lrd")).alias("score"))
    scored = table.select("point", *map(name, features.cols), "rows").join(factor, "point")
    return _to_rows(features, stage(scored, "lof"))


@any_id
def lof(features: Features, contamination: float, seed: int = 0, k: int | None = None) -> DataFrame:
    return flag_top(lof_scores(features, k), contamination, features.n)


def density_radius(features: Features, neighbours: int, min_samples: int) -> DataFrame:
    """(features.df columns, score, spread) on scaled features.

    score is the smallest radius at which the row is not noise: either it is a core row
    itself (min_samples rows within the radius), or some core row is within the radius.
    spread is the distance to its `neighbours`-th nearest row, itself included. A row
    that is not core has fewer than min_samples rows in reach, all in its list, so the
    lists decide noise for every radius without a range join or clustering."""
    scaled = features.scaled
    table = scaled.neighbours(neighbours - 1)
    points = table.count()
    core = table.select(F.col("point").alias("nbr"), _nth_distance(min_samples - 1).alias("core"))
    edges = table.select("point", F.explode(F.arrays_zip("nbrs", "dists")).alias("e")).select(
        "point", F.col("e.nbrs").alias("nbr"), F.col("e.dists").alias("dist")
    )
    reached = _join_neighbour(edges, core, points, neighbours).groupBy("point").agg(
        F.min(F.greatest("dist", "core")).alias("reached")
    )
    scored = (
        table.withColumn("core", _nth_distance(min_samples - 1))
        .withColumn("spread", _nth_distance(neighbours - 1))
        .join(reached, "point")
        .select("point", *map(name, features.cols), "rows", F.least("core", "reached").alias("score"), "spread")
    )
    if points == features.n:
        rows = scored.withColumnRenamed("point", features.id_col).select(*map(name, scaled.df.columns), "score", "spread")
    else:
        table = stage(scored.drop("point"), "dbscan-points")
        rows = lookup_join(scaled.df, table, features.cols, points, features.n, "rows", F.col(name(features.id_col)))
    # scaling leaves its own noise in the last bits, and equal distances must tie
    tied = [F.expr(significant(c)).alias(c) for c in ("score", "spread")]
    return stage(rows.select(*map(name, scaled.df.columns), *tied), "dbscan")


@any_id
def dbscan(
    features: Features,
    contamination: float,
    seed: int = 0,
    neighbours: int | None = None,
    min_samples: int | None = None,
) -> DataFrame:
    """Noise rows at the first radius whose noise share fits the contamination.
    Feature columns of the result are the scaled ones."""
    n = features.n
    neighbours = neighbours or parameters.dbscan_neighbours(n)
    min_samples = min_samples or parameters.dbscan_min_samples(n)
    if neighbours > n:
        raise ValueError(f"dbscan needs at least {neighbours} rows, got {n}")
    scored = density_radius(features, neighbours, min_samples)
    radii = percentiles(scored, "spread", EPS_PERCENTILES, n)
    noise = [F.avg((F.col("score") > F.lit(r)).cast("double")).alias(f"r{i}") for i, r in enumerate(radii)]
    rates = scored.agg(*noise).first()
    for i, radius in enumerate(radii):
        rate = rates[f"r{i}"]
        if abs(rate - contamination) < 0.1 or rate <= contamination * 2:
            break
    return scored.drop("spread").withColumn("is_outlier", F.col("score") > F.lit(radius))
