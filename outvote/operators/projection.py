"""The data behind the report's pictures: principal components, samples, density, hulls."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outvote.functions import kernels
from outvote.functions.frame import Features
from outvote.functions.moments import covariance
from outvote.functions.sampling import first_by_key, sample_key
from outvote.functions.text import name
from outvote.operators.clean import with_row_positions
from outvote.staging import stage

# fixed values: sample sizes by table size, density grid, fewest inliers for a density
SHOW_ALL_ROWS, MEDIUM_ROWS = 50_000, 500_000
MEDIUM_SAMPLE, LARGE_INLIERS = 50_000, 30_000
DENSITY_GRID, DENSITY_MIN_INLIERS = 30, 50
# Hull vertices one task merges.
HULL_GROUP = 200_000


class Components:
    """Principal axes of unscaled data, fitted once and reused for every flag column."""

    def __init__(self, features: Features):
        values, vectors = np.linalg.eigh(covariance(features))
        order = np.argsort(values)[::-1]
        self.values = np.maximum(values[order], 0.0)
        axes = vectors[:, order].T
        # signs are arbitrary: the loading of largest magnitude is made positive
        lead = np.abs(axes).argmax(axis=1)
        self.axes = axes * np.sign(axes[np.arange(len(axes)), lead])[:, None]
        self.mean = features.profile.mean
        self.cols = features.cols

    def explained(self, dim: int) -> list[float]:
        total = self.values.sum()
        return [float(v / total) if total > 0 else 0.0 for v in self.values[:dim]]

    def columns(self, dim: int) -> list[Column]:
        out = []
        for axis in range(dim):
            total = F.lit(0.0)
            for c, m, w in zip(self.cols, self.mean, self.axes[axis]):
                total = total + (F.col(name(c)) - F.lit(float(m))) * F.lit(float(w))
            out.append(total.alias(f"pc{axis + 1}"))
        return out


def check_dimension(dim: int, d: int) -> None:
    if dim not in (2, 3):
        raise ValueError("Dimension must be 2 or 3")
    if d < dim:
        raise ValueError(f"{dim} components need at least {dim} features, got {d}")


def project(features: Features, dim: int = 2, components: Components | None = None) -> DataFrame:
    """(id, pc1, pc2[, pc3])."""
    check_dimension(dim, features.d)
    components = components or Components(features)
    ids = [name(features.id_col)] if features.id_col else []
    return features.df.select(*ids, *components.columns(dim))


def explained_variance(features: Features, dim: int = 2, components: Components | None = None) -> DataFrame:
    """(component, ratio) and, as the last row, component 0 with their total."""
    check_dimension(dim, features.d)
    ratios = (components or Components(features)).explained(dim)
    rows = [(i + 1, r) for i, r in enumerate(ratios)] + [(0, sum(ratios))]
    return features.df.sparkSession.createDataFrame(rows, "component int, ratio double")


def sample_target(n: int, n_outliers: int) -> int:
    """How many points a picture of n rows shows."""
    if n <= SHOW_ALL_ROWS:
        return n
    if n <= MEDIUM_ROWS:
        return min(MEDIUM_SAMPLE, n)
    return n_outliers + min(LARGE_INLIERS, n - n_outliers)


def outlier_preserving_sample(rows: DataFrame, id_col: str, target: int, seed: int = 0) -> DataFrame:
    """All flagged rows plus seeded-random unflagged ones up to target rows in total."""
    flagged = F.col("is_outlier")
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(flagged.cast("bigint")).alias("k")).first()
    n, outliers = counts["n"], counts["k"] or 0
    inliers = n - outliers
    wanted = max(0, min(target - outliers, inliers))
    if wanted >= inliers:
        return rows
    # the key threshold leaves about `wanted` rows to order, not the whole table
    near = first_by_key(rows.filter(~flagged), id_col, wanted, inliers, seed)
    if near.count() < wanted:
        near = rows.filter(~flagged).withColumn("__key", sample_key(id_col, seed))
    chosen = near.orderBy("__key", id_col).limit(wanted).drop("__key")
    return rows.filter(flagged).unionByName(chosen)


def projected_rows(features: Features, flagged: DataFrame, dim: int = 2,
                   components: Components | None = None) -> DataFrame:
    """(id, pc1, pc2[, pc3], is_outlier) of every row."""
    key = name(features.require_id())
    joined = project(features, dim, components).join(flagged.select(key, "is_outlier"), features.id_col)
    return stage(joined, "projection")


def projection_table(features: Features, flagged: DataFrame, dim: int = 2, seed: int = 0,
                     components: Components | None = None) -> DataFrame:
    """(id, pc1, pc2[, pc3], is_outlier), sampled for display when the table is large."""
    return display_sample(features, projected_rows(features, flagged, dim, components), seed)


def display_sample(features: Features, joined: DataFrame, seed: int = 0) -> DataFrame:
    outliers = joined.filter("is_outlier").count()
    return outlier_preserving_sample(joined, features.require_id(), sample_target(features.n, outliers), seed)


def picture_stats(features: Features, flagged: DataFrame, dim: int = 2, components: Components | None = None) -> DataFrame:
    """One row: total explained variance and the outlier rate over all rows, in percent."""
    check_dimension(dim, features.d)
    total = sum((components or Components(features)).explained(dim))
    rate = F.avg(F.col("is_outlier").cast("double")) * 100
    return flagged.agg(rate.alias("outlier_rate_pct")).withColumn("variance_explained_pct", F.lit(total * 100))


def hex_density(points: DataFrame, x: str = "pc1", y: str = "pc2", grid: int = DENSITY_GRID) -> DataFrame:
    """(lattice, ix, iy, x, y, n): points per hexagonal cell, empty cells left out.

    The plane carries two rectangular lattices, one shifted by half a cell; a point
    belongs to the nearer of its two candidate centres, vertical distance counting
    three times. Fewer than DENSITY_MIN_INLIERS + 1 points give no cells."""
    bounds = points.agg(
        F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.count(F.lit(1)).alias("n")
    ).first()
    shape = "lattice int, ix bigint, iy bigint, x double, y double, n bigint"
    if bounds["n"] <= DENSITY_MIN_INLIERS:
        return points.sparkSession.createDataFrame([], shape)
    ny = int(grid / math.sqrt(3))
    pad = 1e-9 * (bounds["x1"] - bounds["x0"]), 1e-9 * (bounds["y1"] - bounds["y0"])
    x0, x1 = bounds["x0"] - pad[0], bounds["x1"] + pad[0]
    y0, y1 = bounds["y0"] - pad[1], bounds["y1"] + pad[1]
    if x0 == x1 or y0 == y1:
        return points.sparkSession.createDataFrame([], shape)
    sx, sy = (x1 - x0) / grid, (y1 - y0) / ny
    u, v = (F.col(x) - F.lit(x0)) / F.lit(sx), (F.col(y) - F.lit(y0)) / F.lit(sy)
    placed = points.select(
        u.alias("u"), v.alias("v"),
        F.floor(u + 0.5).alias("i1"), F.floor(v + 0.5).alias("j1"), F.floor(u).alias("i2"), F.floor(v).alias("j2"),
    )

    def gap(i, j):
        return (F.col("u") - i) * (F.col("u") - i) + F.lit(3.0) * (F.col("v") - j) * (F.col("v") - j)

    first = gap(F.col("i1"), F.col("j1")) < gap(F.col("i2") + 0.5, F.col("j2") + 0.5)
    cells = placed.select(
        F.when(first, 1).otherwise(2).alias("lattice"),
        F.when(first, F.col("i1")).otherwise(F.col("i2")).alias("ix"),
        F.when(first, F.col("j1")).otherwise(F.col("j2")).alias("iy"),
    )
    shift = F.when(F.col("lattice") == 1, 0.0).otherwise(0.5)
    return cells.groupBy("lattice", "ix", "iy").agg(F.count(F.lit(1)).alias("n")).select(
        "lattice", "ix", "iy",
        ((F.col("ix") + shift) * F.lit(sx) + F.lit(x0)).alias("x"),
        ((F.col("iy") + shift) * F.lit(sy) + F.lit(y0)).alias("y"),
        "n",
    )


def hull_vertices(x: np.ndarray) -> np.ndarray:
    """Counter-clockwise hull of one task's 2-D points; collinear points are left out."""
    x = np.unique(x, axis=0)
    if len(x) < 3:
        return x

    def half(points):
        kept = []
        for px, py in points:
            while len(kept) > 1:
                (ax, ay), (bx, by) = kept[-2], kept[-1]
                if (bx - ax) * (py - ay) - (by - ay) * (px - ax) > 0:
                    break
                kept.pop()
            kept.append((px, py))
        return kept[:-1]

    listed = x.tolist()
    return np.array(half(listed) + half(listed[::-1]))


def convex_hull(points: DataFrame, x: str = "pc1", y: str = "pc2") -> DataFrame:
    """(position, x, y): hull vertices counter-clockwise from the leftmost; empty when the
    points do not span an area. The hull of partial hulls is the hull: points well inside
    are filtered out by expression, each partition keeps its own vertices, and vertices of
    neighbouring x ranges are merged until one task can hold them or none goes any more."""
    planar = points.select(F.col(x).alias("x"), F.col(y).alias("y"))
    sides = [F.col("x"), F.col("y"), F.col("x") + F.col("y"), F.col("x") - F.col("y")]
    extremes = [f(F.struct(s.alias("s"), "x", "y")).alias(f"{n}{i}") for i, s in enumerate(sides) for n, f in (("lo", F.min), ("hi", F.max))]
    found = planar.agg(*extremes).first()
    shape = "position int, x double, y double"
    if found["lo0"] is None:
        return points.sparkSession.createDataFrame([], shape)
    inner = hull_vertices(np.array([[v["x"], v["y"]] for v in found]))
    if len(inner) >= 3:
        # keep only points on or outside some edge of the polygon of extreme points
        outside = F.lit(False)
        for (ax, ay), (bx, by) in zip(inner.tolist(), np.roll(inner, -1, axis=0).tolist()):
            turn = F.lit(bx - ax) * (F.col("y") - F.lit(ay)) - F.lit(by - ay) * (F.col("x") - F.lit(ax))
            outside = outside | (turn <= 0)
        planar = planar.filter(outside)

    def partial(batches):
        kept = np.zeros((0, 2))
        for batch in batches:
            kept = hull_vertices(np.vstack([kept, kernels.matrix(batch, ["x", "y"])]))
        yield pa.RecordBatch.from_pydict({"x": pa.array(kept[:, 0], pa.float64()), "y": pa.array(kept[:, 1], pa.float64())})

    def merge(table: pa.Table) -> pa.Table:
        kept = hull_vertices(kernels.matrix(table, ["x", "y"]))
        return pa.table({"x": pa.array(kept[:, 0], pa.float64()), "y": pa.array(kept[:, 1], pa.float64())})

    def final(table: pa.Table) -> pa.Table:
        kept = hull_vertices(kernels.matrix(table, ["x", "y"]))
        if len(kept) < 3:
            kept = kept[:0]
        return pa.table({"position": pa.array(np.arange(len(kept)), pa.int32()), "x": pa.array(kept[:, 0], pa.float64()), "y": pa.array(kept[:, 1], pa.float64())})

    left = stage(planar.mapInArrow(partial, "x double, y double"), "hull")
    count, idle, turn = left.count(), 0, 0
    # neighbouring x ranges share most of their edges, so merging them drops most vertices.
    # Cuts of one turn lie inside the ranges of the next: when two turns drop nothing, every
    # three neighbours have met, and a chain that is convex everywhere is the hull's
    while count > HULL_GROUP and idle < 2:
        groups = math.ceil(count / HULL_GROUP) * 2
        cuts = left.approxQuantile("x", [(i + 0.25 + 0.5 * (turn % 2)) / groups for i in range(groups)], 0.1 / groups)
        number = F.size(F.filter(F.lit(sorted(set(cuts))), lambda c: c < F.col("x")))
        ranged = left.withColumn("g", number).repartition(groups, "g")
        left = stage(ranged.groupBy("g").applyInArrow(lambda t: merge(t.select(["x", "y"])), "x double, y double"), "hull")
        merged = left.count()
        count, idle, turn = merged, idle + 1 if merged == count else 0, turn + 1
    if count <= HULL_GROUP:
        return left.groupBy(F.lit(0).alias("g")).applyInArrow(lambda t: final(t.select(["x", "y"])), shape)
    # more vertices than a task should hold: numbered by their order along the two chains
    ends = left.agg(F.min(F.struct("x", "y")).alias("a"), F.max(F.struct("x", "y")).alias("b")).first()
    (ax, ay), (bx, by) = ends["a"], ends["b"]
    turn = F.lit(bx - ax) * (F.col("y") - F.lit(ay)) - F.lit(by - ay) * (F.col("x") - F.lit(ax))
    last = (F.col("x") == F.lit(bx)) & (F.col("y") == F.lit(by))
    above = (turn > 0) | last
    chain = left.select(
        above.cast("int").alias("chain"), F.when(above, -F.col("x")).otherwise(F.col("x")).alias("u"),
        F.when(above, -F.col("y")).otherwise(F.col("y")).alias("v"), "x", "y",
    )
    order = ["chain", "u", "v"]
    placed = with_row_positions(chain.repartitionByRange(*order).sortWithinPartitions(*order), "position")
    return placed.select(F.col("position").cast("int"), "x", "y")
