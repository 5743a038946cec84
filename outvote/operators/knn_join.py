"""Exact k-nearest-neighbour self-join.

Equal rows are collapsed to one weighted point first: a point held by a third of the
table becomes one row, and since copies of a point are interchangeable as neighbours,
nothing is lost. Points are then joined either against a broadcast copy of all points
(few points, checked) or through a space partition:

  1. a tree of cuts from a bounded sample assigns each point to a leaf; leaves are near
     equal in size, and any that is not is cut again;
  2. inside each leaf, every point finds its k nearest, which bounds its true radius;
  3. a point visits another leaf only if that leaf's bounding box is within the radius. It
     visits the NEAR nearest leaves first; what they hold narrows its radius, and only leaves
     within the narrower one are visited after that;
  4. leaves with many visitors are split over several tasks, and the k best of all visited
     leaves are kept per point, cut down before the shuffle.

Beyond LEADING features, cuts and boxes are made on the LEADING principal components and the
distance from the space they span. That map moves no two points apart, so what is out of
reach there is out of reach; a box over all features would hardly rule anything out."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outvote.functions import kernels, partition_tree
from outvote.functions.frame import Features
from outvote.functions.moments import moments
from outvote.functions.sampling import first_by_key
from outvote.functions.text import name
from outvote.staging import discard, stage

# Points x features that may be broadcast (8 bytes each).
BROADCAST_CELLS = 400_000
BROADCAST_POINTS = 20_000
LEAF_POINTS = 16_384
MAX_DEPTH = 16
SAMPLE_PER_LEAF = 16
VISITORS_PER_TASK = 20_000
# Principal components that stand in for more features in cuts and boxes.
LEADING = 12
# Leaves that a point visits before its radius is narrowed.
NEAR = 4
# Distances one task should compute.
TASK_WORK = 40_000_000

FOUND = "point bigint, nbr bigint, dist double, copies bigint"
LISTS = "point bigint, nbrs array<bigint>, dists array<double>"
DISTANCES = "point bigint, dists array<double>"


@dataclass(frozen=True)
class Limits:
    broadcast_points: int = BROADCAST_POINTS
    leaf_points: int = LEAF_POINTS
    visitors_per_task: int = VISITORS_PER_TASK


def distinct_points(features: Features) -> DataFrame:
    """(point, copies, features...): point is the smallest id among equal rows."""
    id_col = features.require_id()
    if not features.integer_id:
        raise ValueError(f"neighbours need an integer id column, {id_col} is not one: see Features.numbered")
    return features.df.groupBy(*map(name, features.cols)).agg(
        F.min(F.col(name(id_col)).cast("bigint")).alias("point"), F.count(F.lit(1)).alias("copies")
    )


def _found(queries, points, copies, row, col, dist) -> pa.Table:
    """Flat result rows; a point is its own neighbour once per further copy."""
    own = queries[row] == points[col]
    weight = copies[col] - own
    keep = weight > 0
    return pa.table(
        {"point": queries[row][keep], "nbr": points[col][keep], "dist": dist[keep], "copies": weight[keep]}
    )


def _lists(queries: np.ndarray, points: np.ndarray, copies: np.ndarray, row, col, dist, k: int) -> dict:
    """Flat (query, point, distance) results as list columns with one entry per table row
    of the neighbour, at most k entries per query; a query is its own neighbour once per
    further copy."""
    weight = copies[col] - (queries[row] == points[col])
    # copies beyond a query's k-th entry are never spelled out
    before = np.cumsum(weight) - weight
    starts = np.minimum(np.searchsorted(row, np.arange(len(queries))), max(0, len(row) - 1))
    if len(row):
        before -= before[starts][row]
    weight = np.minimum(weight, np.maximum(k - before, 0))
    row, col, dist = np.repeat(row, weight), np.repeat(col, weight), np.repeat(dist, weight)
    lengths = np.bincount(row, minlength=len(queries))
    return {
        "point": queries,
        "nbrs": kernels.list_array(points[col], lengths),
        "dists": kernels.list_array(dist, lengths),
    }


def _kth(lists: dict, k: int) -> np.ndarray:
    """The k-th distance of each list; infinite where the list is shorter."""
    dists, firsts = lists["dists"].values.to_numpy(), lists["dists"].offsets.to_numpy()
    found = np.full(len(firsts) - 1, np.inf)
    full = np.diff(firsts) >= k
    found[full] = dists[firsts[:-1][full] + k - 1]
    return found


def _against_broadcast(points: DataFrame, cols: list[str], k: int, count: int, lists: bool = True) -> DataFrame:
    spark = points.sparkSession
    local = points.orderBy("point").toArrow()
    shared = spark.sparkContext.broadcast(
        (kernels.matrix(local, cols), kernels.column(local, "point"), kernels.column(local, "copies"))
    )

    def search(batches):
        x, point, copies = shared.value
        for batch in batches:
            if batch.num_rows:
                row, col, dist = kernels.nearest_points(kernels.matrix(batch, cols), x, k + 1)
                found = _lists(kernels.column(batch, "point"), point, copies, row, col, dist, k)
                if not lists:
                    found = {"point": found["point"], "dist": _kth(found, k)}
                yield pa.RecordBatch.from_pydict(found)

    tasks = max(1, math.ceil(count * count * len(cols) / TASK_WORK))
    return points.repartition(tasks, "point").mapInArrow(search, LISTS if lists else "point bigint, dist double")


def _cut_oversized(points: DataFrame, cols: list[str], limits: Limits, count: int) -> DataFrame:
    """Add a leaf number; no leaf holds more than four times the target, unless the
    bounded number of leaves forces larger ones everywhere."""
    depth = min(MAX_DEPTH, max(1, math.ceil(math.log2(count / limits.leaf_points))))
    target = max(limits.leaf_points, count / 2**depth)
    pending, finished, base, rows = points, [], 0, count
    while True:
        sample = first_by_key(pending, "point", SAMPLE_PER_LEAF * 2**depth, rows, seed=base).select(*map(name, cols))
        feature, value = partition_tree.build_cuts(kernels.matrix(sample.toArrow(), cols), depth)
        shared = pending.sparkSession.sparkContext.broadcast((feature, value))

        def assign(batches, shared=shared, depth=depth, base=base):
            for batch in batches:
                leaf = partition_tree.leaf_of(kernels.matrix(batch, cols), *shared.value, depth) + base
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(leaf.astype(np.int32))], [*batch.schema.names, "leaf"]
                )

        schema = T.StructType([*pending.schema.fields, T.StructField("leaf", T.IntegerType())])
        assigned = stage(pending.mapInArrow(assign, schema), "leaves")
        base += 2**depth
        sizes = assigned.groupBy("leaf").count()
        large = sizes.filter(F.col("count") > F.lit(4 * target)).collect()
        finished.append(assigned)
        rows = sum(r["count"] for r in large)
        if not large:
            break
        heavy = F.col("leaf").isin([r["leaf"] for r in large])
        finished[-1] = assigned.filter(~heavy)
        pending = assigned.filter(heavy).drop("leaf")
        depth = min(MAX_DEPTH, max(1, math.ceil(math.log2(rows / target)) + 1))
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return out


def _with_leading(points: DataFrame, cols: list[str]) -> tuple[DataFrame, list[str], float]:
    """points with the columns that cuts and boxes are made on, and how far rounding may move
    a point in them."""
    if len(cols) <= LEADING:
        return points, cols, 0.0
    _, centre, cov = moments(points, cols, np.zeros(len(cols)))
    basis = np.linalg.eigh(cov)[1][:, ::-1][:, :LEADING].copy()
    made = [f"lead{i}" for i in range(LEADING + 1)]

    def project(batches):
        for batch in batches:
            x = kernels.matrix(batch, cols) - centre
            lead = x @ basis
            rest = x - lead @ basis.T
            columns = [*lead.T.copy(), np.sqrt((rest * rest).sum(axis=1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, columns)], [*batch.schema.names, *made])

    schema = T.StructType([*points.schema.fields, *(T.StructField(c, T.DoubleType()) for c in made)])
    reach = points.agg(*(F.max(F.abs(c)).alias(c) for c in cols)).first()
    size = math.sqrt(sum((v or 0.0) ** 2 for v in reach)) + float(np.linalg.norm(centre))
    return stage(points.mapInArrow(project, schema), "knn-leading"), made, 1e-13 * len(cols) * size


def _search(visits: DataFrame, leaves: DataFrame, cols: list[str], k: int, limits: Limits, lists: bool = True) -> DataFrame:
    """visits: point, features, radius, leaf. The k nearest residents of the leaf for each; without
    lists only their distances, spelled out, a row for each point and leaf."""
    # a leaf with many visitors is worked on by several tasks, each with its own copy of the leaf
    shares = visits.groupBy("leaf").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(limits.visitors_per_task)).cast("int").alias("tasks")
    )
    shares = stage(shares, "knn-shares")
    groups = max(1, (shares.agg(F.sum("tasks")).first()[0] or 0) // 2)
    chunked = visits.join(F.broadcast(shares), "leaf").withColumn(
        "chunk", F.pmod(F.xxhash64("point"), F.col("tasks")).cast("int")
    )
    copies_of = leaves.join(F.broadcast(shares), "leaf").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))
    )

    def across(visitors: pa.Table, residents: pa.Table) -> pa.Table:
        if visitors.num_rows == 0 or residents.num_rows == 0:
            kinds = [("nbr", pa.int64()), ("dist", pa.float64()), ("copies", pa.int64())] if lists else [("dists", pa.list_(pa.float64()))]
            return pa.schema([("point", pa.int64()), *kinds]).empty_table()
        residents = residents.sort_by("point")
        row, col, dist = kernels.nearest_points(
            kernels.matrix(visitors, cols), kernels.matrix(residents, cols), k, kernels.column(visitors, "radius")
        )
        who, point, copies = kernels.column(visitors, "point"), kernels.column(residents, "point"), kernels.column(residents, "copies")
        if not lists:
            found = _lists(who, point, copies, row, col, dist, k)
            return pa.table({"point": who, "dists": found["dists"]}).filter(pc.greater(pc.list_value_length(found["dists"]), 0))
        return _found(who, point, copies, row, col, dist)

    # explicit partition counts: these stages are heavy in CPU, not in bytes, so they must not
    # be coalesced by size
    visitors_by_task = chunked.select("leaf", "chunk", "point", *map(name, cols), "radius").repartition(groups, "leaf", "chunk")
    residents_by_task = copies_of.select("leaf", "chunk", "point", "copies", *map(name, cols)).repartition(groups, "leaf", "chunk")
    return (
        visitors_by_task.groupBy("leaf", "chunk")
        .cogroup(residents_by_task.groupBy("leaf", "chunk"))
        .applyInArrow(across, FOUND if lists else DISTANCES)
    )


def _best(lists: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The k best of each point's list and of what it has found elsewhere."""
    entries = F.explode(F.arrays_zip("nbrs", "dists"))
    started = lists.select("point", entries.alias("e"))
    started = started.select(
        "point", F.col("e.nbrs").alias("nbr"), F.col("e.dists").alias("dist"), F.lit(1).cast("bigint").alias("copies")
    )
    # the window keeps the k best of each map task before it shuffles them
    best = Window.partitionBy("point").orderBy("dist", "nbr")
    chosen = started.unionByName(found).withColumn("__at", F.row_number().over(best)).filter(F.col("__at") <= k)
    ordered = F.array_sort(F.collect_list(F.struct("dist", "nbr", "copies")))
    merged = chosen.groupBy("point").agg(ordered.alias("e"))
    spelled = F.flatten(F.transform("e", lambda e: F.array_repeat(e, F.least(e["copies"], F.lit(k)).cast("int"))))
    return merged.select("point", F.slice(spelled, 1, k).alias("e")).select(
        "point", F.col("e.nbr").alias("nbrs"), F.col("e.dist").alias("dists")
    )


@dataclass(frozen=True)
class _Inside:
    """Points with what they found in their own leaves, and the leaves in their reach."""

    first: DataFrame
    leaves: DataFrame
    boxes: int


def _inside(points: DataFrame, cols: list[str], k: int, limits: Limits, count: int, lists: bool) -> _Inside:
    """Without lists, a point with no other leaf in reach has its radius alone (the k-th
    distance) and the others their distances without names."""
    led, guide, moved = _with_leading(points, cols)
    leaves = _cut_oversized(led, guide, limits, count)
    if not lists:
        discard(points, led)
    extremes = [f(name(c)).alias(f"{k}{i}") for k, f in (("l", F.min), ("h", F.max)) for i, c in enumerate(guide)]
    # one row per leaf, at most a few 2^MAX_DEPTH
    boxes = leaves.groupBy("leaf").agg(*extremes).orderBy("leaf").toArrow()
    low = kernels.matrix(boxes, [f"l{i}" for i in range(len(guide))]) - moved
    high = kernels.matrix(boxes, [f"h{i}" for i in range(len(guide))]) + moved
    shared = points.sparkSession.sparkContext.broadcast((kernels.column(boxes, "leaf"), low, high))

    def inside(table: pa.Table) -> pa.Table:
        table = table.sort_by("point")
        x, point, copies = kernels.matrix(table, cols), kernels.column(table, "point"), kernels.column(table, "copies")
        row, col, dist = kernels.nearest_points(x, x, k + 1)
        weight = copies[col] - (row == col)
        # radius: where the running weight reaches k, else everything must be visited
        starts = np.searchsorted(row, np.arange(len(x)))
        running = np.cumsum(weight)
        before = running[starts] - weight[starts]
        enough = running - before[row] >= k
        radius = np.full(len(x), np.inf)
        np.minimum.at(radius, row[enough], dist[enough])
        names, box_low, box_high = shared.value
        own_leaf = table.column("leaf")[0].as_py()
        visit_row, visit_box, gap = partition_tree.boxes_within(kernels.matrix(table, guide), radius, box_low, box_high)
        other = names[visit_box] != own_leaf
        visit_row, visit, gap = visit_row[other], names[visit_box[other]], gap[other]
        order = np.lexsort((visit, gap, visit_row))
        times = np.bincount(visit_row, minlength=len(x))
        if lists:
            found = _lists(point, point, copies, row, col, dist, k)
        else:
            open_ = times[row] > 0
            found = _lists(point, point, copies, row[open_], col[open_], dist[open_], k)
            found = {"point": found["point"], "copies": copies, "dists": found["dists"]}
        return pa.table(
            {
                **found,
                **{c: x[:, j].copy() for j, c in enumerate(cols)},
                "radius": radius,
                "visits": kernels.list_array(visit[order].astype(np.int32), times),
                "gaps": kernels.list_array(gap[order], times),
            }
        )

    numbers = ", ".join(f"{name(c)} double" for c in cols)
    kept = LISTS if lists else LISTS.replace("nbrs array<bigint>", "copies bigint")
    first = stage(
        leaves.repartition(max(1, boxes.num_rows // 2), "leaf").groupBy("leaf").applyInArrow(
            inside,
            f"{kept}, {numbers}, radius double, visits array<int>, gaps array<double>",
        ),
        "knn-inside",
    )
    shared.destroy()
    return _Inside(first, leaves, boxes.num_rows)


def _crowded(at: _Inside, better: DataFrame, cols: list[str], k: int) -> DataFrame:
    """Visits of points with more than NEAR leaves in reach, with the radius they have now."""
    crowded = at.first.filter(F.size("visits") > NEAR).select("point", *map(name, cols), "visits", "gaps").join(better, "point")
    radius = F.when(F.size("dists") >= k, F.element_at("dists", k)).otherwise(F.lit(math.inf))
    later = F.arrays_zip(F.slice("visits", NEAR + 1, at.boxes).alias("leaf"), F.slice("gaps", NEAR + 1, at.boxes).alias("gap"))
    far = crowded.withColumn("radius", radius).withColumn("visit", F.explode(later))
    far = far.filter(F.col("visit.gap") <= F.col("radius") * (1 + 1e-12))
    return stage(far.select("point", *map(name, cols), "radius", F.col("visit.leaf").alias("leaf")), "knn-far")


def _through_partition(points: DataFrame, cols: list[str], k: int, limits: Limits, count: int) -> DataFrame:
    at = _inside(points, cols, k, limits, count, lists=True)
    first, leaves = at.first, at.leaves
    places = ["point", *map(name, cols)]
    near = first.filter(F.size("visits") > 0)
    visits = near.select(*places, "radius", F.explode(F.slice("visits", 1, NEAR)).alias("leaf"))
    better = stage(_best(near, _search(visits, leaves, cols, k, limits), k), "knn-near")
    far = _crowded(at, better, cols, k)
    alone = first.filter(F.size("visits") == 0).select("point", "nbrs", "dists")
    if far.isEmpty():
        return alone.unionByName(better)
    on = far.select("point").distinct()
    final = _best(better.join(on, "point", "left_semi"), _search(far, leaves, cols, k, limits), k)
    return alone.unionByName(better.join(on, "point", "left_anti")).unionByName(final)


def _kth_through_partition(points: DataFrame, cols: list[str], k: int, limits: Limits, count: int) -> DataFrame:
    """(point, features, copies, dist). Lists of distances travel only for points with other
    leaves in reach; the rest of the table is written without."""
    at = _inside(points, cols, k, limits, count, lists=False)
    places = ["point", *map(name, cols)]
    near = at.first.filter(F.size("visits") > 0)
    visits = near.select(*places, "radius", F.explode(F.slice("visits", 1, NEAR)).alias("leaf"))

    def merged(lists: DataFrame, found: DataFrame) -> DataFrame:
        every = F.array_sort(F.flatten(F.collect_list("dists")))
        return lists.select("point", "dists").unionByName(found).groupBy("point").agg(F.slice(every, 1, k).alias("dists"))

    better = stage(merged(near, _search(visits, at.leaves, cols, k, limits, lists=False)), "knn-near")
    far = _crowded(at, better, cols, k)
    final = better
    if not far.isEmpty():
        on = far.select("point").distinct()
        final = merged(better.join(on, "point", "left_semi"), _search(far, at.leaves, cols, k, limits, lists=False))
        final = better.join(on, "point", "left_anti").unionByName(final)
    dist = final.select("point", F.element_at("dists", k).alias("dist"))
    settled = at.first.filter(F.size("visits") == 0).select(*places, "copies", F.col("radius").alias("dist"))
    found = stage(settled.unionByName(near.select(*places, "copies").join(dist, "point")), "kth-distances")
    discard(at.first, at.leaves, better, far)
    return found


def kth_distance(features: Features, k: int, limits: Limits = Limits()) -> DataFrame:
    """(point, features..., rows, dist): for each distinct point the distance to its k-th nearest
    other row (k < n), as `nearest_others` has it, without the lists: a number for each point."""
    cols = [f"x{i}" for i in range(features.d)]
    points = stage(distinct_points(features).toDF(*cols, "point", "copies"), "points")
    count = points.count()
    if count <= limits.broadcast_points and count * len(cols) <= BROADCAST_CELLS:
        found = points.join(_against_broadcast(points, cols, k, count, lists=False), "point")
    else:
        found = _kth_through_partition(points, cols, k, limits, count)
    named = found.select("point", *(F.col(c).alias(own) for c, own in zip(cols, features.cols)), F.col("copies").alias("rows"), "dist")
    return named if count > limits.broadcast_points else stage(named, "kth-distances")


def nearest_others(features: Features, k: int, limits: Limits = Limits()) -> DataFrame:
    """(point, features..., rows, nbrs, dists): for each distinct point its min(k, n - 1)
    nearest other rows in (distance, point) order, rows named by their point.

    `rows` is how many table rows the point stands for. Copies of a neighbour appear as
    repeated entries, so entry i is the (i + 1)-th nearest row."""
    # kernels travel with features under numbers, whatever their names
    cols = [f"x{i}" for i in range(features.d)]
    points = stage(distinct_points(features).toDF(*cols, "point", "copies"), "points")
    count = points.count()
    k = max(1, min(k, features.n - 1))
    if count <= limits.broadcast_points and count * len(cols) <= BROADCAST_CELLS:
        lists = _against_broadcast(points, cols, k, count)
    else:
        lists = _through_partition(points, cols, k, limits, count)
    named = points.select("point", *(F.col(c).alias(own) for c, own in zip(cols, features.cols)), F.col("copies").alias("rows"))
    joined = named.join(lists, "point")
    return stage(joined, "neighbours")
