"""Mean distance to all rows, with exact flags at any size.

The mean distance of a row to a box of rows with mean m and spread s (mean squared distance
from m) lies between |x - m| and sqrt(|x - m|^2 + s): the root is concave in the square and
distance is convex in the place. A tree of cuts makes the boxes. Each leaf of it takes a
list of boxes that together hold every row, large ones far away and small ones near by, and
so every row of the leaf gets a lower and an upper bound on its score.

A flag is a score above one order statistic of the scores. That statistic lies between the
same statistic of the lower and of the upper bounds, which settles most rows. The others get
bounds from finer trees until they are few, and those still open are summed against every row: the
statistic is one of their scores. Scores of rows that were settled early are the middle of their
bounds; flags are those of the exact scores.

Sums over many pairs of places in one or two features go by boxes too. Near leaves are summed row
by row. A far box's rows are replaced by weighted places, its Chebyshev nodes: a distance from afar
is a polynomial over the box to within rounding, so the weights that give each polynomial the same
sum give the distances the same sum. Other sums take all pairs, in blocks of a bounded size."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outvote.functions import kernels, partition_tree
from outvote.functions.arrow import map_in_arrow
from outvote.functions.frame import Features, Profile
from outvote.functions.selection import order_statistics, quantile_position
from outvote.functions.text import name, significant
from outvote.staging import stage

# Numbers the leaves of a tree may take on the driver and in a broadcast (8 bytes each).
TREE_CELLS = 4_000_000
SAMPLE_PER_LEAF = 8
# Numbers in a block of rows that is summed against all rows in one pass.
BLOCK_CELLS = 400_000
# Distances that are rather computed than bounded by a finer tree.
CHEAP_DISTANCES = 2_000_000_000
TASK_WORK = 100_000_000
TASKS_PER_CORE = 4
# Squares that are worked on at a time.
CACHE_CELLS = 32_768
# Sums by boxes: the most features; a box is far from APART times half its width; rows in a leaf;
# the levels of the tree below a task's box; numbers that stand for rows, on the driver and in a
# broadcast (8 bytes each); error of what stands for rows, relative to a distance.
BOX_FEATURES = 2
APART = 3.0
LEAF_PLACES = 256
GROUP_DEPTH = 4
STAND_CELLS = 10_000_000
ACCURACY = 1e-14
# Relative slack of bounds, far above rounding and far below any real difference.
SLACK = 1e-10


@dataclass(frozen=True)
class Level:
    """A tree of 2^depth leaves; a box is far when its spread is at most `far` times twice
    the squared distance to it."""

    depth: int
    far: float


LEVELS = (Level(10, 0.02), Level(14, 0.002))
# Further levels, each taken while the rows still open are too many to be summed against all:
# their number is a share of the rows, so sums alone would grow with the square of the table.
FINER = (Level(16, 2e-4), Level(17, 2e-5), Level(19, 2e-6))


@dataclass
class Boxes:
    """Boxes in heap order: node i is halved into 2i + 1 and 2i + 2."""

    feature: np.ndarray
    value: np.ndarray
    weight: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    @property
    def depth(self) -> int:
        return int(math.log2(len(self.feature) + 1))

    def around(self, low: np.ndarray, high: np.ndarray, far: float) -> np.ndarray:
        """Boxes that hold every row once, as seen from the box between low and high."""
        found, front = [], np.zeros(1, np.int64)
        inner = len(self.feature)
        while len(front):
            front = front[self.weight[front] > 0]
            gap = np.maximum(np.maximum(low - self.mean[front], self.mean[front] - high), 0)
            near = self.spread[front] > 2 * far * (gap**2).sum(1)
            near &= front < inner
            found.append(front[~near])
            front = np.concatenate((2 * front[near] + 1, 2 * front[near] + 2))
        return np.concatenate(found)

    def bounds(self, x: np.ndarray, far: float, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound on each row's mean distance to all rows."""
        low, high = np.empty(len(x)), np.empty(len(x))
        leaf = partition_tree.leaf_of(x, self.feature, self.value, depth)
        order = np.argsort(leaf, kind="stable")
        firsts = np.flatnonzero(np.concatenate(([True], np.diff(leaf[order]) > 0)))
        total = self.weight[0]
        for rows in np.split(order, firsts[1:]):
            block = x[rows]
            boxes = self.around(block.min(0), block.max(0), far)
            share, mean, spread = self.weight[boxes] / total, self.mean[boxes], self.spread[boxes]
            for at in range(0, len(rows), max(1, kernels.BLOCK // len(boxes))):
                part = rows[at : at + max(1, kernels.BLOCK // len(boxes))]
                square = kernels.squared_distances(x[part], mean)
                low[part] = np.sqrt(square) @ share
                square += spread
                high[part] = np.sqrt(square, out=square) @ share
        return low * (1 - SLACK), high * (1 + SLACK)


def _sample(features: Features, wanted: int) -> np.ndarray:
    """About `wanted` rows, the same on every run. Only the shape of the tree follows from it."""
    keyed = F.pmod(F.xxhash64(*map(name, features.cols)), F.lit(1 << 20))
    share = min(1.0, wanted / max(1, features.n))
    rows = features.df.filter(keyed < int(share * (1 << 20)) + 1).select(*map(name, features.cols))
    return kernels.matrix(rows.limit(4 * wanted).toArrow(), features.cols)


def build_boxes(features: Features, depth: int) -> Boxes:
    """One pass over the rows, with a sum of weights, places and squares for each leaf."""
    cols, d, centre = features.cols, features.d, features.profile.mean
    feature, value = partition_tree.build_cuts(_sample(features, SAMPLE_PER_LEAF << depth), depth)

    def sums(batches):
        total = np.zeros((1 << depth, d + 2))
        for batch in batches:
            x = kernels.matrix(batch, cols)
            leaf = partition_tree.leaf_of(x, feature, value, depth)
            x = x - centre
            total[:, 0] += np.bincount(leaf, minlength=len(total))
            total[:, 1] += np.bincount(leaf, (x * x).sum(1), len(total))
            for j in range(d):
                total[:, j + 2] += np.bincount(leaf, x[:, j], len(total))
        seen = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(seen), kernels.list_array(total[seen].ravel(), np.full(len(seen), d + 2))], ["leaf", "s"])

    partial = map_in_arrow(features.df.select(*map(name, cols)), sums, "leaf bigint, s array<double>")
    added = partial.groupBy("leaf").agg(*(F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(d + 2)))
    rows = added.toArrow()  # a row for each leaf at most
    leaves = rows.column("leaf").to_numpy() + (1 << depth) - 1
    weight, square, mean = np.zeros((2 << depth) - 1), np.zeros((2 << depth) - 1), np.zeros(((2 << depth) - 1, d))
    weight[leaves], square[leaves] = rows.column("s0").to_numpy(), rows.column("s1").to_numpy()
    for j in range(d):
        mean[leaves, j] = rows.column(f"s{j + 2}").to_numpy()
    # sums of a box are those of its halves
    for k in range(depth - 1, -1, -1):
        node = np.arange((1 << k) - 1, (2 << k) - 1)
        for total in (weight, square, mean):
            total[node] = total[2 * node + 1] + total[2 * node + 2]
    rows = np.maximum(weight, 1)
    mean /= rows[:, None]
    # squares around the common centre cancel: what may be lost is added again
    lost = 1e-13 * (square[0] / rows[0] + (features.profile.high - features.profile.low).max(initial=0.0) ** 2)
    spread = np.maximum(square / rows - (mean**2).sum(1), 0) + lost * (weight > 1)
    return Boxes(feature, value, weight, mean + centre, spread)


def _bounded(rows: DataFrame, cols: list[str], boxes: Boxes, far: float) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(boxes)
    depth = boxes.depth

    def bound(batches):
        for batch in batches:
            low, high = shared.value.bounds(kernels.matrix(batch, cols), far, depth) if batch.num_rows else (np.zeros(0), np.zeros(0))
            kept = [c for c in batch.schema.names if c not in ("__low", "__high")]
            columns = [*(batch.column(c) for c in kept), pa.array(low), pa.array(high)]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "__low", "__high"])

    kept = [f for f in rows.schema.fields if f.name not in ("__low", "__high")]
    double = T.DoubleType()
    schema = T.StructType([*kept, T.StructField("__low", double), T.StructField("__high", double)])
    found = stage(map_in_arrow(rows, bound, schema), "distance-bounds")
    shared.destroy()
    return found


def _summed(x: np.ndarray, places: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Sum of the distances of each row of x to all places, in blocks that stay in the cache."""
    total = np.zeros(len(x))
    wide = CACHE_CELLS if len(places) > CACHE_CELLS else max(1, len(places))
    step = max(1, CACHE_CELLS // wide)
    for at in range(0, len(x), step):
        for begin in range(0, len(places), wide):
            square = kernels.squared_distances(x[at : at + step], places[begin : begin + wide])
            total[at : at + step] += np.sqrt(square, out=square) @ copies[begin : begin + wide]
    return total


def orders(half: np.ndarray) -> np.ndarray:
    """Chebyshev nodes for each feature of a box with these half widths, so that distances from
    places at least APART times the largest of them away are interpolated to ACCURACY.

    Along one feature a distance is sqrt((t - a)^2 + b^2), which is analytic but for a +- bi. These
    lie outside the ellipse of parameter r around the box, and the error falls with r^-nodes."""
    found = np.ones(len(half), np.int64)
    wide = half > 0
    ratio = APART * half.max(initial=0.0) / half[wide]
    r = ratio + np.sqrt(1 + ratio * ratio)
    found[wide] = np.ceil(np.log(8 / (ACCURACY * (r - 1))) / np.log(r)).astype(np.int64) + 1
    return found


def condensed(x: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted places that stand for the weighted rows of a box in sums of distances from afar:
    the box's Chebyshev nodes, or the rows themselves when these are not more."""
    half, middle = (high - low) / 2, (high + low) / 2
    nodes = orders(half)
    if len(x) <= nodes.prod():
        return x, weight
    total, axes = np.zeros(nodes.prod()), []
    for j, p in enumerate(nodes):
        axes.append(np.cos((2 * np.arange(p) + 1) * np.pi / (2 * p)))
    step = max(1, CACHE_CELLS * 4 // int(nodes.prod()))
    for at in range(0, len(x), step):
        part, value = x[at : at + step], weight[at : at + step, None]
        for j, p in enumerate(nodes):
            scaled = np.clip((part[:, j] - middle[j]) / (half[j] or 1.0), -1, 1)
            k = np.arange(1, p)
            # Lagrange's polynomials of the nodes, by Chebyshev's
            basis = (1 + 2 * np.cos(np.arccos(scaled)[:, None] * k) @ np.cos(np.outer(k, np.arccos(axes[j])))) / p
            value = value[:, :, None] * basis[:, None, :]
            value = value.reshape(len(part), -1)
        total += value.sum(0)
    grid = np.meshgrid(*(m + h * a for m, h, a in zip(middle, half, axes)), indexing="ij")
    return np.column_stack([g.ravel() for g in grid]), total


@dataclass
class Stands:
    """Boxes in heap order, and for each the weighted places that stand for its rows afar."""

    feature: np.ndarray
    value: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    place: np.ndarray
    weight: np.ndarray

    def around(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Boxes that together hold every row once: those far from the box between low and high,
        and leaves near it. What is near a part of a box is near the box."""
        far, leaves, front = [], [], np.zeros(1, np.int64)
        inner = len(self.feature)
        while len(front):
            front = front[self.low[front, 0] <= self.high[front, 0]]
            gap = np.maximum(np.maximum(low - self.high[front], self.low[front] - high), 0)
            half = (self.high[front] - self.low[front]).max(1) / 2
            apart = (gap * gap).sum(1) >= (APART * half) ** 2
            apart &= (gap > 0).any(1)
            far.append(front[apart])
            near = front[~apart]
            leaves.append(near[near >= inner] - inner)
            near = near[near < inner]
            front = np.concatenate((2 * near + 1, 2 * near + 2))
        return np.concatenate(far), np.concatenate(leaves)


def _located(points: DataFrame, cols: list[str], distinct: int) -> tuple[DataFrame, np.ndarray, np.ndarray, int]:
    """points with __leaf, a box of some LEAF_PLACES of them, and the tree of cuts."""
    d = len(cols)
    # boxes as wide as long have most nodes, for each of which d + 1 numbers are kept
    most = math.log2(STAND_CELLS / (2 * (d + 1) * int(orders(np.ones(d)).prod())))
    depth = max(1, min(int(most), math.ceil(math.log2(max(2, distinct / LEAF_PLACES)))))
    profile = Profile(distinct, *(np.zeros(d),) * 4)
    feature, value = partition_tree.build_cuts(_sample(Features(points, cols, None, profile), SAMPLE_PER_LEAF << depth), depth)

    def locate(batches):
        for batch in batches:
            leaf = partition_tree.leaf_of(kernels.matrix(batch, cols), feature, value, depth)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "__leaf"])

    schema = T.StructType([*points.schema.fields, T.StructField("__leaf", T.LongType())])
    return stage(map_in_arrow(points, locate, schema), "distance-located"), feature, value, depth


def _ordered(table, cols: list[str]) -> pa.Table:
    """The rows in an order of their own, so that sums are added alike on every run."""
    return table.sort_by([(c, "ascending") for c in ["__leaf", *cols]])


def build_stands(located: DataFrame, cols: list[str], feature: np.ndarray, value: np.ndarray, depth: int) -> Stands:
    """One pass for the leaves' bounds and one for what stands for their rows; boxes above the
    leaves are made from their halves."""
    d, inner = len(cols), (1 << depth) - 1
    low, high = np.full((2 * inner + 1, d), np.inf), np.full((2 * inner + 1, d), -np.inf)
    ends = located.groupBy("__leaf").agg(*(f(c).alias(f"{k}{j}") for k, f in (("l", F.min), ("h", F.max)) for j, c in enumerate(cols))).toArrow()
    at = kernels.column(ends, "__leaf") + inner
    for j in range(d):
        low[at, j], high[at, j] = kernels.column(ends, f"l{j}"), kernels.column(ends, f"h{j}")
    leaf_low, leaf_high = low[inner:].copy(), high[inner:].copy()

    def stand(table: pa.Table) -> pa.Table:
        table = _ordered(table, cols)
        leaf = table.column("__leaf")[0].as_py()
        places, weight = condensed(kernels.matrix(table, cols), kernels.column(table, "copies").astype(float), leaf_low[leaf], leaf_high[leaf])
        flat = np.column_stack([places, weight]).ravel()
        return pa.table({"__leaf": pa.array([leaf], pa.int64()), "s": kernels.list_array(flat, np.array([len(flat)]))})

    rows = located.groupBy("__leaf").applyInArrow(stand, "__leaf bigint, s array<double>").toArrow()
    found: list = [np.zeros((0, d + 1))] * (2 * inner + 1)
    for leaf, flat in zip(kernels.column(rows, "__leaf"), rows.column("s")):
        found[leaf + inner] = flat.values.to_numpy().reshape(-1, d + 1)
    for node in range(inner - 1, -1, -1):
        both = np.concatenate((found[2 * node + 1], found[2 * node + 2]))
        low[node], high[node] = np.minimum(low[2 * node + 1], low[2 * node + 2]), np.maximum(high[2 * node + 1], high[2 * node + 2])
        if len(both):
            found[node] = np.column_stack(condensed(both[:, :-1], both[:, -1], low[node], high[node]))
    first = np.concatenate(([0], np.cumsum([len(f) for f in found])))
    every = np.concatenate(found)
    return Stands(feature, value, low, high, first, every[:, :-1].copy(), every[:, -1].copy())


def _sums_by_boxes(points: DataFrame, wanted: DataFrame, cols: list[str], n: int, distinct: int) -> DataFrame:
    """Each wanted place meets the rows of near leaves one by one, and what stands for the others
    for far boxes: some thousands of places, however many rows there are."""
    spark = points.sparkSession
    located, feature, value, depth = _located(points, cols, distinct)
    stands = build_stands(located, cols, feature, value, depth)
    # neighbouring leaves go to one task, with all the leaves that are near them
    shift = min(depth, GROUP_DEPTH)
    groups = np.arange(1 << (depth - shift))
    near = [stands.around(stands.low[g], stands.high[g])[1] if stands.low[g, 0] <= stands.high[g, 0] else groups[:0] for g in groups + len(groups) - 1]
    counts = [len(x) for x in near]
    pairs = spark.createDataFrame(pa.table({"__group": np.repeat(groups, counts), "__leaf": np.concatenate(near)}))
    shared = spark.sparkContext.broadcast(stands)

    def add(table: pa.Table) -> pa.Table:
        table, stands = _ordered(table, cols), shared.value
        x, copies = kernels.matrix(table, cols), kernels.column(table, "copies").astype(float)
        leaf, asked = kernels.column(table, "__leaf"), kernels.column(table, "__wanted").astype(bool)
        asked &= leaf >> shift == table.column("__group")[0].as_py()
        inner, score = len(stands.feature), np.zeros(len(x))
        for own in np.unique(leaf[asked]):
            rows = np.flatnonzero(asked & (leaf == own))
            far, leaves = stands.around(stands.low[own + inner], stands.high[own + inner])
            spans = [slice(stands.first[b], stands.first[b + 1]) for b in far]
            begin, end = np.searchsorted(leaf, leaves), np.searchsorted(leaf, leaves, "right")
            near = [slice(b, e) for b, e in zip(begin, end)]
            places = np.concatenate([*(stands.place[s] for s in spans), *(x[s] for s in near)])
            weight = np.concatenate([*(stands.weight[s] for s in spans), *(copies[s] for s in near)])
            score[rows] = _summed(x[rows], places, weight) / n
        return pa.table([*(pa.array(x[asked, j]) for j in range(len(cols))), pa.array(score[asked])], [*cols, "__score"])

    marked = located.join(wanted.select(*map(name, cols), F.lit(True).alias("__wanted")), cols, "left")
    marked = marked.withColumn("__wanted", F.coalesce("__wanted", F.lit(False)))
    gathered = marked.join(F.broadcast(pairs), "__leaf").repartition(len(groups), "__group")
    schema = ", ".join([*(f"{name(c)} double" for c in cols), "__score double"])
    found = stage(gathered.groupBy("__group").applyInArrow(add, schema), "distance-sums")
    shared.destroy()
    return found


def _sums_in_blocks(points: DataFrame, wanted: DataFrame, cols: list[str], n: int) -> DataFrame:
    """Each wanted place meets every row: a pass over the points for each block of wanted places."""
    spark, size = points.sparkSession, max(1, BLOCK_CELLS // len(cols))
    numbered = stage(wanted.select(*map(name, cols)).withColumn("__at", F.monotonically_increasing_id()), "distance-wanted")
    blocks = []
    pending, count = numbered, numbered.count()
    for k in range(-(-count // size)):
        # rows by their place in the staged table: the first `size` that are left
        block = pending.orderBy("__at").limit(size).toArrow()
        last = block.column("__at")[-1].as_py()
        pending = numbered.filter(F.col("__at") > last)
        shared = spark.sparkContext.broadcast((kernels.matrix(block, cols), kernels.column(block, "__at")))

        def add(batches, shared=shared):
            places, at = shared.value
            total = np.zeros(len(places))
            for batch in batches:
                x, copies = kernels.matrix(batch, cols), kernels.column(batch, "copies").astype(float)
                total += _summed(places, x, copies)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total)], ["__at", "__sum"])

        # every task has a sum for each place, so tasks must not grow in number with the rows
        tasks = max(1, min(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, math.ceil(len(block) * n / TASK_WORK)))
        partial = map_in_arrow(points.repartition(tasks, *map(name, cols)), add, "__at bigint, __sum double")
        # sums are added in one order always
        sums = partial.groupBy("__at").agg(F.sort_array(F.collect_list("__sum")).alias("s"))
        blocks.append(stage(sums.select("__at", F.expr(f"aggregate(s, 0D, (a, x) -> a + x) / {float(n)!r}D").alias("__score")), "distance-sums"))
        shared.destroy()
    if not blocks:
        return numbered.select(*map(name, cols), F.lit(None).cast("double").alias("__score"))
    return numbered.join(reduce(DataFrame.unionByName, blocks), "__at").drop("__at")


def distance_sums(points: DataFrame, wanted: DataFrame, cols: list[str], n: int) -> DataFrame:
    """wanted (distinct places: the columns) with __score: the mean distance to all points (the
    columns and copies). In few features far boxes of rows are summed at once, to ACCURACY, which
    is the rounding of such sums."""
    distinct = points.count()
    if len(cols) <= BOX_FEATURES and distinct * wanted.count() > CHEAP_DISTANCES:
        return _sums_by_boxes(points, wanted, cols, n, distinct)
    return _sums_in_blocks(points, wanted, cols, n)


def mean_distance(
    features: Features, contamination: float, every_score: bool = False, levels: tuple[Level, ...] = LEVELS, cheap: float = CHEAP_DISTANCES
) -> DataFrame:
    """Rows with score and is_outlier (a mean Euclidean distance to all rows, itself included,
    above its (1 - contamination) percentile). With every_score, or if that is cheap, no row is
    settled by bounds and all scores are sums over all pairs."""
    n = features.n
    # kernels travel with features under numbers, whatever their names
    cols = [f"__x{i}" for i in range(features.d)]
    inner = features.df.select("*", *(F.expr(f"{name(c)} + 0D").alias(x) for c, x in zip(features.cols, cols)))
    plain = Features(inner.select(*cols), cols, None, features.profile)
    points = stage(plain.df.groupBy(*cols).agg(F.count(F.lit(1)).alias("copies")), "distance-points")
    distinct = points.count()
    position, below = quantile_position(n, contamination), 0
    rows, open_, settled = inner, n, []
    for number, level in enumerate((*levels, *FINER) if not every_score and n * distinct > cheap else ()):
        if number >= len(levels) and open_ * distinct <= CHEAP_DISTANCES:
            break
        depth = min(level.depth, int(math.log2(max(1, TREE_CELLS // (features.d + 2)))), max(1, int(math.log2(max(2, distinct / 4)))))
        rows = _bounded(rows, cols, build_boxes(plain, depth), level.far)
        (low,) = order_statistics(rows, "__low", [position - below], open_)
        (high,) = order_statistics(rows, "__high", [position - below], open_)
        under, over = F.col("__high") < F.lit(low * (1 - SLACK)), F.col("__low") > F.lit(high * (1 + SLACK))
        settled += [rows.filter(under).withColumn("is_outlier", F.lit(False)), rows.filter(over).withColumn("is_outlier", F.lit(True))]
        counts = rows.agg(F.count_if(under).alias("under"), F.count_if(over).alias("over")).first()
        below, open_ = below + counts["under"], open_ - counts["under"] - counts["over"]
        rows = rows.filter(~under & ~over)
        if open_ * distinct <= cheap:
            break
    scored = distance_sums(points, rows.select(*cols).distinct(), cols, n)
    scored = stage(rows.drop("__low", "__high").join(scored, cols).withColumn("score", F.expr(significant("__score"))).drop("__score"), "distance-open")
    (limit,) = order_statistics(scored, "score", [position - below], open_)
    parts = [scored.withColumn("is_outlier", F.col("score") > F.lit(limit))]
    parts += [x.withColumn("score", (F.col("__low") + F.col("__high")) / 2).drop("__low", "__high") for x in settled]
    return reduce(DataFrame.unionByName, parts).drop(*cols)
