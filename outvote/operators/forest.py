"""Isolation forest: trees built per group from bounded samples, rows scored in one pass."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outvote.functions.arrow import map_in_arrow
from outvote.functions import kernels, parameters
from outvote.functions.frame import Features
from outvote.functions.sampling import row_sample
from outvote.functions.selection import flag_top
from outvote.functions.text import significant
from outvote.staging import stage

TREE = "tree int, node int, feature int, cut double, depth double"
ESTIMATE_TREES = 100  # fixed value: forest size of the contamination estimate


def average_path(size: int) -> float:
    """Mean depth of an unsuccessful search in a binary search tree of `size` keys."""
    if size <= 1:
        return 0.0
    if size == 2:
        return 1.0
    return 2.0 * (math.log(size - 1.0) + np.euler_gamma) - 2.0 * (size - 1.0) / size


def per_round_samples(features: Features, rounds: int, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and a (rounds, size) index table into them: a sample without replacement per
    round. At most rounds * size rows come to the driver. Rounds are consecutive disjoint
    chunks of one seeded order; when the (by then small) table is used up, of the next one,
    whose keys also have the number of the pass."""
    id_col = features.require_id()
    table = row_sample(features, rounds * size, seed)
    rows, ids = table[features.cols].to_numpy(float), [str(i) for i in table[id_col]]
    chunks = max(1, len(rows) // size)
    order, index = np.arange(len(rows)), []
    for r in range(rounds):
        if r and r % chunks == 0:
            keys = [(hashlib.md5(f"{i}:{seed}:{r // chunks}".encode()).hexdigest(), i) for i in ids]
            order = np.array(sorted(range(len(ids)), key=keys.__getitem__))
        index.append(order[r % chunks * size :][:size])
    return rows, np.stack(index)


def hash_draws(seed: int, tree: int):
    """Two numbers from 0 to 1 for each node: the first 8 and the next 12 hexadecimal digits
    of an md5, so that any engine can grow the same tree."""

    def draw(node: int) -> tuple[float, float]:
        digits = hashlib.md5(f"{seed}:{tree}:{node}".encode()).hexdigest()
        return int(digits[:8], 16) / 2**32, int(digits[8:20], 16) / 2**48

    return draw


def grow_tree(x: np.ndarray, height: int, draw):
    """One tree in heap order: random varying feature, uniform cut, until a node holds one
    row, only equal rows, or the height is reached. A leaf passes its depth (plus the
    average path of the rows it still holds) down its leftmost line, so that every row
    can be walked exactly `height` steps. draw: of a node, where to choose and to cut."""
    inner = 2**height - 1
    feature, cut, depth = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(2**height)
    todo = [(0, 0, np.arange(len(x)))]
    while todo:
        node, level, rows = todo.pop()
        block = x[rows]
        low, high = (block.min(axis=0), block.max(axis=0)) if len(rows) else (None, None)
        if level == height or len(rows) <= 1 or not (low < high).any():
            at = node
            for _ in range(height - level):
                at = 2 * at + 1
            depth[at - inner] = level + average_path(len(rows))
            continue
        choice, place = draw(node)
        varying = np.nonzero(low < high)[0]
        f = int(varying[int(choice * len(varying))])
        c = low[f] + place * (high[f] - low[f])
        if c >= high[f]:
            c = low[f]
        feature[node], cut[node] = f, c
        right = block[:, f] > c
        todo.append((2 * node + 1, level + 1, rows[~right]))
        todo.append((2 * node + 2, level + 1, rows[right]))
    return feature, cut, depth


class Forest:
    """Flat arrays of all trees: at most 200 trees of 2^8 leaves for the default sizes."""

    def __init__(self, cols, height, sample_size, feature, cut, depth):
        self.cols, self.height, self.sample_size = cols, height, sample_size
        self.feature, self.cut, self.depth = feature, cut, depth

    def score(self, df: DataFrame) -> DataFrame:
        """Append the anomaly score 2^(-mean path / average path) to every row. A pure
        row-wise projection: nothing shuffles."""
        cols, height = self.cols, self.height
        trees, inner = self.feature.shape
        shared = df.sparkSession.sparkContext.broadcast((self.feature.astype(np.int64), self.cut, self.depth))
        unit = average_path(self.sample_size) or 1.0

        def walk(batches):
            feature, cut, depth = shared.value
            for batch in batches:
                x = kernels.matrix(batch, cols)
                flat, start = x.ravel(), np.arange(len(x)) * len(cols)
                path = np.zeros(len(x))
                # tree by tree: one tree's arrays and the batch's node numbers stay in cache
                for f, c, leaves in zip(feature, cut, depth):
                    node = np.zeros(len(x), dtype=np.int64)
                    for _ in range(height):
                        right = flat.take(f.take(node) + start) > c.take(node)
                        node += node
                        node += 1
                        node += right
                    path += leaves.take(node - inner)
                score = pa.array(np.exp2(-path / (trees * unit)))
                yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, "score"])

        schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())])
        return map_in_arrow(df, walk, schema).withColumn("score", F.expr(significant("score")))


def fit_forest(features: Features, trees: int, sample_size: int, seed: int) -> Forest:
    spark = features.df.sparkSession
    cols = features.cols
    rows, index = per_round_samples(features, trees, sample_size, seed)
    height = max(1, math.ceil(math.log2(max(sample_size, 2))))
    shared = spark.sparkContext.broadcast((rows, index))

    def grow(batches):
        rows, index = shared.value
        for batch in batches:
            for tree in batch.column("id").to_pylist():
                feature, cut, depth = grow_tree(rows[index[tree]], height, hash_draws(seed, tree))
                inner = len(feature)
                yield pa.RecordBatch.from_pydict(
                    {
                        "tree": pa.array(np.full(2 * inner + 1, tree), pa.int32()),
                        "node": pa.array(np.arange(2 * inner + 1), pa.int32()),
                        "feature": pa.array(np.concatenate([feature, np.zeros(inner + 1, int)]), pa.int32()),
                        "cut": np.concatenate([cut, np.zeros(inner + 1)]),
                        "depth": np.concatenate([np.zeros(inner), depth]),
                    }
                )

    # trees * 2^(height + 1) rows: bounded by the settings, whatever the table size
    tasks = min(trees, spark.sparkContext.defaultParallelism)
    nodes = spark.range(0, trees, 1, tasks).mapInArrow(grow, TREE).toArrow()
    order = np.lexsort((kernels.column(nodes, "node"), kernels.column(nodes, "tree")))
    shape = (trees, 2 ** (height + 1) - 1)
    inner = 2**height - 1
    feature, cut, depth = (kernels.column(nodes, c)[order].reshape(shape) for c in ("feature", "cut", "depth"))
    return Forest(
        cols, height, sample_size, feature[:, :inner].copy(), cut[:, :inner].copy(), depth[:, inner:].copy()
    )


def isoforest_scores(features: Features, seed: int = 0, trees: int | None = None) -> DataFrame:
    n = features.n
    forest = fit_forest(features, trees or parameters.forest_trees(n), parameters.forest_sample(n), seed)
    return forest.score(features.spread())


def isoforest(features: Features, contamination: float, seed: int = 0, trees: int | None = None) -> DataFrame:
    return flag_top(stage(isoforest_scores(features, seed, trees), "isoforest"), contamination, features.n)


def estimate_contamination(features: Features, seed: int = 0) -> float:
    """Share of rows whose isolation score exceeds one half. Scoring is one linear pass, so
    every row is scored instead of a 100,000 row sample."""
    forest = fit_forest(features, ESTIMATE_TREES, parameters.forest_sample(features.n), seed)
    scored = forest.score(features.spread())
    return float(scored.agg(F.avg((F.col("score") > 0.5).cast("double"))).first()[0])
