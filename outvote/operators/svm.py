"""One-class SVM by grid search, trained in the primal feature space.

The rbf kernel is approximated by random cosine features phi, so a model is a weight
vector w and an offset rho, and scoring is a row-wise projection. Training minimises
|w|^2 / 2 - rho + mean(max(0, rho - w.phi)) / nu through its dual: w is always an average
of phi over rows, and each step moves w towards the average over the nu share of rows
with the smallest w.phi (conditional gradient with exact line search). That average takes
one pass over all rows for all candidates together, or a second where a sample misleads.

The linear kernel needs no training: on standardised data equal weights on all rows give
w = 0, the smallest possible, so no row lies below the boundary and every linear
candidate is refused by the outlier-share rule.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outvote.functions.arrow import map_in_arrow
from outvote.functions import kernels
from outvote.functions.frame import SPREAD_ROWS, Features
from outvote.functions.sampling import row_sample, sample_key
from outvote.functions.selection import order_statistics
from outvote.functions.text import name
from outvote.staging import stage

COSINES = 256
# Up to this many rows each candidate is trained by one task on a broadcast copy.
TASK_ROWS = 20_000
TASK_CELLS = 2_000_000
TASK_STEPS = 300
PASS_STEPS = 30
HISTOGRAM_BINS = 1_024
# Rows that tell where a step's share is likely to end, and the most bins summed one by one for it.
WINDOW_SAMPLE = 4_096
WINDOW_BINS = 64
SIDE_SAMPLE = 2_000

# fixed values: the grid in search order, share limits and score weights
NUS = [0.05, 0.1, 0.2]
GAMMAS = ["scale", "auto", 0.01, 0.1]
SHARE_LIMITS = (0.1, 5.0)
SCORE_WEIGHTS = {"silhouette": 1.0, "separation": 0.5, "compactness": 0.3, "isolation": 0.2, "share": 2.0}


@dataclass(frozen=True)
class Candidate:
    kernel: str
    gamma: float
    nu: float


def candidates(features: Features) -> list[Candidate]:
    """The distinct grid points, in grid order. gamma means nothing to the linear kernel."""
    varying = sum(s > 0 for s in features.profile.std)
    known = {"scale": 1.0 / varying if varying else 1.0, "auto": 1.0 / features.d}
    found: list[Candidate] = []
    for gamma in GAMMAS:
        for kernel in ("rbf", "linear"):
            for nu in NUS:
                value = 0.0 if kernel == "linear" else float(known.get(gamma, gamma))
                candidate = Candidate(kernel, value, nu)
                if candidate not in found:
                    found.append(candidate)
    return found


# sin(s) / s in powers of s^2, highest first, to within rounding for s up to a quarter turn
SINE = [(-1) ** k / math.factorial(2 * k + 1) for k in range(10, -1, -1)]
# pi in two parts; the first has so few bits that whole multiples of it are exact
PI_HIGH = 3.141592502593994
PI_LOW = math.pi - PI_HIGH + 1.2246467991473532e-16
# Numbers that are worked on at a time, so that they stay in the cache.
CACHE_CELLS = 65_536


def cosine(half: np.ndarray) -> np.ndarray:
    """cos(2 half) as 1 - 2 sin(half)^2, three times as fast as numpy's. Overwrites half."""
    turns = np.rint(half * (1 / math.pi))
    half -= turns * PI_HIGH
    turns *= PI_LOW
    half -= turns
    square = half * half
    total = np.full_like(half, SINE[0])
    for c in SINE[1:]:
        total *= square
        total += c
    total *= half
    total *= total
    total *= -2
    total += 1
    return total


class CosineMap:
    """phi for several gammas from one set of random directions."""

    def __init__(self, d: int, gammas: list[float], seed: int):
        rng = np.random.default_rng([seed, 7])
        self.directions = rng.standard_normal((d, COSINES))
        self.offsets = rng.uniform(0, 2 * math.pi, COSINES)
        self.gammas = gammas

    def phis(self, x: np.ndarray) -> list[np.ndarray]:
        z, found = x @ self.directions, []
        for g in self.gammas:
            half = z * (math.sqrt(2 * g) / 2)
            half += self.offsets / 2
            phi = cosine(half)
            phi *= math.sqrt(2.0 / COSINES)
            found.append(phi)
        return found

    def in_parts(self, x: np.ndarray):
        """phis of a few rows at a time."""
        step = CACHE_CELLS // COSINES
        for at in range(0, len(x), step):
            yield self.phis(x[at : at + step])


def toward(w: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Exact line search from w towards the tail average."""
    move = w - tail
    length = float(move @ move)
    if length < 1e-24:
        return w
    return w - min(1.0, max(0.0, float(w @ move) / length)) * move


def _train_in_tasks(features: Features, phi: CosineMap, grid: list[tuple[int, float]], seed: int) -> np.ndarray:
    """One task per candidate on a broadcast copy of a table that is small by check."""
    spark = features.df.sparkSession
    p = features.profile
    rows = row_sample(features, features.n, seed)[features.cols].to_numpy(float)
    shared = spark.sparkContext.broadcast((rows - p.mean) / np.where(p.std > 0, p.std, 1.0))

    def train(batches):
        x = shared.value
        for batch in batches:
            for at in batch.column("id").to_pylist():
                gamma, nu = grid[at]
                m = phi.phis(x)[gamma]
                k = max(1, int(math.ceil(nu * len(m))))
                w = m.mean(axis=0)
                for _ in range(TASK_STEPS):
                    value = m @ w
                    tail = m[np.argpartition(value, k - 1)[:k]].mean(axis=0)
                    following = toward(w, tail)
                    if np.array_equal(following, w):
                        break
                    w = following
                yield pa.RecordBatch.from_pydict({"id": [at], "w": [w.tolist()]})

    trained = spark.range(0, len(grid), 1, len(grid)).mapInArrow(train, "id bigint, w array<double>").collect()
    return np.array([r["w"] for r in sorted(trained, key=lambda r: r["id"])])


def _bins_of(value: np.ndarray, reach: float) -> np.ndarray:
    return np.clip(((value / reach + 1) / 2 * HISTOGRAM_BINS).astype(np.int64), 0, HISTOGRAM_BINS - 1)


def _likely_bins(phis: list[np.ndarray], grid: list[tuple[int, float]], w: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """For each candidate the first and the last bin in which the nu share of all rows may end,
    by a sample of them."""
    found = np.zeros((len(grid), 2), np.int64)
    for c, (g, nu) in enumerate(grid):
        value = np.sort(phis[g] @ w[c])
        m = len(value)
        off = 5 * math.sqrt(nu * (1 - nu) / m)
        ends = value[[max(0, math.floor((nu - off) * m)), min(m - 1, math.ceil((nu + off) * m))]]
        first, last = _bins_of(ends, reach[c])
        middle = _bins_of(value[min(m - 1, int(nu * m))], reach[c])
        found[c] = max(first, middle - WINDOW_BINS // 2, 0), min(last, middle + WINDOW_BINS // 2 - 1, HISTOGRAM_BINS - 1)
    return found


def _train_in_passes(features: Features, phi: CosineMap, grid: list[tuple[int, float]], seed: int = 0) -> np.ndarray:
    """All candidates together, over all rows where they lie. Driver data: one weight vector and
    one histogram per candidate, and the sums of phi in WINDOW_BINS bins at most.

    A step needs the histogram and then sums over its lowest bins. One pass gives both: a sample
    tells in which bins the share is likely to end, these have sums of their own, and all below
    are added up. Where it ends elsewhere, a second pass takes the sums; so the sample decides
    how many passes there are, not what comes out."""
    cols, count = features.cols, len(grid)
    df = features.spread().select(*map(name, cols))
    if df.sparkSession.sparkContext.defaultParallelism * SPREAD_ROWS > features.n:
        df = stage(df, "svm-rows")  # else each pass would spread them again
    p = features.profile
    mean, unit = p.mean, np.where(p.std > 0, p.std, 1.0)
    spark = df.sparkSession
    sample = row_sample(features, WINDOW_SAMPLE, seed)[cols].to_numpy(float)
    known = phi.phis((sample - mean) / unit)

    def summed(partial_sums, size: int) -> np.ndarray:
        """Add up one vector of `size` numbers per partition."""

        def run(batches):
            total = np.zeros(size)
            for batch in batches:
                for phis in phi.in_parts((kernels.matrix(batch, cols) - mean) / unit):
                    partial_sums(phis, total)
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(seen, pa.int32()), "v": total[seen]})

        out = np.zeros(size)
        cells = map_in_arrow(df, run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
        out[kernels.column(cells, "cell")] = kernels.column(cells, "v")
        return out

    def all_rows(phis, total):
        view = total.reshape(len(phi.gammas), COSINES)
        for g, m in enumerate(phis):
            view[g] += m.sum(axis=0)

    averages = summed(all_rows, len(phi.gammas) * COSINES).reshape(-1, COSINES) / features.n
    w = np.stack([averages[g] for g, _ in grid])
    for _ in range(PASS_STEPS):
        # |phi| is at most sqrt(2), so values lie in a known range
        reach = np.sqrt(2.0) * np.linalg.norm(w, axis=1) + 1e-12
        likely = _likely_bins(known, grid, w, reach)
        # a candidate's histogram, its sum below the likely bins, and those of each of them
        ends = np.cumsum(HISTOGRAM_BINS + COSINES * (likely[:, 1] - likely[:, 0] + 2))
        parts = np.stack([np.concatenate(([0], ends[:-1])), ends], axis=1)
        shared = spark.sparkContext.broadcast((w.copy(), reach, likely, parts))

        def both(phis, total, shared=shared):
            weights, reach, likely, parts = shared.value
            for c, (g, _) in enumerate(grid):
                at = _bins_of(phis[g] @ weights[c], reach[c])
                (first, last), view = likely[c], total[slice(*parts[c])]
                view[:HISTOGRAM_BINS] += np.bincount(at, minlength=HISTOGRAM_BINS)
                sums = view[HISTOGRAM_BINS:].reshape(-1, COSINES)
                sums[0] += (at < first) @ phis[g]
                rows = np.flatnonzero((at >= first) & (at <= last))
                if len(rows):
                    rows = rows[np.argsort(at[rows], kind="stable")]
                    bins, starts = np.unique(at[rows], return_index=True)
                    sums[1 + bins - first] += np.add.reduceat(phis[g][rows], starts, axis=0)

        total = summed(both, int(ends[-1]))
        last, share = np.zeros(count, dtype=int), np.zeros(count)
        tails, missed = np.zeros((count, COSINES)), False
        for c, (_, nu) in enumerate(grid):
            view, wanted = total[slice(*parts[c])], nu * features.n
            counts = view[:HISTOGRAM_BINS]
            running = counts.cumsum()
            last[c] = int(np.searchsorted(running, wanted))
            before = running[last[c] - 1] if last[c] else 0.0
            share[c] = (wanted - before) / max(counts[last[c]], 1.0)
            place = last[c] - likely[c, 0]
            if 0 <= place and last[c] <= likely[c, 1]:
                sums = view[HISTOGRAM_BINS:].reshape(-1, COSINES)
                tails[c] = sums[: 1 + place].sum(axis=0) + share[c] * sums[1 + place]
            else:
                missed = True

        if missed:

            def tail_sums(phis, total, shared=shared, last=last, share=share):
                weights, reach, _, _ = shared.value
                view = total.reshape(count, COSINES)
                for c, (g, _) in enumerate(grid):
                    at = _bins_of(phis[g] @ weights[c], reach[c])
                    view[c] += (at < last[c]) @ phis[g] + share[c] * ((at == last[c]) @ phis[g])

            tails = summed(tail_sums, count * COSINES).reshape(count, COSINES)
        shared.destroy()
        following = np.stack([toward(w[c], tails[c] / (nu * features.n)) for c, (_, nu) in enumerate(grid)])
        if np.allclose(following, w, rtol=0, atol=1e-9):
            break
        w = following
    return w


def decisions(features: Features, seed: int = 0, in_passes: bool | None = None) -> tuple[DataFrame, list[Candidate]]:
    """features.df plus `decision`, an array with one value per rbf candidate; negative
    means outside the boundary."""
    grid = [c for c in candidates(features) if c.kernel == "rbf"]
    gammas = sorted({c.gamma for c in grid})
    phi = CosineMap(features.d, gammas, seed)
    layout = [(gammas.index(c.gamma), c.nu) for c in grid]
    if in_passes is None:
        in_passes = features.n > TASK_ROWS or features.n * features.d > TASK_CELLS
    w = _train_in_passes(features, phi, layout, seed) if in_passes else _train_in_tasks(features, phi, layout, seed)
    p, cols = features.profile, features.cols
    mean, unit = p.mean, np.where(p.std > 0, p.std, 1.0)
    shared = features.df.sparkSession.sparkContext.broadcast(w)

    def project(batches):
        weights = shared.value
        for batch in batches:
            parts = phi.in_parts((kernels.matrix(batch, cols) - mean) / unit)
            values = [np.column_stack([phis[g] @ weights[c] for c, (g, _) in enumerate(layout)]) for phis in parts]
            value = np.concatenate([np.zeros((0, len(layout))), *values])
            lists = kernels.list_array(value.ravel(), np.full(len(value), len(layout)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "value"])

    schema = T.StructType([*features.df.schema.fields, T.StructField("value", T.ArrayType(T.DoubleType()))])
    values = stage(map_in_arrow(features.spread(), project, schema), "svm-values")
    # rho is the nu quantile of the values, exactly: the share nu of the rows lies outside
    rho = []
    for c, (_, nu) in enumerate(layout):
        rank = max(0, math.ceil(nu * features.n) - 1)
        rho += order_statistics(values.select(F.col("value")[c].alias("v")), "v", [rank], features.n)
    shifted = F.array(*[F.col("value")[c] - F.lit(r) for c, r in enumerate(rho)])
    return values.select(*map(name, features.df.columns), shifted.alias("decision")), grid


def _shape_scores(inl: np.ndarray, out: np.ndarray, n_in: int, n_out: int, data_std: float) -> tuple:
    """Silhouette, compactness and isolation terms from the two sides' (sampled) rows."""

    def distances(a, b):
        return np.sqrt(kernels.squared_distances(a, b))

    ii, oo, oi = distances(inl, inl), distances(out, out), distances(out, inl)

    def side(own, other):
        if len(own) < 2:
            return 0.0
        a, b = own.sum(axis=1) / (len(own) - 1), other.mean(axis=1)
        top = np.maximum(a, b)
        return float(np.mean(np.where(top > 0, (b - a) / np.where(top > 0, top, 1.0), 0.0)))

    silhouette = (n_in * side(ii, oi.T) + n_out * side(oo, oi)) / (n_in + n_out)
    if len(inl) > 1:
        pairs = ii[np.triu_indices(len(inl), 1)]
        spread = pairs.std()
        compactness = -pairs.mean() / spread if spread > 0 else -math.inf
    else:
        compactness = 0.0
    isolation = oi.min(axis=1).mean() / data_std if data_std > 0 else 0.0
    return silhouette, float(compactness), float(isolation)


def candidate_scores(features: Features, decided: DataFrame, grid: list[Candidate], contamination: float, seed: int = 0):
    """Per acceptable candidate (its index, total score, outlier share). Shares, separation
    and spread come from all rows; the quadratic terms from at most SIDE_SAMPLE rows of
    each side, which is everything on a small table."""
    id_col, n = features.require_id(), features.n
    flat = decided.select(F.posexplode("decision").alias("c", "v"))
    outside = F.col("v") < 0
    stats = flat.groupBy("c").agg(
        F.sum(outside.cast("bigint")).alias("k"),
        F.avg(F.when(outside, F.col("v"))).alias("out_mean"),
        F.avg(F.when(~outside, F.col("v"))).alias("in_mean"),
        F.stddev_pop("v").alias("std"),
    )
    low, high = (contamination * limit for limit in SHARE_LIMITS)
    kept = {r["c"]: r for r in stats.collect() if low <= r["k"] / n <= high and 0 < r["k"] < n}
    if not kept:
        return []
    # keys under a per-side threshold: about 1.2 x SIDE_SAMPLE rows per side reach the ordering
    share = {(c, o): min(1.0, (1.2 * SIDE_SAMPLE + 100) / m) for c, r in kept.items() for o, m in ((True, r["k"]), (False, n - r["k"]))}
    limits = F.create_map(*[F.lit(v) for (c, o), s in share.items() for v in (f"{c}{o}", f"{int(s * 2**32):08x}" if s < 1 else "g")])
    wanted = F.array(*[F.struct(F.lit(c).alias("c"), (F.col("decision")[c] < 0).alias("o")) for c in kept])
    sides = (
        decided.select(name(id_col), "decision", *features.scaled_columns())
        .withColumn("key", sample_key(id_col, seed))
        .withColumn("s", F.explode(wanted))
        .withColumn("limit", limits[F.concat(F.col("s.c").cast("string"), F.when(F.col("s.o"), "True").otherwise("False"))])
        .filter(F.col("key") < F.col("limit"))
        .select(F.col("s.c").alias("c"), F.col("s.o").alias("o"), "key", *(F.col(name(c)).alias(f"x{i}") for i, c in enumerate(features.cols)))
    )
    place = Window.partitionBy("c", "o").orderBy("key")
    sampled = sides.withColumn("at", F.row_number().over(place)).filter(F.col("at") <= SIDE_SAMPLE).drop("at", "key")
    p, cols = features.profile, [f"x{i}" for i in range(features.d)]
    data_std = math.sqrt(np.mean(p.std > 0))
    sizes = {c: (n - r["k"], r["k"]) for c, r in kept.items()}

    def shape(table: pa.Table) -> pa.Table:
        c = table.column("c")[0].as_py()
        x, o = kernels.matrix(table, cols), kernels.column(table, "o").astype(bool)
        a, b, e = _shape_scores(x[~o], x[o], *sizes[c], data_std)
        return pa.table({"c": pa.array([c], pa.int32()), "silhouette": [a], "compactness": [b], "isolation": [e]})

    shapes = sampled.groupBy("c").applyInArrow(shape, "c int, silhouette double, compactness double, isolation double")
    weights, scores = SCORE_WEIGHTS, []
    for row in shapes.collect():
        r = kept[row["c"]]
        rate = r["k"] / n
        total = (
            weights["silhouette"] * row["silhouette"]
            + weights["separation"] * (r["in_mean"] - r["out_mean"]) / r["std"]
            + weights["compactness"] * row["compactness"]
            + weights["isolation"] * row["isolation"]
            - weights["share"] * abs(rate - contamination) / contamination
        )
        scores.append((row["c"], total, rate))
    return sorted(scores)


def svm(features: Features, contamination: float, seed: int = 0, in_passes: bool | None = None) -> DataFrame:
    """Rows outside the boundary of the best-scoring candidate; none if none is acceptable."""
    none = features.df.withColumn("score", F.lit(0.0)).withColumn("is_outlier", F.lit(False))
    if contamination == 0 or features.n < 2:
        return none
    decided, grid = decisions(features, seed, in_passes)
    scores = [s for s in candidate_scores(features, decided, grid, contamination, seed) if math.isfinite(s[1])]
    if not scores:
        return none
    # the first of equal scores wins
    best = max(scores, key=lambda s: (s[1], -s[0]))[0]
    value = F.col("decision")[best]
    return decided.select(*features.df.columns, (-value).alias("score"), (value < 0).alias("is_outlier"))
