"""Robust-covariance detectors (elliptic, mcd) and their fallbacks."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outvote.functions import kernels, parameters
from outvote.functions.arrow import map_in_arrow
from outvote.functions.frame import Features
from outvote.functions.moments import PACKED, chi2_quantile, covariance, moments, packed_rows, unpacked, with_quadratic_form
from outvote.functions.ranks import cumulative_counts
from outvote.functions.sampling import row_sample
from outvote.functions.selection import flag_top, order_statistics
from outvote.functions.text import name, significant
from outvote.operators.pair_distances import mean_distance
from outvote.operators.statistical import max_abs_z
from outvote.staging import stage

STARTS = 64
# Numbers in the row sample that starts are tried on, and the rows that makes at most.
START_CELLS = 400_000
START_ROWS = 50_000
# Of these, so many go on to all rows.
CARRIED = 10
MAX_STEPS = 100
# Bits of a distance that one counting pass settles.
DIGIT_BITS = 16
# Rows that may be left to the driver when a selection ends.
OPEN_ROWS = 2_000
# fixed values: probabilities of the consistency correction and of the reweighting cut
CORRECTION, REWEIGHTING = 0.5, 0.975


@dataclass
class Scatter:
    """A location and a covariance; d numbers and d x d numbers on the driver."""

    location: np.ndarray
    cov: np.ndarray

    @property
    def inverse(self) -> np.ndarray:
        return np.linalg.pinv(self.cov, hermitian=True)

    @property
    def log_det(self) -> float:
        sign, value = np.linalg.slogdet(self.cov)
        return value if sign > 0 else -math.inf

    def distances(self, features: Features) -> DataFrame:
        return with_quadratic_form(features.df, features.cols, self.location, self.inverse, "score")


def concentration_step(features: Features, scatter: Scatter, h: int) -> Scatter:
    """Location and covariance of the h rows nearest to the current estimate (rows tied
    with the h-th included): exact selection, then one aggregation over those rows."""
    return concentration_steps(features, [scatter], h)[0]


def concentration_steps(features: Features, scatters: list[Scatter], h: int) -> list[Scatter]:
    """A concentration step of several estimates at once. The h-th least distances are found
    digit by digit: distances are not negative, so the integers of their bits have the same
    order. A pass counts the next DIGIT_BITS bits of the distances that agree so far, for all
    estimates, until few are left; the last one sums up the rows within the limits."""
    cols, d = features.cols, features.d
    df = features.df.select(*map(name, cols))
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast([(s.location, s.inverse) for s in scatters])

    def distances(x: np.ndarray) -> list[np.ndarray]:
        gaps = (x - location for location, _ in shared.value)
        return [np.maximum(np.einsum("ij,ij->i", g @ inverse, g), 0) for g, (_, inverse) in zip(gaps, shared.value)]

    prefix, below, open_ = [0] * len(scatters), [0] * len(scatters), [features.n] * len(scatters)
    shift = 64
    while shift and max(open_) > OPEN_ROWS:
        shift -= DIGIT_BITS

        def count(batches, shift=shift, prefix=tuple(prefix)):
            total = np.zeros((len(prefix), 1 << DIGIT_BITS))
            for batch in batches:
                for k, value in enumerate(distances(kernels.matrix(batch, cols))):
                    bits = value.view(np.uint64)
                    if shift + DIGIT_BITS < 64:
                        bits = bits[bits >> np.uint64(shift + DIGIT_BITS) == np.uint64(prefix[k])]
                    digit = (bits >> np.uint64(shift)) & np.uint64((1 << DIGIT_BITS) - 1)
                    total[k] += np.bincount(digit.astype(np.int64), minlength=total.shape[1])
            yield packed_rows(list(total))

        counts = unpacked(map_in_arrow(df, count, PACKED))
        for k in range(len(scatters)):
            running = below[k] + np.cumsum(counts[k])
            digit = int(np.searchsorted(running, h))  # the h-th least is the first to reach h
            open_[k] = int(counts[k][digit])
            below[k] = int(running[digit]) - open_[k]
            prefix[k] = prefix[k] << DIGIT_BITS | digit

    # rows below the prefix are summed; the few that share it come to the driver, unless all
    # bits are known: then those rows are tied, and summed as well
    tied = not shift

    def sums(batches, shift=shift, prefix=tuple(prefix)):
        total = [np.zeros(1 + d + d * d) for _ in prefix]
        rest: list[list[np.ndarray]] = [[] for _ in prefix]
        for batch in batches:
            x = kernels.matrix(batch, cols)
            for k, value in enumerate(distances(x)):
                first = value.view(np.uint64) >> np.uint64(shift) if shift < 64 else np.zeros(len(value), np.uint64)
                last = np.uint64(prefix[k])
                gap = x - shared.value[k][0]
                near = gap[first <= last if tied else first < last]
                total[k][0] += len(near)
                total[k][1 : d + 1] += near.sum(axis=0)
                total[k][d + 1 :] += (near.T @ near).ravel()
                if not tied:
                    same = first == last
                    rest[k].append(np.column_stack((value[same], gap[same])).ravel())
        yield packed_rows(total)
        # a block of its own for each task and estimate
        task = 1 + TaskContext.get().partitionId()
        left = {task * len(prefix) + k: np.concatenate(r) for k, r in enumerate(rest) if sum(map(len, r))}
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int32()), pa.array([v.tobytes() for v in left.values()], pa.binary())], ["block", "data"])

    found, made = unpacked(map_in_arrow(df, sums, PACKED)), []
    shared.destroy()
    for k, scatter in enumerate(scatters):
        total = found[k]
        rows = [v.reshape(-1, 1 + d) for b, v in sorted(found.items()) if b >= len(scatters) and b % len(scatters) == k]
        if rows:
            rows = np.concatenate(rows)
            limit = np.sort(rows[:, 0])[h - below[k] - 1]
            near = rows[rows[:, 0] <= limit, 1:]
            total = total + np.concatenate(([len(near)], near.sum(axis=0), (near.T @ near).ravel()))
        n, shift_ = total[0], total[1 : d + 1] / total[0]
        made.append(Scatter(scatter.location + shift_, total[d + 1 :].reshape(d, d) / n - np.outer(shift_, shift_)))
    return made


def concentrate(features: Features, starts: list[Scatter], h: int, steps: int = MAX_STEPS) -> Scatter:
    """Concentration steps until no determinant falls any more; the least one's estimate, the
    first of several. Raises if some determinant still falls after `steps`."""
    current = list(starts)
    # an estimate without an extent cannot move
    moving = [k for k, s in enumerate(starts) if s.log_det > -math.inf]
    for _ in range(steps):
        if not moving:
            break
        for k, following in zip(list(moving), concentration_steps(features, [current[k] for k in moving], h)):
            if following.log_det >= current[k].log_det - 1e-9 or following.log_det == -math.inf:
                moving.remove(k)
            if following.log_det <= current[k].log_det + 1e-9:
                current[k] = following
    if not moving:
        return min(current, key=lambda s: s.log_det)
    raise ArithmeticError(f"no convergence in {steps} concentration steps")


def start_rows(d: int) -> int:
    return min(START_ROWS, max(2_000, START_CELLS // d))


def starting_scatters(features: Features, support: float, seed: int) -> list[Scatter]:
    """The best of many random starts, each concentrated on a bounded row sample."""
    spark, d = features.df.sparkSession, features.d
    table = row_sample(features, start_rows(d), seed)
    rows, ids = table[features.cols].to_numpy(float), [str(i) for i in table[features.id_col]]
    h = max(1, int(support * len(rows)))
    shared = spark.sparkContext.broadcast((rows, ids))

    def try_starts(batches):
        x, ids = shared.value
        for batch in batches:
            for start in batch.column("id").to_pylist():
                # rows in the order of a hash, so that any engine can draw the same ones
                keys = [(hashlib.md5(f"{seed}:{start}:{i}".encode()).hexdigest(), i) for i in ids]
                # small starts escape outliers, large ones (one in four) find points held by most rows
                chosen = np.array(sorted(range(len(x)), key=keys.__getitem__)[: h if start % 4 == 3 else d + 1])
                last = math.inf
                for _ in range(MAX_STEPS):
                    location = x[chosen].mean(axis=0)
                    gap = x[chosen] - location
                    cov = gap.T @ gap / len(chosen)
                    sign, log_det = np.linalg.slogdet(cov)
                    log_det = log_det if sign > 0 else -math.inf
                    if len(chosen) == h and (log_det >= last - 1e-12 or log_det == -math.inf):
                        break
                    last = log_det if len(chosen) == h else math.inf
                    away = x - location
                    dist = np.einsum("ij,ij->i", away @ np.linalg.pinv(cov, hermitian=True), away)
                    chosen = np.argsort(dist, kind="stable")[:h]
                yield pa.RecordBatch.from_pydict(
                    {"start": [start], "log_det": [log_det], "location": [location.tolist()], "cov": [cov.ravel().tolist()]}
                )

    schema = "start bigint, log_det double, location array<double>, cov array<double>"
    tasks = min(STARTS, spark.sparkContext.defaultParallelism)
    tried = spark.range(0, STARTS, 1, tasks).mapInArrow(try_starts, schema)
    found: list[Scatter] = []
    for row in tried.orderBy("log_det", "start").collect():  # STARTS rows
        scatter = Scatter(np.array(row["location"]), np.array(row["cov"]).reshape(d, d))
        # many starts end alike
        if not any(abs(scatter.log_det - other.log_det) < 1e-9 or scatter.log_det == other.log_det for other in found):
            found.append(scatter)
    return found[:CARRIED]


def _shortest_spans(features: Features, h: int) -> tuple[float, float]:
    """Of sorted values, the least x[r + h] - x[r], and the mean middle of all r that have it.

    A value holds a run of ranks, so both ends are steps over r. The ranks where either end
    steps are put in order; between two of them both ends stay. Values ascend, so an end's
    value at a rank is the greatest one begun by then: a running maximum inside each range
    of ranks, and the ranges' maxima before it."""
    n = features.n
    counts, _ = cumulative_counts(features)
    first = F.col("cum") - F.col("cnt")
    none = F.lit(None).cast("double")
    steps = counts.select(first.alias("at"), F.col("v").alias("low"), none.alias("high")).unionByName(
        counts.select((first - F.lit(h)).alias("at"), none.alias("low"), F.col("v").alias("high"))
    )
    merged = steps.groupBy("at").agg(F.max("low").alias("low"), F.max("high").alias("high"))
    ranged = stage(merged.repartitionByRange("at").withColumn("part", F.spark_partition_id()), "half-steps")
    # a row for each range
    of_part = ranged.groupBy("part").agg(F.max("low").alias("low"), F.max("high").alias("high"), F.min("at").alias("begin"))
    parts = Window.partitionBy(F.lit(0)).orderBy("part")
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    carried = of_part.select(
        "part",
        F.max("low").over(before).alias("low_before"),
        F.max("high").over(before).alias("high_before"),
        F.lead("begin").over(parts).alias("after"),
    )
    inside = Window.partitionBy("part").orderBy("at")
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = ranged.select(
        "part", "at", F.max("low").over(running).alias("low"), F.max("high").over(running).alias("high"), F.lead("at").over(inside).alias("next")
    ).join(F.broadcast(carried), "part")
    low, high = F.greatest("low", "low_before"), F.greatest("high", "high_before")
    end = F.least(F.coalesce("next", "after", F.lit(n - h)), F.lit(n - h))
    spans = spans.select((high - low).alias("width"), ((low + high) / 2).alias("middle"), (end - F.greatest("at", F.lit(0))).alias("rows"))
    spans = stage(spans.filter("rows > 0"), "half-spans")
    width = spans.agg(F.min("width")).first()[0]
    tied = spans.filter(F.col("width") == F.lit(width)).agg(F.sum(F.col("middle") * F.col("rows")).alias("s"), F.sum("rows").alias("n")).first()
    return width, tied["s"] / tied["n"]


def _shortest_half(features: Features, h: int) -> Scatter:
    """One feature: the middle of the shortest interval over h + 1 sorted values (the mean one
    of several), and the variance of the h values nearest to it, lower ones first."""
    n, x = features.n, features.cols[0]
    if h >= n:
        return Scatter(features.profile.mean, np.array([[features.profile.var[0]]]))
    _, middle = _shortest_spans(features, h)
    away = features.df.select((F.col(name(x)) - F.lit(middle)).alias("d"))
    gap = away.withColumn("gap", F.expr(significant("abs(d)")))  # both sides tie although the middle is rounded
    (limit,) = order_statistics(gap, "gap", [h - 1], n)
    side = F.when(F.col("gap") < F.lit(limit), 0).when(F.col("d") < 0, 1).otherwise(2).alias("side")
    sums = gap.filter(F.col("gap") <= F.lit(limit)).groupBy(side).agg(
        F.count(F.lit(1)).alias("n"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("q")
    )
    left, total, square = h, 0.0, 0.0
    for row in sorted(sums.collect(), key=lambda r: r["side"]):  # three rows
        taken = min(left, row["n"])
        left -= taken
        total, square = total + row["s"] * taken / row["n"], square + row["q"] * taken / row["n"]
    return Scatter(np.array([middle]), np.array([[max(0.0, square / h - (total / h) ** 2)]]))


def reweighted(features: Features, raw: Scatter, h: int) -> Scatter:
    """Scale the raw covariance to agree with a normal sample's median distance, then
    re-estimate from all rows that are not far out."""
    d, n = features.d, features.n
    if h < n and np.allclose(raw.cov, 0):
        raise ValueError("the supporting rows all lie on one point: no robust covariance")
    measured = raw.distances(features)
    low, high = order_statistics(measured, "score", [(n - 1) // 2, n // 2], n)
    correction = (low + high) / 2 / chi2_quantile(CORRECTION, d)
    near = measured.filter(F.col("score") < F.lit(chi2_quantile(REWEIGHTING, d) * correction))
    _, location, cov = moments(near, features.cols, raw.location)
    return Scatter(location, cov)


def robust_scatter(features: Features, support: float, seed: int) -> Scatter:
    """Minimum covariance determinant with correction and reweighting."""
    h = max(1, int(support * features.n))
    if features.d == 1:
        raw = _shortest_half(features, h)
    else:
        raw = concentrate(features, starting_scatters(features, support, seed), h)
    return reweighted(features, raw, h)


def from_classical_start(features: Features, support: float, steps: int) -> Scatter:
    """A fixed number of concentration steps from the ordinary mean and covariance: no
    randomness, for data known to be mildly contaminated."""
    h = max(1, int(support * features.n))
    raw = Scatter(features.profile.mean, covariance(features))
    for _ in range(steps):
        raw = concentration_step(features, raw, h)
    return reweighted(features, raw, h)


def _none_flagged(features: Features) -> DataFrame:
    return features.df.withColumn("score", F.lit(0.0)).withColumn("is_outlier", F.lit(False))


def _flag_distances(features: Features, scatter: Scatter, contamination: float, all_features: Features) -> DataFrame:
    scored = with_quadratic_form(all_features.df, features.cols, scatter.location, scatter.inverse, "score")
    return flag_top(scored.withColumn("score", F.expr(significant("score"))), contamination, features.n)


def elliptic(features: Features, contamination: float, seed: int = 0, steps: int | None = None) -> DataFrame:
    """Robust elliptic envelope. Falls back to mean pairwise distance when the covariance
    cannot be estimated or inverted. With `steps`, a fixed number of concentration steps
    from the classical estimate replaces the search from random starts."""
    n = features.n
    varying = features.varying()
    if n < 2 or varying.d == 0:
        return _none_flagged(features)
    if varying.d >= n:
        return mean_distance(features, contamination)
    if varying.d > 1:
        # the condition number does not depend on the factor n / (n - 1)
        try:
            singular = np.linalg.cond(covariance(varying)) > 1e12
        except np.linalg.LinAlgError:
            singular = True
        if singular:
            return mean_distance(features, contamination)
    support = parameters.elliptic_support(n, features.d)
    scatter = robust_scatter(varying, support, seed) if steps is None else from_classical_start(varying, support, steps)
    return _flag_distances(varying, scatter, contamination, features)


def mcd(features: Features, contamination: float, seed: int = 0, steps: int | None = None) -> DataFrame:
    """Minimum covariance determinant distances, with z-score and mean-distance fallbacks.
    `steps` as in elliptic."""
    n = features.n
    if n < 2:
        return _none_flagged(features)
    if n <= features.d:
        return max_abs_z(features, contamination)
    varying = features.varying()
    if varying.d == 0:
        return _none_flagged(features)
    support = parameters.mcd_support(n, varying.d)
    try:
        scatter = robust_scatter(varying, support, seed) if steps is None else from_classical_start(varying, support, steps)
    except (np.linalg.LinAlgError, ValueError):
        return mean_distance(features, contamination)
    return _flag_distances(varying, scatter, contamination, features)
