"""Means, covariances and quadratic forms over all rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outvote.functions.arrow import map_in_arrow
from outvote.functions import kernels
from outvote.functions.frame import EXPRESSION_FEATURES, Features
from outvote.functions.text import name, number

# Columns of a block of products, and tasks that add up a block in the first round.
BLOCK_COLUMNS = 64
FIRST_ROUND = 16
PACKED = "block int, data binary"


def _blocks(d: int) -> list[tuple[slice, slice]]:
    """The pairs of column blocks on and above the diagonal."""
    parts = [slice(at, min(at + BLOCK_COLUMNS, d)) for at in range(0, d, BLOCK_COLUMNS)]
    return [(a, b) for i, a in enumerate(parts) for b in parts[i:]]


def add_up(rows: DataFrame) -> DataFrame:
    """rows of (block, data: packed doubles) with the sum of each block's rows, in two rounds: a
    task of the first takes a FIRST_ROUND-th of a block's rows."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                values = np.frombuffer(data.as_buffer(), float)
                total[block] = total[block] + values if block in total else values.copy()
        if total:
            data = [v.tobytes() for v in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array(data, pa.binary())], ["block", "data"])

    share = F.pmod(F.spark_partition_id(), F.lit(FIRST_ROUND)).alias("share")
    rows = rows.select("*", share).repartition("block", "share").drop("share").mapInArrow(add, PACKED)
    return rows.repartition("block").mapInArrow(add, PACKED)


def packed_rows(values: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each array, numbered."""
    return pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array([v.tobytes() for v in values], pa.binary())], ["block", "data"])


def unpacked(rows: DataFrame) -> dict[int, np.ndarray]:
    """The sums of the blocks on the driver; their number and size are the caller's to bound."""
    found = add_up(rows).toArrow()
    return {b: np.frombuffer(x, float) for b, x in zip(found.column("block").to_pylist(), found.column("data").to_pylist())}


def _wide_sums(df: DataFrame, cols: list[str], center: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sums and products around the centre. A task sums its products in one matrix and
    hands them on in blocks of columns."""
    d, pairs = len(cols), _blocks(len(cols))

    def partial(batches):
        n, first, second = 0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            x = kernels.matrix(batch, cols) - center
            n, first = n + len(x), first + x.sum(axis=0)
            second += x.T @ x
        yield packed_rows([np.append(first, n), *(second[a, b] for a, b in pairs)])

    sums = unpacked(map_in_arrow(df.select(*map(name, cols)), partial, PACKED))
    if not sums:
        return 0, np.zeros(d), np.zeros((d, d))
    second = np.zeros((d, d))
    for k, (a, b) in enumerate(pairs):
        second[a, b] = sums[k + 1].reshape(a.stop - a.start, b.stop - b.start)
        second[b, a] = second[a, b].T
    return int(sums[0][-1]), sums[0][:-1], second


def moments(df: DataFrame, cols: list[str], center: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, mean and population covariance from one aggregation. Sums are taken
    around `center` (an earlier estimate of the mean) so that they do not cancel."""
    d = len(cols)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    if d <= EXPRESSION_FEATURES:
        gap = [f"({name(c)} - {number(m)})" for c, m in zip(cols, center)]
        sums = [f"sum({g}) as s{i}" for i, g in enumerate(gap)]
        products = [f"sum({gap[i]} * {gap[j]}) as p{i}_{j}" for i, j in pairs]
        row = df.selectExpr("count(*) as n", *sums, *products).first()
        n = row["n"]
        first = np.array([row[f"s{i}"] or 0.0 for i in range(d)])
        second = [row[f"p{i}_{j}"] or 0.0 for i, j in pairs]
    else:
        n, first, second = _wide_sums(df, cols, center)
    if n == 0:
        return 0, np.array(center, float), np.zeros((d, d))
    shift = first / n
    cov = np.zeros((d, d))
    if d > EXPRESSION_FEATURES:
        return n, np.asarray(center, float) + shift, second / n - np.outer(shift, shift)
    for (i, j), p in zip(pairs, second):
        cov[i, j] = cov[j, i] = p / n - shift[i] * shift[j]
    return n, np.asarray(center, float) + shift, cov


def covariance(features: Features) -> np.ndarray:
    """Population covariance of all rows."""
    return moments(features.df, features.cols, features.profile.mean)[2]


def with_quadratic_form(
    df: DataFrame, cols: list[str], center: np.ndarray, inverse: np.ndarray, name_: str
) -> DataFrame:
    """Append (x - center)' inverse (x - center): squared Mahalanobis distance."""
    d = len(cols)
    if d <= EXPRESSION_FEATURES // 2:
        gap = [f"({name(c)} - {number(m)})" for c, m in zip(cols, center)]
        terms = [
            f"{number(inverse[i, j] * (1 if i == j else 2))} * {gap[i]} * {gap[j]}" for i in range(d) for j in range(i, d)
        ]
        return df.withColumn(name_, F.expr(" + ".join(terms)))

    def measure(batches):
        for batch in batches:
            x = kernels.matrix(batch, cols) - center
            value = pa.array(np.einsum("ij,ij->i", x @ inverse, x))
            yield pa.RecordBatch.from_arrays([*batch.columns, value], [*batch.schema.names, name_])

    return map_in_arrow(df, measure, T.StructType([*df.schema.fields, T.StructField(name_, T.DoubleType())]))


def _lower_gamma(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function by its power series."""
    if x <= 0:
        return 0.0
    term = total = 1.0 / a
    k = a
    while term > total * 1e-17:
        k += 1.0
        term *= x / k
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a)))


def chi2_quantile(p: float, d: int) -> float:
    """The value a chi-squared variable with d degrees of freedom stays under with
    probability p, by bisection."""
    low, high = 0.0, 1.0
    while _lower_gamma(d / 2, high / 2) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if _lower_gamma(d / 2, mid / 2) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2
