"""Exact order statistics of a distributed column, and the flag rule built on them."""

from __future__ import annotations

import math
from itertools import accumulate, groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outvote.functions.text import number

# Up to this many values the exact aggregate (a value -> count map in one reducer) is used.
EXACT_LIMIT = 100_000
SKETCH_ACCURACY = 10_000


def quantile_position(n: int, contamination: float) -> int:
    """Index of the largest score that is not flagged: flags are scores above the
    (1 - contamination) percentile, and a strict comparison with the interpolated
    percentile equals a strict comparison with its lower order statistic."""
    fraction = ((1 - contamination) * 100) / 100
    return min(n - 1, max(0, math.floor((n - 1) * fraction)))


def order_statistics(
    df: DataFrame, col: str, positions: list[int], n: int, exact_limit: int = EXACT_LIMIT
) -> list[float]:
    """Exact values at 0-based sorted positions of a column without nulls.

    A quantile sketch brackets each position, one pass counts the bracket, and the
    bracket is narrowed until an exact aggregate over it is small. Every pass is one
    aggregation with map-side partials; only counts and single values reach the driver.
    """
    values = df.select(F.col(col).cast("double").alias("__v"))
    v = F.col("__v")
    found: dict[int, float] = {}
    # brackets: (low, high, rows below low, rows in [low, high], positions wanted inside).
    # Conditions stay inside the aggregates: a filter would be pushed into the expressions
    # the column is computed from and repeat them.
    open_ = [(-math.inf, math.inf, 0, n, sorted(set(positions)))]

    def inside(low: float, high: float) -> str:
        return f"__v >= {number(low)} and __v <= {number(high)}"

    while open_:
        small = [b for b in open_ if b[3] <= exact_limit]
        if small:
            picks = [
                F.expr(
                    f"percentile_disc({number((p - below + 0.5) / count)}) "
                    f"within group (order by if({inside(low, high)}, __v, null)) as p{p}"
                )
                for low, high, below, count, wanted in small
                for p in wanted
            ]
            found.update({int(k[1:]): value for k, value in values.agg(*picks).first().asDict().items()})
        open_ = [b for b in open_ if b[3] > exact_limit]
        if not open_:
            break

        sketches, spans = [], []
        for low, high, below, count, wanted in open_:
            # positions closer than the sketch can tell apart share a bracket
            margin = 2.0 / SKETCH_ACCURACY
            for p in wanted:
                q = (p - below + 0.5) / count
                if spans and spans[-1][0] == (low, high) and q - margin <= spans[-1][2]:
                    spans[-1][2] = q + margin
                    spans[-1][3].append(p)
                else:
                    spans.append([(low, high), q - margin, q + margin, [p], below, count])
        for (low, high), group in groupby(spans, key=lambda s: s[0]):
            fractions = [min(1.0, max(0.0, q)) for s in group for q in s[1:3]]
            sketches.append(
                F.expr(
                    f"percentile_approx(if({inside(low, high)}, __v, null), "
                    f"array({', '.join(map(number, fractions))}), {SKETCH_ACCURACY})"
                )
            )
        ends = [value for column in values.agg(*sketches).first() for value in column]
        counts = []
        for i in range(len(spans)):
            low, high = number(ends[2 * i]), number(ends[2 * i + 1])
            counts += [
                F.expr(f"count_if(__v < {low})"),
                F.expr(f"count_if(__v = {low})"),
                F.expr(f"count_if(__v > {low} and __v < {high})"),
                F.expr(f"count_if(__v = {high} and __v > {low})"),
            ]
        counted = values.agg(*[c.alias(f"c{i}") for i, c in enumerate(counts)]).first()
        open_ = []
        for i, ((old_low, old_high), _, _, wanted, below, count) in enumerate(spans):
            low, high = ends[2 * i], ends[2 * i + 1]
            at_low, at_mid, at_high, above = accumulate(counted[4 * i : 4 * i + 4])
            under, middle, over = [], [], []
            for p in wanted:
                if at_low <= p < at_mid:
                    found[p] = low
                elif at_high <= p < above:
                    found[p] = high
                else:
                    (under if p < at_low else middle if p < at_high else over).append(p)
            # ties at either end are outside the middle, so it is at most the sketch window
            after, before = math.nextafter(low, math.inf), math.nextafter(high, -math.inf)
            for part in (
                (old_low, math.nextafter(low, -math.inf), below, at_low - below, under),
                (after, before, at_mid, at_high - at_mid, middle),
                (math.nextafter(high, math.inf), old_high, above, below + count - above, over),
            ):
                if part[4]:
                    open_.append(part)
    return [found[p] for p in positions]


def percentiles(df: DataFrame, col: str, fractions: list[float], n: int) -> list[float]:
    """Linearly interpolated percentiles from exact order statistics."""
    spots = [(n - 1) * f for f in fractions]
    lows = [math.floor(s) for s in spots]
    highs = [min(n - 1, low + 1) for low in lows]
    got = order_statistics(df, col, lows + highs, n)
    low_values, high_values = got[: len(spots)], got[len(spots) :]
    return [a + (b - a) * (s - low) for a, b, s, low in zip(low_values, high_values, spots, lows)]


def flag_top(scored: DataFrame, contamination: float, n: int, score: str = "score") -> DataFrame:
    """Add is_outlier: score strictly above its (1 - contamination) percentile."""
    (limit,) = order_statistics(scored, score, [quantile_position(n, contamination)], n)
    return scored.withColumn("is_outlier", F.col(score) > F.lit(limit))
