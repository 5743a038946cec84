"""Detectors that need only per-feature statistics: zscore, hbos, copod, ecod."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outvote.functions import parameters
from outvote.functions.frame import Features
from outvote.functions.lookup import lookup_join
from outvote.functions.ranks import cumulative_counts
from outvote.functions.selection import flag_top, order_statistics
from outvote.functions.text import name, number, significant
from outvote.staging import stage

# Distinct values, over all features together, whose look-up tables may be broadcast.
BROADCAST_VALUES = 1_000_000
# Above this many features, value look-ups share one join.
WIDE_FEATURES = 8


def largest(terms: list[str]) -> str:
    return terms[0] if len(terms) == 1 else f"greatest({', '.join(terms)})"


def absolute_z(features: Features, guarded: bool = True) -> list[str]:
    """|x - mean| / population std per feature. The guard zeroes a feature whose spread is
    negligible, absolutely or relative to its mean; without it only constants drop out."""
    p = features.profile
    out = []
    for i, c in enumerate(features.cols):
        mean, std = float(p.mean[i]), float(p.std[i])
        reach = max(p.high[i] - mean, mean - p.low[i]) / (abs(mean) + 1e-10)
        flat = std < 1e-10 or reach < 1e-12 if guarded else std == 0
        out.append("0D" if flat else f"abs(({name(c)} - {number(mean)}) / {number(std)})")
    return out


def zscore_scores(features: Features, guarded: bool = True) -> DataFrame:
    return features.df.withColumn("score", F.expr(largest(absolute_z(features, guarded))))


def zscore(features: Features, contamination: float, seed: int = 0) -> DataFrame:
    return flag_top(zscore_scores(features), contamination, features.n)


def max_abs_z(features: Features, contamination: float) -> DataFrame:
    """The fallback for more features than rows."""
    return flag_top(zscore_scores(features, guarded=False), contamination, features.n)


def _edges(features: Features, i: int, bins: int) -> tuple[float, float, list[float]]:
    """Lower end, bin width and all edges of a feature's histogram; a constant feature gets
    half a unit on either side."""
    low, high = float(features.profile.low[i]), float(features.profile.high[i])
    if low == high:
        low, high = low - 0.5, high + 0.5
    step = (high - low) / bins
    return low, step, [low + b * step for b in range(bins)] + [high]


def _with_bins(features: Features, bins: int) -> DataFrame:
    """Add the bin of every feature value, __own0, __own1, ..."""
    ends = [_edges(features, i, bins)[:2] for i in range(features.d)]
    # floor division is only a first guess (one projection): the explicit edges decide (the next)
    guesses, owns = {}, {}
    for i, (c, (low, step)) in enumerate(zip(features.cols, ends)):
        x, low, step, guess = name(c), number(low), number(step), f"__guess{i}"
        guesses[guess] = F.expr(f"least(greatest(cast(floor(({x} - {low}) / {step}) as int), 0), {bins - 1})")
        owns[f"__own{i}"] = F.expr(
            f"{guess} + if({guess} < {bins - 1} and {x} >= {low} + ({guess} + 1) * {step}, 1, 0)"
            f" - if({guess} > 0 and {x} < {low} + {guess} * {step}, 1, 0)"
        )
    return features.df.withColumns(guesses).withColumns(owns).drop(*guesses)


def histograms(features: Features, bins: int) -> DataFrame:
    """(f, bin, cnt): at most bins rows per feature."""
    cells = ", ".join(f"named_struct('f', {i}, 'bin', __own{i})" for i in range(features.d))
    exploded = _with_bins(features, bins).select(F.expr(f"explode(array({cells})) as c"))
    return exploded.groupBy("c.f", "c.bin").agg(F.count(F.lit(1)).alias("cnt"))


def hbos_scores(features: Features, own_bin: bool = False) -> DataFrame:
    """Sum over features of -ln(density), densities floored at 1e-6.

    By default the density of the *next* bin is used (x in (e_i, e_i+1] reads bin i+1,
    the last bin reads itself), which is the behaviour users of the original expect;
    own_bin=True reads the value's own bin."""
    n, bins = features.n, parameters.histogram_bins(features.n)
    counts = [[0] * bins for _ in range(features.d)]
    for row in histograms(features, bins).collect():
        counts[row["f"]][row["bin"]] = row["cnt"]
    terms = []
    for i, c in enumerate(features.cols):
        low, step, edges = _edges(features, i, bins)
        costs = [-math.log(max(k / (n * (edges[b + 1] - edges[b])), 1e-6)) for b, k in enumerate(counts[i])]
        bin_ = f"__own{i}"
        if not own_bin:
            past_edge = f"if({name(c)} > {number(low)} + {bin_} * {number(step)}, 1, 0)"
            bin_ = f"least({bin_} + {past_edge}, {bins - 1})"
        terms.append(f"get(array({', '.join(map(number, costs))}), {bin_})")
    scored = _with_bins(features, bins).select(*map(name, features.df.columns), F.expr(f"{' + '.join(terms)} as score"))
    return scored.withColumn("score", F.expr(significant("score")))


def hbos(features: Features, contamination: float, seed: int = 0, own_bin: bool = False) -> DataFrame:
    return flag_top(stage(hbos_scores(features, own_bin), "hbos"), contamination, features.n)


def _tail_total(features: Features, tail: str, wide_features: int = WIDE_FEATURES, **limits) -> DataFrame:
    """features.df plus `total`: the sum over features of `tail`, an expression over cum and
    cnt, looked up by value."""
    table, distinct = cumulative_counts(features, **limits)
    if features.d > wide_features and features.id_col:
        # many features: one join on (feature, value) instead of a join per feature. A row's
        # terms are added up where they were exploded, so the last shuffle has n rows.
        pairs = ", ".join(f"named_struct('f', {i}, 'v', {name(c)})" for i, c in enumerate(features.cols))
        key = features.id_col
        exploded = features.df.select(key, F.expr(f"inline(array({pairs}))"))
        tails = table.selectExpr("f", "v", f"{tail} as t", "cnt as __uses")
        rows = features.n * features.d
        joined = lookup_join(exploded, tails, ["f", "v"], sum(distinct.values()), rows, "__uses", F.col(key))
        return features.df.join(joined.groupBy(key).agg(F.sum("t").alias("total")), key)
    rows = features.df
    spread = F.col(name(features.id_col)) if features.id_col else F.monotonically_increasing_id()
    budget = BROADCAST_VALUES
    for i, c in sorted(enumerate(features.cols), key=lambda f: distinct[f[0]]):
        tails = table.filter(f"f = {i}").selectExpr(f"v as {name(c)}", f"{tail} as __t{i}", "cnt as __uses")
        rows = lookup_join(rows, tails, c, distinct[i], features.n, "__uses", spread, broadcast_rows=budget)
        budget -= distinct[i] if distinct[i] <= budget else 0
    total = " + ".join(f"__t{i}" for i in range(features.d))
    return rows.select(*map(name, features.df.columns), F.expr(f"{total} as total"))


def copod_scores(features: Features, **limits) -> DataFrame:
    """Sum over features of the larger tail's -ln probability at the average rank."""
    above = number(features.n + 1.0)
    f, eps = f"(cum - (cnt - 1) / 2D) / {above}", f"1D / {above}"
    rows = _tail_total(features, f"greatest(-ln({f} + {eps}), -ln(1D - {f} + {eps}))", **limits)
    return stage(rows.select(*map(name, features.df.columns), F.expr(significant("total")).alias("raw_score")), "copod")


def _median(df: DataFrame, col: str, n: int) -> float:
    low, high = order_statistics(df, col, [(n - 1) // 2, n // 2], n)
    return (low + high) / 2


def copod(features: Features, contamination: float, seed: int = 0) -> DataFrame:
    """Flags come from the raw score: scaling by median and MAD keeps its order."""
    raw = copod_scores(features)
    n = features.n
    median = _median(raw, "raw_score", n)
    mad = _median(raw.select(F.abs(F.col("raw_score") - F.lit(median)).alias("gap")), "gap", n) or 1.0
    flagged = flag_top(raw, contamination, n, "raw_score")
    score = (F.col("raw_score") - F.lit(median)) / F.lit(mad)
    return flagged.select(*map(name, features.df.columns), score.alias("score"), "is_outlier")


def ecod_scores(features: Features, **limits) -> DataFrame:
    """exp of the mean over features of -ln(min(F, 1 - F) + 1e-10), F = share of values <= x."""
    f = f"cum / {number(features.n)}"
    rows = _tail_total(features, f"-ln(least({f}, 1D - {f}) + 1e-10D)", **limits)
    score = f"exp({significant(f'total / {number(features.d)}')}) as score"
    return stage(rows.select(*map(name, features.df.columns), F.expr(score)), "ecod")


def ecod(features: Features, contamination: float, seed: int = 0) -> DataFrame:
    return flag_top(ecod_scores(features), contamination, features.n)
