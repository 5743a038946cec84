"""Cleaning: numeric projection, finite-row filter, column subset, row ids, scaling."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outvote.functions.frame import Features
from outvote.functions.text import name
from outvote.staging import discard, stage

# fixed values: texts that callers match
EMPTY = "Input DataFrame is empty or None"
NOTHING_NUMERIC = "No numeric columns with valid finite values found"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def select_columns(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """Column subset; a missing name is an error listing all missing ones."""
    if not columns:
        return df
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"The table has no columns named {missing}")
    return df.select(*[F.col(name(c)) for c in columns])


def finite_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows where every listed column is neither null, NaN nor infinite. NaN sorts above
    infinity in Spark and null compares to null, so one comparison covers all of them."""
    return df.filter(reduce(and_, [F.abs(F.col(name(c))) < F.lit(float("inf")) for c in cols]))


def _features_only(df: DataFrame, cols: list[str], id_col: str | None) -> DataFrame:
    ids = [] if id_col is None else [F.col(name(id_col))]
    return df.select(*ids, *[F.col(name(c)).cast("double").alias(c) for c in cols])


def clean(df: DataFrame | None, id_col: str | None = None) -> DataFrame:
    """Numeric columns as doubles, finite rows only (the id column is carried along)."""
    if df is None or not df.columns or df.isEmpty():
        raise ValueError(EMPTY)
    cols = [c for c in numeric_columns(df) if c != id_col]
    if not cols:
        raise ValueError(NOTHING_NUMERIC)
    out = finite_rows(_features_only(df, cols, id_col), cols)
    if out.isEmpty():
        raise ValueError(NOTHING_NUMERIC)
    return out


def with_row_positions(df: DataFrame, position_col: str = "row_id") -> DataFrame:
    """Consecutive 0-based ids in partition order, without a global sort.

    The table is staged with Spark's per-partition ids first, so they can no longer
    change; the offsets table has one row per input partition."""
    raw = stage(df.withColumn("__raw", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("__raw", 33)
    counts = raw.groupBy(part.alias("__part")).count().orderBy("__part").collect()
    offsets, running = [], 0
    for row in counts:
        offsets.append((row["__part"], running))
        running += row["count"]
    table = df.sparkSession.createDataFrame(offsets or [(0, 0)], "__part bigint, __offset bigint")
    placed = raw.withColumn("__part", part).join(F.broadcast(table), "__part")
    position = F.col("__offset") + F.col("__raw").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.select(position.alias(position_col), *map(name, df.columns))


def prepare(
    df: DataFrame | None,
    id_col: str | None = None,
    columns: list[str] | None = None,
    staged: bool = True,
    assign_ids: bool = False,
) -> Features:
    """Clean a table into the frame detectors use.

    staged=True writes the narrow result once, which pays when the input is more than
    a scan, since detectors pass over it repeatedly. assign_ids adds a `row_id`
    numbering the input rows when there is no key."""
    if df is None or not df.columns:
        raise ValueError(EMPTY)
    placed = None
    if id_col is None and assign_ids:
        df = placed = with_row_positions(select_columns(df, columns))
        id_col = "row_id"
    if columns:
        select_columns(df, columns)
    cols = [c for c in numeric_columns(df) if c != id_col and (not columns or c in columns)]
    if not cols:
        raise ValueError(EMPTY if df.isEmpty() else NOTHING_NUMERIC)
    out = finite_rows(_features_only(df, cols, id_col), cols)
    features = Features(stage(out, "features") if staged else out, cols, id_col)
    if placed is not None and staged:
        discard(placed)
    if features.n == 0:
        raise ValueError(EMPTY if df.isEmpty() else NOTHING_NUMERIC)
    return features


def standardize(features: Features) -> DataFrame:
    return features.scaled.df


def feature_profile(features: Features) -> DataFrame:
    """One row per feature: n, mean, population std, min, max."""
    wide = features.df.agg(
        F.count(F.lit(1)).alias("n"),
        *[
            F.struct(
                *(f(name(c)).alias(k) for k, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max)))
            ).alias(f"s{i}")
            for i, c in enumerate(features.cols)
        ],
    )
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"s{i}").alias("s")) for i, c in enumerate(features.cols)])
    return wide.select("n", F.explode(rows).alias("r")).select("r.feature", "n", "r.s.mean", "r.s.std", "r.s.min", "r.s.max")
