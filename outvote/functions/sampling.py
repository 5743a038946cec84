"""Uniform row samples that are the same on every run and every engine."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outvote.functions.frame import Features

# Largest row sample any detector brings to the driver.
MAX_SAMPLE = 1_100_000


def sample_key(id_col: str, seed: int) -> Column:
    """Rows ordered by this text are in a seeded random order."""
    return F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))


def first_by_key(df: DataFrame, id_col: str, m: int, n: int, seed: int) -> DataFrame:
    """The m rows with the smallest sample keys. A threshold on the key keeps about m
    rows before anything is ordered, so partitions do not each offer m candidates."""
    keyed = df.withColumn("__key", sample_key(id_col, seed))
    if m < n:
        share = min(1.0, (m + 8 * math.sqrt(m) + 64) / n)
        if share < 1.0:
            keyed = keyed.filter(F.col("__key") < F.lit(f"{int(share * 2**32):08x}"))
    return keyed


def row_sample(features: Features, m: int, seed: int) -> pd.DataFrame:
    """At most m rows, in key order, on the driver. m is bounded by MAX_SAMPLE."""
    if m > MAX_SAMPLE:
        raise ValueError(f"a sample of {m} rows is not meant for the driver")
    id_col = features.require_id()
    wanted = min(m, features.n)
    got = first_by_key(features.df, id_col, wanted, features.n, seed).toPandas()
    if len(got) < wanted:
        # the key threshold was unlucky: take the exact order instead
        keyed = features.df.withColumn("__key", sample_key(id_col, seed))
        got = keyed.orderBy("__key", id_col).limit(wanted).toPandas()
    got = got.sort_values(["__key", id_col], ignore_index=True).head(wanted)
    return got.drop(columns="__key")
