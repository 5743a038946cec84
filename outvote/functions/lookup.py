"""Equi-join of many rows with a table of unique keys, safe for hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outvote.functions.text import name

# A lookup table is broadcast only when its counted rows stay under this bound.
BROADCAST_ROWS = 200_000
# A key is hot when it holds more than 1/HOT_SHARE of the rows: at most HOT_SHARE keys are.
HOT_SHARE = 512


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    key: str | list[str],
    table_rows: int,
    total_rows: int,
    uses: str | None = None,
    spread: Column | None = None,
    how: str = "inner",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join rows with table on `key`, which is unique in table.

    Small tables (counted, not guessed) are broadcast. Otherwise both sides shuffle,
    and each hot key is split over as many salts as its share of the rows calls for;
    its single table row is repeated once per salt. `uses` names the table column that
    says how many rows carry the key (dropped from the result), `spread` is a column
    that differs between rows with the same key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if table_rows <= broadcast_rows:
        return rows.join(F.broadcast(table.drop(uses) if uses else table), keys, how)
    if uses is None:
        return rows.join(table, keys, how)
    per_salt = max(1, total_rows // HOT_SHARE)
    salted = table.withColumn("__salts", F.greatest(F.lit(1), F.ceil(F.col(uses) / F.lit(per_salt)).cast("int")))
    hot = salted.filter("__salts > 1").select(*map(name, keys), F.col("__salts").alias("__n"))
    salt = F.coalesce(F.pmod(F.xxhash64(spread), F.col("__n")).cast("int"), F.lit(0))
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", salt).drop("__n")
    right = salted.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).drop("__salts", uses)
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
