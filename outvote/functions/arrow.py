"""Arrow functions over tables with any column names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def map_in_arrow(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str
) -> DataFrame:
    """df.mapInArrow, which by itself takes no names with dots or back quotes: such a table's
    columns travel under numbers."""
    names = df.columns
    if not any("." in c or "`" in c for c in names):
        return df.mapInArrow(function, schema)

    def under_own_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return function(pa.RecordBatch.from_arrays(b.columns, names) for b in batches)

    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(under_own_names, schema)
