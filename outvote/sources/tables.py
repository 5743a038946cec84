"""Reading inputs and writing results."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outvote.functions.text import name

# fixed values: texts read as missing
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
NUMBER = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"


def read_csv(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, **options) -> DataFrame:
    """A headed CSV with numeric columns as doubles and the rest as text.

    A quote inside a quoted field is doubled. Pass multiLine=True for fields with line breaks;
    files can't be split then.

    Types are not left to schema inference: there one literal NA turns a numeric column
    into text. A column is numeric when each of its non-missing values is a number, which
    one aggregation over the (selected) columns decides."""
    from outvote.operators.clean import select_columns

    raw = spark.read.options(**{"header": True, "nullValue": "", "escape": '"', **options}).csv(path)
    raw = select_columns(raw, columns)
    names = raw.columns
    text = raw.select(*[F.when(~F.col(name(c)).isin(NA_TOKENS), F.col(name(c))).alias(c) for c in names])
    odd = text.agg(*[F.count(F.when(~F.col(name(c)).rlike(NUMBER), 1)).alias(f"c{i}") for i, c in enumerate(names)]).first()
    return text.select(
        *[
            F.trim(F.col(name(c))).try_cast("double").alias(c) if odd[f"c{i}"] == 0 else F.col(name(c))
            for i, c in enumerate(names)
        ]
    )


def read_parquet(spark: SparkSession, *paths: str, columns: list[str] | None = None) -> DataFrame:
    from outvote.operators.clean import select_columns

    return select_columns(spark.read.parquet(*paths), columns)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write one result table. An existing path is an error, never overwritten."""
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}: csv, json or parquet")
    return path


def write_report(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> dict[str, str]:
    """One sub-folder per report table."""
    return {k: write_table(df, f"{folder.rstrip('/')}/{k}", fmt) for k, df in tables.items()}
