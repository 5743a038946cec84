"""Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word, wherever words are counted.
WORD = r"[^\x20\x09-\x0D]+"


def named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def others(df: DataFrame, made: Iterable[str]) -> list[Column]:
    """The columns of df apart from those an operator makes itself (whatever their case):
    an input column of such a name gives way to the operator's."""
    taken = {c.lower() for c in made}
    return [named(c) for c in df.columns if c.lower() not in taken]


def needed(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the named columns, under the given names."""
    return df.select(*(named(c).alias(name) for name, c in wanted.items()))


class Beside:
    """A table's columns under numbers, beside columns an operator makes: none can clash,
    whatever names the table has."""

    def __init__(self, df: DataFrame, **made: Column):
        self.columns = df.columns
        self.numbers = [f"c{i}" for i in range(len(df.columns))]
        self.df = df.select("*", *made.values()).toDF(*self.numbers, *made)

    def number(self, column: str) -> str:
        """The number of a column, found by its name or else by its name in any case."""
        if column in self.columns:
            return self.numbers[self.columns.index(column)]
        return self.numbers[[c.lower() for c in self.columns].index(column.lower())]

    def others(self, made: Iterable[str] = ()) -> list[Column]:
        """The table's own columns under their names, apart from those of the names given."""
        taken = {c.lower() for c in made}
        return [F.col(n).alias(c) for n, c in zip(self.numbers, self.columns) if c.lower() not in taken]
