"""Pieces of Spark SQL text. One parsed expression costs far less driver time than a tree
built call by call, which matters for expressions with a term per feature or per pair."""

from __future__ import annotations

import math


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def significant(x: str) -> str:
    """x to 40 of its 53 bits, some 12 significant digits whatever its scale: sums of the
    same terms added in another order still tie. Adding and taking away a multiple drops
    the low bits; no decimal place is special."""
    return f"(({x}) * 8193D - (({x}) * 8193D - ({x})))"


def number(value: float) -> str:
    value = float(value)
    return f"({value!r}D)" if math.isfinite(value) else f"double('{value!r}')"
