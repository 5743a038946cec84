"""The frame detectors work on: an id column and d finite double columns."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass
from functools import cached_property
from threading import Lock, get_ident

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outvote.functions.text import name, number

# Above this many features, per-pair aggregate expressions give way to an Arrow kernel.
EXPRESSION_FEATURES = 16
# Rows per core below which a kernel's input is spread over all cores.
SPREAD_ROWS = 200_000


@dataclass(frozen=True)
class Profile:
    """One row of statistics per feature, from a single aggregation."""

    n: int
    mean: np.ndarray
    std: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @property
    def var(self) -> np.ndarray:
        return self.std**2


class Features:
    """Finite numeric columns plus an optional unique id.

    `df` is scanned many times by the detectors, so it should be a table scan or a
    staged table rather than an expensive plan (see `operators.clean.prepare`).
    """

    def __init__(self, df: DataFrame, cols: list[str], id_col: str | None, profile: Profile | None = None):
        self.df = df
        self.cols = list(cols)
        self.id_col = id_col
        if profile is not None:
            self.__dict__["profile"] = profile
        self._neighbours = None
        self.neighbour_hint = 0
        self._joining = Lock()
        #: Seconds of each thread in, or waiting for, work that several detectors use; of
        #: that work itself under 0.
        self.apart: dict[int, float] = {}

    @property
    def d(self) -> int:
        return len(self.cols)

    @property
    def n(self) -> int:
        return self.profile.n

    @cached_property
    def profile(self) -> Profile:
        aggs = ["count(*) as n"]
        for i, c in enumerate(map(name, self.cols)):
            aggs += [f"avg({c}) as m{i}", f"stddev_pop({c}) as s{i}", f"min({c}) as l{i}", f"max({c}) as h{i}"]
        row = self.df.selectExpr(*aggs).first()

        def stat(key):
            return np.array([math.nan if row[f"{key}{i}"] is None else row[f"{key}{i}"] for i in range(self.d)])

        return Profile(row["n"], stat("m"), stat("s"), stat("l"), stat("h"))

    @property
    def shared_seconds(self) -> float:
        return self.apart.get(0, 0.0)

    def require_id(self) -> str:
        if self.id_col is None:
            raise ValueError("this detector needs a unique id column")
        return self.id_col

    @property
    def integer_id(self) -> bool:
        return isinstance(self.df.schema[self.require_id()].dataType, T.IntegralType)

    @cached_property
    def numbered(self) -> tuple["Features", DataFrame]:
        """The same rows with whole numbers for ids, and the numbers' table (__number, id)."""
        from outvote.operators.clean import with_row_positions

        placed = with_row_positions(self.df, "__number")
        key = name(self.require_id())
        inner = Features(placed.drop(placed[key]), self.cols, "__number", self.profile)
        inner.neighbour_hint, inner.apart = self.neighbour_hint, self.apart
        return inner, placed.select("__number", key)

    def subset(self, cols: list[str]) -> "Features":
        keep = [self.cols.index(c) for c in cols]
        p = self.profile
        part = Profile(p.n, p.mean[keep], p.std[keep], p.low[keep], p.high[keep])
        return Features(self.df, cols, self.id_col, part)

    def varying(self, tiny: float = 1e-10) -> "Features":
        """Only the features whose population variance is not negligible."""
        kept = [c for c, v in zip(self.cols, self.profile.var) if v >= tiny]
        return self if len(kept) == self.d else self.subset(kept)

    def scaled_columns(self) -> list[Column]:
        """(x - mean) / population std; a constant feature is divided by 1."""
        return [
            F.expr(f"({name(c)} - {number(m)}) / {number(s if s > 0 else 1.0)} as {name(c)}")
            for c, m, s in zip(self.cols, self.profile.mean, self.profile.std)
        ]

    @cached_property
    def scaled(self) -> "Features":
        ids = [] if self.id_col is None else [name(self.id_col)]
        p = self.profile
        unit = np.where(p.std > 0, p.std, 1.0)
        profile = Profile(p.n, np.zeros(self.d), p.std / unit, (p.low - p.mean) / unit, (p.high - p.mean) / unit)
        return Features(self.df.select(*ids, *self.scaled_columns()), self.cols, self.id_col, profile)

    def spread(self) -> DataFrame:
        """df for a CPU-heavy row-wise kernel: a small table is spread over all cores, a
        large one already has more partitions than that and stays where it is."""
        cores = self.df.sparkSession.sparkContext.defaultParallelism
        if self.n >= cores * SPREAD_ROWS:
            return self.df
        return self.df.repartition(cores, name(self.id_col)) if self.id_col else self.df.repartition(cores)

    @property
    def lists_wanted(self) -> bool:
        """Whether lists of neighbours are there, or will be asked for by several detectors."""
        return self._neighbours is not None or self.neighbour_hint > 0

    def neighbours(self, k: int) -> DataFrame:
        """The k-nearest-other-rows table, computed once and shared by the detectors.

        A smaller k reads a prefix of the stored lists; neighbour_hint announces the
        largest k that will be asked for."""
        from outvote.operators.knn_join import nearest_others

        begin = time.perf_counter()
        with self._joining:
            if self._neighbours is None or self._neighbours[0] < min(k, self.n - 1):
                k, joined = max(k, self.neighbour_hint), time.perf_counter()
                self._neighbours = (k, nearest_others(self, k))
                self.apart[0] = self.shared_seconds + time.perf_counter() - joined
            # the join, and waiting for it, belong to none of its users
            self.apart[get_ident()] = self.apart.get(get_ident(), 0.0) + time.perf_counter() - begin
            return self._neighbours[1]
