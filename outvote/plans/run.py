"""The detector registry, running detectors, and the whole pipeline."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import get_ident

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outvote.functions import parameters
from outvote.functions.frame import Features
from outvote.operators import votes as V
from outvote.operators.clean import prepare
from outvote.operators.forest import estimate_contamination, isoforest
from outvote.operators.neighbourhood import dbscan, knn, lof
from outvote.operators.robust import elliptic, mcd
from outvote.operators.statistical import copod, ecod, hbos, zscore
from outvote.operators.subspace import inne
from outvote.operators.svm import svm
from outvote.sources.tables import read_csv, write_table
from outvote.staging import stage

Detector = Callable[..., DataFrame]

# Name -> detector(features, contamination, seed=...) giving features.df's id, a score and
# is_outlier. Add an entry to make a detector of your own selectable by name.
DETECTORS: dict[str, Detector] = {
    "zscore": zscore,
    "dbscan": dbscan,
    "isoforest": isoforest,
    "lof": lof,
    "svm": svm,
    "elliptic": elliptic,
    "knn": knn,
    "mcd": mcd,
    "copod": copod,
    "hbos": hbos,
    "inne": inne,
    "ecod": ecod,
}


def check_contamination(contamination: float) -> float:
    if contamination < 0 or contamination > 0.5:
        # fixed value: callers match this text
        raise ValueError("Contamination must be between 0.0 and 0.5")
    return contamination


def check_detectors(names: list[str] | None) -> list[str]:
    names = list(names) if names else list(DETECTORS)
    invalid = [n for n in names if n not in DETECTORS]
    if invalid:
        # fixed value: callers match the first two words
        raise ValueError(f"Invalid algorithm(s): {invalid}; known are {', '.join(DETECTORS)}")
    return names


@dataclass
class RunResult:
    """Flags of all successful detectors and what is known about the run."""

    spark: SparkSession
    features: Features
    contamination: float
    requested: list[str]
    successful: list[str]
    errors: dict[str, str]
    seconds: dict[str, float]
    total_seconds: float
    flagged: dict[str, DataFrame] = field(repr=False)

    @property
    def flags(self) -> DataFrame:
        """(row_id, detector, score, is_outlier), one row per table row and detector."""
        if not self.flagged:
            return self.spark.createDataFrame([], "row_id bigint, detector string, score double, is_outlier boolean")
        out = None
        for df in self.flagged.values():
            out = df if out is None else out.unionByName(df)
        return out

    @property
    def votes(self) -> DataFrame:
        return V.votes(self.flags)

    def timings(self) -> DataFrame:
        rows = [(n, self.seconds.get(n), self.errors.get(n)) for n in self.requested]
        return self.spark.createDataFrame(rows, "detector string, execution_time double, error string")

    def stats(self) -> DataFrame:
        """One row per requested detector; a failed one has only its error."""
        return self.timings().join(V.detector_stats(self.flags, self.contamination), "detector", "left")

    def timing_summary(self) -> DataFrame:
        """Total, mean, fastest and slowest detector, over the successful ones. What detectors
        share (the neighbour join) is a column of its own and in none of their times; times of
        detectors that ran side by side overlap, so they may add up to more than the total."""
        done = self.timings().filter("execution_time is not null")
        return done.agg(
            F.lit(self.total_seconds).alias("total_time"),
            F.lit(self.features.shared_seconds).alias("shared_time"),
            F.coalesce(F.avg("execution_time"), F.lit(0.0)).alias("average_time"),
            F.min_by("detector", "execution_time").alias("fastest_algorithm"),
            F.max_by("detector", "execution_time").alias("slowest_algorithm"),
            F.coalesce(F.min("execution_time"), F.lit(0.0)).alias("fastest_time"),
            F.coalesce(F.max("execution_time"), F.lit(0.0)).alias("slowest_time"),
        )

    def metadata(self) -> DataFrame:
        """One row: shape, contamination, requested, successful and failed detectors."""
        failed = [n for n in self.requested if n in self.errors]
        row = (
            self.features.n,
            self.features.d,
            float(self.contamination),
            self.requested,
            self.successful,
            failed,
            len(self.successful) / len(self.requested) if self.requested else 0.0,
        )
        return self.spark.createDataFrame(
            [row],
            "n_rows bigint, n_features int, contamination_used double, algorithms_requested array<string>, "
            "algorithms_successful array<string>, algorithms_failed array<string>, success_rate double",
        )


def run_all(
    data: Features | DataFrame,
    detectors: list[str] | None = None,
    contamination: float | None = None,
    id_col: str | None = None,
    seed: int = 0,
    at_once: int = 4,
) -> RunResult:
    """Run detectors, `at_once` of them submitting Spark jobs at a time. An error in one is
    recorded and the others go on.

    Each detector's flags are written to the shared folder inside its own try, so that a
    failure is attributed to it, and votes and reports read three narrow columns."""
    names = check_detectors(detectors)
    if contamination is not None:
        check_contamination(contamination)
    features = data if isinstance(data, Features) else prepare(data, id_col, assign_ids=id_col is None)
    if contamination is None:
        contamination = check_contamination(estimate_contamination(features, seed))
    if {"knn", "lof"} <= set(names) and features.n > 1:
        # one neighbour join serves both
        features.neighbour_hint = max(parameters.lof_neighbours(features.n), parameters.knn_neighbours(features.n) - 1)
    flagged, errors, seconds = {}, {}, {}
    begin = time.perf_counter()

    def run_one(name: str) -> None:
        started, apart = time.perf_counter(), features.apart.get(get_ident(), 0.0)
        try:
            found = DETECTORS[name](features, contamination, seed=seed)
            narrow = found.select(
                F.col(features.require_id()).alias("row_id"), F.lit(name).alias("detector"), "score", "is_outlier"
            )
            flagged[name] = stage(narrow, f"flags-{name}")
            seconds[name] = time.perf_counter() - started - (features.apart.get(get_ident(), 0.0) - apart)
        except Exception as error:  # any failure belongs to this detector alone
            errors[name] = str(error).split("\n")[0]

    with ThreadPoolExecutor(max_workers=max(1, at_once)) as pool:
        list(pool.map(inheritable_thread_target(features.df.sparkSession)(run_one), names))
    flagged = {n: flagged[n] for n in names if n in flagged}
    successful = [n for n in names if n in flagged]
    return RunResult(
        features.df.sparkSession, features, contamination, names, successful, errors, seconds,
        time.perf_counter() - begin, flagged,
    )


@dataclass
class Detection:
    run: RunResult
    threshold: int
    consensus: DataFrame
    report: dict[str, DataFrame]
    cleaned: DataFrame
    written: str | None


def detect_outliers(
    spark: SparkSession,
    source: str | DataFrame,
    detectors: list[str] | None = None,
    contamination: float | None = None,
    consensus_threshold: int | None = None,
    columns: list[str] | None = None,
    id_col: str | None = None,
    output: str | None = None,
    output_format: str = "csv",
    all_columns: bool = False,
    seed: int = 0,
) -> Detection:
    """Read, clean, estimate, detect, vote, report, and (with output) write the rows that
    are not consensus outliers.

    The cleaned rows hold the numeric columns of finite rows; all_columns keeps every
    column of the input instead (which then needs an id_col)."""
    from outvote.plans.report import report_tables

    check_detectors(detectors)
    if contamination is not None:
        check_contamination(contamination)
    if isinstance(source, str):
        table = spark.read.parquet(source) if source.rstrip("/").endswith(".parquet") else read_csv(spark, source)
    else:
        table = source
    features = prepare(table, id_col, columns, assign_ids=id_col is None)
    run = run_all(features, detectors, contamination, seed=seed)
    threshold = V.check_threshold(consensus_threshold, max(1, len(run.successful)))
    chosen = V.consensus(run.votes, threshold)
    key = features.id_col
    if all_columns:
        if id_col is None:
            raise ValueError("keeping all columns needs an id column")
        kept = table.join(features.df.select(key), key, "left_semi")
        cleaned = V.remove_outliers(kept, chosen, key)
    else:
        cleaned = V.remove_outliers(features.df, chosen, key)
        cleaned = cleaned if id_col else cleaned.drop(key)
    written = write_table(cleaned, output, output_format) if output else None
    return Detection(run, threshold, chosen, report_tables(run, threshold), cleaned, written)
