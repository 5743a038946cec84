"""The tables behind the console report and the report page."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import cached_property, partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outvote.operators import projection as P
from outvote.operators import votes as V
from outvote.plans.run import RunResult
from outvote.staging import stage


def report_tables(run: RunResult, threshold: int | None = None) -> dict[str, DataFrame]:
    """Per-detector results, timing, consensus, agreement distribution and top rows.
    Without a successful detector the vote tables are empty."""
    n = max(1, len(run.successful))
    threshold = V.check_threshold(threshold, n)
    votes = stage(run.votes, "votes")
    chosen = V.consensus(votes, threshold)
    return {
        "detector_stats": run.stats().orderBy(F.desc("n_outliers"), "detector"),
        "timing": run.timing_summary(),
        "metadata": run.metadata(),
        "consensus": V.confidence(chosen, n).orderBy(F.desc("consensus_pct"), "row_id"),
        "agreement_distribution": V.agreement_distribution(chosen, n).orderBy(F.desc("n_votes")),
        "threshold_sweep": V.threshold_sweep(votes, n).orderBy("threshold"),
        "max_agreement": V.max_agreement(votes),
        "top_consensus": V.top_consensus(chosen),
        "best_without_consensus": V.best_without_consensus(votes.filter(F.lit(chosen.isEmpty()))),
    }


class PictureTables(Mapping):
    """Projection, density and hull data for the consensus and for every detector, each made
    when it is asked for. The components are fitted once, and the consensus and its projection
    are staged once."""

    def __init__(self, run: RunResult, threshold: int, seed: int):
        self.run, self.threshold, self.seed = run, threshold, seed
        features = run.features
        self._makers: dict[str, Callable[[], DataFrame]] = {
            "summary": lambda: V.detector_stats(run.flags, run.contamination).select("detector", "n_outliers")
        }
        if features.d < 2:
            return
        self._makers["projection_2d"] = lambda: P.display_sample(features, self._planar, seed)
        if features.d >= 3:
            self._makers["projection_3d"] = lambda: P.projection_table(features, self._agreed, 3, seed, self._components)
        for dim in (2, 3):
            if features.d >= dim:
                self._makers[f"explained_variance_{dim}d"] = partial(self._variance, dim)
        # the sample is for display; density and hulls are of all rows
        self._makers["picture_stats"] = lambda: P.picture_stats(features, self._agreed, 2, self._components)
        self._makers["density"] = lambda: P.hex_density(self._planar.filter("not is_outlier"))
        self._makers["hull_inliers"] = lambda: P.convex_hull(self._planar.filter("not is_outlier"))
        self._makers["hull_outliers"] = lambda: P.convex_hull(self._planar.filter("is_outlier"))
        for name in run.flagged:
            self._makers[f"projection_{name}"] = partial(self._projection, name)

    @cached_property
    def _components(self) -> P.Components:
        return P.Components(self.run.features)

    @cached_property
    def _agreed(self) -> DataFrame:
        key = self.run.features.require_id()
        every = self.run.features.df.select(F.col(key).alias("row_id"))
        agreed = V.consensus_mask(every, stage(self.run.votes, "votes"), self.threshold)
        return stage(agreed.select(F.col("row_id").alias(key), F.col("is_consensus").alias("is_outlier")), "consensus-mask")

    @cached_property
    def _planar(self) -> DataFrame:
        return P.projected_rows(self.run.features, self._agreed, 2, self._components)

    def _variance(self, dim: int) -> DataFrame:
        return P.explained_variance(self.run.features, dim, self._components)

    def _projection(self, name: str) -> DataFrame:
        features = self.run.features
        own = self.run.flagged[name].select(F.col("row_id").alias(features.require_id()), "is_outlier")
        return P.projection_table(features, own, 2, self.seed, self._components)

    def __getitem__(self, name: str) -> DataFrame:
        return self._makers[name]()

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def picture_tables(run: RunResult, threshold: int | None = None, seed: int = 0) -> PictureTables:
    """The tables of the report page. Dimensions the table does not have are left out."""
    return PictureTables(run, V.check_threshold(threshold, max(1, len(run.successful))), seed)
