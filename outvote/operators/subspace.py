"""Random-subspace nearest-neighbour ensemble (inne)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outvote.functions.arrow import map_in_arrow
from outvote.functions import kernels, parameters
from outvote.functions.frame import Features
from outvote.functions.selection import flag_top
from outvote.functions.text import significant
from outvote.operators.forest import per_round_samples
from outvote.staging import stage

TRAIN_ROWS = 256  # fixed value: rows each round measures distances to


def subset_key(seed: int, number: int, feature: int) -> str:
    """Features of a round come in the order of these."""
    return hashlib.md5(f"{seed}:{number}:{feature}".encode()).hexdigest()


def inne_scores(
    features: Features, seed: int = 0, rounds: int | None = None, subspaces: list[list[int]] | None = None
) -> DataFrame:
    """Mean over rounds of the mean distance, in a random feature subset of the scaled
    data, to the nearest of that round's training rows. Appended to features.df.

    The training rows (rounds x 256 x subset features) are broadcast; every row is scored
    where it lies, one pass, no shuffle."""
    n, d = features.n, features.d
    rounds = rounds or parameters.subspace_rounds(n)
    if subspaces is None:
        size = parameters.subspace_features(d)
        subspaces = [sorted(range(d), key=lambda j: subset_key(seed, r, j))[:size] for r in range(rounds)]
    train = min(TRAIN_ROWS, n)
    nearest = max(1, min(parameters.subspace_neighbours(n), train - 1))
    rows, index = per_round_samples(features, rounds, train, seed)
    p = features.profile
    mean, unit = p.mean, np.where(p.std > 0, p.std, 1.0)
    scaled = (rows - mean) / unit
    model = [(subset, scaled[index[r]][:, subset]) for r, subset in enumerate(subspaces[:rounds])]
    shared = features.df.sparkSession.sparkContext.broadcast(model)
    cols = features.cols

    def measure(batches):
        for batch in batches:
            x = (kernels.matrix(batch, cols) - mean) / unit
            total = np.zeros(len(x))
            for subset, points in shared.value:
                total += kernels.mean_nearest(x[:, subset], points, nearest)
            score = pa.array(total / len(shared.value))
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, "score"])

    schema = T.StructType([*features.df.schema.fields, T.StructField("score", T.DoubleType())])
    return map_in_arrow(features.spread(), measure, schema).withColumn("score", F.expr(significant("score")))


def inne(
    features: Features,
    contamination: float,
    seed: int = 0,
    rounds: int | None = None,
    subspaces: list[list[int]] | None = None,
) -> DataFrame:
    if features.n < 5:
        return features.df.withColumn("score", F.lit(0.0)).withColumn("is_outlier", F.lit(False))
    scored = stage(inne_scores(features, seed, rounds, subspaces), "inne")
    return flag_top(scored, contamination, features.n)
