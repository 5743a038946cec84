import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from outvote.functions.frame import Features  # noqa: E402
from outvote.operators.clean import prepare  # noqa: E402
from outvote.staging import local_session, release_staged  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, memory="6g", shuffle_partitions=4)
    yield session
    release_staged(session)
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """numpy matrix -> Features with id column `id`."""

    def make(x, ids=None, parts=3) -> Features:
        x = np.asarray(x, float)
        cols = [f"x{j}" for j in range(x.shape[1])]
        ids = range(len(x)) if ids is None else ids
        rows = [(int(i), *map(float, r)) for i, r in zip(ids, x)]
        schema = "id bigint, " + ", ".join(f"{c} double" for c in cols)
        return prepare(spark.createDataFrame(rows, schema).repartition(parts), "id")

    return make


@pytest.fixture(scope="session")
def mask():
    """Flagged DataFrame -> boolean array in id order."""

    def get(flagged):
        rows = sorted((r["id"], r["is_outlier"]) for r in flagged.select("id", "is_outlier").collect())
        return np.array([r[1] for r in rows])

    return get


@pytest.fixture(scope="session")
def scores():
    def get(scored):
        rows = sorted((r["id"], r["score"]) for r in scored.select("id", "score").collect())
        return np.array([r[1] for r in rows])

    return get
