"""Neighbours of whole embeddings."""

import numpy as np
import pytest

from outvote.functions import parameters
from outvote.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_all_entries_of_an_embedding_count(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], float)
    assert x.shape[1] == 64
    far = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T, 0))
    np.fill_diagonal(far, 0)
    wanted = np.sort(far, axis=1)[:, parameters.knn_neighbours(len(x)) - 1]
    found = {r["vec_id"]: r["score"] for r in QUERIES["knn_embeddings_whole"](spark, FOLDER).collect()}
    assert [found[r["vec_id"]] for r in rows] == pytest.approx(wanted, abs=2e-6)
