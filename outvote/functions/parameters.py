"""Detector settings as functions of the row count n and the feature count d."""

from __future__ import annotations

import math

# fixed values: the bounds and factors in these rules define the expected results


def dbscan_neighbours(n: int) -> int:
    return max(20, min(50, int(math.sqrt(n))))


def dbscan_min_samples(n: int) -> int:
    return max(5, min(20, int(n * 0.005)))


def forest_trees(n: int) -> int:
    return max(50, min(200, int(n / 10)))


def forest_sample(n: int) -> int:
    return min(256, n)


def lof_neighbours(n: int) -> int:
    return min(n - 1, max(min(n, 20), min(50, int(math.log(n) * 3))))


def knn_neighbours(n: int) -> int:
    """Counts the row itself as its first neighbour."""
    return min(n, max(min(n, 20), min(40, int(math.log(n) * 2))))


def histogram_bins(n: int) -> int:
    return max(5, min(50, int(math.log2(n)) + 1))


def subspace_rounds(n: int) -> int:
    return max(50, min(200, int(math.log2(n) * 10)))


def subspace_features(d: int) -> int:
    return max(1, min(d, int(math.sqrt(d))))


def subspace_neighbours(n: int) -> int:
    return max(1, min(10, int(math.log(n))))


def elliptic_support(n: int, d: int) -> float:
    return max(0.5, min(0.9, (n - d - 1) / n))


def mcd_support(n: int, d: int) -> float:
    rows = min(n, max(d + 1, int(n * 0.5)))
    return max(0.5, min(0.9, rows / n))
