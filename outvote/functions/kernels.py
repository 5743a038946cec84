"""Small numpy helpers used inside tasks on one Arrow batch or one group."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from outvote.functions.partition_tree import boxes_within, build_cuts, leaf_of

# Doubles per distance block: about 32 MB.
BLOCK = 4_000_000
# The same while nearest points are picked, which holds several such arrays.
SEARCH_BLOCK = 1_000_000
# Entries found in a local search before they are cut down to the k best of each query.
SEARCH_FOUND = 1_000_000
SLACK = 1 + 1e-12
# Points per cell of a task's local search, and the most features cells are of use for.
CELL_POINTS = 512
CELL_FEATURES = 12
# Features from which a matrix product pays before exact differences.
PRODUCT_FEATURES = 8


def matrix(table, cols: list[str]) -> np.ndarray:
    """Columns of an Arrow table or batch as a dense row-major matrix."""
    return np.column_stack([table.column(c).to_numpy(zero_copy_only=False) for c in cols]).astype(float, copy=False)


def _to_numpy(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def column(table, name: str) -> np.ndarray:
    return _to_numpy(table.column(name))


def list_array(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A list column: `counts[i]` consecutive entries of values belong to row i."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differences are squared directly: |a|^2 + |b|^2 - 2ab cancels on unscaled data."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = a[:, j, None] - b[None, :, j]
        gap *= gap
        out += gap
    return out


def smallest(d2: np.ndarray, k: int, limit2: np.ndarray | None = None):
    """Per row of squared distances, the k smallest distances ordered by (distance, column)
    as flat arrays (row, column, distance). Ties at the k-th go to the lowest columns.
    Entries above limit2 (one bound per row) are left out."""
    k = min(k, d2.shape[1])
    cut = np.partition(d2, k - 1, axis=1)[:, k - 1] if k < d2.shape[1] else np.full(len(d2), np.inf)
    if limit2 is not None:
        cut = np.minimum(cut, limit2)
    # a hair of slack: squares that differ in the last digit can have equal roots
    row, col = np.nonzero(d2 <= (cut * SLACK)[:, None])
    value = np.sqrt(d2[row, col])
    order = np.lexsort((col, value, row))
    row, col, value = row[order], col[order], value[order]
    starts = np.searchsorted(row, np.arange(len(d2)))
    keep = np.arange(len(row)) - starts[row] < k
    return row[keep], col[keep], value[keep]


def smallest_by_product(queries: np.ndarray, points: np.ndarray, k: int, limit2: np.ndarray):
    """What `smallest` finds, for many features. One matrix product gives every square to
    within a bound; only the pairs that it leaves open are squared difference by difference."""
    centre = points.mean(axis=0)
    q, p = queries - centre, points - centre
    q2, p2 = (q * q).sum(axis=1), (p * p).sum(axis=1)
    rough = q @ p.T
    rough *= -2
    rough += q2[:, None]
    rough += p2
    error = 8 * (q.shape[1] + 8) * np.finfo(float).eps * (np.sqrt(q2) + math.sqrt(p2.max())) ** 2
    k = min(k, len(points))
    cut = np.partition(rough, k - 1, axis=1)[:, k - 1] if k < len(points) else np.full(len(q), np.inf)
    # k squares are at most cut + error, and those within that seem at most cut + 2 errors
    row, col = np.nonzero(rough <= (np.minimum(cut + 2 * error, limit2 * SLACK + error) * SLACK)[:, None])
    value = np.zeros(len(row))
    for j in range(q.shape[1]):
        gap = queries[row, j] - points[col, j]
        gap *= gap
        value += gap
    kept = value <= limit2[row] * SLACK
    row, col, value = row[kept], col[kept], np.sqrt(value[kept])
    order = np.lexsort((col, value, row))
    row, col, value = row[order], col[order], value[order]
    keep = np.arange(len(row)) - np.searchsorted(row, np.arange(len(q)))[row] < k
    return row[keep], col[keep], value[keep]


def _nearest_in_blocks(queries: np.ndarray, points: np.ndarray, k: int, limit: np.ndarray):
    step = max(1, SEARCH_BLOCK // max(1, len(points)))
    parts = []
    for at in range(0, len(queries) if len(points) else 0, step):
        block = slice(at, at + step)
        if queries.shape[1] >= PRODUCT_FEATURES:
            row, col, value = smallest_by_product(queries[block], points, k, limit[block] ** 2)
        else:
            row, col, value = smallest(squared_distances(queries[block], points), k, limit[block] ** 2)
        parts.append((row + at, col, value))
    if not parts:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(p) for p in zip(*parts))


def nearest_points(queries: np.ndarray, points: np.ndarray, k: int, limit: np.ndarray | None = None):
    """k nearest points per query as flat (query, point, distance) arrays, at most `limit`
    away. Many points in few dimensions are cut into cells first: a query's own cell bounds
    its radius, and only cells within that radius are looked at."""
    radius = np.full(len(queries), np.inf) if limit is None else np.array(limit, float)
    if len(points) <= CELL_POINTS * 4 or points.shape[1] > CELL_FEATURES or len(queries) == 0:
        return _nearest_in_blocks(queries, points, k, radius)
    depth = math.ceil(math.log2(len(points) / CELL_POINTS))
    cuts = build_cuts(points[:: max(1, CELL_POINTS // 16)], depth)
    cell_of_point = leaf_of(points, *cuts, depth)
    order = np.argsort(cell_of_point, kind="stable")
    cells, starts = np.unique(cell_of_point[order], return_index=True)
    ends = np.append(starts[1:], len(order))
    low, high = np.minimum.reduceat(points[order], starts), np.maximum.reduceat(points[order], starts)
    leaf = leaf_of(queries, *cuts, depth)
    own = np.minimum(np.searchsorted(cells, leaf), len(cells) - 1)
    own[cells[own] != leaf] = -1

    def look(rows: np.ndarray, at: np.ndarray) -> list[tuple]:
        found = []
        by_cell = np.argsort(at, kind="stable")
        named, firsts = np.unique(at[by_cell], return_index=True)
        for cell, group in zip(named, np.split(rows[by_cell], firsts[1:])):
            members = order[starts[cell] : ends[cell]]
            row, col, dist = _nearest_in_blocks(queries[group], points[members], k, radius[group])
            found.append((group[row], members[col], dist))
        return found

    # queries of the same and of nearby cells together; what they find is cut down at once
    k = min(k, len(points))
    counts = np.zeros(len(queries), np.int64)
    best_col, best_dist = np.zeros((len(queries), k), np.int64), np.zeros((len(queries), k))
    by_place, at_once = np.argsort(own, kind="stable"), max(256, SEARCH_FOUND // (4 * k))
    for begin in range(0, len(queries), at_once):
        rows = by_place[begin : begin + at_once]
        found = look(rows[own[rows] >= 0], own[rows[own[rows] >= 0]])
        if found:
            row, _, dist = (np.concatenate(p) for p in zip(*found))
            number, farthest = np.bincount(row, minlength=len(queries)), np.zeros(len(queries))
            np.maximum.at(farthest, row, dist)
            radius[rows] = np.where(number[rows] >= k, np.minimum(radius[rows], farthest[rows]), radius[rows])
        row, box, _ = boxes_within(queries[rows], radius[rows], low, high)
        row = rows[row]
        other = box != own[row]
        found += look(row[other], box[other])
        if not found:
            continue
        row, col, dist = (np.concatenate(p) for p in zip(*found))
        best = np.lexsort((col, dist, row))
        row, col, dist = row[best], col[best], dist[best]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < k
        row, place = row[kept], place[kept]
        best_col[row, place], best_dist[row, place] = col[kept], dist[kept]
        counts += np.bincount(row, minlength=len(queries))
    there = np.arange(k) < counts[:, None]
    return np.repeat(np.arange(len(queries)), counts), best_col[there], best_dist[there]


def mean_nearest(queries: np.ndarray, points: np.ndarray, k: int) -> np.ndarray:
    """Mean distance to the k nearest points."""
    step = max(1, BLOCK // 8 // max(1, len(points)))
    out = np.empty(len(queries))
    for at in range(0, len(queries), step):
        d2 = squared_distances(queries[at : at + step], points)
        if k < d2.shape[1]:
            d2.partition(k - 1, axis=1)
        out[at : at + step] = np.sqrt(np.sort(d2[:, :k], axis=1)).mean(axis=1)
    return out
