"""A balanced tree of axis-parallel cuts, built from a bounded sample."""

from __future__ import annotations

import numpy as np


def build_cuts(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Heap-ordered (feature, value) cuts: each node halves its sample rows along the
    feature with the widest spread. Rows go right when x[feature] > value."""
    inner = 2**depth - 1
    feature, value = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
    members = {0: np.arange(len(sample))}
    for node in range(inner):
        rows = members.pop(node, np.zeros(0, dtype=np.int64))
        left = right = rows[:0]
        if len(rows) > 1:
            block = sample[rows]
            f = int(np.argmax(block.max(axis=0) - block.min(axis=0)))
            column = block[:, f]
            low, high = column.min(), column.max()
            if low < high:
                cut = np.median(column)
                if cut >= high:
                    cut = column[column < high].max()
                feature[node], value[node] = f, cut
                goes_right = column > cut
                left, right = rows[~goes_right], rows[goes_right]
            else:
                left = rows
        else:
            left = rows
        if 2 * node + 1 < inner:
            members[2 * node + 1], members[2 * node + 2] = left, right
    return feature, value


def leaf_of(x: np.ndarray, feature: np.ndarray, value: np.ndarray, depth: int) -> np.ndarray:
    node = np.zeros(len(x), dtype=np.int64)
    rows = np.arange(len(x))
    for _ in range(depth):
        node = 2 * node + 1 + (x[rows, feature[node]] > value[node])
    return node - (2**depth - 1)


def boxes_within(x: np.ndarray, radius: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Flat (row, box, distance) triples where the box comes within radius of the row. Rows are
    taken in chunks of similar radius and place, so most boxes are ruled out per chunk."""
    order = np.lexsort((x[:, 0], np.floor(np.log2(np.maximum(radius, 1e-300)))))
    rows_out, boxes_out, gaps_out = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
    for at in range(0, len(order), 256):
        rows = order[at : at + 256]
        block, r = x[rows], radius[rows]
        reach = r.max()
        near = np.all((low <= block.max(axis=0) + reach) & (high >= block.min(axis=0) - reach), axis=1).nonzero()[0]
        if len(near) == 0:
            continue
        d2 = np.zeros((len(rows), len(near)))
        for j in range(x.shape[1]):
            gap = np.maximum(low[near, j][None, :] - block[:, j, None], block[:, j, None] - high[near, j][None, :])
            d2 += np.maximum(gap, 0.0) ** 2
        hit_row, hit_box = np.nonzero(d2 <= (r**2 * (1 + 1e-12))[:, None])
        rows_out.append(rows[hit_row])
        boxes_out.append(near[hit_box])
        gaps_out.append(np.sqrt(d2[hit_row, hit_box]))
    return np.concatenate(rows_out), np.concatenate(boxes_out), np.concatenate(gaps_out)
