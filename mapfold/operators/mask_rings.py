"""Rings around the components of masks, over arrays of many components at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from mapfold.operators.run_labels import group_starts, whole_groups

LABEL = ["map_id", "key", "lrow", "lcol"]


def _steps(group: np.ndarray, row: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> list[np.ndarray]:
    """(group, y, x, ty, tx, way): the boundary of runs as steps that keep the set pixels on their right, in order of (group, y, x, way).

    Pixel (row, col) is the square from (col, row) to (col + 1, row + 1). way is 0 right,
    1 down, 2 left, 3 up.
    """
    c1 = c1 + 1
    # along a line between two rows: how many runs below and above it cover each stretch
    one, none = np.ones(len(row), np.int64), np.zeros(len(row), np.int64)
    marks = [np.concatenate(c) for c in ((group,) * 4, (row, row, row + 1, row + 1), (c0, c1, c0, c1), (one, -one, none, none), (none, none, one, -one))]
    by = np.lexsort(marks[2::-1])
    g, y, x, below, above = (c[by] for c in marks)
    below, above = np.cumsum(below), np.cumsum(above)  # every run ends where it began to count
    flat = np.flatnonzero((below != above)[:-1] & (x[1:] > x[:-1]) & (y[1:] == y[:-1]) & (g[1:] == g[:-1]))
    right = below[flat] > above[flat]
    a, b = x[flat], x[flat + 1]
    sides = [
        (g[flat], y[flat], np.where(right, a, b), y[flat], np.where(right, b, a), np.where(right, 0, 2)),
        (group, row, c1, row + 1, c1, one),
        (group, row + 1, c0, row, c0, 3 * one),
    ]
    steps = [np.concatenate(c) for c in zip(*sides, strict=True)]
    by = np.lexsort((steps[5], steps[2], steps[1], steps[0]))
    return [c[by] for c in steps]


def _followed(g: np.ndarray, y: np.ndarray, x: np.ndarray, ty: np.ndarray, tx: np.ndarray, way: np.ndarray) -> np.ndarray:
    """The step after each one: where corners of two pixels touch, the turn to the right stays with the pixel."""
    n = len(g)
    of = np.concatenate([x, tx]), np.concatenate([y, ty]), np.concatenate([g, g])
    by = np.lexsort(of)
    new = np.any([c[by[1:]] != c[by[:-1]] for c in of], axis=0)
    point = np.empty(2 * n, np.int64)
    point[by] = np.concatenate([[0], np.cumsum(new)])
    out = np.argsort(point[:n], kind="stable")
    low, high = (np.searchsorted(point[:n][out], point[n:], side) for side in ("left", "right"))
    first, last = out[low], out[high - 1]
    return np.where((high - low > 1) & (way[last] == (way + 1) % 4), last, first)


def _ring_places(follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, ahead) of each step: the least of its ring, and how many steps on it comes. Pointer doubling as in chains.ring_ranks."""
    least, off, to, span = np.arange(len(follows)), np.zeros(len(follows), np.int64), follows, np.ones(len(follows), np.int64)
    while True:
        fell = least[to] < least
        if not fell.any():
            return least, off
        off, least = np.where(fell, span + off[to], off), np.where(fell, least[to], least)
        span, to = span + span[to], to[to]


def mask_rings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of labelled runs (map_id, key, lrow, lcol, row, c0, c1) in order of label to (map_id, key, lrow, lcol, ring, holes)."""
    for rows in whole_groups(batches, LABEL):
        begins = group_starts(rows, LABEL)
        group = np.cumsum(begins) - 1
        steps = _steps(group, *(rows[c].to_numpy().astype(np.int64) for c in ("row", "c0", "c1")))
        g, y, x, _, _, way = steps
        follows = _followed(*steps)
        start, ahead = _ring_places(follows)
        came = np.empty(len(g), np.int64)
        came[follows] = way
        corner = np.flatnonzero((way != came) | (start == np.arange(len(g))))
        # a ring begins at its start, what follows has the most ahead, and ends there
        first = np.flatnonzero(start == np.arange(len(g)))
        at, ring = np.concatenate([corner, first]), np.concatenate([start[corner], first])
        order = np.concatenate([np.where(corner == start[corner], -len(g) - 1, -ahead[corner]), np.ones(len(first), np.int64)])
        by = np.lexsort((order, ring))
        at, ring = at[by], ring[by]
        offsets = np.append(np.searchsorted(ring, first), len(ring))
        points = pa.StructArray.from_arrays([pa.array(c[at].astype(np.float64)) for c in (x, y)], ["x", "y"])
        rings = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), points)
        # the highest ring of a component is the outer one
        outer = np.ones(len(first), bool)
        outer[1:] = g[first[1:]] != g[first[:-1]]
        inner = np.flatnonzero(~outer)
        holes = np.searchsorted(g[first[inner]], np.arange(int(begins.sum()) + 1))
        told = {"ring": rings.take(pa.array(np.flatnonzero(outer))), "holes": pa.ListArray.from_arrays(pa.array(holes, pa.int32()), rings.take(pa.array(inner)))}
        yield from pa.table({**{c: rows[c].take(np.flatnonzero(begins)) for c in LABEL}, **told}).to_batches()
