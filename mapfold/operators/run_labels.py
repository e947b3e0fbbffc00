"""Components of runs inside one band of rows of a mask, over arrays of many masks at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 17  #: rows that are solved together, about; a group is never cut


def group_starts(rows: pa.Table, names: list[str]) -> np.ndarray:
    """Whether a row starts a group: one of names differs from the row before, or is null."""
    new = np.ones(len(rows), bool)
    if len(rows) > 1:
        new[1:] = False
        for c in names:
            differs = pc.fill_null(pc.not_equal(rows[c].slice(1), rows[c].slice(0, len(rows) - 1)), True)
            new[1:] |= differs.to_numpy()
    return new


def whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups of names, from batches in order of names."""
    held, n, enough = [], 0, CHUNK
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= enough:
            rows = pa.Table.from_batches(held).combine_chunks()
            last = int(np.flatnonzero(group_starts(rows, names))[-1])
            if last:
                yield rows.slice(0, last)
            rest = rows.slice(last).combine_chunks()
            held, n = rest.to_batches(), len(rest)
            enough = max(CHUNK, 2 * n)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n things the least one that the links a, b join it to."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further
    return root


def touching(group: np.ndarray, row: np.ndarray, c0: np.ndarray, c1: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs of a group in rows next to each other, at most reach columns apart. Runs in order of (group, row, c0)."""
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(row), bool)
    new[1:] = (group[1:] != group[:-1]) | (row[1:] != row[:-1])
    line = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    follows = np.zeros(len(first), bool)  # whether the next line is the next row of the same group
    follows[:-1] = (group[first[1:]] == group[first[:-1]]) & (row[first[1:]] == row[first[:-1]] + 1)
    c0, c1 = c0 - c0.min() + reach + 1, c1 - c0.min() + reach + 1
    width = int(c1.max()) + reach + 2
    above = np.flatnonzero(follows[line])
    base = (line[above] + 1) * width
    low = np.searchsorted(line * width + c1, base + c0[above] - reach, "left")
    high = np.searchsorted(line * width + c0, base + c1[above] + reach, "right")
    n = np.maximum(high - low, 0)
    below = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
    return np.repeat(above, n), below


def run_labels(reach: int):
    """A function of batches (map_id, key, _band, row, c0, c1) in that order: the same with (lrow, lcol), the first run of their component in the band."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["map_id", "key", "_band"]):
            group = np.cumsum(group_starts(rows, ["map_id", "key", "_band"]))
            whole = np.flatnonzero(pc.and_(rows["c0"].is_valid(), rows["row"].is_valid()).to_numpy())
            row, c0, c1 = (rows[c].take(whole).to_numpy().astype(np.int64) for c in ("row", "c0", "c1"))
            root = np.arange(len(rows))
            root[whole] = whole[least_reached(len(whole), *touching(group[whole], row, c0, c1, reach))]
            yield from rows.append_column("lrow", rows["row"].take(root)).append_column("lcol", rows["c0"].take(root)).to_batches()

    return solve
