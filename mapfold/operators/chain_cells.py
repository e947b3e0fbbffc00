"""Chains that lie in one cell of node numbers, by pointer doubling over arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

STOP, INNER, UNKNOWN = 0, 1, 2  #: a node without two edges, one with two, one of another cell


def cell_chains(bits: int):
    """A function of the distinct edges (map_id, u, v, _cell) that touch a cell: (map_id, cu, cv, pos, node, su, sv).

    Nodes of the chains that end at stops, with their chain's first edge; the edges of all
    others (rings, and chains that leave the cell) come back as cu, cv with their ends' states.
    """

    def chains(edges: pa.Table) -> pa.Table:
        u, v = edges["u"].to_numpy(), edges["v"].to_numpy()
        _, at, n = np.unique(np.concatenate([u, v]), return_inverse=True, return_counts=True)
        state = np.where(n[at] == 2, INNER, STOP)
        state[np.concatenate([u, v]) >> bits != edges["_cell"][0].as_py()] = UNKNOWN
        return _in_order(edges, u, v, state[: len(u)], state[len(u) :])

    return chains


def _in_order(edges: pa.Table, u: np.ndarray, v: np.ndarray, su: np.ndarray, sv: np.ndarray) -> pa.Table:
    m = len(u)
    start, end = np.empty(2 * m, np.int64), np.empty(2 * m, np.int64)
    start[0::2], start[1::2], end[0::2], end[1::2] = u, v, v, u  # a dart and its way back are neighbours
    state = np.empty(2 * m, np.int64)
    state[0::2], state[1::2] = sv, su  # of the end
    back = np.arange(2 * m) ^ 1
    out = np.flatnonzero(state[back] == INNER)
    x, y = out[np.argsort(start[out], kind="stable")].reshape(-1, 2).T
    last, steps = np.arange(2 * m), np.zeros(2 * m, np.int64)
    last[back[x]], last[back[y]] = y, x
    open_ = last != np.arange(2 * m)
    steps[open_] = 1
    for _ in range(max(2 * m, 2).bit_length()):
        if not (open_ & open_[last]).any():
            break
        steps = steps + np.where(open_, steps[last], 0)
        last = np.where(open_, last[last], last)
    whole = (state[last] == STOP) & (state[last[back]] == STOP)  # on rings the end stays inner
    first = back[last[back]]
    chain = (start[first], end[first])
    other = (end[last], start[last])
    chosen = whole & ((chain[0] < other[0]) | (chain[0] == other[0]) & (chain[1] < other[1]))
    pos = steps[back]
    tail = chosen & (steps == 0)
    rest = np.flatnonzero(~whole[0::2])

    def column(inner: np.ndarray, final: np.ndarray, left: np.ndarray | None, kind: pa.DataType = pa.int64()) -> pa.ChunkedArray:
        open_part = pa.nulls(len(rest), kind) if left is None else pa.array(left[rest], kind)
        return pa.chunked_array([pa.array(inner[chosen], kind), pa.array(final[tail], kind), open_part])

    none = lambda values: pa.chunked_array([pa.nulls(int(chosen.sum() + tail.sum()), pa.int32()), pa.array(values[rest], pa.int32())])
    told = {"cu": column(chain[0], chain[0], u), "cv": column(chain[1], chain[1], v), "pos": column(pos, pos + 1, None), "node": column(start, end, None), "su": none(su), "sv": none(sv)}
    return pa.table({"map_id": pa.repeat(edges["map_id"][0], len(told["cu"])), **told})
