"""Parts of graphs that lie in one cell of node numbers, over arrays of many cells at once.

Rows are edges (map_id, _cell, u, v, ..) in order of (map_id, _cell); a cell has every edge
that touches one of its nodes. A part all of whose nodes are the cell's is closed: it is
solved where it is. The others are open and told edge by edge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from mapfold.operators.run_labels import group_starts, least_reached, whole_groups

CELL_BITS = (16, 12, 8)  #: bits of a node number inside a cell, the first that keeps cells from being crowded
CROWD = 1 << 19  #: edges of a cell at most
PAIRS = 1 << 21  #: (start, node) pairs that are held at once, about


def whole_numbers(df: DataFrame, *names: str) -> bool:
    return all(isinstance(df.schema[c].dataType, LongType) for c in names)


def _touched(bits: int) -> Column:
    return F.explode(F.filter(F.array_distinct(F.array(F.shiftright("u", bits), F.shiftright("v", bits))), lambda c: c.isNotNull()))


def cell_bits(edges: DataFrame) -> tuple[int | None, bool]:
    """How many bits of a node number tell nodes of one cell apart, so that no cell has more than CROWD edges (None if small cells have more), and whether edges leave their cells."""
    for bits in CELL_BITS:
        leaves = F.coalesce(F.shiftright("u", bits) != F.shiftright("v", bits), F.lit(True))
        n = edges.select("map_id", leaves.alias("l"), _touched(bits).alias("c")).groupBy("map_id", "c").agg(F.count("*").alias("n"), F.max("l").alias("l"))
        most, open_ = n.agg(F.max("n"), F.max("l")).first()
        if (most or 0) <= CROWD:
            return bits, bool(open_)
    return None, True


def in_cells(edges: DataFrame, bits: int) -> DataFrame:
    """edges with a row for each cell they touch, dealt and ordered by cell."""
    return edges.withColumn("_cell", _touched(bits)).repartition("map_id", "_cell").sortWithinPartitions("map_id", "_cell")


class _Cells:
    """The parts of some cells: number of each edge's ends, and of each node its group, name, least node and whether its part is open."""

    def __init__(self, rows: pa.Table, bits: int):
        group = np.cumsum(group_starts(rows, ["map_id", "_cell"])) - 1
        u, v = rows["u"], rows["v"]
        lone = pc.or_(u.is_null(), v.is_null()).to_numpy()  # a null end is of no cell
        u, v = pc.coalesce(u, v).to_numpy(), pc.coalesce(v, u).to_numpy()
        m, of, name = len(u), np.concatenate([group, group]), np.concatenate([u, v])
        by = np.lexsort((name, of))
        new = np.ones(len(by), bool)
        new[1:] = (of[by[1:]] != of[by[:-1]]) | (name[by[1:]] != name[by[:-1]])
        at = np.empty(len(by), np.int64)
        at[by] = np.cumsum(new) - 1
        self.u, self.v, one = at[:m], at[m:], by[new]
        self.row, self.name = one % max(m, 1), name[one]
        self.least = least_reached(len(one), self.u, self.v)
        out = (self.name >> bits) != rows["_cell"].to_numpy()[self.row]
        out[self.u[lone]] = True
        open_ = np.zeros(len(one), bool)
        open_[self.least[out]] = True
        self.open = open_[self.least]
        # an edge of two cells is told by that of its lesser end
        self.told = np.flatnonzero(self.open[self.u] & (lone | ((np.minimum(u, v) >> bits) == rows["_cell"].to_numpy())))


def cell_components(bits: int):
    """A function of batches of edges: (map_id, a, b, open), the nodes of closed parts with their least node, and the edges of the others."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["map_id", "_cell"]):
            c = _Cells(rows, bits)
            sizes = np.bincount(c.least, minlength=len(c.least))[c.least]
            done = np.flatnonzero(~c.open & (sizes > 1))  # loops join nothing
            maps = pa.concat_arrays([x for col in (rows["map_id"].take(c.row[done]), rows["map_id"].take(c.told)) for x in col.chunks] or [pa.nulls(0, rows["map_id"].type)])
            ends = [pa.concat_arrays([pa.array(closed, pa.int64()), rows[e].take(c.told).combine_chunks()]) for closed, e in ((c.name[done], "u"), (c.name[c.least[done]], "v"))]
            yield from pa.table({"map_id": maps, "a": ends[0], "b": ends[1], "open": np.arange(len(maps)) >= len(done)}).to_batches()

    return solve


def open_edges(bits: int, names: list[str]):
    """A function of batches of edges: names of the edges of open parts, each once."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["map_id", "_cell"]):
            yield from rows.select(names).take(_Cells(rows, bits).told).to_batches()

    return solve


def _walked(start: np.ndarray, u: np.ndarray, v: np.ndarray, length: np.ndarray, n: int, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, node, distance) up to reach from each start, over edges of n nodes; rounds as in graphs.bounded_distances."""
    a, b, w = np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([length, length])
    by = np.argsort(a, kind="stable")
    b, w, first = b[by], w[by], np.searchsorted(a[by], np.arange(n + 1))
    at, d = start * n + start, np.zeros(len(start))  # pairs as numbers, in order
    front, far = at, d
    while len(front):
        s, x = np.divmod(front, n)
        k = first[x + 1] - first[x]
        e = np.repeat(first[x] - np.cumsum(k) + k, k) + np.arange(k.sum())
        to, at_d = np.repeat(s, k) * n + b[e], np.repeat(far, k) + w[e]
        good = (at_d <= reach) & (np.repeat(s, k) != b[e])
        to, at_d = to[good], at_d[good]
        by = np.lexsort((at_d, to))
        to, at_d = to[by], at_d[by]
        one = np.ones(len(to), bool)
        one[1:] = to[1:] != to[:-1]
        to, at_d = to[one], at_d[one]
        place = np.searchsorted(at, to)
        known = at[np.minimum(place, len(at) - 1)] == to
        fell = known.copy()
        fell[known] = at_d[known] < d[place[known]] - 1e-12
        d[place[fell]] = at_d[fell]
        front, far = to[fell | ~known], at_d[fell | ~known]
        at, d = np.insert(at, place[~known], to[~known]), np.insert(d, place[~known], at_d[~known])
    return (*np.divmod(at, n), d)


def _closed_walks(c: _Cells, rows: pa.Table, wanted: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, node, distance) of the wanted nodes in closed parts, some starts at a time; a part's starts stay in order."""
    sizes = np.bincount(c.least, minlength=len(c.least))[c.least]
    starts = np.flatnonzero(wanted & ~c.open)
    starts = starts[np.argsort(c.least[starts], kind="stable")]
    closed = ~c.open[c.u]
    u, v, length = c.u[closed], c.v[closed], rows["length"].to_numpy()[closed]
    ends = np.cumsum(sizes[starts])
    cuts = [0, *(np.flatnonzero(np.diff(ends // PAIRS)) + 1).tolist(), len(starts)]
    for i, j in zip(cuts, cuts[1:]):
        if i < j:
            yield _walked(np.sort(starts[i:j]), u, v, length, len(c.name), reach)


def cell_distances(bits: int, reach: float, every: int):
    """A function of batches of edges with length: (map_id, start, node, distance) from each node of a closed part that every divides."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["map_id", "_cell"]):
            c = _Cells(rows, bits)
            for s, x, d in _closed_walks(c, rows, c.name % every == 0, reach):
                yield from pa.table({"map_id": rows["map_id"].take(c.row[s]), "start": c.name[s], "node": c.name[x], "distance": d}).to_batches()

    return solve


def cell_rivals(bits: int, reach: float, sure: float):
    """A function of batches of edges with length and the scores su, sv of their ends: (map_id, start) of the nodes of closed parts that evaluate.without_rivals keeps."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["map_id", "_cell"]):
            c = _Cells(rows, bits)
            score = np.empty(len(c.name))
            score[c.u], score[c.v] = rows["su"].to_numpy(), rows["sv"].to_numpy()
            rank = np.empty(len(c.name), np.int64)
            rank[np.lexsort((c.name, score))] = np.arange(len(c.name))
            pairs = [(s[better], x[better]) for s, x, _ in _closed_walks(c, rows, np.ones(len(c.name), bool), reach) for better in [rank[s] > rank[x]]]
            a, b = (np.concatenate([p[k] for p in pairs] or [np.zeros(0, np.int64)]) for k in (0, 1))
            kept = score >= sure
            known = kept | c.open
            a, b = a[~known[b]], b[~known[b]]
            while not known.all():
                beaten, waits = np.zeros(len(kept), bool), np.zeros(len(kept), bool)
                beaten[b[kept[a]]] = True
                waits[b[~known[a]]] = True
                kept |= ~known & ~beaten & ~waits
                known |= beaten | ~waits
                left = ~known[b]
                a, b = a[left], b[left]
            some = np.flatnonzero(kept & ~c.open)
            yield from pa.table({"map_id": rows["map_id"].take(c.row[some]), "start": c.name[some]}).to_batches()

    return solve
