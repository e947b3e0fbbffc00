"""Joins by place over a quadtree that a sample has fitted.

A fixed cell is too small for empty country and too large for a crowded one. Here cells are
the leaves of a quadtree: a bounded sample of the rows decides where it is split, until no
key (a map) has more than a quota of rows in a leaf. The tree holds a few thousand nodes at
most and travels with the plan; rows get the leaves that their box touches, and the join is
an equi-join on key and leaf. A pair is kept in the first leaf that both touch only. The
sample decides how even the work is, never which pairs come out.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

SAMPLE = 1 << 15  #: rows of either side that decide where the tree is split
QUOTA = 2000  #: rows of one key that a leaf should hold at most
FEWEST = 8  #: rows of the sample under which a leaf is not split
DEPTH = 24
NODES = 1 << 16  #: nodes of a tree at most


@dataclass(frozen=True)
class Tree:
    """Nodes, parents first: their square, and the first of their four children, 0 for a leaf."""

    x: np.ndarray
    y: np.ndarray
    size: np.ndarray
    child: np.ndarray

    def touched(self, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of the leaves that boxes touch; what lies outside the tree counts to its border."""
        edge = np.nextafter(self.x[0] + self.size[0], -np.inf), np.nextafter(self.y[0] + self.size[0], -np.inf)
        x0, x1 = (np.clip(v, self.x[0], edge[0]) for v in (x0, x1))
        y0, y1 = (np.clip(v, self.y[0], edge[1]) for v in (y0, y1))
        row = np.flatnonzero(~np.isnan(x0 + y0 + x1 + y1))
        node, out = np.zeros(len(row), np.int64), []
        while len(row):
            inner = self.child[node] > 0
            out.append((row[~inner], node[~inner]))
            row, first = np.repeat(row[inner], 4), np.repeat(self.child[node[inner]], 4)
            node = first + np.tile(np.arange(4), len(first) // 4)
            x, y, size = self.x[node], self.y[node], self.size[node]
            hit = (x0[row] < x + size) & (x1[row] >= x) & (y0[row] < y + size) & (y1[row] >= y)
            row, node = row[hit], node[hit]
        row, leaf = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
        by = np.lexsort((leaf, row))
        return row[by], leaf[by]

    def leaves(self, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        """The leaves that a box touches, in order; none where a coordinate is null."""

        @F.pandas_udf(ArrayType(IntegerType()))
        def touched(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
            row, leaf = self.touched(*(s.to_numpy(np.float64, na_value=np.nan) for s in (a, b, c, d)))
            return pd.Series(np.split(leaf.astype(np.int32), np.searchsorted(row, np.arange(1, len(a)))) if len(a) else [], dtype=object)

        return touched(*(c.cast("double") for c in (x0, y0, x1, y1)))


def split(keys: np.ndarray, x: np.ndarray, y: np.ndarray, most: float) -> Tree:
    """The tree whose leaves hold at most so many of the given places of one key.

    Leaves with fewer than FEWEST of them tell no more about where rows are; where most is
    less than that, they are split evenly.
    """
    low = (float(x.min(initial=np.inf)), float(y.min(initial=np.inf))) if len(x) else (0.0, 0.0)
    size = max(float(x.max() - low[0]), float(y.max() - low[1]), 1e-9) * (1 + 1e-9) if len(x) else 1.0
    nodes, child = [(*low, size)], [0]
    todo = deque([(0, np.arange(len(x)), 0, 0)])
    while todo and len(nodes) < NODES:
        at, own, depth, evenly = todo.popleft()
        crowd = np.unique(keys[own], return_counts=True)[1].max(initial=0)
        if depth == DEPTH or not evenly and crowd <= most:
            continue
        if not evenly and crowd <= FEWEST:
            evenly = int(np.ceil(np.log(crowd / most) / np.log(4)))
        x0, y0, half = nodes[at][0], nodes[at][1], nodes[at][2] / 2
        child[at] = len(nodes)
        right, top = x[own] >= x0 + half, y[own] >= y0 + half
        for k in range(4):
            if evenly != 1:  # the last of even splits makes leaves
                todo.append((len(nodes), own[(right == bool(k & 1)) & (top == bool(k & 2))], depth + 1, max(evenly - 1, 0)))
            nodes.append((x0 + half * (k & 1), y0 + half * (k >> 1), half))
            child.append(0)
    a = np.array(nodes)
    return Tree(a[:, 0].copy(), a[:, 1].copy(), a[:, 2].copy(), np.array(child, np.int64))


def fitted(rows: DataFrame, keys: list[str], x: Column, y: Column, quota: int = QUOTA) -> Tree:
    """A tree for rows with a place, from the SAMPLE rows whose digests come first."""
    places = rows.select(F.xxhash64(*keys).alias("k"), x.cast("double").alias("x"), y.cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    places = places.withColumn("_d", F.xxhash64("k", "x", "y", F.monotonically_increasing_id()))
    count = places.count()
    # the least digests, twice as many as needed: else each task sends SAMPLE rows to the driver
    share = min(1.0, 2 * SAMPLE / max(count, 1))
    seen = places.filter(F.col("_d") <= int(-(2**63) + share * (2**64 - 2**11))).orderBy("_d").limit(SAMPLE).drop("_d").collect()
    most = quota * len(seen) / max(count, 1)
    columns = list(zip(*seen, strict=True)) or [(), (), ()]
    return split(np.array(columns[0], np.int64), np.array(columns[1], float), np.array(columns[2], float), most)


def leaf_join(left: DataFrame, right: DataFrame, keys: list[str], left_box, right_box, tree: Tree, reach: float = 0.0) -> DataFrame:
    """Pairs of rows of equal keys whose boxes share a leaf, right's grown by reach; each pair once. Other columns must differ."""
    x0, y0, x1, y1 = right_box
    l = left.withColumn("_l", tree.leaves(*left_box)).withColumn("_leaf", F.explode("_l"))  # noqa: E741
    r = right.withColumn("_r", tree.leaves(x0 - reach, y0 - reach, x1 + reach, y1 + reach)).withColumn("_leaf", F.explode("_r"))
    pairs = l.join(r.hint("merge"), [*keys, "_leaf"])  # shuffled: Spark sizes a side before its copies
    return pairs.filter(F.col("_leaf") == F.array_min(F.array_intersect("_l", "_r"))).drop("_leaf", "_l", "_r")
