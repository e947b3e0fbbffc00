"""Chains in order, rings and traced masks against plain walks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from mapfold.functions import geometry as G
from mapfold.operators import chains as C
from mapfold.operators import pixels as P


def walks(edges):
    """Chains of a graph as node lists, each from its lesser end, keyed by its first edge."""
    near = {}
    for u, v in {(min(e), max(e)) for e in edges if e[0] != e[1]}:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    out, seen = {}, set()
    stops = {n for n in near if len(near[n]) != 2}

    def follow(u, v):
        path = [u, v]
        while path[-1] not in stops and path[-1] != u:
            path.append(next(n for n in near[path[-1]] if n != path[-2]))
        return path

    for n in sorted(near):
        for v in sorted(near[n]):
            if n in stops or (n not in seen and len(near[n]) == 2 and _on_ring(near, stops, n)):
                path = follow(n, v)
                if (path[0], path[1]) < (path[-1], path[-2]):
                    out[path[0], path[1]] = path
                seen.update(path if n not in stops else [])
    return out


def _on_ring(near, stops, n):
    last, at = n, min(near[n])
    while at != n:
        if at in stops:
            return False
        last, at = at, next(x for x in near[at] if x != last)
    return True


def got_chains(frame):
    out = {}
    for r in C.ordered_chains(frame).collect():
        out.setdefault((r.map_id, r.chain.u, r.chain.v), {})[r.pos] = r.node
    assert all(sorted(c) == list(range(len(c))) for c in out.values())
    return {k: [c[i] for i in range(len(c))] for k, c in out.items()}


def test_chains_against_walks(spark):
    r = random.Random(2)
    rows, want = [], {}
    for m in range(6):
        n = r.randint(8, 30)
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(r.randint(n // 2, n))]
        base = 100
        for size in (3, 4, 7):  # rings of their own
            edges += [(base + k, base + (k + 1) % size) for k in range(size)]
            base += size
        edges += [(200, 201), (201, 202), (202, 200), (200, 203)]  # a ring that hangs on a junction
        edges += edges[:3]
        rows += [(m, u, v, 1) for u, v in edges]
        want.update({(m, *k): c for k, c in walks(edges).items()})
    rows += [(9, 4, None, 1), (9, 5, 5, 1)]
    frame = spark.createDataFrame(rows, "map_id int, u long, v long, id int")
    assert got_chains(frame) == want
    assert got_chains(frame.filter("false")) == {}


def test_a_chain_of_ten_thousand_nodes_takes_few_rounds(spark, monkeypatch):
    rounds, cut = [], C.cut
    monkeypatch.setattr(C, "cut", lambda df: rounds.append(1) or cut(df))
    order = list(range(10_000))
    random.Random(1).shuffle(order)
    frame = spark.createDataFrame([(1, a, b) for a, b in zip(order, order[1:], strict=False)], "map_id int, u long, v long")
    (chain,) = got_chains(frame).values()
    assert chain == (order if order[0] < order[-1] else order[::-1])
    assert len(rounds) < 20


def test_points_along_chains(spark):
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 5, 6)], "map_id int, u long, v long")
    nodes = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 30.0, 0.0), (1, 2, 30.0, 70.0), (1, 5, 0.0, 0.0), (1, 6, 0.0, 9.0)], "map_id int, node long, x double, y double")
    v = C.chain_vertices(edges, nodes)
    found = {}
    for p in C.resampled(v, 40.0).collect():
        found.setdefault(p.line_id.u, {})[p.k] = (round(p.x, 6), round(p.y, 6))
    assert found == {0: {0: (0, 0), 1: (30, 3.333333), 2: (30, 36.666667), 3: (30, 70)}, 5: {0: (0, 0), 1: (0, 9)}}
    regions = spark.createDataFrame([(1, (0.0, 0.0, 100.0, 100.0))], "map_id int, box struct<xmin: double, ymin: double, xmax: double, ymax: double>")
    starts = C.start_points(v, 25.0, regions, 0.07)
    assert [(p.k, round(p.x, 6), round(p.y, 6)) for p in starts.orderBy("k").collect()] == [(2, 30, 10), (3, 30, 30), (4, 30, 50)]  # the first is too near the border, the short chain too short


def holes_of(cells):
    """Number of background parts, connected at corners too, that don't reach the border."""
    rows, cols = [r for r, _ in cells], [c for _, c in cells]
    free = {(r, c) for r in range(min(rows) - 1, max(rows) + 2) for c in range(min(cols) - 1, max(cols) + 2)} - cells
    parts = 0
    while free:
        stack = [free.pop()]
        while stack:
            r, c = stack.pop()
            for n in [(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if n in free:
                    free.discard(n)
                    stack.append(n)
        parts += 1
    return parts - 1


@pytest.mark.parametrize("share", [0.35, 0.6, 0.8])
def test_masks_to_polygons_and_back(spark, share):
    r = random.Random(share)
    masks = {(m, k): {(a, b) for a in range(14) for b in range(14) if r.random() < share} for m in range(3) for k in "xy"}
    masks[7, "frame"] = {(a, b) for a in range(9) for b in range(9)} - {(a, b) for a in range(2, 7) for b in range(2, 7)} | {(a, b) for a in range(3, 6) for b in range(3, 6)} - {(4, 4)}
    masks[8, "pinch"] = {(0, 0), (1, 1), (0, 1), (2, 2)} | {(4, 0), (4, 1), (4, 2), (5, 0), (5, 2), (6, 0), (6, 1), (6, 3), (7, 1), (7, 2), (7, 3)}
    rows = [(m, k, a, b) for (m, k), cells in masks.items() for a, b in cells]
    frame = spark.createDataFrame(rows + rows[:5], "map_id int, key string, row int, col int")
    shapes = C.mask_polygons(P.labelled_runs(frame)).cache()
    back = {tuple(x) for x in P.filled_polygons(shapes).select("map_id", "key", "row", "col").collect()}
    assert back == set(rows)
    members = {}
    for x in P.labelled_runs(frame).collect():
        members.setdefault((x.map_id, x.key, tuple(x.label)), set()).update((x.row, c) for c in range(x.c0, x.c1 + 1))
    for s in shapes.withColumn("inner", F.transform("holes", G.signed_area)).withColumn("outer", G.signed_area(F.col("ring"))).collect():
        cells = members.pop((s.map_id, s.key, tuple(s.label)))
        assert s.ring[0] == s.ring[-1] and len(s.holes) == holes_of(cells)
        assert s.outer > 0 and all(a < 0 for a in s.inner) and s.outer + sum(s.inner) == len(cells)
        assert all((p.x != q.x) != (p.y != q.y) for p, q in zip(s.ring, s.ring[1:], strict=False))
    assert not members
    assert C.mask_polygons(P.labelled_runs(frame.filter("false"))).count() == 0


@pytest.mark.parametrize("bits, crowd", [((16,), 1 << 19), ((1,), 1 << 19), ((3,), 1 << 19), ((16, 4), 30), ((16,), 5)])
def test_cells_of_nodes_change_no_chain(spark, monkeypatch, bits, crowd):
    monkeypatch.setattr(C, "CELL_BITS", bits)
    monkeypatch.setattr(C, "CROWD", crowd)
    r = random.Random(8)
    rows, want = [], {}
    for m in range(5):
        edges = [(r.randrange(-9, 20), r.randrange(-9, 20)) for _ in range(r.randint(12, 25))]
        edges += [(100, 101), (101, 102), (102, 100)] + [(200 + k, 201 + k) for k in range(40)] + edges[:4]
        rows += [(m, u, v) for u, v in edges]
        want.update({(m, *k): c for k, c in walks(edges).items()})
    assert got_chains(spark.createDataFrame(rows, "map_id int, u long, v long")) == want


def test_chains_inside_a_cell_take_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(C, "cut", lambda df: pytest.fail("a round of joins"))
    frame = spark.createDataFrame([(m, k, k + 1) for m in range(3) for k in range(500)], "map_id long, u long, v long")
    assert len(got_chains(frame)) == 3
