"""Components of runs: inside bands, across them, with holes, against a flood over pixels."""

import random

import pytest
from pyspark.sql import functions as F

from mapfold.operators import pixels as P
from mapfold.operators import run_labels as L


def _flood(cells: set, diagonal: bool) -> dict:
    """The first pixel of the component of each pixel."""
    out = {}
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not (a and b))]
    for start in sorted(cells):
        if start not in out:
            out[start], front = start, [start]
            while front:
                r, c = front.pop()
                for p in ((r + a, c + b) for a, b in near):
                    if p in cells and p not in out:
                        out[p] = start
                        front.append(p)
    return out


def _masks(spark, seed: int):
    draw = random.Random(seed)
    masks = {(m, k): {(draw.randrange(-3, 20), draw.randrange(-2, 14)) for _ in range(draw.randrange(1, 220))} for m in range(5) for k in "ab"}
    rows = [(m, k, r, c) for (m, k), cells in masks.items() for r, c in cells]
    return masks, spark.createDataFrame(rows + rows[:50], "map_id long, key string, row int, col int")


@pytest.mark.parametrize("diagonal", [False, True])
@pytest.mark.parametrize("bits", [9, 2, 0])
def test_labels_are_those_of_a_flood(spark, monkeypatch, diagonal, bits):
    monkeypatch.setattr(L, "CHUNK", 7)
    masks, frame = _masks(spark, 3)
    got = {}
    for x in P.labelled_runs(frame, diagonal, bits).collect():
        for c in range(x.c0, x.c1 + 1):
            got[x.map_id, x.key, x.row, c] = (x.label.row, x.label.col)
    want = {(*at, *p): to for at, cells in masks.items() for p, to in _flood(cells, diagonal).items()}
    assert got == want


def test_runs_without_a_key_or_place_stand_alone(spark):
    rows = [(1, None, 0, 0), (1, None, 1, 0), (None, "k", 0, 0), (None, "k", 1, 0), (1, "k", None, 0), (1, "k", 0, None), (1, "k", 0, 0), (1, "k", 1, 0)]
    got = P.labelled_runs(spark.createDataFrame(rows, "map_id long, key string, row int, col int")).collect()
    assert sorted((str((x.map_id, x.key, x.row, x.c0)), x.label.row, x.label.col) for x in got) == sorted([(str((*r,)), 0 if r == (1, "k", 1, 0) else r[2], r[3]) for r in rows])


def test_legends_are_filled_run_by_run(spark, monkeypatch):
    masks, frame = _masks(spark, 8)
    inside = {at: {p for p in cells if 0 <= p[0] < 18 and 0 <= p[1] < 12} for at, cells in masks.items()}
    want = set()
    for (m, k), cells in masks.items():
        whole = {(r, c) for r in range(18) for c in range(12)}
        back = _flood(whole - inside[m, k], False)
        holes = {p for p, to in back.items() if to != back.get((0, 0), None)}
        want |= {(m, k, *p) for p in cells | holes}
    sizes = spark.range(5).select(F.col("id").alias("map_id"), F.lit(18).alias("height"), F.lit(12).alias("width"))
    rows = []
    monkeypatch.setattr(P, "background", lambda *_: rows.append(1))  # no row for each pixel of the frame
    got = [tuple(x) for x in P.holes_filled(frame, sizes.unionByName(sizes)).select("map_id", "key", "row", "col").collect()]
    assert len(got) == len(set(got)) and set(got) == want and not rows
    one = frame.filter("map_id = 0 AND key = 'a'")
    cells = masks[0, "a"]
    labels = _flood(cells, False)
    best = max(set(labels.values()), key=lambda t: (sum(v == t for v in labels.values()), (-t[0], -t[1])))
    big = {p for p, t in labels.items() if t == best}
    back = _flood({(r, c) for r in range(18) for c in range(12)} - big, False)
    other = spark.createDataFrame([(0, "a", 0, 0), (0, "a", 50, 3)], frame.schema)
    full = big | {p for p, t in back.items() if t != back.get((0, 0))} | {(0, 0), (50, 3)}
    legend = P.refined_legend(one, other, sizes)
    assert {(x.row, x.col) for x in legend.collect()} == full and legend.count() == len(full)
    assert P.refined_legend_runs(one, other, sizes).agg(F.sum(F.col("c1") - F.col("c0") + 1)).first()[0] == len(full)
