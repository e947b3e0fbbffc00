"""Rings of many components in one task, without rounds; filled again without a row for each copy of a pixel."""

import random

from pyspark.sql import functions as F

from mapfold.operators import chains as C
from mapfold.operators import pixels as P
from mapfold.operators import run_labels as L


def test_rings_take_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(L, "CHUNK", 9)
    monkeypatch.setattr(C, "ring_ranks", lambda links: 1 / 0)
    draw = random.Random(5)
    rows = [(m, k, a, b) for m in range(4) for k in "xy" for a in range(-4, 12) for b in range(-3, 9) if draw.random() < 0.7]
    rows += [(9, "hole", a, b) for a in range(3) for b in range(5) if (a, b) not in ((1, 1), (1, 3))]
    frame = spark.createDataFrame(rows + [(None, "x", 0, 0), (1, None, 0, 0), (1, "x", None, 0), (1, "x", 0, None)], "map_id long, key string, row int, col int")
    shapes = C.mask_polygons(P.labelled_runs(frame)).cache()
    assert "MapInArrow" in shapes._jdf.queryExecution().optimizedPlan().toString()
    back = [tuple(x) for x in P.filled_polygons(shapes).select("map_id", "key", "row", "col").collect()]
    assert len(back) == len(set(back)) and set(back) == set(rows)
    whole = shapes.filter("map_id = 9").first()
    ring = lambda r: [(p.x, p.y) for p in r]
    assert ring(whole.ring) == [(0, 0), (5, 0), (5, 3), (0, 3), (0, 0)]
    assert [ring(h) for h in whole.holes] == [[(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)], [(3, 1), (3, 2), (4, 2), (4, 1), (3, 1)]]
    assert shapes.filter(F.col("map_id").isNull() | F.col("key").isNull()).count() == 0


def test_polygons_over_each_other_fill_each_pixel_once(spark):
    box = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d), (a, b)]
    polygons = spark.createDataFrame([(1, "k", box(0.0, 0.0, 6.0, 4.0), []), (1, "k", box(4.0, 1.0, 9.0, 3.0), []), (1, "k", box(0.0, 0.0, 6.0, 4.0), [])], "map_id int, key string, ring array<struct<x: double, y: double>>, holes array<array<struct<x: double, y: double>>>")
    got = [(r.row, r.col) for r in P.filled_polygons(polygons).collect()]
    assert sorted(got) == sorted({(r, c) for r in range(4) for c in range(6)} | {(r, c) for r in range(1, 3) for c in range(4, 9)})
