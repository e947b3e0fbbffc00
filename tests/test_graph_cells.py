"""Parts of graphs solved in cells of node numbers, against rounds of joins over the whole graph."""

import random

import pytest
from pyspark.sql import functions as F

from mapfold.operators import evaluate as E
from mapfold.operators import graph_cells as C
from mapfold.operators import graphs as GR
from mapfold.operators import run_labels as L

SCHEMA = "map_id long, u long, v long, length double"


def _edges(spark, odd: bool, near: int):
    draw = random.Random(6)
    rows = []
    for _ in range(150):
        u = draw.randrange(-20, 90)
        rows.append((draw.randrange(2), u, u + draw.randrange(0, near), float(draw.randrange(1, 4))))
    rows += rows[:9]
    if odd:
        rows += [(0, None, 5, 1.0), (1, 7, None, 1.0), (1, None, None, 1.0), (None, 3, 4, 1.0), (0, 500, None, 1.0), (0, 80, 81, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(params=[(16, 2, False), (2, 2, False), (2, 9, True), (16, 2, True)], ids=str)
def edges(request, spark, monkeypatch):
    bits, near, odd = request.param
    monkeypatch.setattr(C, "CELL_BITS", (bits,))
    monkeypatch.setattr(L, "CHUNK", 20)
    monkeypatch.setattr(C, "PAIRS", 15)
    return _edges(spark, odd, near)


def _same(got, want):
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_parts_distances_and_rivals_are_those_of_rounds(spark, edges):
    cols = ["map_id", "node", "component"]
    _same(GR.components(edges).select(cols), GR._components_by_rounds(edges).select(cols))
    starts = GR.both_ways(edges.select("map_id", "u", "v")).select("map_id", F.col("u").alias("start")).distinct()
    cols = ["map_id", "start", "node", "distance"]
    near = GR.bounded_distances(edges, starts, 4.0).select(cols)
    _same(GR.distances_from_nodes(edges, 4.0).select(cols), near)
    _same(GR.distances_from_nodes(edges, 4.0, 7).select(cols), near.filter("start % 7 = 0"))
    score = lambda n: n * 37 % 101 / F.lit(100.0)
    want = E.without_rivals(starts.withColumn("score", score(F.col("start"))), near.select("map_id", F.col("start").alias("a"), F.col("node").alias("b")))
    _same(E.starts_apart(edges, score, 4.0).select("map_id", "start"), want.select("map_id", "start"))


def test_whole_parts_go_through_no_round(spark, monkeypatch):
    edges = spark.range(40).select(F.lit(1).cast("long").alias("map_id"), F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.lit(1.0).alias("length"))
    stop = lambda *_: pytest.fail("rounds")
    for module, name in ((GR, "connected_components"), (GR, "bounded_distances"), (E, "bounded_distances"), (E, "without_rivals")):
        monkeypatch.setattr(module, name, stop)
    assert {r.component for r in GR.components(edges).collect()} == {0}
    assert GR.distances_from_nodes(edges, 3.0).count() == 41 * 7 - 12
    assert E.starts_apart(edges, lambda n: -n, 3.0).count() == 11
    assert GR.components(edges.filter("false")).count() == 0
