"""Rings that meet themselves, labels that only touch, boxes to be ignored, and deliveries map by map."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from mapfold.functions import geometry as G
from mapfold.operators import evaluate as E
from mapfold.operators import legends as L
from mapfold.operators import spatial as S
from mapfold.sources import writers as W

RING = "array<struct<x: double, y: double>>"


def ring(*points):
    return [(float(x), float(y)) for x, y in points]


SHAPES = {
    None: ring((0, 0), (0, 4), (4, 4), (4, 0), (0, 0)),
    "crosses": ring((0, 0), (4, 4), (4, 0), (0, 4), (0, 0)),
    "touches": ring((0, 0), (0, 4), (2, 0), (4, 4), (4, 0), (0, 0)),
    "spike": ring((0, 0), (0, 4), (4, 4), (9, 4), (4, 4), (4, 0), (0, 0)),
    "points": ring((0, 0), (1, 1), (0, 0)),
    "open": ring((0, 0), (0, 4), (4, 4)),
}


@pytest.mark.parametrize("fault", SHAPES, ids=str)
def test_ring_faults(spark, fault):
    rows = spark.createDataFrame([(SHAPES[fault],), (SHAPES[fault][::-1],)], f"ring {RING}")
    assert [r[0] for r in rows.select(G.ring_fault(F.col("ring"))).collect()] == [fault, fault]


def test_more_ring_faults(spark):
    eight = ring((0, 0), (2, 0), (2, 2), (4, 2), (4, 4), (2, 4), (2, 2), (0, 2), (0, 0))  # two squares that share a corner
    doubled = ring((0, 0), (0, 4), (0, 4), (4, 4), (4, 0), (0, 0), (0, 0))
    flat = ring((0, 0), (0, 2), (0, 4), (0, 0))
    star = ring((0, 3), (2, -3), (-3, 1), (3, 1), (-2, -3), (0, 3))
    triangle = ring((0, 0), (0, 4), (4, 4), (0, 0))
    got = spark.createDataFrame([(k, r) for k, r in enumerate((eight, doubled, flat, star, triangle))], f"k int, ring {RING}").select("k", G.ring_fault(F.col("ring")).alias("f")).orderBy("k").collect()
    assert [r.f for r in got] == ["touches", None, "spike", "crosses", None]


def test_detections_get_a_reason(spark):
    good = SHAPES[None]
    rows = [(1, 0, good), (1, 1, good[::-1]), (1, 2, SHAPES["crosses"]), (1, 3, ring((0, 0), (0, 400), (4, 4), (0, 0))), (1, 4, None), (9, 5, good)]
    df = spark.createDataFrame(rows, f"map_id int, box_id int, ring {RING}")
    sheets = spark.createDataFrame([(1, 100, 100)], "map_id int, height int, width int")
    kept, bad = L.valid_detections(df, sheets)
    assert [r.box_id for r in kept.collect()] == [0]
    assert {r.box_id: r.reason for r in bad.collect()} == {1: "turns", 2: "crosses", 3: "outside", 4: "missing", 5: "missing"}


def test_segments_that_meet(spark):
    cases = {(0, 0, 4, 0, 4, 0, 8, 3): True, (0, 0, 4, 0, 2, 0, 6, 0): True, (0, 0, 4, 0, 5, 0, 9, 0): False, (0, 0, 4, 0, 2, -1, 2, 0): True, (0, 0, 4, 4, 0, 4, 4, 0): True, (0, 0, 4, 0, 0, 1, 4, 1): False, (1, 1, 1, 1, 0, 0, 2, 2): True}
    rows = spark.createDataFrame([tuple(map(float, c)) for c in cases], ", ".join(f"c{k} double" for k in range(8)))
    got = rows.select(*rows.columns, G.segments_meet(*[F.col(c) for c in rows.columns]).alias("hit")).collect()
    assert {tuple(int(v) for v in r[:8]): r.hit for r in got} == cases


def test_labels_link_to_polygons_that_only_touch(spark):
    box = lambda x, y, w: ring((x, y), (x, y + w), (x + w, y + w), (x + w, y), (x, y))
    labels = spark.createDataFrame([(1, "Qa", box(64, 0, 10)), (2, "Qa", box(200, 0, 10)), (3, "Tv", box(64, 0, 10))], f"label_id int, text string, ring {RING}")
    polygons = spark.createDataFrame([(5, "qa unit", box(0, 0, 64)), (6, "qa", box(74, 10, 20)), (7, "qa", box(75, 0, 5))], f"polygon_id int, name string, geom {RING}")
    assert {r.label_id: r.polygon_ids for r in S.link_labels(labels, polygons, 64.0).collect()} == {1: [5, 6], 2: None, 3: None}


def test_an_ignored_box_swallows_one_detection(spark):
    at = lambda k, x, det, score, ignore: (1, 1, k, det, score, ignore, float(x), 0.0, float(x) + 10, 10.0)
    rows = [at(1, 0, False, 0.0, True), at(2, 50, False, 0.0, False), at(3, 0, True, 0.9, False), at(4, 1, True, 0.8, False), at(5, 50, True, 0.7, False), at(6, 51, True, 0.6, False)]
    boxes = spark.createDataFrame(rows, "image_id long, class long, box_id long, is_det boolean, score double, ignore boolean, xmin double, ymin double, xmax double, ymax double")
    assert [(r.box_id, r.tp) for r in E.detection_curve(boxes).orderBy("rank").collect()] == [(4, False), (5, True), (6, False)]


def delivery(spark, maps, names=("Qa", "Tv"), known=None):
    meta = spark.createDataFrame([(m, f"sheet {m}") for m in maps], "map_id int, title string")
    gcps = spark.createDataFrame([(m, 1, 0.0, 0.0, 1.0, 2.0) for m in maps], "map_id int, gcp_id int, px double, py double, mx double, my double")
    polygons = spark.createDataFrame([(m, n, None, None, n, None, None, "u", None, None, None, ring((0, 0), (0, m), (1, 1), (0, 0))) for m in maps for n in names], f"map_id int, name string, color string, pattern string, abbreviation string, description string, category string, unit_name string, unit_age string, b_age double, t_age double, geom {RING}")
    points = spark.createDataFrame([(m, "mine", None, 1.0, float(m), None) for m in maps], "map_id int, type string, description string, x double, y double, dip double")
    lines = spark.createDataFrame([], f"map_id int, name string, description string, dash string, symbol string, geom {RING}")
    return W.delivery_tables(meta, gcps, polygons, points, lines, known)


def rows_of(tables):
    return {n: sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect()))) for n, df in tables.items()}


def test_delivering_a_map_leaves_the_others(spark, tmp_path):
    path, both = str(tmp_path / "d"), str(tmp_path / "both")
    assert W.read_delivery(spark, path) == {}
    for m in (1, 2, 1):
        W.write_delivery(delivery(spark, [m], known=W.read_delivery(spark, path)), path)
    W.write_delivery(delivery(spark, [1, 2]), both)
    assert rows_of(W.read_delivery(spark, path)) == rows_of(W.read_delivery(spark, both))
    assert {r.map_id for r in W.read_delivery(spark, path)["polygon_feature"].collect()} == {1, 2}


def test_a_delivery_that_breaks_off_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "d")
    W.write_delivery(delivery(spark, [1]), path)
    before = rows_of(W.read_delivery(spark, path))
    broken = delivery(spark, [1, 3], names=("Zz",))
    broken["line_type"] = broken["line_type"].select("map_id", F.raise_error(F.lit("stop")).alias("x")).unionByName(spark.range(1).select(F.lit(1).alias("map_id"), F.raise_error(F.lit("stop")).alias("x")))
    with pytest.raises(Exception, match="stop"):
        W.write_delivery(broken, path)
    assert rows_of(W.read_delivery(spark, path)) == before


def test_type_ids_stay_from_delivery_to_delivery(spark, tmp_path):
    path = str(tmp_path / "d")
    W.write_delivery(delivery(spark, [1, 2], names=("Mm", "Tv")), path)
    W.write_delivery(delivery(spark, [1], names=("Aa", "Tv"), known=W.read_delivery(spark, path)), path)
    now = {(r.map_id, r.name): r.type_id for r in W.read_delivery(spark, path)["polygon_type"].collect()}
    assert now == {(1, "Mm"): 1, (1, "Tv"): 2, (1, "Aa"): 3, (2, "Mm"): 1, (2, "Tv"): 2}


def test_collections_of_other_maps_stay(spark, tmp_path):
    path = str(tmp_path / "c")
    for m, text in ((1, "a"), (2, "b"), (1, "c")):
        W.write_collections(spark.createDataFrame([(m, text)], "map_id int, json string"), path, ["map_id"])
    assert {(r.map_id, r.value) for r in spark.read.text(path).collect()} == {(1, "c"), (2, "b")}
