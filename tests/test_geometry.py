"""Column geometry against hand-worked answers and plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from mapfold.functions import geometry as G


def one(spark, **columns):
    r = spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()
    return r


def ring(*points):
    return F.array(*[G.point(F.lit(float(x)), F.lit(float(y))) for x, y in points])


def test_boxes(spark):
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("xmin", "ymin", "xmax", "ymax"), strict=True)])
    r = one(spark, iou=G.box_iou(box(0, 0, 2, 2), box(1, 1, 3, 3)), giou=G.box_giou(box(0, 0, 1, 1), box(2, 0, 3, 1)), c=F.array(*G.box_center_int(F.lit(1), F.lit(2), F.lit(4), F.lit(7))), s=G.scale_box(box(0, 0, 10, 10), F.lit(1.1), F.lit(2.0)), loose=G.box_in_roi(box(1, 1, 50, 50), box(0, 0, 9, 9), False), strict=G.box_in_roi(box(1, 1, 50, 50), box(0, 0, 9, 9)))
    assert r.iou == pytest.approx(1 / 7) and r.giou == pytest.approx(-1 / 3) and r.c == [2, 4]
    assert (r.s.xmin, r.s.ymax) == (pytest.approx(-0.5), pytest.approx(15)) and r.loose and not r.strict


def test_rings(spark):
    square = ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))
    dent = ring((0, 0), (4, 0), (4, 4), (2, 1), (0, 4), (0, 0))
    r = one(spark, area=G.ring_area(square), turned=G.signed_area(G.clockwise(square)), closed=F.size(G.closed(ring((0, 0), (1, 1)))), inside=G.in_ring(F.lit(2.0), F.lit(2.0), dent), below=G.in_ring(F.lit(2.0), F.lit(0.5), dent), flat=G.valid_ring(ring((0, 0), (1, 1), (2, 2), (0, 0))), n=F.size(G.along(ring((0, 0), (10, 0)), 3.0)), empty=F.size(G.closed(F.array().cast("array<struct<x:double,y:double>>"))))
    assert (r.area, r.turned, r.closed, r.inside, r.below, r.flat, r.n, r.empty) == (16, -16, 3, False, True, False, 5, 0)
    flat = one(spark, p=G.pairs_to_ring(F.array(*[F.lit(float(x)) for x in (1, 2, 3, 4)]))).p
    assert [tuple(p) for p in flat] == [(1, 2), (3, 4)]


def test_transforms_return(spark):
    c = F.struct(*[F.lit(v).alias(k) for k, v in zip("abcdef", (2.0, 0.5, 10.0, -0.3, 1.5, -4.0), strict=True)])
    x, y = G.affine(F.lit(37.0), F.lit(12.0), c)
    mx, my = G.mercator(F.lit(-120.5), F.lit(45.25))
    lon, lat = G.inverse_mercator(mx, my)
    tx, ty = G.tile_number(F.lit(-120.5), F.lit(45.25), F.lit(12))
    blon, blat = G.tile_corner(tx, ty, F.lit(12))
    r = one(spark, back=F.array(*G.inverse_affine(x + 1e-6, y + 1e-6, c)), lon=lon, lat=lat, blon=blon, blat=blat)
    assert r.back == [37, 12] and (r.lon, r.lat, r.blon, r.blat) == tuple(pytest.approx(v, abs=1e-8) for v in (-120.5, 45.25, -120.5, 45.25))


def test_distances(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    r = one(spark, seg=G.segment_distance(*lit(0, 5, -1, 0, 1, 0)), end=G.segment_distance(*lit(4, 4, 0, 0, 1, 0)), dot=G.segment_distance(*lit(3, 4, 0, 0, 0, 0)), km=G.great_circle_km(*lit(0, 0, 0, 1)), cross=G.segments_cross(*lit(0, 0, 2, 2, 0, 2, 2, 0)), apart=G.segments_cross(*lit(0, 0, 1, 1, 3, 3, 4, 5)), at=F.array(*G.crossing_point(*lit(0, 0, 2, 2, 0, 2, 2, 0))), ext=G.ray_extension(*lit(0, 0, 1, 0, 3, -1, 3, 1)), dip=G.dip_direction(F.lit(math.radians(300.0)), wrap=True))
    assert (r.seg, r.end, r.dot, r.cross, r.apart, r.at, r.ext) == (5, 5, 5, True, False, [1, 1], 2)
    assert r.km == pytest.approx(111.195, abs=0.01) and r.dip == pytest.approx(30)


def test_colours(spark):
    r = one(spark, h=G.hex_color(F.lit(255), F.lit(10), F.lit(0)), hsv=F.array(*G.hsv(F.lit(0), F.lit(255), F.lit(0))))
    assert r.h == "#ff0a00" and r.hsv == [60, 255, 255]


def test_points_in_random_rings(spark):
    rnd = random.Random(3)
    pts = [(rnd.uniform(0, 10), rnd.uniform(0, 10)) for _ in range(12)]
    corner = [*pts, pts[0]]

    def inside(x, y):
        hit = False
        for (ax, ay), (bx, by) in zip(corner, corner[1:], strict=False):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                hit = not hit
        return hit

    probes = [(rnd.uniform(0, 10), rnd.uniform(0, 10)) for _ in range(200)]
    got = spark.createDataFrame(probes, "x double, y double").select("x", "y", G.in_ring(F.col("x"), F.col("y"), ring(*corner)).alias("i")).collect()
    assert all(r.i == inside(r.x, r.y) for r in got)


def test_polygon_overlaps(spark):
    from mapfold.functions import polygons as PG

    rnd = random.Random(7)
    pt = lambda p: [{"x": float(x), "y": float(y)} for x, y in p]
    dent = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]
    assert PG.overlap(pt(dent), pt([(0, 0), (4, 0), (4, 4), (0, 4)])) == pytest.approx(10)
    assert PG.overlap(pt(dent), pt([(1.9, 3), (2.1, 3), (2.1, 4), (1.9, 4)])) == 0
    for _ in range(30):  # stars of random radius against boxes: the overlap is additive over a split box
        star = [(r * math.cos(k), r * math.sin(k)) for k in [i * math.pi / 5 for i in range(10)] for r in [rnd.uniform(1, 5)]]
        x = rnd.uniform(-3, 3)
        box = lambda a, b: pt([(a, -9), (b, -9), (b, 9), (a, 9)])
        whole = abs(PG._area(star))
        assert PG.overlap(pt(star), box(-9, x)) + PG.overlap(pt(star), box(x, 9)) == pytest.approx(whole)
    a, b = ring((0, 0), (2, 0), (2, 2), (0, 2), (0, 0)), ring((1, 1), (3, 1), (3, 3), (1, 3), (1, 1))
    r = spark.range(1).select(PG.ring_iou(a, b).alias("iou"), PG.union_area(a, b).alias("u")).first()
    assert (r.iou, r.u) == (pytest.approx(1 / 7), pytest.approx(7))


def test_text_ratios(spark):
    from mapfold.functions import similarity as SM

    rnd = random.Random(9)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for c in a:
            prev = 0
            for j, d in enumerate(b, 1):
                prev, row[j] = row[j], prev + 1 if c == d else max(row[j], row[j - 1])
        return row[-1]

    pairs = [("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 12))), "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 12)))) for _ in range(200)]
    assert all(SM._common(a, b) == lcs(a, b) for a, b in pairs)
    rows = spark.createDataFrame([("abcd", "bcde"), (None, "x"), ("", "")], "a string, b string").select(SM.sequence_ratio("a", "b").alias("q"), SM.subsequence_ratio("a", "b").alias("s")).collect()
    assert [r.q for r in rows][0] == 0.75 and [r.s for r in rows][0] == 0.75 and rows[1].q is None and rows[2].s == 1
