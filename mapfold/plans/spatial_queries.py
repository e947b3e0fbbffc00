"""Queries of the spatial joins, and the point pipeline they make up."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mapfold.functions import geometry as G
from mapfold.operators import quadtree as Q
from mapfold.operators import spatial as S
from mapfold.plans import inputs as I
from mapfold.plans.registry import query

_IN_REGION = "kept AS (SELECT p.* FROM points p LEFT JOIN regions r USING (map_id) WHERE r.rx0 IS NULL OR (x BETWEEN rx0 AND rx1 AND y BETWEEN ry0 AND ry1))"
#: A point is in a rectangle's ring by the even-odd rule: left and lower edges in, right and upper out.
_OFF_TEXT = "clear AS (SELECT * FROM kept k WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE b.map_id = k.map_id AND x >= xmin AND x < xmax AND y >= ymin AND y < ymax))"
_DIP = """nearest AS (
  SELECT s.map_id, strike_seq, dip, arg_min(point_id, (sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)), point_id)) AS point_id
  FROM strikes s JOIN clear c ON c.map_id = s.map_id AND c.type IN ('A', 'R') AND abs(x - sx) <= 20 AND abs(y - sy) <= 20 AND sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)) <= 20
  GROUP BY s.map_id, strike_seq, dip
), dips AS (SELECT map_id, point_id, arg_max(dip, strike_seq) AS dip_direction FROM nearest GROUP BY map_id, point_id)"""


@query(f"WITH {I.POINTS_SQL}, {I.REGIONS_SQL}, {_IN_REGION} SELECT map_id, point_id, type, x, y FROM kept")
def points_in_map_region(spark, sf_dir):
    """JN4."""
    return S.points_in_region(I.points(spark, sf_dir), I.regions(spark, sf_dir)).select("map_id", "point_id", "type", "x", "y")


@query(f"WITH {I.POINTS_SQL}, {I.BOXES_SQL}, kept AS (SELECT * FROM points), {_OFF_TEXT} SELECT map_id, point_id FROM clear")
def points_off_text(spark, sf_dir):
    """JN5."""
    return S.points_off_text(I.points(spark, sf_dir), I.box_rings(spark, sf_dir), 64.0).select("map_id", "point_id")


@query(f"WITH {I.POINTS_SQL}, {I.BOXES_SQL}, kept AS (SELECT * FROM points), {_OFF_TEXT} SELECT map_id, point_id FROM clear")
def points_off_text_by_leaves(spark, sf_dir):
    """JN5 over the leaves of a quadtree."""
    points = I.points(spark, sf_dir)
    tree = Q.fitted(points, ["map_id"], F.col("x"), F.col("y"), 500)
    return S.points_off_text(points, I.box_rings(spark, sf_dir), tree).select("map_id", "point_id")


@query(f"WITH {I.POINTS_SQL}, {I.STRIKES_SQL}, clear AS (SELECT * FROM points), {_DIP} SELECT map_id, point_id, dip_direction FROM points LEFT JOIN dips USING (map_id, point_id)")
def dip_direction_by_leaves(spark, sf_dir):
    """JN7, GEO30 over the leaves of a quadtree."""
    points = I.points(spark, sf_dir)
    tree = Q.fitted(points, ["map_id"], F.col("x"), F.col("y"), 500)
    return S.copy_dip_direction(points, I.strikes(spark, sf_dir), ["A", "R"], tree=tree).select("map_id", "point_id", "dip_direction")


@query(f"WITH {I.POINTS_SQL}, {I.STRIKES_SQL}, clear AS (SELECT * FROM points), {_DIP} SELECT map_id, point_id, dip_direction FROM points LEFT JOIN dips USING (map_id, point_id)")
def dip_direction_to_points(spark, sf_dir):
    """JN7, GEO30."""
    return S.copy_dip_direction(I.points(spark, sf_dir), I.strikes(spark, sf_dir), ["A", "R"]).select("map_id", "point_id", "dip_direction")


@query(
    f"""WITH {I.POINTS_SQL}, {I.REGIONS_SQL}, {I.BOXES_SQL}, {I.STRIKES_SQL}, {_IN_REGION}, {_OFF_TEXT}, {_DIP}
SELECT map_id, type, CAST(row_number() OVER (PARTITION BY map_id, type ORDER BY point_id) AS INTEGER) AS feature_id, x, y, score, dip_direction
FROM clear LEFT JOIN dips USING (map_id, point_id)"""
)
def point_pipeline(spark, sf_dir):
    """Which point symbols are on each map, inside its area, off the text, with a dip direction (SRC2..SNK1 of 7.3)."""
    kept = S.points_in_region(I.points(spark, sf_dir), I.regions(spark, sf_dir))
    clear = S.points_off_text(kept, I.box_rings(spark, sf_dir), 64.0)
    dipped = S.copy_dip_direction(clear, I.strikes(spark, sf_dir), ["A", "R"])
    number = F.row_number().over(Window.partitionBy("map_id", "type").orderBy("point_id"))
    return dipped.select("map_id", "type", number.alias("feature_id"), "x", "y", "score", "dip_direction")


@query(
    f"""WITH {I.BOXES_SQL}, items AS (SELECT map_id, box_id AS item_id, (xmin + xmax) / 2 AS x, (ymin + ymax) / 2 AS y FROM boxes WHERE box_id % 2 = 0),
described AS (SELECT map_id, box_id AS text_id, (xmin + xmax) / 2 AS tx, (ymin + ymax) / 2 AS ty FROM boxes WHERE box_id % 2 = 1),
near AS (SELECT i.map_id, item_id, arg_min(text_id, (sqrt((x-tx)*(x-tx)+(y-ty)*(y-ty)), text_id)) AS text_id, min(sqrt((x-tx)*(x-tx)+(y-ty)*(y-ty))) AS d
  FROM items i JOIN described t ON i.map_id = t.map_id AND sqrt((x-tx)*(x-tx)+(y-ty)*(y-ty)) < 30 GROUP BY i.map_id, item_id)
SELECT map_id, item_id, coalesce(text_id, -1) AS text_id, round(d, 6) AS distance FROM items LEFT JOIN near USING (map_id, item_id)"""
)
def legend_nearest_description(spark, sf_dir):
    """JN8, GEO3: each legend item with the nearest description's id, -1 without one."""
    x, y = G.box_center(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))
    centers = I.boxes(spark, sf_dir).select("map_id", "box_id", x.alias("x"), y.alias("y"))
    items = centers.filter("box_id % 2 = 0").withColumnRenamed("box_id", "item_id")
    texts = centers.filter("box_id % 2 = 1").withColumnRenamed("box_id", "text_id")
    found = S.nearest_within(items, texts, "item_id", "text_id", 30.0)
    return found.select("map_id", "item_id", F.coalesce("text_id", F.lit(-1)).alias("text_id"), F.round("distance", 6).alias("distance"))


@query(
    f"""WITH {I.BOXES_SQL}, pairs AS (
  SELECT a.map_id, a.box_id AS a, b.box_id AS b, greatest(0, least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * greatest(0, least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)) AS inter,
         (a.xmax - a.xmin) * (a.ymax - a.ymin) AS sa, (b.xmax - b.xmin) * (b.ymax - b.ymin) AS sb
  FROM boxes a JOIN boxes b ON a.map_id = b.map_id AND a.box_id < b.box_id AND a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax)
SELECT map_id, a, b, round(inter / (sa + sb - inter), 6) AS iou FROM pairs WHERE sa + sb > inter AND inter / (sa + sb - inter) > 0.1"""
)
def overlapping_legend_boxes(spark, sf_dir):
    """GEO8 over a cell join."""
    return S.overlapping_boxes(I.boxes(spark, sf_dir), 0.1).select("map_id", "a", "b", F.round("iou", 6).alias("iou"))


@query(
    f"""WITH {I.BOXES_SQL}, {I.REGIONS_SQL}
SELECT map_id, box_id, xmax <= rx1 AND ymax <= ry1 AND xmax >= rx0 AND ymax >= ry0 AS whole FROM boxes JOIN regions USING (map_id) WHERE xmin BETWEEN rx0 AND rx1 AND ymin BETWEEN ry0 AND ry1"""
)
def legend_boxes_in_region(spark, sf_dir):
    """JN6, JN26, FLT3 in both forms: the corner decides, and whether the whole box is inside."""
    boxes, regions = I.boxes(spark, sf_dir), I.regions(spark, sf_dir)
    loose = S.boxes_in_region(boxes, regions, strict=False)
    strict = S.boxes_in_region(boxes, regions).select("map_id", "box_id", F.lit(True).alias("inside"))
    return loose.join(strict, ["map_id", "box_id"], "left").select("map_id", "box_id", F.coalesce("inside", F.lit(False)).alias("whole"))


@query(
    f"""WITH seg AS (SELECT o_orderkey % 20 AS map_id, o_orderkey AS id, CAST((o_orderkey * 13) % 500 AS DOUBLE) AS ax, CAST((o_custkey * 7) % 500 AS DOUBLE) AS ay,
  CAST((o_orderkey * 13) % 500 + o_custkey % 23 - 11 AS DOUBLE) AS bx, CAST((o_custkey * 7) % 500 + o_orderkey % 19 - 9 AS DOUBLE) AS by FROM orders)
SELECT p.map_id, p.id AS a, q.id AS b FROM seg p JOIN seg q ON p.map_id = q.map_id AND p.id < q.id
WHERE greatest(p.ax, p.bx) >= least(q.ax, q.bx) AND least(p.ax, p.bx) <= greatest(q.ax, q.bx) AND greatest(p.ay, p.by) >= least(q.ay, q.by) AND least(p.ay, p.by) <= greatest(q.ay, q.by)
AND NOT ((p.ax = q.ax AND p.ay = q.ay) OR (p.ax = q.bx AND p.ay = q.by) OR (p.bx = q.ax AND p.by = q.ay) OR (p.bx = q.bx AND p.by = q.by))
AND ((q.by - p.ay) * (q.ax - p.ax) > (q.ay - p.ay) * (q.bx - p.ax)) <> ((q.by - p.by) * (q.ax - p.bx) > (q.ay - p.by) * (q.bx - p.bx))
AND ((q.ay - p.ay) * (p.bx - p.ax) > (p.by - p.ay) * (q.ax - p.ax)) <> ((q.by - p.ay) * (p.bx - p.ax) > (p.by - p.ay) * (q.bx - p.ax))"""
)
def crossing_segments(spark, sf_dir):
    """JN18, GEO24."""
    from mapfold.session import table

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ax, ay = (k * 13) % 500, (c * 7) % 500
    seg = table(spark, sf_dir, "orders").select((k % 20).alias("map_id"), k.alias("seg_id"), *[e.cast("double").alias(n) for n, e in (("ax", ax), ("ay", ay), ("bx", ax + c % 23 - 11), ("by", ay + k % 19 - 9))])
    return S.crossing_segments(seg).select("map_id", "a", "b")
