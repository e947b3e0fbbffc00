"""Queries of chains in order and of mask boundaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapfold.functions import geometry as G
from mapfold.operators import chains as C
from mapfold.operators import pixels as P
from mapfold.plans import inputs as I
from mapfold.plans.registry import query

_CHAINS = f"""{I.PARTS_SQL}, b AS (SELECT map_id, u, v FROM parts UNION ALL SELECT map_id, v, u FROM parts),
d AS (SELECT map_id, u AS node, count(*) AS degree FROM b GROUP BY 1, 2),
reach AS (SELECT map_id, u AS node, u AS other FROM b UNION SELECT r.map_id, r.node, b.v FROM reach r JOIN b ON b.map_id = r.map_id AND b.u = r.other),
piece AS (SELECT map_id, node, min(other) AS least FROM reach GROUP BY 1, 2),
stops AS (SELECT map_id, node FROM d WHERE degree <> 2
 UNION ALL SELECT map_id, least FROM piece JOIN d USING (map_id, node) GROUP BY 1, 2 HAVING min(degree) = 2 AND max(degree) = 2),
inner2 AS (SELECT map_id, node FROM d ANTI JOIN stops USING (map_id, node)),
walk AS (SELECT b.map_id, b.u AS fu, b.v AS fv, 1 AS pos, b.u AS prev, b.v AS node FROM b JOIN stops s ON s.map_id = b.map_id AND s.node = b.u
 UNION ALL SELECT w.map_id, fu, fv, pos + 1, w.node, b.v FROM walk w JOIN inner2 i ON i.map_id = w.map_id AND i.node = w.node JOIN b ON b.map_id = w.map_id AND b.u = w.node AND b.v <> w.prev),
chosen AS (SELECT w.map_id, fu, fv FROM walk w JOIN stops s ON s.map_id = w.map_id AND s.node = w.node WHERE fu < w.node OR fu = w.node AND fv < prev),
chain AS (SELECT map_id, fu, fv, 0 AS pos, fu AS node FROM chosen UNION ALL SELECT w.map_id, w.fu, w.fv, w.pos, w.node FROM walk w JOIN chosen USING (map_id, fu, fv))"""


@query(f"WITH RECURSIVE {_CHAINS} SELECT map_id, fu, fv, CAST(pos AS BIGINT) AS pos, node FROM chain")
def chain_nodes(spark, sf_dir):
    """GRF5, GRF19: the nodes of every chain in order."""
    found = C.ordered_chains(I.part_rows(spark, sf_dir))
    return found.select("map_id", F.col("chain.u").alias("fu"), F.col("chain.v").alias("fv"), "pos", "node")


_LEGS = f"""{_CHAINS}, {I.PLACES_SQL},
v AS (SELECT map_id, fu, fv, pos, x, y, sum(leg) OVER (PARTITION BY map_id, fu, fv ORDER BY pos ROWS UNBOUNDED PRECEDING) AS length
 FROM (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS leg FROM chain JOIN places USING (map_id, node) WINDOW w AS (PARTITION BY map_id, fu, fv ORDER BY pos))),
legs AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0, lag(length) OVER w AS length0, max(length) OVER (PARTITION BY map_id, fu, fv) AS total FROM v WINDOW w AS (PARTITION BY map_id, fu, fv ORDER BY pos))"""
_INNER = """inner_points AS (SELECT map_id, fu, fv, k, x0 + t * (x - x0) AS x, y0 + t * (y - y0) AS y FROM (
 SELECT *, (k * step - length0) / (length - length0) AS t FROM (SELECT *, unnest(range(CAST(floor(length0 / step) AS BIGINT) + 1, least(CAST(floor(length / step) AS BIGINT), parts - 1) + 1)) AS k
 FROM (SELECT *, total / parts AS step FROM cuts WHERE length0 IS NOT NULL AND total > 0))))"""


@query(
    f"""WITH RECURSIVE {_LEGS}, cuts AS (SELECT *, CAST(floor(total / 150.3) AS BIGINT) + 1 AS parts FROM legs), {_INNER}
SELECT map_id, fu, fv, k, round(x, 5) AS x, round(y, 5) AS y FROM inner_points
UNION ALL SELECT map_id, fu, fv, CASE WHEN pos = 0 THEN 0 ELSE parts END, round(x, 5), round(y, 5) FROM cuts WHERE length0 IS NULL OR pos = (SELECT max(pos) FROM v WHERE v.map_id = cuts.map_id AND v.fu = cuts.fu AND v.fv = cuts.fv)"""
)
def resampled_chains(spark, sf_dir):
    """GRF5, WIN13: chains as points at even distances of about 150.3."""
    edges = I.part_rows(spark, sf_dir)
    points = C.resampled(C.chain_vertices(edges, I.places(edges)), 150.3)
    return points.select("map_id", F.col("line_id.u").alias("fu"), F.col("line_id.v").alias("fv"), "k", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query(
    f"""WITH RECURSIVE {_LEGS}, {I.REGIONS_SQL}, cuts AS (SELECT *, greatest(CAST(floor(total / 201.7) AS BIGINT), 1) + 1 AS parts FROM legs WHERE total >= 201.7 / 2), {_INNER}
SELECT map_id, fu, fv, k, round(x, 5) AS x, round(y, 5) AS y FROM inner_points JOIN regions USING (map_id)
WHERE x - rx0 > 0.07 * (rx1 - rx0) AND rx1 - x > 0.07 * (rx1 - rx0) AND y - ry0 > 0.07 * (ry1 - ry0) AND ry1 - y > 0.07 * (ry1 - ry0)"""
)
def chain_start_points(spark, sf_dir):
    """GRF20: evaluation starts along chains, away from the region's border."""
    edges = I.part_rows(spark, sf_dir)
    points = C.start_points(C.chain_vertices(edges, I.places(edges)), 201.7, I.regions(spark, sf_dir))
    return points.select("map_id", F.col("line_id.u").alias("fu"), F.col("line_id.v").alias("fv"), "k", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


_CORNERS = "UNION ALL ".join(
    f"SELECT map_id, key, m.row, m.col, (NOT has(a.row) AND NOT has(b.row) OR has(a.row) AND has(b.row) AND NOT has(c.row)) AS corner FROM sheet_mask m "
    f"LEFT JOIN sheet_mask a ON a.map_id = m.map_id AND a.key = m.key AND a.row = m.row + ({dr}) AND a.col = m.col "
    f"LEFT JOIN sheet_mask b ON b.map_id = m.map_id AND b.key = m.key AND b.row = m.row AND b.col = m.col + ({dc}) "
    f"LEFT JOIN sheet_mask c ON c.map_id = m.map_id AND c.key = m.key AND c.row = m.row + ({dr}) AND c.col = m.col + ({dc}) "
    for dr in (-1, 1)
    for dc in (-1, 1)
)
_CORNERS = _CORNERS.replace("SELECT map_id, key,", "SELECT m.map_id, m.key,")
for _c in "abc":
    _CORNERS = _CORNERS.replace(f"has({_c}.row)", f"({_c}.row IS NOT NULL)")


@query(
    f"""WITH RECURSIVE {I.SHEET_MASK_SQL}, touch AS (SELECT a.map_id, a.key, a.row, a.col, b.row AS r2, b.col AS c2 FROM sheet_mask a JOIN sheet_mask b ON b.map_id = a.map_id AND b.key = a.key AND abs(b.row - a.row) + abs(b.col - a.col) = 1),
reach AS (SELECT map_id, key, row, col, row AS r, col AS c FROM sheet_mask UNION SELECT x.map_id, x.key, x.row, x.col, t.r2, t.c2 FROM reach x JOIN touch t ON t.map_id = x.map_id AND t.key = x.key AND t.row = x.r AND t.col = x.c),
labels AS (SELECT map_id, key, row, col, min(r * 1000 + c) AS label FROM reach GROUP BY 1, 2, 3, 4),
corners AS (SELECT map_id, key, row, col, sum(corner::INT) AS corners FROM ({_CORNERS}) GROUP BY 1, 2, 3, 4),
sides AS (SELECT map_id, key, row, col, count(*) FILTER (WHERE r2 > row OR c2 > col) AS sides FROM touch GROUP BY 1, 2, 3, 4),
squares AS (SELECT m.map_id, m.key, m.row, m.col FROM sheet_mask m SEMI JOIN sheet_mask a ON a.map_id = m.map_id AND a.key = m.key AND a.row = m.row + 1 AND a.col = m.col
 SEMI JOIN sheet_mask b ON b.map_id = m.map_id AND b.key = m.key AND b.row = m.row AND b.col = m.col + 1 SEMI JOIN sheet_mask c ON c.map_id = m.map_id AND c.key = m.key AND c.row = m.row + 1 AND c.col = m.col + 1)
SELECT map_id, key, CAST(label // 1000 AS INTEGER) AS row, CAST(label % 1000 AS INTEGER) AS col, CAST(count(*) AS DOUBLE) AS area, CAST(sum(corners) AS BIGINT) AS n_corners,
       CAST(1 - (count(*) - coalesce(sum(sides), 0) + count(q.hit)) AS INTEGER) AS n_holes
FROM labels l JOIN corners USING (map_id, key, row, col) LEFT JOIN sides USING (map_id, key, row, col) LEFT JOIN (SELECT *, 1 AS hit FROM squares) q USING (map_id, key, row, col) GROUP BY map_id, key, label"""
)
def mask_polygons(spark, sf_dir):
    """RAS3, SNK12: components as rings with holes, with their area, corners and holes."""
    shapes = C.mask_polygons(P.labelled_runs(I.sheet_mask(spark, sf_dir)))
    area = G.signed_area(F.col("ring")) + F.aggregate("holes", F.lit(0.0), lambda a, h: a + G.signed_area(h))
    corners = F.size("ring") - 1 + F.aggregate("holes", F.lit(0), lambda a, h: a + F.size(h) - 1)
    return shapes.select("map_id", "key", F.col("label.row").alias("row"), F.col("label.col").alias("col"), area.alias("area"), corners.cast("long").alias("n_corners"), F.size("holes").alias("n_holes"))


@query(f"WITH {I.SHEET_MASK_SQL} SELECT map_id, key, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col FROM sheet_mask")
def masks_from_polygons(spark, sf_dir):
    """RAS3, RAS5, SNK12: masks traced to polygons with holes and filled again are the masks."""
    shapes = C.mask_polygons(P.labelled_runs(I.sheet_mask(spark, sf_dir)))
    return P.filled_polygons(shapes).select("map_id", "key", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
