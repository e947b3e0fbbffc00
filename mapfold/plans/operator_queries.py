"""Queries that run single operators which no other query reaches."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapfold.functions import geometry as G
from mapfold.functions import text as X
from mapfold.operators import graphs as R
from mapfold.operators import matching as M
from mapfold.operators import tiles as T
from mapfold.plans import inputs as I
from mapfold.plans.registry import query
from mapfold.session import table


@query(
    """WITH c AS (SELECT conv_id, turn, role, regexp_extract_all(lower(text), '[a-z]+') AS w FROM conversations),
p AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN [coalesce(w[1], 'x') || ':', coalesce(w[2], 'y')] ELSE [array_to_string(w[1:2], ' '), array_to_string(w[1:5], ' ')] END AS parts FROM c),
u AS (SELECT conv_id AS map_id, turn AS item_id, unnest(range(2)) AS pos, trim(unnest(parts)) AS part FROM p),
t AS (SELECT *, last_value(CASE WHEN part LIKE '%:' THEN regexp_replace(part, ':$', '') END IGNORE NULLS) OVER (PARTITION BY map_id ORDER BY item_id, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS title FROM u)
SELECT map_id, item_id, CAST(pos AS INTEGER) AS pos, title, CASE WHEN len(string_split(part, ' ')) < 4 AND title IS NOT NULL THEN title || ' ' || part ELSE part END AS "full" FROM t WHERE part NOT LIKE '%:'"""
)
def titled_descriptions(spark, sf_dir):
    """TXT5: short parts get the last title above them in front."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", w.alias("w"))
    title = F.concat_ws(";", F.concat(F.coalesce(F.get("w", F.lit(0)), F.lit("x")), F.lit(":")), F.coalesce(F.get("w", F.lit(1)), F.lit("y")))
    other = F.concat(F.array_join(F.slice("w", 1, 2), " "), F.lit(";"), F.array_join(F.slice("w", 1, 5), " "))
    items = words.select(F.col("conv_id").alias("map_id"), F.col("turn").alias("item_id"), F.when(F.col("role") == "user", title).otherwise(other).alias("description"))
    return M.carry_titles(items).select("map_id", "item_id", "pos", "title", "full")


@query(
    """SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS title,
concat_ws(' ', p_name, CASE WHEN p_partkey % 3 > 0 THEN p_brand || ' ' || p_type END, CASE WHEN p_partkey % 5 > 0 THEN p_type END) AS search FROM part"""
)
def searched_names(spark, sf_dir):
    """TXT6, TXT7: names in title case and as search strings with counties and state, where they are known."""
    counties = F.when(F.col("p_partkey") % 3 > 0, F.concat_ws(",", "p_brand", "p_type"))
    state = F.when(F.col("p_partkey") % 5 > 0, F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", X.title_case(F.upper("p_name")).alias("title"), X.search_string(F.col("p_name"), counties, state).alias("search"))


@query(
    """WITH t AS (SELECT c_custkey AS map_id, 256 * i AS x0, 256 * j AS y0, c_custkey * 13 % 700 AS ax, c_custkey * 29 % 500 AS ay FROM customer, range(4) r(i), range(4) s(j))
SELECT map_id, x0, y0 FROM t WHERE least(x0 + 256, ax + 300) > greatest(x0, ax) AND least(y0 + 256, ay + 200) > greatest(y0, ay)
AND (least(x0 + 256, ax + 300) - greatest(x0, ax)) * (least(y0 + 256, ay + 200) - greatest(y0, ay)) >= 20000"""
)
def tiles_with_content(spark, sf_dir):
    """FLT11: tiles that overlap their map's content by at least 20,000 pixels."""
    maps = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("map_id"))
    steps = F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))
    tiles = maps.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps)).select("map_id", (F.col("i") * 256).alias("x0"), (F.col("j") * 256).alias("y0"))
    x, y = F.col("map_id") * 13 % 700, F.col("map_id") * 29 % 500
    areas = maps.select("map_id", F.struct(x.alias("xmin"), y.alias("ymin"), (x + 300).alias("xmax"), (y + 200).alias("ymax")).alias("box"))
    return T.content_tiles(tiles, areas, 256, 20000).select("map_id", "x0", "y0")


@query(f"WITH {I.BOXES_SQL} SELECT map_id, box_id, 4 AS n, xmin AS x, ymin AS y, (xmax - xmin) * (ymax - ymin) / 2 AS area FROM boxes")
def closed_rings(spark, sf_dir):
    """GEO6: half of each legend box as a ring that ends where it began."""
    b = I.boxes(spark, sf_dir)
    corner = lambda x, y: G.point(F.col("box." + x), F.col("box." + y))
    ring = b.select("map_id", "box_id", G.closed(F.array(corner("xmin", "ymin"), corner("xmax", "ymin"), corner("xmax", "ymax"))).alias("ring"))
    last = F.element_at("ring", -1)
    return ring.select("map_id", "box_id", F.size("ring").alias("n"), last["x"].alias("x"), last["y"].alias("y"), G.ring_area(F.col("ring")).alias("area"))


@query(
    """WITH v AS (SELECT l_orderkey, l_orderkey // 500 AS map_id, CAST(l_partkey % 40 AS DOUBLE) AS x, CAST(l_suppkey % 40 AS DOUBLE) AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem),
e AS (SELECT a.map_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bz FROM v a JOIN v b ON a.l_orderkey = b.l_orderkey AND b.k = a.k + 1 WHERE a.x <> b.x OR a.y <> b.y)
SELECT DISTINCT map_id, CASE WHEN s THEN ax ELSE bx END AS ux, CASE WHEN s THEN ay ELSE bz END AS uy, CASE WHEN s THEN bx ELSE ax END AS vx, CASE WHEN s THEN bz ELSE ay END AS vy FROM (SELECT *, ax < bx OR ax = bx AND ay < bz AS s FROM e)"""
)
def edges_of_order_lines(spark, sf_dir):
    """SET4, GRF1, GRF2: polylines as undirected edges without loops and doubles."""
    at = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    ordered = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(at)).alias("v"))
    line = F.transform("v", lambda p: G.point((p["l_partkey"] % 40).cast("double"), (p["l_suppkey"] % 40).cast("double")))
    lines = ordered.select(F.floor(F.col("l_orderkey") / 500).alias("map_id"), line.alias("line"))
    return R.edges_of_lines(lines).select("map_id", F.col("u.x").alias("ux"), F.col("u.y").alias("uy"), F.col("v.x").alias("vx"), F.col("v.y").alias("vy"))
