"""Queries of scalar geometry, filters, windows, legend rules, sets, texts, tiles and samples, each with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapfold.functions import geometry as G
from mapfold.functions import text as X
from mapfold.operators import evaluate as E
from mapfold.operators import georef as R
from mapfold.operators import graphs as GR
from mapfold.operators import legends as L
from mapfold.operators import matching as M
from mapfold.operators import tiles as T
from mapfold.operators import vectors as V
from mapfold.plans import inputs as I
from mapfold.plans.registry import query
from mapfold.session import table


def _box(*names):
    return F.struct(*[F.col(n).alias(c) for n, c in zip(names, ("xmin", "ymin", "xmax", "ymax"), strict=True)])


@query(
    f"""WITH {I.BOXES_SQL} SELECT box_id, (xmin + xmax) / 2 AS cx, ymax - ymin AS h, xmin AS back, ymin AS swapped, -ymax AS negated, round_even(xmax / 8, 1) AS rounded, xmax * 2.5 AS scaled_x, ymax / 4 AS scaled_y,
 CASE WHEN (xmax - xmin) * (ymax - ymin) > 0 THEN 1.0::DOUBLE END AS giou FROM boxes"""
)
def ring_scalars(spark, sf_dir):
    """GEO5, GEO8, GEO14, GEO16, GEO26, REF4."""
    b = F.col("box")
    c = G.box_to_center(b)
    back = G.box_from_center(c["cx"], c["cy"], c["w"], c["h"])
    ring = G.box_ring(b)
    return I.boxes(spark, sf_dir).select(
        "box_id",
        c["cx"].alias("cx"),
        c["h"].alias("h"),
        back["xmin"].alias("back"),
        G.swapped(ring)[0]["x"].alias("swapped"),
        G.negated(ring)[2]["y"].alias("negated"),
        G.rounded(G.scaled(ring, F.lit(0.125), F.lit(1.0)), 1)[2]["x"].alias("rounded"),
        G.scaled(ring, F.lit(2.5), F.lit(0.25))[2]["x"].alias("scaled_x"),
        G.scaled(ring, F.lit(2.5), F.lit(0.25))[2]["y"].alias("scaled_y"),
        G.box_giou(b, b).alias("giou"),
    )


@query(
    """WITH p AS (SELECT o_orderkey AS id, o_orderkey % 1000 AS x, o_custkey % 800 AS y FROM orders)
SELECT id, 2.0 * x + 0.5 * y - 120 AS mx, 0.25 * x - 2.0 * y + 45 AS my, CAST(x AS INTEGER) AS px, CAST(y AS INTEGER) AS py FROM p"""
)
def affine_there_and_back(spark, sf_dir):
    """GEO9, GEO10."""
    c = F.struct(*[F.lit(v).alias(k) for k, v in zip("abcdef", (2.0, 0.5, -120.0, 0.25, -2.0, 45.0), strict=True)])
    mx, my = G.affine((F.col("o_orderkey") % 1000).cast("double"), (F.col("o_custkey") % 800).cast("double"), c)
    px, py = G.inverse_affine(mx, my, c)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), mx.alias("mx"), my.alias("my"), px.alias("px"), py.alias("py"))


@query(
    """WITH p AS (SELECT o_orderkey AS id, o_orderkey % 512 AS x, o_custkey % 512 AS y FROM orders)
SELECT id, round((10 + x / 256.0) / 4096.0::DOUBLE * 360 - 180, 6) AS lon, round(degrees(atan(sinh(pi() * (1 - 2 * (20 + y / 256.0::DOUBLE) / 4096)))), 6) AS lat,
 round(-100 + x / 512.0::DOUBLE * 4, 6) AS west_of, round(40 - y / 512.0::DOUBLE * 8, 6) AS north_of, x AS px, y AS py FROM p"""
)
def region_mappings(spark, sf_dir):
    """GEO13, GEO31."""
    x, y = (F.col("o_orderkey") % 512).cast("double"), (F.col("o_custkey") % 512).cast("double")
    lon, lat = G.stitched_lonlat(x, y, F.lit(10), F.lit(20), F.lit(12))
    r = F.struct(F.lit(-100.0).alias("west"), F.lit(-96.0).alias("east"), F.lit(32.0).alias("south"), F.lit(40.0).alias("north"))
    rlon, rlat = G.region_lonlat(x, y, r, F.lit(512.0), F.lit(512.0))
    px, py = G.region_pixel(rlon, rlat, r, F.lit(512.0), F.lit(512.0))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), lon.alias("lon"), lat.alias("lat"), F.round(rlon, 6).alias("west_of"), F.round(rlat, 6).alias("north_of"), px.cast("long").alias("px"), py.cast("long").alias("py"))


@query(
    """WITH p AS (SELECT o_orderkey AS id, (o_orderkey % 9 + 1)::DOUBLE AS ux, (o_custkey % 7 - 3)::DOUBLE AS uy, (o_orderkey % 5 - 2)::DOUBLE AS vx, (o_custkey % 4 + 1)::DOUBLE AS vy, (o_orderkey % 17 + 2)::DOUBLE AS cx, (o_custkey % 23 - 20)::DOUBLE AS cy FROM orders),
d AS (SELECT *, ux * 30 - uy * 2 AS det FROM p), t AS (SELECT *, (cx * 30 - cy * 2) / nullif(det, 0) AS t, (cx * uy - cy * ux) / nullif(det, 0) AS u FROM d)
SELECT id, round(ux / sqrt(ux * ux + uy * uy), 6) + 0 AS dx, round(1 - (ux * vx + uy * vy) / (sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy)), 6) + 0 AS apart,
 round(CASE WHEN t >= 1 AND u >= 0 AND u <= 1 THEN (t - 1) * sqrt(ux * ux + uy * uy) END, 6) + 0 AS more FROM t"""
)
def directions(spark, sf_dir):
    """GEO23, GEO25: the ray from (0, 0) through (ux, uy) against the segment from (cx, cy) to (cx + 2, cy + 30)."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ux, uy, vx, vy, cx, cy = (e.cast("double") for e in (k % 9 + 1, c % 7 - 3, k % 5 - 2, c % 4 + 1, k % 17 + 2, c % 23 - 20))
    o = F.lit(0.0)
    more = G.ray_extension(o, o, ux, uy, cx, cy, cx + 2, cy + 30)
    return table(spark, sf_dir, "orders").select(k.alias("id"), (F.round(G.unit(ux, uy)[0], 6) + 0.0).alias("dx"), (F.round(G.angle_distance(ux, uy, vx, vy), 6) + 0.0).alias("apart"), (F.round(more, 6) + 0.0).alias("more"))


_VERTICES_SQL = """v AS (SELECT o_custkey % 20 AS map_id, o_custkey AS line_id, o_orderkey AS pos, CAST(o_orderkey % 300 AS DOUBLE) AS x, CAST(o_orderkey * 7 % 200 AS DOUBLE) AS y FROM orders),
s AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step FROM v WINDOW w AS (PARTITION BY map_id, line_id ORDER BY pos)),
l AS (SELECT *, sum(step) OVER (PARTITION BY map_id, line_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS length FROM s)"""


def _vertices(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select((c % 20).alias("map_id"), c.alias("line_id"), k.alias("pos"), (k % 300).cast("double").alias("x"), (k * 7 % 200).cast("double").alias("y"))


@query(f"WITH {_VERTICES_SQL} SELECT map_id, line_id, pos, round(length, 5) AS length, CAST(floor(round(length, 5) / 77.7) AS BIGINT) AS piece FROM l")
def line_pieces(spark, sf_dir):
    """WIN13, GEO29: length along each line, and the piece of target length."""
    p = GR.pieces(_vertices(spark, sf_dir), 77.7)
    return p.select("map_id", "line_id", "pos", F.round("length", 5).alias("length"), F.floor(F.round("length", 5) / 77.7).alias("piece"))


@query(f"WITH {_VERTICES_SQL} SELECT map_id, line_id, CAST(sum(CASE WHEN step > 0 THEN ceil(round(step, 6) / 10) WHEN pos > m THEN 1 ELSE 0 END) + 1 AS BIGINT) AS n FROM (SELECT *, min(pos) OVER (PARTITION BY map_id, line_id) AS m FROM s) GROUP BY 1, 2")
def spaced_vertices(spark, sf_dir):
    """GEO27: vertices of every line at most ten apart."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))), lambda v: G.point(v["x"], v["y"]))
    lines = _vertices(spark, sf_dir).groupBy("map_id", "line_id").agg(line.alias("line"))
    return lines.select("map_id", "line_id", F.size(G.along(F.col("line"), 10.0)).cast("long").alias("n"))


@query(
    """WITH c AS (SELECT c_custkey AS map_id, c_custkey % 7 AS a, c_custkey % 5 AS b FROM customer)
SELECT map_id, g.id AS gcp_id, CAST(g.col AS DOUBLE) AS px, CAST(g.row AS DOUBLE) AS py, CAST(g.lon AS DOUBLE) AS mx, CAST(g.lat AS DOUBLE) AS my FROM (SELECT map_id, unnest([
 {'id': 1, 'row': 10 + a, 'col': 5, 'lon': a, 'lat': 50 + b}, {'id': 2, 'row': 12, 'col': 900, 'lon': 10 + a, 'lat': 50 + b}, {'id': 3, 'row': 700, 'col': 905 + b, 'lon': 10 + a, 'lat': b}, {'id': 4, 'row': 705, 'col': 3, 'lon': a, 'lat': b}]) AS g FROM c)"""
)
def corner_control_points(spark, sf_dir):
    """GEO18, GEO17."""
    k = F.col("c_custkey")
    a, b = k % 7, k % 5
    p = lambda r, c: F.struct(r.cast("long").alias("row"), c.cast("long").alias("col"))
    c = table(spark, sf_dir, "customer")
    corners = R.ordered_corners(c.select(k.alias("map_id"), F.inline(F.array(p(F.lit(705), F.lit(3)), p(10 + a, F.lit(5)), p(F.lit(700), 905 + b), p(F.lit(12), F.lit(900))))))
    bounds = c.select(k.alias("map_id"), *[e.cast("double").alias(n) for n, e in (("west", a), ("east", 10 + a), ("north", 50 + b), ("south", b))])
    return R.corner_gcps(corners, bounds)


@query(
    """WITH o AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey % 100 - 3 AS conf, l_suppkey AS top, CAST(l_partkey % 31 + 1 AS DOUBLE) AS width, CAST(l_quantity AS DOUBLE) AS height FROM lineitem),
t AS (SELECT id, width, CASE WHEN height > 1.5 * width THEN top + 0.2 * height ELSE top END AS top, CASE WHEN height > 1.5 * width THEN 0.6 * height ELSE height END AS height FROM o WHERE conf >= 0)
SELECT id, round(top, 4) AS top, round(height, 4) AS height FROM t WHERE height <= 2 * width AND height <= 30"""
)
def ocr_boxes(spark, sf_dir):
    """FLT2."""
    li = table(spark, sf_dir, "lineitem")
    b = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 100 - 3).alias("conf"), F.col("l_suppkey").cast("double").alias("top"), (F.col("l_partkey") % 31 + 1).cast("double").alias("width"), F.col("l_quantity").cast("double").alias("height"))
    return L.ocr_filtered(b).select("id", F.round("top", 4).alias("top"), F.round("height", 4).alias("height"))


@query(f"WITH {I.BOXES_SQL} SELECT map_id, box_id FROM boxes WHERE (xmax - xmin) * (ymax - ymin) > 400 AND box_id % 7 > 0")
def sane_polygons(spark, sf_dir):
    """FLT5, FLT6: small rings, and every 7th one empty."""
    r = I.box_rings(spark, sf_dir)
    r = r.withColumn("geom", F.when(F.col("box_id") % 7 > 0, F.col("ring")).otherwise(F.slice("ring", 1, 0)))
    return L.sane_geometry(r, 400.0).select("map_id", "box_id")


@query(
    """WITH d AS (SELECT p_partkey % 20 AS map_id, p_partkey AS id, lower(p_type) AS t, p_partkey % 20 < 12 AS first FROM part), h AS (SELECT * FROM d WHERE t LIKE '%promo%' OR t LIKE '%large%')
SELECT map_id, id FROM h WHERE first AND map_id % 3 > 0 UNION ALL SELECT map_id, id FROM h WHERE map_id NOT IN (SELECT map_id FROM h WHERE first AND map_id % 3 > 0)"""
)
def routed_legend_lines(spark, sf_dir):
    """FLT9, FLT18: rows with a keyword from a second source for maps without any in the first."""
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 20).alias("map_id"), F.col("p_partkey").alias("id"), F.col("p_type").alias("description"), F.lit("").alias("symbol"))
    return L.routed_lines(p.filter("map_id < 12 AND map_id % 3 > 0"), p, ("promo", "large")).select("map_id", "id")


@query(
    """WITH b AS (SELECT o_custkey AS map_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) // 6 AS c, o_orderkey AS box_id, o_orderkey % 300 AS variance, o_orderkey * 7 % 1200 AS n_chars FROM orders)
SELECT map_id, c AS "column", box_id FROM b QUALIFY count_if(variance >= 100 AND n_chars < 1000) OVER (PARTITION BY map_id, c) > 3"""
)
def column_votes(spark, sf_dir):
    """FLT15 over columns of at most six boxes, which are all sampled."""
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(k))
    b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("map_id"), F.floor(n / 6).alias("column"), k.alias("box_id"), (k % 300).alias("variance"), (k * 7 % 1200).alias("n_chars"))
    return L.column_vote(b).select("map_id", "column", "box_id")


@query(
    f"""WITH {I.BOXES_SQL} SELECT map_id, box_id, CASE WHEN xmax > 700 OR ymax > 600 THEN 'outside'
 WHEN box_id % 5 = 2 THEN CASE WHEN xmax > xmin THEN 'crosses' ELSE 'points' END WHEN xmax = xmin THEN 'points' WHEN box_id % 5 = 3 THEN 'spike' WHEN box_id % 5 = 4 THEN 'touches' WHEN box_id % 5 = 0 THEN 'turns' ELSE 'kept' END AS verdict FROM boxes"""
)
def detection_checks(spark, sf_dir):
    """FLT17, GEO20: rings inside the sheet that turn the right way and don't meet themselves; bow ties, spikes and pinches otherwise."""
    b = I.boxes(spark, sf_dir)
    p = {k: G.point(*(F.col(f"box.{c}") for c in cs)) for k, cs in {"nw": ("xmin", "ymin"), "ne": ("xmax", "ymin"), "se": ("xmax", "ymax"), "sw": ("xmin", "ymax")}.items()}
    mid = G.point((F.col("box.xmin") + F.col("box.xmax")) / 2, F.col("box.ymin"))
    shapes = {0: ("nw", "ne", "se", "sw", "nw"), 1: ("nw", "sw", "se", "ne", "nw"), 2: ("nw", "se", "ne", "sw", "nw"), 3: ("nw", "sw", "se", "ne", "se", "ne", "nw"), 4: ("nw", "sw", mid, "se", "ne", "nw")}
    ring = F.coalesce(*[F.when(F.col("box_id") % 5 == k, F.array(*[p[v] if isinstance(v, str) else v for v in vs])) for k, vs in shapes.items()])
    sheets = b.select("map_id").distinct().select("map_id", F.lit(600).alias("height"), F.lit(700).alias("width"))
    good, bad = L.valid_detections(b.select("map_id", "box_id", ring.alias("ring")), sheets)
    told = lambda df, verdict: df.select("map_id", "box_id", verdict.alias("verdict"))
    return told(good, F.lit("kept")).unionByName(told(bad, F.col("reason")))


@query(
    f"""WITH {I.BOXES_SQL}, r AS (SELECT map_id, box_id, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY map_id, box_id % 3) - 1 AS last FROM boxes WINDOW w AS (PARTITION BY map_id, box_id % 3 ORDER BY ymin, box_id))
SELECT map_id, box_id, CASE WHEN r < last // 3 THEN 0 WHEN r < last * 2 // 3 THEN 1 ELSE 2 END AS part FROM r"""
)
def column_thirds(spark, sf_dir):
    """WIN6."""
    b = I.boxes(spark, sf_dir).select("map_id", "box_id", (F.col("box_id") % 3).alias("column"), F.col("ymin").alias("y1"))
    return L.thirds(b).select("map_id", "box_id", "part")


@query(
    """WITH c AS (SELECT p_partkey % 20 AS map_id, p_partkey % 7 AS c, CAST(min(p_partkey % 20 * 50 + p_partkey % 7 * 700 + p_partkey % 7 * p_partkey % 20 * 30) AS DOUBLE) AS x0 FROM part GROUP BY 1, 2),
n AS (SELECT *, lead(x0) OVER (PARTITION BY map_id ORDER BY x0) AS n FROM c)
SELECT map_id, c AS "column", CASE WHEN n - x0 > 1000 THEN n ELSE CAST(9000 + map_id AS DOUBLE) END AS x1 FROM n"""
)
def column_extents(spark, sf_dir):
    """WIN8."""
    k = F.col("p_partkey")
    c = table(spark, sf_dir, "part").groupBy((k % 20).alias("map_id"), (k % 7).alias("column")).agg(F.min(k % 20 * 50 + k % 7 * 700 + k % 7 * k % 20 * 30).cast("double").alias("x0"))
    rois = c.select("map_id").distinct().withColumn("box", F.struct((9000 + F.col("map_id")).cast("double").alias("xmax")))
    return L.column_extent(c, rois).select("map_id", "column", "x1")


@query(
    """WITH f AS (SELECT o_custkey AS name, list(DISTINCT o_orderkey % 30) AS f FROM orders GROUP BY 1), t AS (SELECT c_custkey AS name, [c_custkey % 30, c_custkey * 7 % 30] AS t FROM customer),
b AS (SELECT name, len(list_intersect(f, t)) > 0 AS hit FROM f JOIN t USING (name))
SELECT CAST(NULL AS BIGINT) AS name, round(avg(hit::INT), 6) AS recall, count_if(hit) AS hits, count(*) AS n FROM b UNION ALL SELECT name, NULL, NULL, NULL FROM b WHERE NOT hit"""
)
def candidate_recall(spark, sf_dir):
    """EVL7, SET3, AGG5: the share of names with a true candidate, and the names without."""
    found = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("name")).agg(F.collect_set(F.col("o_orderkey") % 30).alias("ids"))
    k = F.col("c_custkey")
    truth = table(spark, sf_dir, "customer").select(k.alias("name"), F.array(k % 30, k * 7 % 30).alias("ids"))
    score, missed = E.candidate_recall(found, truth)
    none = F.lit(None).cast("long")
    return score.select(none.alias("name"), F.round("recall", 6).alias("recall"), "hits", "n").unionByName(missed.select("name", F.lit(None).cast("double").alias("recall"), none.alias("hits"), none.alias("n")))


@query(
    f"""WITH {I.BOXES_SQL}, s AS (SELECT map_id, box_id, CASE WHEN box_id % 3 = 0 THEN 'a_line' ELSE 'a_poly' END AS label, xmin, ymin, xmax, ymax FROM boxes WHERE map_id % 4 > 0 OR box_id % 3 = 0),
m AS (SELECT DISTINCT map_id FROM boxes)
SELECT m.map_id, count_if(label = 'a_poly') AS n, min(xmin) FILTER (label = 'a_line') - 300 AS xmin, max(xmax) FILTER (label = 'a_line') + 1800 AS xmax, max(ymax) FILTER (label = 'a_line') + 300 AS ymax FROM m LEFT JOIN s USING (map_id) GROUP BY 1"""
)
def legend_counts_and_search_boxes(spark, sf_dir):
    """AGG19, AGG20."""
    b = I.boxes(spark, sf_dir)
    s = b.filter("map_id % 4 > 0 OR box_id % 3 = 0").select("map_id", F.when(F.col("box_id") % 3 == 0, "a_line").otherwise("a_poly").alias("label"), "box")
    maps = b.select("map_id").distinct()
    return L.polygon_items(s, maps).join(L.search_box(s).select("map_id", "xmin", "xmax", "ymax"), "map_id", "left")


@query(
    """SELECT s_name AS name, s_nationkey AS nation FROM supplier UNION ALL SELECT c_name, c_nationkey FROM customer"""
)
def united_gazetteers(spark, sf_dir):
    """SET1, SET2: rows of both on the columns they share."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.lit(1).alias("only_here"))
    return L.shared_union(s, table(spark, sf_dir, "customer").select(F.lit(2).alias("only_there"), F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name")))


@query(
    """WITH m AS (SELECT o_custkey AS map_id, o_orderpriority AS p, min(o_orderkey) AS k FROM orders GROUP BY ALL) SELECT map_id, string_agg(p || '.pt', ',' ORDER BY k) AS models FROM m GROUP BY 1"""
)
def model_files(spark, sf_dir):
    """SET6: distinct models of each map in first order."""
    lists = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("map_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]).alias("models"))
    return L.distinct_models(lists).select("map_id", F.array_join("models", ",").alias("models"))


@query(
    """SELECT p_partkey, replace(replace(lower(p_type), 'economy', 'eco'), 'standard', 'std') AS synonyms, lower(p_type) LIKE 'promo%' OR lower(p_type) LIKE 'small%' AS line,
 CASE WHEN contains(lower(p_type), 'sta') OR contains(lower(p_type), 'dium') THEN 'plain' WHEN contains(lower(p_type), 'large') THEN 'big' END AS class,
 p_name || 's done' AS pieces, replace(p_brand || '-x-1', '-', '') AS hyphens, p_partkey % 3 <> 1 AS same FROM part"""
)
def text_rules(spark, sf_dir):
    """TXT3, TXT4, TXT20, TXT22, TXT25."""
    t, k = F.lower("p_type"), F.col("p_partkey")
    other = F.when(k % 3 == 0, F.concat(F.upper("p_name"), F.lit("."))).when(k % 3 == 1, F.concat("p_name", F.lit("x"))).otherwise(F.concat(F.lit("("), "p_name"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        X.replace_synonyms(t, {"economy": "eco", "standard": "std"}).alias("synonyms"),
        X.is_line_feature(t, ("promo", "small")).alias("line"),
        X.point_class(t, (("plain", ("sta", "dium")), ("big", ("large",)))).alias("class"),
        X.rejoin_pieces(F.array(F.col("p_name"), F.lit("##s"), F.lit("done"))).alias("pieces"),
        X.without_hyphens(F.concat("p_brand", F.lit("-x-1"))).alias("hyphens"),
        # the text as it is on the side of which edges are set aside
        X.same_transcription(other, F.col("p_name")).alias("same"),
    )


@query("SELECT c_custkey, 'S' || c_custkey AS symbol, c_name AS description FROM customer WHERE c_custkey % 3 < 2")
def answered_rows(spark, sf_dir):
    """TXT21: lists inside prose, and answers that are no list."""
    k = F.col("c_custkey")
    well = F.concat(F.lit("Here it is: [('S"), k, F.lit("', '"), "c_name", F.lit("'),] as asked"))
    text = F.when(k % 3 < 2, well).otherwise(F.concat(F.lit("[('S"), k))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.explode(X.answer_rows(text)).alias("r"))
    return rows.select("c_custkey", F.col("r")[0].alias("symbol"), F.col("r")[1].alias("description"))


@query(
    """WITH t AS (SELECT s_suppkey AS map_id, s_suppkey % 3 + 1 AS rows, s_suppkey % 2 + 2 AS cols FROM supplier), g AS (SELECT map_id, rows, cols, r, c, NOT (map_id % 4 = 1 AND r = 0 AND c = 1) AS have FROM t, range(4) x(r), range(4) y(c) WHERE r < rows AND c < cols)
SELECT map_id, r AS tile_row, c AS tile_col, CASE WHEN have THEN 'kept' ELSE 'missing' END AS what FROM g WHERE NOT have OR map_id % 4 <> 1"""
)
def complete_tiles(spark, sf_dir):
    """TIL3, TIL6: tiles of maps that have every tile, and the tiles that are missing."""
    k = F.col("s_suppkey")
    sheets = table(spark, sf_dir, "supplier").select(k.alias("map_id"), ((k % 3 + 1) * 1024).alias("height"), ((k % 2 + 2) * 1024 - 5).alias("width"))
    grid = T.grid_tiles(sheets, 1024)
    have = grid.filter("NOT (map_id % 4 = 1 AND tile_row = 0 AND tile_col = 1)").select("map_id", "tile_row", "tile_col")
    expected = grid.groupBy("map_id").agg(F.count("*").alias("n"))
    told = lambda df, what: df.select("map_id", "tile_row", "tile_col", F.lit(what).alias("what"))
    return told(T.complete_only(have, expected, ["map_id"]), "kept").unionByName(told(T.missing_tiles(grid, have, ["map_id"]), "missing"))


@query(
    f"""WITH {I.MASK_SQL} SELECT map_id, key, row, col, CASE WHEN map_id % 2 = 0 THEN row // 5 END AS r, CASE WHEN map_id % 2 = 0 THEN col // 5 END AS c FROM mask"""
)
def split_components(spark, sf_dir):
    """TIL8: components of every other map count as large and are cut into cells."""
    m = I.mask(spark, sf_dir).withColumn("label", F.col("map_id"))
    span = F.when(F.col("map_id") % 2 == 0, 100).otherwise(1)
    summary = m.groupBy("map_id", "key", "label").agg(F.lit(0).alias("row0"), F.lit(0).alias("col0")).withColumns({"row1": span, "col1": span})
    return T.split_large(m, summary, 50, 5).select("map_id", "key", "row", "col", F.col("part.r").alias("r"), F.col("part.c").alias("c"))


@query(
    """WITH v AS (SELECT vec_id AS id, label, ('0x' || substr(md5(vec_id || '/1'), 1, 8))::BIGINT / 4294967296.0 AS u FROM embeddings), m AS (SELECT DISTINCT label FROM embeddings),
f AS (SELECT label, ntile(3) OVER (ORDER BY md5(label || '/1')) - 1 AS fold FROM m), n AS (SELECT id, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS n FROM v)
SELECT id, u < 0.2 AS validation, CAST(fold AS INTEGER) AS fold, CAST((fold + 1) % 3 AS INTEGER) AS validation_fold, n % 4 = 0 AS fourth FROM v JOIN f USING (label) JOIN n USING (id)"""
)
def sampling_is_repeatable(spark, sf_dir):
    """SMP3, SMP4, SMP5: the split, the folds and the n-th rows themselves."""
    e = I.embeddings(spark, sf_dir).select("id", "label")
    s = V.folds(V.split_share(e, "id", 0.2), "label", 3)
    nth = V.every_nth(e, ["label"], "id", 4).select("id", F.lit(True).alias("fourth"))
    return s.join(nth, "id", "left").select("id", "validation", F.col("fold").cast("int").alias("fold"), F.col("validation_fold").cast("int").alias("validation_fold"), F.coalesce("fourth", F.lit(False)).alias("fourth"))


@query("""SELECT s_suppkey % 10 || '_' || s_suppkey AS id, array_to_string(list_sort(list_filter(list(s_suppkey % 10 || '_' || s_suppkey) OVER (PARTITION BY s_suppkey % 10), lambda x: x <> s_suppkey % 10 || '_' || s_suppkey)), ',') AS same FROM supplier""")
def same_area_groups(spark, sf_dir):
    """SMP2."""
    k = F.col("s_suppkey")
    return V.same_area(table(spark, sf_dir, "supplier").select(F.concat_ws("_", k % 10, k).alias("id"))).select("id", F.array_join("same", ",").alias("same"))


@query("SELECT round(avg((coalesce(list_position([c_custkey % 5, c_custkey % 3, 4], c_custkey % 4), 9) <= 2)::INT), 6) AS accuracy FROM customer")
def top_two_accuracy(spark, sf_dir):
    """EVL16."""
    k = F.col("c_custkey")
    ranked = table(spark, sf_dir, "customer").select(F.array(k % 5, k % 3, F.lit(4).cast("long")).alias("predictions"), (k % 4).alias("label"))
    return E.top_k_accuracy(ranked, 2).select(F.round("accuracy", 6).alias("accuracy"))


@query(
    """WITH v AS (SELECT o_custkey % 20 AS map_id, o_orderpriority AS key, o_orderkey AS row, o_custkey AS col, CASE WHEN o_custkey % 20 = 3 THEN 255 WHEN o_custkey % 20 = 4 AND o_orderkey % 2 = 0 THEN 7 WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS value FROM orders)
SELECT map_id, key, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col FROM v WHERE value > 0 AND (map_id, key) IN (SELECT (map_id, key) FROM v GROUP BY map_id, key HAVING count(DISTINCT value) > 1 AND bool_and(value IN (0, 1, 255)))"""
)
def valid_masks(spark, sf_dir):
    """EVL3: masks of one value and masks with other values than 0, 1, 255 are left out."""
    k, m = F.col("o_orderkey"), F.col("o_custkey") % 20
    value = F.when(m == 3, 255).when((m == 4) & (k % 2 == 0), 7).when(k % 3 == 0, 1).otherwise(0)
    return E.valid_mask(table(spark, sf_dir, "orders").select(m.alias("map_id"), F.col("o_orderpriority").alias("key"), k.alias("row"), F.col("o_custkey").alias("col"), value.alias("value")))
