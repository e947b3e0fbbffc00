"""Queries of the readers and writers: rows go out as files of a kind and come back.

The files are written by Spark from the given tables into the shared folder and read by
the readers; the SQL works on the tables themselves, so a round trip must lose nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapfold.functions import geometry as G
from mapfold.operators import legends as L
from mapfold.operators import pixels as P
from mapfold.plans import inputs as I
from mapfold.plans.registry import query
from mapfold.session import shared_dir, table
from mapfold.sources import readers as S
from mapfold.sources import writers as W


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def _text_files(rows: DataFrame, keys: list[str]) -> str:
    """rows (keys, json) as text, a folder for each key; gives the path."""
    path = _folder(rows.sparkSession)
    W.write_collections(rows, path, keys)
    return path


def _key(name: str = "map_id"):
    return F.regexp_extract("file", f"{name}=(\\d+)", 1).cast("long").alias(name)


@query(
    f"""WITH {I.BOXES_SQL} SELECT map_id, CAST(row_number() OVER (PARTITION BY map_id ORDER BY box_id) - 1 AS INTEGER) AS seq, 'Polygon' AS kind, name,
 xmin AS x0, ymin AS y0, xmax AS x2, ymax AS y2, 5 AS n FROM boxes"""
)
def geojson_features(spark, sf_dir):
    """SRC1, SNK1: feature collections written by map and read back."""
    rings = I.box_rings(spark, sf_dir)
    coordinates = F.array(F.transform("ring", lambda p: F.array(p["x"], p["y"])))
    maps = rings.select("map_id").distinct()
    f = rings.select("map_id", "box_id", W.feature("Polygon", coordinates, F.struct("name")).alias("feature"))
    back = S.geojson(spark, _text_files(W.feature_collections(f, maps, ["map_id"], "box_id"), ["map_id"]), "name string")
    ring = S.outer_ring(F.col("coordinates"))
    return back.select(_key(), "seq", "kind", "name", ring[0]["x"].alias("x0"), ring[0]["y"].alias("y0"), ring[2]["x"].alias("x2"), ring[2]["y"].alias("y2"), F.size(ring).alias("n"))


@query(
    f"""WITH {I.POINTS_SQL} SELECT map_id, type, x, y, round(score, 6) AS score FROM points"""
)
def patch_predictions(spark, sf_dir):
    """SRC2, TXT24, GEO1: points written as patch files named map_row_col.json and moved back by the offsets in the names."""
    at = lambda c: (F.floor(F.col(c) / 500) * 500).cast("int")
    p = I.points(spark, sf_dir).withColumns({"r": at("y"), "c": at("x")})
    one = F.struct((F.col("x") - F.col("c")).alias("x"), (F.col("y") - F.col("r")).alias("y"), F.col("score").cast("string").alias("score"), "type")
    files = p.groupBy(F.concat_ws("_", "map_id", "r", F.concat(F.col("c").cast("string"), F.lit(".json"))).alias("patch")).agg(F.to_json(F.collect_list(one)).alias("json"))
    back = S.patches(spark, _text_files(files, ["patch"]), "x double, y double, score string, type string")
    x, y = G.shift(F.col("x"), F.col("y"), F.col("patch_col"), F.col("patch_row"))
    return back.select(F.col("map_name").cast("long").alias("map_id"), "type", x.alias("x"), y.alias("y"), F.round(F.col("score").cast("double"), 6).alias("score"))


@query(f"WITH {I.BOXES_SQL} SELECT map_id, box_id, name AS text, xmin AS x0, ymin AS y0 FROM boxes")
def column_files(spark, sf_dir):
    """SRC3: tables whose columns are index -> value objects."""
    b = I.boxes(spark, sf_dir)
    by_index = lambda c: F.map_from_entries(F.collect_list(F.struct(F.col("box_id").cast("string"), c)))
    files = b.groupBy("map_id").agg(F.to_json(F.struct(by_index(F.array("xmin", "xmax")).alias("polygon_x"), by_index(F.array("ymin", "ymax")).alias("polygon_y"), by_index(F.col("name")).alias("text"))).alias("json"))
    schema = "polygon_x map<string,array<double>>, polygon_y map<string,array<double>>, text map<string,string>"
    rows = spark.read.schema(schema).json(_text_files(files, ["map_id"]), multiLine=True).withColumn("file", F.input_file_name())
    back = S.column_oriented(rows, ["polygon_x", "polygon_y", "text"], ["file"])
    return back.select(_key(), F.col("index").cast("long").alias("box_id"), "text", F.col("polygon_x")[0].alias("x0"), F.col("polygon_y")[0].alias("y0"))


@query(
    """SELECT CAST(s_suppkey AS VARCHAR) || '0' AS external_id, 'im-' || s_suppkey AS image_no, CASE WHEN s_suppkey % 2 = 0 THEN 'affine' ELSE 'tps' END AS transformation_method,
 CAST(s_suppkey % 90 AS DOUBLE) AS lon, CAST(s_suppkey % 700 AS DOUBLE) AS px, 2 AS n FROM supplier"""
)
def catalog_rows(spark, sf_dir):
    """SRC4, SRC5, SRC6, SNK5: a catalogue written as CSV with quoted ids and lists in cells."""
    k = F.col("s_suppkey")
    point = lambda a, b: F.format_string("{'location': [%d.0, 1.5], 'pixel': [%d, 7]}", a, b)
    rows = table(spark, sf_dir, "supplier").select(
        F.format_string("'%d.0'", k).alias("external_id"),
        F.concat(F.lit("im-"), k).alias("image_no"),
        F.when(k % 2 == 0, "affine").otherwise("tps").alias("transformation_method"),
        F.concat(F.lit("["), point(k % 90, k % 700), F.lit(", "), point(k % 80, k % 600), F.lit("]")).alias("gcps"),
    )
    path = _folder(spark)
    W.write_csv(rows, path)
    c = S.catalog(spark, path)
    return c.select("external_id", "image_no", "transformation_method", F.col("gcps")[0]["location"][0].alias("lon"), F.col("gcps")[0]["pixel"][0].alias("px"), F.size("gcps").alias("n"))


@query(
    f"""WITH {I.BOXES_SQL}, c AS (SELECT *, CASE box_id % 3 WHEN 0 THEN 'map' WHEN 1 THEN 'legend_polygons' ELSE 'legend_points_lines' END AS class_label FROM boxes)
SELECT map_id, class_label, count(*) AS n, arg_max(xmin, box_id) AS xmin, arg_max(ymax, box_id) AS ymax FROM c GROUP BY ALL"""
)
def layout_segments(spark, sf_dir):
    """SRC7: layout files; segments of each class and the box of the last one."""
    b = I.boxes(spark, sf_dir)
    names = F.element_at(F.array(F.lit("map"), F.lit("legend_polygons"), F.lit("legend_points_lines")), (F.col("box_id") % 3 + 1).cast("int"))
    one = F.struct("box_id", names.alias("class_label"), F.array("xmin", "ymin", "xmax", "ymax").alias("bbox"))
    files = b.groupBy("map_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(one)).alias("segments"))).alias("json"))
    segments = S.layout(spark, _text_files(files, ["map_id"])).withColumn("file", F.regexp_extract("file", r"map_id=(\d+)", 1))
    n = segments.groupBy("file", "class_label").agg(F.count("*").alias("n"))
    last = S.last_of_class(segments, ["map", "legend_polygons", "legend_points_lines"])
    last = last.unpivot("file", ["map", "legend_polygons", "legend_points_lines"], "class_label", "box").filter("box IS NOT NULL")
    return n.join(last, ["file", "class_label"]).select(F.col("file").cast("long").alias("map_id"), "class_label", "n", "box.xmin", "box.ymax")


@query(
    f"""WITH {I.BOXES_SQL} SELECT map_id, 'map ' || map_id || '.tif' AS file_name, CAST(box_id % 4 AS INTEGER) AS category_id, xmin, ymin, xmax, ymax, 4 AS corners, xmax AS x1, ymin AS y1 FROM boxes WHERE box_id % 4 <> 2"""
)
def coco_annotations(spark, sf_dir):
    """SRC8, SRC9: annotation files with encoded image names, one category left out, flat coordinate lists as rings."""
    b = I.boxes(spark, sf_dir)
    image = F.struct(F.col("map_id").cast("int").alias("id"), F.concat(F.lit("map%20"), "map_id", F.lit(".tif")).alias("file_name"), F.lit(9).alias("height"), F.lit(8).alias("width"))
    note = F.struct(
        F.col("map_id").cast("int").alias("image_id"),
        (F.col("box_id") % 4).cast("int").alias("category_id"),
        F.array(F.col("xmin"), F.col("ymin"), F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")).alias("bbox"),
        F.array(F.array("xmin", "ymin", "xmax", "ymin", "xmax", "ymax", "xmin", "ymax")).alias("segmentation"),
    )
    files = b.groupBy("map_id").agg(F.to_json(F.struct(F.collect_set(image).alias("images"), F.collect_list(note).alias("annotations"))).alias("json"))
    c = S.coco(spark, _text_files(files, ["map_id"]))
    ring = F.col("ring")
    return c.select(F.regexp_extract("file_name", r"(\d+)", 1).cast("long").alias("map_id"), "file_name", "category_id", "box.*", F.size(ring).alias("corners"), ring[1]["x"].alias("x1"), ring[1]["y"].alias("y1"))


@query(
    f"""WITH {I.BOXES_SQL}, s AS (SELECT map_id, name || CASE WHEN box_id % 3 = 0 THEN '_line' ELSE '_poly' END AS label, xmin, ymin, xmax, ymax FROM boxes)
SELECT map_id, label, min((xmin, ymin, xmax, ymax)).xmin AS xmin, coalesce(nullif(CASE WHEN length(label) % 2 = 0 THEN '' ELSE label END, ''), 'id') || '_poly' AS told
FROM (SELECT map_id, label, {{'xmin': xmin, 'ymin': ymin, 'xmax': xmax, 'ymax': ymax}} AS b, xmin, ymin, xmax, ymax FROM s WHERE label LIKE '%\\_poly' ESCAPE '\\') GROUP BY map_id, label""".replace("min((xmin, ymin, xmax, ymax)).xmin", "min(b).xmin")
)
def legend_labels(spark, sf_dir):
    """SRC10, SRC11: distinct polygon labels with a box; labels from abbreviations or ids."""
    b = I.boxes(spark, sf_dir)
    label = F.concat("name", F.when(F.col("box_id") % 3 == 0, "_line").otherwise("_poly"))
    shapes = b.groupBy("map_id").agg(F.collect_list(F.struct(label.alias("label"), F.array(F.array("xmin", "ymin"), F.array("xmax", "ymax")).alias("points"))).alias("shapes"))
    found = S.polygon_labels(shapes)
    return found.select("map_id", "label", "box.xmin", S.legend_label(F.when(F.length("label") % 2 == 0, "").otherwise(F.col("label")), F.lit("id")).alias("told"))


@query(
    """WITH r AS (SELECT o_custkey AS way_id, o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders), l AS (SELECT * FROM r WHERE b IS NOT NULL)
SELECT w.way_id, w.a, w.b, round(x.o_orderkey / 1000.0, 6) AS lat FROM (SELECT * FROM l UNION ALL SELECT way_id, b, a FROM l) w JOIN orders x ON x.o_orderkey = w.a"""
)
def osm_links(spark, sf_dir):
    """SRC12: extracts of a hundred ways each as XML, links in both directions with the place of their start."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", k, F.floor(F.col("o_custkey") / 100).alias("extract"))
    node = F.format_string('<node id="%d" lat="%s" lon="%s"/>', k, (k / 1000.0).cast("string"), (k / 500.0).cast("string"))
    refs = F.array_join(F.transform(F.array_sort(F.collect_list(k)), lambda x: F.concat(F.lit('<nd ref="'), x, F.lit('"/>'))), "")
    one = F.concat(F.array_join(F.collect_list(node), ""), F.lit('<way id="'), F.col("o_custkey"), F.lit('">'), refs, F.lit("</way>"))
    ways = o.groupBy("extract", "o_custkey").agg(one.alias("way"))
    files = ways.groupBy("extract").agg(F.concat(F.lit("<osm>"), F.array_join(F.collect_list("way"), ""), F.lit("</osm>")).alias("json"))
    path = _text_files(files, ["extract"])
    nodes, links = S.osm(spark, path)
    return links.join(nodes.select(F.col("id").alias("a"), "lat"), "a").select("way_id", "a", "b", F.round("lat", 6).alias("lat"))


@query("SELECT n_regionkey AS map_id, list(CAST(n_nationkey AS DOUBLE) ORDER BY n_nationkey) AS x, list(CAST(n_nationkey * 2 AS DOUBLE) ORDER BY n_nationkey) AS y FROM nation GROUP BY 1")
def aux_points(spark, sf_dir):
    """SRC13: flat lists of target points in XML, even and odd places."""
    n = table(spark, sf_dir, "nation")
    pairs = F.array_sort(F.collect_list(F.struct("n_nationkey", (F.col("n_nationkey") * 2).alias("y"))))
    tags = F.array_join(F.transform(pairs, lambda p: F.concat(F.lit("<Double>"), p["n_nationkey"], F.lit("</Double><Double>"), p["y"], F.lit("</Double>"))), "")
    files = n.groupBy(F.col("n_regionkey").cast("long").alias("map_id")).agg(F.concat(F.lit("<TargetGCPs>"), tags, F.lit("</TargetGCPs>")).alias("json"))
    return S.aux_control_points(spark, _text_files(files, ["map_id"]), "TargetGCPs", "Double").select(_key(), "x", "y")


@query("SELECT c_name AS text, CAST(c_custkey % 10 AS DOUBLE) AS score, CAST(c_custkey % 90 AS DOUBLE) AS lat, CAST(c_custkey % 180 AS DOUBLE) AS lng FROM customer WHERE c_custkey % 5 NOT IN (1, 3)")
def geocoder_answers(spark, sf_dir):
    """SRC14: JSON lines; answers without a place are left out."""
    k = F.col("c_custkey")
    place = F.when(k % 5 != 1, F.struct(F.when(k % 5 != 3, (k % 90).cast("double")).alias("lat"), (k % 180).cast("double").alias("lng")))
    rows = table(spark, sf_dir, "customer").select(F.to_json(F.struct(F.col("c_name").alias("text"), (k % 10).cast("double").alias("score"), F.lit("POINT").alias("geometry"), place.alias("geocoding"))).alias("value"))
    path = _folder(spark)
    rows.write.text(path)
    return S.geocoded(spark, path).select("text", "score", "lat", "lng")


@query(f"WITH {I.BOXES_SQL} SELECT map_id, 4 AS n, xmin AS x0, ymax AS y3, box_id / 1000.0 AS confidence, name AS transcription FROM boxes")
def evaluation_lines(spark, sf_dir):
    """SRC18: lines x1,y1,..,confidence,####text."""
    b = I.boxes(spark, sf_dir)
    numbers = F.concat_ws(",", *[F.col(c).cast("string") for c in ("xmin", "ymin", "xmax", "ymin", "xmax", "ymax", "xmin", "ymax")], (F.col("box_id") / 1000.0).cast("string"))
    files = b.select("map_id", F.concat(numbers, F.lit(",####"), "name").alias("json"))
    back = S.evaluation_lines(spark, _text_files(files, ["map_id"]), with_confidence=True)
    return back.select(_key(), F.size("ring").alias("n"), F.col("ring")[0]["x"].alias("x0"), F.col("ring")[3]["y"].alias("y3"), "confidence", "transcription")


@query(
    f"""WITH {I.COLORS_SQL}, s AS (SELECT key, map_id, CAST(sum(r) AS DOUBLE) AS r, CAST(sum(g) AS DOUBLE) AS g, CAST(sum(b) AS DOUBLE) AS b FROM pixels GROUP BY ALL)
SELECT p.map_id, p.key, count(*) AS n, s.r AS first, s.g + s.b AS second FROM pixels p JOIN s ON s.key = p.key AND s.map_id = p.map_id GROUP BY ALL"""
)
def tile_statistics(spark, sf_dir):
    """SRC19, JN27: a statistics table by key as CSV, met by the tiles of the same key."""
    px = I.pixels(spark, sf_dir)
    s = px.groupBy("map_id", "key").agg(*[F.sum(c).cast("double").alias(c) for c in "rgb"]).select(F.concat_ws("/", "map_id", "key").alias("key"), "r", "g", "b")
    path = _folder(spark)
    W.write_csv(s, path)
    stats = S.key_statistics(spark, path, 1, 2)
    tiles = px.select("map_id", "key", F.concat_ws("/", "map_id", "key").alias("name"))
    met = L.with_statistics(tiles, stats, "name")
    return met.groupBy("map_id", "key", "first", "second").agg(F.count("*").alias("n")).select("map_id", "key", "n", F.col("first")[0].alias("first"), (F.col("second")[0] + F.col("second")[1]).alias("second"))


@query(f"WITH {I.BOXES_SQL} SELECT map_id, CAST(row_number() OVER (PARTITION BY map_id ORDER BY name, xmin, ymin, box_id) AS INTEGER) AS ID, name, 'line' AS type, CAST(NULL AS VARCHAR) AS dash, name AS symbol FROM (SELECT * FROM boxes WHERE xmin > 0)")
def line_file_fields(spark, sf_dir):
    """SNK7."""
    b = I.boxes(spark, sf_dir).filter("xmin > 0")
    line = F.array(G.point(F.col("xmin"), F.col("ymin")), G.point(F.col("box_id"), F.lit(0.0)))
    return W.line_fields(b.select("map_id", "name", F.col("name").alias("symbol"), line.alias("geom"))).select("map_id", "ID", "name", "type", "dash", "symbol")


@query(f'WITH {I.POINTS_SQL} SELECT DISTINCT map_id, type AS "key", CAST(y AS INTEGER) AS row, CAST(x AS INTEGER) AS col FROM points')
def burned_points(spark, sf_dir):
    """SNK9."""
    return P.points_mask(I.points(spark, sf_dir))


@query(
    """WITH p AS (SELECT o_custkey % 7 AS geo_id, o_orderkey % 5 AS topo_id, o_orderkey % 300 AS gx, o_custkey AS gy, o_orderkey % 200 AS tx, o_orderkey AS ty FROM orders)
SELECT geo_id, topo_id, '[' || string_agg('{"geomap":[' || gx || ',' || gy || '],"topomap":[' || tx || ',' || ty || ']}', ',' ORDER BY gx, gy, tx, ty) || ']' AS json FROM p GROUP BY 1, 2"""
)
def keypoint_files(spark, sf_dir):
    """SNK11."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return W.keypoint_pairs(table(spark, sf_dir, "orders").select((c % 7).alias("geo_id"), (k % 5).alias("topo_id"), (k % 300).alias("gx"), c.alias("gy"), (k % 200).alias("tx"), k.alias("ty")))


@query(
    f"""WITH {I.BOXES_SQL} SELECT map_id, name AS abbr, 'polygon_feature_' || name || '_instance_' || row_number() OVER (PARTITION BY map_id, name ORDER BY box_id) AS id, xmin AS x0, nullif(CASE WHEN box_id % 2 = 0 THEN '' ELSE 'tuff' END, '') AS description FROM boxes"""
)
def nested_records(spark, sf_dir):
    """SNK12, GEO32, GEO16: records nested by map and key, unnested again."""
    r = I.box_rings(spark, sf_dir).select("map_id", F.col("name").alias("abbr"), F.col("box_id").alias("seq"), F.col("ring").alias("geom"), F.when(F.col("box_id") % 2 == 0, "").otherwise("tuff").alias("description"))
    n = W.nested_polygons(r, "abbr")
    return n.select("map_id", "abbr", F.inline("polygon_features")).select("map_id", "abbr", "id", F.col("polygon_geometry")[0]["x"].alias("x0"), "description")


@query(
    f"""WITH {I.BOXES_SQL}, s AS (SELECT map_id, box_id || CASE WHEN box_id % 3 = 0 THEN '_poly' ELSE '_ptln' END AS label, '[[' || xmin || ',' || ymin || '],[' || xmax || ',' || ymax || ']]' AS points FROM boxes)
SELECT map_id, '{{"shapes":[' || string_agg('{{"label":"' || label || '","points":' || points || '}}', ',' ORDER BY label) || ']}}' AS json FROM s GROUP BY 1"""
)
def competition_legends(spark, sf_dir):
    """SNK13."""
    b = I.boxes(spark, sf_dir)
    return W.competition_legend(b.select("map_id", F.col("box_id").alias("id"), F.when(F.col("box_id") % 3 == 0, "polygon").otherwise("point").alias("kind"), "box"))


@query(
    f"""WITH {I.BOXES_SQL}, k AS (SELECT DISTINCT map_id, t.kind FROM boxes, (VALUES ('line'), ('point'), ('polygon')) t(kind))
SELECT k.map_id, k.kind AS feature_type, b.box_id, b.name AS description FROM k JOIN boxes b ON b.map_id = k.map_id AND k.kind = CASE b.box_id % 3 WHEN 0 THEN 'line' WHEN 1 THEN 'point' ELSE 'polygon' END"""
)
def description_files(spark, sf_dir):
    """SNK14, FLT8, D11: entries keyed by box for three feature types, read back without the keys that are no box."""
    b = I.boxes(spark, sf_dir)
    kind = F.element_at(F.array(F.lit("line"), F.lit("point"), F.lit("polygon")), (F.col("box_id") % 3 + 1).cast("int"))
    # the box id in the first corner keeps the keys of a map apart
    box = F.struct(F.col("box_id").cast("double").alias("xmin"), "ymin", "xmax", "ymax")
    items = b.select("map_id", kind.alias("feature_type"), box.alias("box"), F.col("name").alias("description"), "name")
    layout = b.groupBy("map_id").agg(F.min("box").alias("map_content_box"), F.max("box").alias("poly_box"), F.max("box").alias("ptln_box"))
    out = W.description_records(items, layout)
    entries = out.select("map_id", "feature_type", F.explode(F.from_json("json", "map<string,string>")).alias("key", "value"))
    data = L.data_keys(entries)
    numbers = F.from_json("key", "array<double>")
    return data.select("map_id", "feature_type", numbers[0].cast("long").alias("box_id"), F.get_json_object("value", "$.description").alias("description"))


def _delivery(spark, sf_dir, chosen="true", known=None):
    """The delivery tables of the maps with control points that are chosen."""
    from mapfold.plans import map_pipelines as MP

    gcps = I.gcps(spark, sf_dir).filter(chosen)
    maps = gcps.select("map_id").distinct()
    rings = I.box_rings(spark, sf_dir).join(maps, "map_id", "left_semi")
    none = lambda *cs: [F.lit(None).cast("string").alias(c) for c in cs]
    ages = [F.lit(None).cast("double").alias(c) for c in ("b_age", "t_age")]
    unknown = none("color", "pattern", "abbreviation", "description", "category", "unit_name", "unit_age")
    polygons = rings.select("map_id", "name", *unknown, *ages, F.col("ring").alias("geom"))
    points = I.points(spark, sf_dir).join(maps, "map_id", "left_semi").select("map_id", "type", *none("description"), "x", "y", F.lit(None).cast("double").alias("dip"))
    lines = rings.select("map_id", F.concat("name", F.lit("_line")).alias("name"), *none("description", "dash", "symbol"), F.col("ring").alias("geom"))
    return MP.delivery(maps, gcps, polygons, points, lines, known=known)


def _row_counts(tables):
    out = None
    for name, df in sorted(tables.items()):
        one = df.groupBy("map_id").agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), F.col("map_id").cast("long").alias("map_id"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


_DELIVERED_SQL = """WITH g AS (SELECT DISTINCT n_regionkey AS map_id FROM nation), p AS (SELECT p_partkey % 20 AS map_id, p_partkey AS id, p_name AS name FROM part WHERE p_partkey % 20 IN (SELECT map_id FROM g)),
pt AS (SELECT DISTINCT l_orderkey % 20 AS map_id, l_returnflag AS type, l_partkey % 1000 AS x, (l_suppkey * 7 + l_linenumber * 131) % 1000 AS y FROM lineitem WHERE l_orderkey % 20 IN (SELECT map_id FROM g)),
u AS (SELECT 'map' AS t, map_id FROM g UNION ALL SELECT 'georeference_meta', map_id FROM g UNION ALL SELECT 'ground_control_point', n_regionkey FROM nation
 UNION ALL SELECT 'polygon_type', map_id FROM (SELECT DISTINCT map_id, name FROM p) UNION ALL SELECT 'geologic_unit', map_id FROM (SELECT DISTINCT map_id FROM p)
 UNION ALL SELECT 'polygon_feature', map_id FROM p UNION ALL SELECT 'point_type', map_id FROM (SELECT DISTINCT map_id, type FROM pt) UNION ALL SELECT 'point_feature', map_id FROM pt
 UNION ALL SELECT 'line_type', map_id FROM (SELECT DISTINCT map_id, name FROM p) UNION ALL SELECT 'line_feature', map_id FROM p)
SELECT t AS "table", CAST(map_id AS BIGINT) AS map_id, count(*) AS rows FROM u GROUP BY 1, 2"""


@query(_DELIVERED_SQL)
def delivery_row_counts(spark, sf_dir):
    """SNK3, SNK4, KEY1-KEY3, REF2: rows of each delivery table of every map with control points."""
    return _row_counts(_delivery(spark, sf_dir))


@query(_DELIVERED_SQL)
def delivered_map_by_map(spark, sf_dir):
    """SNK3, SNK4, KEY1-KEY3: what is read back when two deliveries hold all maps and one map comes a second time."""
    path = _folder(spark)
    for chosen in ("map_id < 2", "map_id >= 2", "map_id = 1"):
        W.write_delivery(_delivery(spark, sf_dir, chosen, W.read_delivery(spark, path)), path)
    return _row_counts(W.read_delivery(spark, path))
