"""Queries of georeferencing, embeddings, tiles, legends, evaluation, sinks and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from mapfold.functions import geometry as G
from mapfold.operators import evaluate as E
from mapfold.operators import georef as R
from mapfold.operators import legends as L
from mapfold.operators import tiles as T
from mapfold.operators import vector_lists as VL
from mapfold.operators import vectors as V
from mapfold.plans import inputs as I
from mapfold.plans.registry import query
from mapfold.session import shared_dir, table
from mapfold.sources import writers as S
from mapfold.streaming import ingest


@query(
    f"""WITH {I.GCPS_SQL} SELECT map_id, round(CAST(0.001 AS DOUBLE), 6) AS a, round(CAST(0.0002 AS DOUBLE), 6) AS b, round(CAST(-120.0 + map_id AS DOUBLE), 4) AS c, round(CAST(0.0001 AS DOUBLE), 6) AS d, round(CAST(-0.0008 AS DOUBLE), 6) AS e, round(CAST(45.0 - map_id AS DOUBLE), 4) AS f FROM gcps GROUP BY map_id"""
)
def affine_coefficients(spark, sf_dir):
    """REF1: the control points follow an affine law, which the fit must give back."""
    c = R.affine_from_gcps(I.gcps(spark, sf_dir), use_all=True)
    return c.select("map_id", *[F.round(k, 4 if k in "cf" else 6).alias(k) for k in "abcdef"])


@query(
    f"""WITH {I.POINTS_SQL} SELECT map_id, point_id, round(-120.0 + map_id + x * 0.001 + y * 0.0002, 6) AS lon, round(45.0 - map_id - y * 0.0008 + x * 0.0001, 6) AS lat FROM points WHERE map_id < 5"""
)
def warped_points(spark, sf_dir):
    """REF3, GEO11."""
    g = I.gcps(spark, sf_dir).withColumn("transformation_method", F.lit("affine"))
    return R.warp(I.points(spark, sf_dir), g).select("map_id", "point_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query(
    """WITH c AS (SELECT c_custkey AS map_id, unnest([{'row': 10 + c_custkey % 7, 'col': 5 + c_custkey % 3}, {'row': 11 + c_custkey % 5, 'col': 900 + c_custkey % 3}, {'row': 700 + c_custkey % 11, 'col': 905 - c_custkey % 2}, {'row': 705, 'col': 3 + c_custkey % 4}]) AS p FROM customer)
SELECT map_id, arg_min(p.row * 10000 + p.col, p.row + p.col) AS tl, arg_max(p.row * 10000 + p.col, p.col - p.row) AS tr, arg_max(p.row * 10000 + p.col, p.row + p.col) AS br, arg_min(p.row * 10000 + p.col, p.col - p.row) AS bl FROM c GROUP BY 1"""
)
def corner_order(spark, sf_dir):
    """GEO17."""
    k = F.col("c_custkey")
    p = lambda r, c: F.struct(r.cast("long").alias("row"), c.cast("long").alias("col"))
    four = F.array(p(10 + k % 7, 5 + k % 3), p(11 + k % 5, 900 + k % 3), p(700 + k % 11, 905 - k % 2), p(F.lit(705), 3 + k % 4))
    c = R.ordered_corners(table(spark, sf_dir, "customer").select(k.alias("map_id"), F.inline(four)))
    code = lambda n: F.col(n)["row"] * 10000 + F.col(n)["col"]
    return c.select("map_id", code("top_left").alias("tl"), code("top_right").alias("tr"), code("bottom_right").alias("br"), code("bottom_left").alias("bl"))


@query()
def map_centers(spark, sf_dir):
    """REF7: places are orders on a fine grid; held against brute force in the tests."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    places = table(spark, sf_dir, "orders").select((c % 50).alias("map_id"), k.alias("seq"), (40 + (k * 7 % 400) / 1000.0).alias("lat"), (-100 + (k * 13 % 300) / 1000.0).alias("lng"))
    return R.map_center(places).select("map_id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query(
    """SELECT vec_id % 10 AS geo_id, arg_max(topo, (sim, -topo)) AS topo_id FROM (SELECT vec_id % 10 AS vec_id, label AS topo, round(sum(embedding[1]), 6) AS sim FROM embeddings GROUP BY 1, 2) GROUP BY 1"""
)
def best_base_maps(spark, sf_dir):
    """REF8, WIN3."""
    s = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 10).alias("geo_id"), F.col("label").alias("topo_id"), F.col("embedding")[0].cast("double").alias("sim"))
    t = s.groupBy("geo_id", "topo_id").agg(F.round(F.sum("sim"), 6).alias("sim"))
    return R.best_base_map(t).select("geo_id", "topo_id")


_NEAREST_SQL = """WITH q AS (SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT query_id, vec_id AS id, round(sqrt(list_sum(list_transform(list_zip(a, embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))), 6) AS distance FROM q, embeddings WHERE vec_id <> query_id)
SELECT query_id, id, distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM p) WHERE rank <= 5"""


@query(_NEAREST_SQL)
def nearest_vectors(spark, sf_dir):
    """VEC1: every 50th vector against all."""
    e = I.embeddings(spark, sf_dir)
    n = V.nearest(e.filter("id % 50 = 0"), e, 8)
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return n.withColumn("distance", F.round("distance", 6)).withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select("query_id", "id", "distance", "rank")


@query(_NEAREST_SQL)
def nearest_vectors_by_lists(spark, sf_dir):
    """VEC1: the same through inverted lists."""
    e = I.embeddings(spark, sf_dir)
    n = VL.nearest_by_lists(e.filter("id % 50 = 0"), e, 8)
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return n.withColumn("distance", F.round("distance", 6)).withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select("query_id", "id", "distance", "rank")


@query(
    """WITH q AS (SELECT vec_id AS query_id, label AS ql, embedding AS a FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT query_id, vec_id AS id, label = ql AS same, sqrt(list_sum(list_transform(list_zip(a, embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) AS d FROM q, embeddings WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS n FROM p), h AS (SELECT query_id, bool_or(same) AS paired, bool_or(same AND n <= 5) AS hit FROM r GROUP BY 1)
SELECT count_if(hit) AS hits, count(*) AS queries, round(count_if(hit) / count(*), 6) AS rate FROM h WHERE paired"""
)
def vector_hit_rate(spark, sf_dir):
    """VEC2: positives are vectors of the same label."""
    e = I.embeddings(spark, sf_dir)
    q = e.filter("id % 50 = 0")
    found = V.nearest(q, e, 5)
    # only found rows are held against their query's label; that a query has positives at all, the count of its label tells
    own = q.select(F.col("id").alias("query_id"), "label")
    hits = found.join(own, "query_id").join(e.select("id", "label"), ["id", "label"], "left_semi").select("query_id", "id")
    paired = own.join(e.groupBy("label").agg(F.count("*").alias("n")).filter("n > 1"), "label", "left_semi").select("query_id", F.lit(None).cast("long").alias("id"))
    return V.hit_rate(found, hits.unionByName(paired)).withColumn("rate", F.round("rate", 6))


@query(
    """WITH e AS (SELECT vec_id AS i, embedding::DOUBLE[] AS v, vec_id % 16 // 2 AS block, abs(embedding[1]) AS s FROM embeddings), p AS (SELECT a.block, a.i AS a, b.i AS b, a.s AS sa, b.s AS sb, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS sim FROM e a JOIN e b ON a.block = b.block WHERE a.i % 2 = 0 AND b.i % 2 = 1),
x AS (SELECT *, row_number() OVER (PARTITION BY block, a ORDER BY sim DESC, b) AS m, row_number() OVER (PARTITION BY block, b ORDER BY sim DESC, a) AS n FROM p) SELECT block, a, b, round(sim, 6) AS sim FROM x WHERE m = 1 AND n = 1 AND sa > 0.01 AND sb > 0.01"""
)
def mutual_nearest_vectors(spark, sf_dir):
    """VEC3, VEC4: patches of two halves of each block of ten labels."""
    e = I.embeddings(spark, sf_dir).select(F.col("id").alias("patch_idx"), "vec", (F.col("id") % 16).alias("block"), F.abs(F.col("vec")[0]).cast("double").alias("saliency"))
    return V.mutual_nearest(e.filter("patch_idx % 2 = 0").withColumn("block", F.floor(F.col("block") / 2)), e.filter("patch_idx % 2 = 1").withColumn("block", F.floor(F.col("block") / 2)), ["block"], 0.01).select("block", "a", "b", F.round("sim", 6).alias("sim"))


@query(
    f"""WITH {I.SHEETS_SQL}, n AS (SELECT *, greatest(height // 200, 1) AS nr, greatest(width // 200, 1) AS nc FROM sheets)
SELECT map_id, tile_row, tile_col, CAST(trunc(5 + CASE WHEN nr > 1 THEN tile_row * (height - 10 - 256) / (nr - 1) ELSE 0 END) AS INTEGER) AS y0, CAST(trunc(5 + CASE WHEN nc > 1 THEN tile_col * (width - 10 - 256) / (nc - 1) ELSE 0 END) AS INTEGER) AS x0
FROM (SELECT *, unnest(range(nr)) AS tile_row FROM n), LATERAL (SELECT unnest(range(nc)) AS tile_col)"""
)
def even_tiles(spark, sf_dir):
    """TIL1."""
    return T.even_tiles(I.sheets(spark, sf_dir), 256, 200).select("map_id", "tile_row", "tile_col", "y0", "x0")


@query(
    f"""WITH {I.SHEETS_SQL} SELECT map_id, tile_row, tile_col, least(1000, width - tile_col * 1000) AS w, least(1000, height - tile_row * 1000) AS h, 'http://x/' || map_id || '/' || tile_col * 1000 || ',' || tile_row * 1000 AS url
FROM (SELECT *, unnest(range(CAST(ceil(height / 1000) AS BIGINT))) AS tile_row FROM sheets), LATERAL (SELECT unnest(range(CAST(ceil(width / 1000) AS BIGINT))) AS tile_col)"""
)
def clipped_tiles(spark, sf_dir):
    """TIL2, TIL4, TIL5."""
    return T.clipped_tiles(I.sheets(spark, sf_dir), 1000, "http://x/{map_id}/{x0},{y0}").select("map_id", "tile_row", "tile_col", F.col("w").cast("long").alias("w"), F.col("h").cast("long").alias("h"), "url")


@query(f"WITH {I.SHEETS_SQL} SELECT map_id, CAST(sum(ceil(height / 2048) * ceil(width / 2048)) AS BIGINT) AS n FROM sheets GROUP BY ROLLUP (map_id)")
def tile_counts(spark, sf_dir):
    """AGG17."""
    return T.tile_counts(I.sheets(spark, sf_dir)).select("map_id", F.col("n").cast("long").alias("n"))


@query(
    f"""WITH {I.BOXES_SQL}, g AS (SELECT map_id, box_id, CASE WHEN xmin - lag(xmin) OVER (PARTITION BY map_id ORDER BY xmin, box_id) > 5 THEN 1 ELSE 0 END AS new, xmin FROM boxes)
SELECT map_id, box_id, CAST(sum(new) OVER (PARTITION BY map_id ORDER BY xmin, box_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "column" FROM g"""
)
def box_columns(spark, sf_dir):
    """WIN7."""
    b = I.boxes(spark, sf_dir).select("map_id", "box_id", F.col("xmin").alias("x"))
    return L.columns_by_gap(b, 5.0).select("map_id", "box_id", "column")


@query(
    f"""WITH {I.BOXES_SQL} SELECT map_id, box_id, least(ymax + 100, coalesce(lead(ymin) OVER (PARTITION BY map_id, box_id % 3 ORDER BY ymin, ymax, box_id), ymax + 100), 950) AS "limit" FROM boxes"""
)
def crop_limits(spark, sf_dir):
    """WIN5."""
    b = I.boxes(spark, sf_dir).select("map_id", "box_id", (F.col("box_id") % 3).alias("column"), F.col("ymin").alias("y1"), F.col("ymax").alias("y2"))
    sheet = b.select("map_id").distinct().withColumn("height", F.lit(950.0))
    return L.row_limits(b, sheet).select("map_id", "box_id", "limit")


@query(f"WITH {I.BOXES_SQL} SELECT map_id, round(least(quantile_cont(ymax - ymin, 0.5), avg(ymax - ymin)) * 0.8, 6) AS threshold FROM boxes WHERE (xmax - xmin) * (ymax - ymin) <= 0.8 * 1000 GROUP BY 1")
def height_thresholds(spark, sf_dir):
    """AGG3, FLT4."""
    b = I.boxes(spark, sf_dir)
    sheet = b.select("map_id").distinct().select("map_id", F.lit(10).alias("height"), F.lit(100).alias("width"))
    return L.height_threshold(b.select("map_id", "box"), sheet).withColumn("threshold", F.round("threshold", 6))


@query(
    f"""WITH {I.BOXES_SQL}, a AS (SELECT map_id, box_id, (xmax - xmin) * (ymax - ymin) AS area FROM boxes), d AS (SELECT *, area - coalesce(lead(area) OVER (PARTITION BY map_id ORDER BY area DESC, box_id), 0) AS dr FROM a)
SELECT map_id, arg_max(box_id, (dr, area, -box_id)) AS region_id FROM d GROUP BY 1"""
)
def region_before_drop(spark, sf_dir):
    """WIN9."""
    return L.area_before_drop(I.boxes(spark, sf_dir).select("map_id", F.col("box_id").alias("region_id"), G.box_area(F.col("box")).alias("area")))


@query(f"WITH {I.POINTS_SQL} SELECT map_id, type, point_id, CAST(row_number() OVER (PARTITION BY map_id, type ORDER BY point_id) - 1 AS INTEGER) AS feature_id FROM points")
def serial_ids(spark, sf_dir):
    """AGG1, WIN4."""
    return L.numbered(I.points(spark, sf_dir), ["map_id", "type"], ["point_id"]).select("map_id", "type", "point_id", "feature_id")


@query("SELECT conv_id AS map_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY 1")
def map_texts(spark, sf_dir):
    """AGG2."""
    return L.all_text(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("map_id"), F.col("turn").alias("seq"), "text"))


@query(
    """WITH s AS (SELECT source, doc_id, quality, n_chars FROM documents JOIN labels USING (doc_id)), r AS (SELECT *, row_number() OVER w AS rank, sum(quality) OVER (w ROWS UNBOUNDED PRECEDING) AS hits FROM s WINDOW w AS (PARTITION BY source ORDER BY n_chars DESC, doc_id))
SELECT source, round(avg(CASE WHEN quality = 1 THEN hits / rank END), 6) AS ap, CAST(sum(quality) AS BIGINT) AS hits, count(*) AS n FROM r GROUP BY 1"""
)
def ranked_average_precision(spark, sf_dir):
    """WIN14, WIN11."""
    s = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("hit", F.col("quality") == 1)
    return E.ranked_ap(s, ["source"], "n_chars", "hit", "doc_id").withColumn("ap", F.round("ap", 6))


@query()
def detection_precision(spark, sf_dir):
    """EVL4, WIN11, WIN12, WIN15: legend boxes against themselves shifted."""
    b = I.boxes(spark, sf_dir).withColumn("class", F.col("box_id") % 3)
    det = b.filter("xmax > xmin").select(F.col("map_id").alias("image_id"), "class", "box_id", F.lit(True).alias("is_det"), (F.col("box_id") * 37 % 101 / 101.0).alias("score"), F.lit(False).alias("ignore"), *[(F.col(c) + F.col("box_id") % 4).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])
    gt = b.filter("xmax > xmin").select(F.col("map_id").alias("image_id"), "class", "box_id", F.lit(False).alias("is_det"), F.lit(0.0).alias("score"), (F.col("box_id") % 11 == 0).alias("ignore"), "xmin", "ymin", "xmax", "ymax")
    return E.average_precision(E.detection_curve(det.unionByName(gt), (0.5, 0.75))).select("class", "iou", F.round("ap", 6).alias("ap"), F.round("ar", 6).alias("ar"))


@query(
    f"""WITH RECURSIVE {I.BOXES_SQL}, p AS (SELECT a.map_id, a.box_id AS a, b.box_id AS b, greatest(0, least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * greatest(0, least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)) AS i, (a.xmax - a.xmin) * (a.ymax - a.ymin) + (b.xmax - b.xmin) * (b.ymax - b.ymin) AS s
 FROM boxes a JOIN boxes b ON a.map_id = b.map_id AND a.box_id <> b.box_id AND a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax), l AS (SELECT map_id, a, b FROM p WHERE s > i AND i / (s - i) > 0.2),
reach AS (SELECT map_id, box_id AS a, box_id AS b FROM boxes UNION SELECT r.map_id, r.a, l.b FROM reach r JOIN l ON l.map_id = r.map_id AND l.a = r.b), g AS (SELECT map_id, a AS box_id, min(b) AS g FROM reach GROUP BY 1, 2)
SELECT map_id, g AS "group", min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax, count(*) AS n FROM boxes JOIN g USING (map_id, box_id) GROUP BY 1, 2"""
)
def merged_legend_boxes(spark, sf_dir):
    """EVL13."""
    return E.merged_boxes(I.boxes(spark, sf_dir).select("map_id", "box_id", "box"))


@query(
    f"""WITH {I.BOXES_SQL}, t AS (SELECT DISTINCT map_id, name FROM boxes), d AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY name) AS type_id FROM t)
SELECT b.map_id, box_id, CAST(type_id AS INTEGER) AS type_id FROM boxes b JOIN d ON d.map_id = b.map_id AND d.name = b.name"""
)
def surrogate_type_keys(spark, sf_dir):
    """KEY1-KEY3."""
    return S.surrogate_keys(I.boxes(spark, sf_dir).select("map_id", "box_id", "name"), ["name"], "type_id")[1].select("map_id", "box_id", "type_id")


@query(
    f"""WITH {I.BOXES_SQL} SELECT box_id AS label_id, '{{"@context":"http://www.w3.org/ns/anno.jsonld","id":"#' || box_id || '","type":"Annotation","body":[{{"type":"TextualBody","purpose":"transcribing","value":"' || name || '"}}],"target":{{"selector":{{"type":"SvgSelector","value":"<svg><polygon points=\\"' ||
 xmin || ',' || ymin || ' ' || xmax || ',' || ymin || ' ' || xmax || ',' || ymax || ' ' || xmin || ',' || ymax || ' ' || xmin || ',' || ymin || '\\"></polygon></svg>"}}}}}}' AS json FROM boxes"""
)
def annotation_json(spark, sf_dir):
    """SNK6."""
    return S.web_annotations(I.box_rings(spark, sf_dir).select(F.col("box_id").alias("label_id"), F.col("name").alias("text"), "ring"))


@query(f"WITH {I.REGIONS_SQL}, {I.BOXES_SQL} SELECT r.map_id, count(b.box_id) AS n FROM (SELECT DISTINCT p_partkey % 25 AS map_id FROM part) r LEFT JOIN boxes b ON b.map_id = r.map_id GROUP BY 1")
def collections_with_empty(spark, sf_dir):
    """SNK1, SNK2: features counted back from the collections, empty ones included."""
    b = I.boxes(spark, sf_dir)
    maps = table(spark, sf_dir, "part").select((F.col("p_partkey") % 25).alias("map_id")).distinct()
    f = b.select("map_id", "box_id", S.feature("Point", F.array("xmin", "ymin"), F.struct("name")).alias("feature"))
    c = S.feature_collections(f, maps, ["map_id"], "box_id")
    back = F.from_json("json", "features array<struct<type string>>")
    return c.select("map_id", F.size(back["features"]).cast("long").alias("n"))


@query(
    """WITH e AS (SELECT event_id // 64 AS map_id, event_id % 4 * 256 AS r, user_id % 4 * 256 AS c FROM events),
n AS (SELECT map_id, count(DISTINCT r * 10000 + c) AS patches FROM e GROUP BY 1)
SELECT map_id, patches, CAST(16 - map_id % 3 AS BIGINT) AS expected, patches = 16 - map_id % 3 AS complete FROM n"""
)
def streamed_completeness(spark, sf_dir):
    """TIL6: patches of each map counted over the stream in two runs, the second from where the first stopped."""
    e, u = F.col("event_id"), F.col("user_id")
    patches = table(spark, sf_dir, "events").select(F.floor(e / 64).alias("map_id"), (e % 4 * 256).alias("patch_row"), (u % 4 * 256).alias("patch_col"), (e % 5 < 2).alias("late"))
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    for late in (False, True):  # of most maps some patches come in the second run
        patches.filter(F.col("late") == late).drop("late").write.mode("append").parquet(f"{folder}/in")
        ingest.count_patches(ingest.patch_stream(spark, f"{folder}/in", patches.drop("late").schema), f"{folder}/out", f"{folder}/state")
    maps = patches.select("map_id").distinct().withColumn("expected", 16 - F.col("map_id") % 3)
    return ingest.complete_maps(spark, f"{folder}/out", maps)


@query(
    """WITH e AS (SELECT user_id % 40 AS map_id, event_id, event_id % 4 * 256 AS r, user_id % 4 * 256 AS c, event_id % 256 AS x, event_id % 255 AS y FROM events), n AS (SELECT map_id, count(DISTINCT r * 10000 + c) AS patches FROM e GROUP BY 1)
SELECT map_id, event_id, CAST(x + c AS BIGINT) AS x, CAST(y + r AS BIGINT) AS y, patches FROM e JOIN n USING (map_id)"""
)
def streamed_patches(spark, sf_dir):
    """Section 2.16: patch predictions as a file stream drained to a table in map coordinates, with the patches of each map (GEO1, TIL6)."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # the pattern stands for the one file or the one folder of that name
    stream = ingest.patch_stream(spark, f"{sf_dir}/events.parque[t]", schema)
    e, u = F.col("event_id"), F.col("user_id")
    stream = stream.select((u % 40).alias("map_id"), "event_id", (e % 4 * 256).alias("patch_row"), (u % 4 * 256).alias("patch_col"), (e % 256).alias("x"), (e % 255).alias("y"))
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    ingest.drain(ingest.stitched(stream), f"{folder}/out", f"{folder}/state")
    out = spark.read.parquet(f"{folder}/out")
    return out.join(ingest.completeness(out).select("map_id", "patches"), "map_id").select("map_id", "event_id", "x", "y", "patches")
