"""Readers, writers and the stream on small files."""

import json

from pyspark.sql import functions as F

from mapfold.functions import geometry as G
from mapfold.functions import text as T
from mapfold.operators import legends as L
from mapfold.operators import tiles as TL
from mapfold.sources import readers as R
from mapfold.sources import writers as W
from mapfold.streaming import ingest


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text if isinstance(text, str) else json.dumps(text))
    return str(path)


def test_geojson_and_errors(spark, tmp_path):
    put(tmp_path / "g/a.json", {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 0]]]}, "properties": {"name": "x", "id": 1}}]})
    put(tmp_path / "g/b.json", "{not json")
    rows = R.geojson(spark, str(tmp_path / "g"), "name string, id int").withColumn("ring", R.outer_ring(F.col("coordinates"))).collect()
    assert [(r.name, r.id, r.kind, len(r.ring)) for r in rows] == [("x", 1, "Polygon", 4)]


def test_patch_names_and_column_oriented(spark, tmp_path):
    put(tmp_path / "p/some_map_256_512.json", [{"type": "a", "score": "0.5", "bbox": [[1, 2], [3, 4]]}])
    r = R.patches(spark, str(tmp_path / "p"), "type string, score string, bbox array<array<int>>").first()
    assert (r.map_name, r.patch_row, r.patch_col, r.score) == ("some_map", 256, 512, "0.5")
    put(tmp_path / "c/x.json", {"text": {"0": "a", "1": "b"}, "score": {"0": 0.5, "1": 0.25}})
    wide = spark.read.json(str(tmp_path / "c"), schema="text map<string,string>, score map<string,double>", multiLine=True).withColumn("k", F.lit(1))
    assert sorted((r["index"], r.text, r.score) for r in R.column_oriented(wide, ["text", "score"], ["k"]).collect()) == [("0", "a", 0.5), ("1", "b", 0.25)]


def test_catalog(spark, tmp_path):
    path = put(tmp_path / "c.csv", "external_id,image_no,transformation_method,gcps\n'12.5',7,affine,\"[{'location': [1.0, 2.0], 'pixel': [3, 4]}]\"\n")
    r = R.catalog(spark, path).first()
    assert r.external_id == "125" and r.gcps[0].location == [1.0, 2.0] and r.gcps[0].pixel == [3.0, 4.0]


def test_layout_coco_shapes_descriptions(spark, tmp_path):
    path = put(tmp_path / "l.json", {"segments": [{"class_label": "map", "bbox": [0, 0, 9, 9], "poly_bounds": [[0, 0]]}, {"class_label": "map", "bbox": [1, 1, 8, 8], "poly_bounds": [[0, 0]]}]})
    assert R.last_of_class(R.layout(spark, path), ["map", "legend_polygons"]).first().map.xmin == 1
    path = put(tmp_path / "k.json", {"images": [{"id": 1, "file_name": "a%20b.tif", "height": 5, "width": 6}], "annotations": [{"image_id": 1, "category_id": c, "bbox": [1, 2, 3, 4], "segmentation": [[0, 0, 1, 0, 1, 1]]} for c in (0, 2)]})
    rows = R.coco(spark, path).collect()
    assert [(r.file_name, r.box.xmax, len(r.ring)) for r in rows] == [("a b.tif", 4.0, 3)]
    shapes = spark.createDataFrame([("m", [("a_poly", [[5.0, 6.0], [1.0, 2.0]]), ("a_poly", [[5.0, 6.0], [1.0, 2.0]]), ("b_pt", [[0.0, 0.0], [1.0, 1.0]])])], "map_id string, shapes array<struct<label:string,points:array<array<double>>>>")
    assert [(r.label, r.box.xmin) for r in R.polygon_labels(shapes).collect()] == [("a_poly", 1.0)]
    d = spark.createDataFrame([("m", json.dumps({"[1, 2, 3, 4]": json.dumps({"description": "sand", "symbol name": "Qs"}), "map_dimension": "[1]".replace(",", "")}))], "map_id string, json string")
    assert [(r.box.ymax, r.description, r.symbol_name) for r in R.descriptions(d).collect()] == [(4.0, "sand", "Qs")]
    assert [r[0] for r in spark.createDataFrame([("", "7"), ("Qa", "8")], "a string, i string").select(R.legend_label(F.col("a"), F.col("i"))).collect()] == ["7_poly", "Qa_poly"]


def test_osm(spark, tmp_path):
    path = put(tmp_path / "o.xml", '<osm><node id="1" lat="1.0" lon="2.0"/><node id="2" lat="1.5" lon="2.5"/><way id="9"><nd ref="1"/><nd ref="2"/></way><way id="10"><nd ref="1"/></way></osm>')
    nodes, links = R.osm(spark, path)
    assert nodes.count() == 2 and sorted((r.a, r.b) for r in links.collect()) == [(1, 2), (2, 1)]


def test_lines_and_geocoder(spark, tmp_path):
    path = put(tmp_path / "e.txt", "0,0,4,0,4,4,####Main, St\n1,1,2,2,0.5,####x\n")
    rows = R.evaluation_lines(spark, path).collect()
    assert (len(rows[0].ring), rows[0].transcription) == (3, "Main, St")
    path = put(tmp_path / "g.jsonl", '{"text":"a","score":1,"geometry":"g","geocoding":{"lat":1.5,"lng":2.5}}\n{"text":"b","geocoding":null}\n')
    assert [r.text for r in R.geocoded(spark, path).collect()] == ["a"]


def test_text_functions(spark):
    r = spark.range(1).select(
        T.answer_rows(F.lit("Here: [('Qal', 'alluvium'), ('Qs', 'sand'),] done")).alias("ok"),
        T.answer_rows(F.lit("[broken")).alias("bad"),
        T.rejoin_pieces(F.array(*[F.lit(x) for x in ("cle", "##ar", "lake")])).alias("pieces"),
        T.same_transcription(F.lit("(Main)"), F.lit("main")).alias("same"),
        T.file_parts(F.lit("/x/my_map_3_4.json"), 2)[0].alias("stem"),
        T.search_string(F.lit("A"), F.lit(None).cast("string"), F.lit("WY")).alias("search"),
        T.point_class(F.lit("steep dip"), (("fold", ("axis",)), ("bed", ("dip",)))).alias("kind"),
        T.ascii_only(F.lit("aéb")).alias("ascii"),
    ).first()
    assert [list(x) for x in r.ok] == [["Qal", "alluvium"], ["Qs", "sand"]] and r.bad is None
    assert (r.pieces, r.same, r.stem, r.search, r.kind, r.ascii) == ("clear lake", True, "my_map", "A WY", "bed", "a b")


def test_delivery_keys_hold(spark, tmp_path):
    ring = lambda x: F.array(*[G.point(F.lit(float(x + a)), F.lit(float(b))) for a, b in ((0, 0), (1, 0), (1, 1), (0, 0))])
    maps = spark.createDataFrame([(1, "m1"), (2, "m2")], "map_id int, name string")
    gcps = spark.createDataFrame([(1, 1, 0.0, 0.0, 5.0, 6.0)], "map_id int, gcp_id int, px double, py double, mx double, my double")
    polys = spark.createDataFrame([(m, n, "#fff", None, n, "d", "c", "u", "age", 2.0, 1.0, k) for m in (1, 2) for k, n in enumerate(("Qa", "Qs", "Qa"))], "map_id int, name string, color string, pattern string, abbreviation string, description string, category string, unit_name string, unit_age string, b_age double, t_age double, k int").withColumn("geom", ring(0)).drop("k")
    points = spark.createDataFrame([(1, "dip", None, 1.0, 2.0, 30.0), (1, "fault", "x", 1.0, 2.0, None)], "map_id int, type string, description string, x double, y double, dip double")
    lines = spark.createDataFrame([(1, "fault_line", "d", "solid", "s"), (1, "abc", "d", "solid", "s")], "map_id int, name string, description string, dash string, symbol string").withColumn("geom", ring(3))
    t = W.delivery_tables(maps, gcps, polys, points, lines)
    assert len(t) == 10 and t["polygon_type"].count() == 4 and t["geologic_unit"].count() == 2
    for child, parent in (("polygon_feature", "polygon_type"), ("point_feature", "point_type"), ("line_feature", "line_type")):
        assert t[child].join(t[parent], ["map_id", "type_id"], "left_anti").count() == 0 and t[child].count() > 0
    W.write_delivery({k: t[k] for k in ("map", "point_feature")}, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d/point_feature")).count() == 2


def test_collections_annotations_and_records(spark, tmp_path):
    p = spark.createDataFrame([(1, 2, 5.0), (1, 1, 4.0)], "map_id int, seq int, x double").withColumn("feature", W.feature("Point", F.array("x", F.lit(0.0)), F.struct("seq")))
    maps = spark.createDataFrame([(1,), (2,)], "map_id int")
    c = {r.map_id: json.loads(r.json) for r in W.feature_collections(p, maps, ["map_id"], "seq").collect()}
    assert [f["properties"]["seq"] for f in c[1]["features"]] == [1, 2] and c[2]["features"] == []
    W.write_collections(W.feature_collections(p, maps, ["map_id"], "seq"), str(tmp_path / "c"), ["map_id"])
    items = spark.createDataFrame([(1, 7, "polygon")], "map_id int, id int, kind string").withColumn("box", F.struct(*[F.lit(float(k)).alias(n) for k, n in enumerate(("xmin", "ymin", "xmax", "ymax"))]))
    assert json.loads(W.competition_legend(items).first().json)["shapes"][0]["label"] == "7_poly"
    rows = spark.createDataFrame([(1, "a", 0, "", "n")], "map_id int, unit string, seq int, description string, name string").withColumn("geom", F.array(G.point(F.lit(1.23456), F.lit(2.0))))
    f = W.nested_polygons(rows, "unit").first().polygon_features[0]
    assert (f.id, f.description, f.polygon_geometry[0].x) == ("polygon_feature_a_instance_1", None, 1.235)
    e = W.errors({"read": spark.createDataFrame([(1, "bad")], "map_id int, reason string")})
    W.write_csv(e.withColumn("list", F.array(F.lit(1))), str(tmp_path / "e"))
    assert spark.read.csv(str(tmp_path / "e"), header=True).first().list == "[1]"


def test_tiles_and_stream(spark, tmp_path):
    sheets = spark.createDataFrame([(1, 500, 700)], "map_id int, height int, width int")
    grid = TL.grid_tiles(sheets, 256)
    expected = grid.groupBy("map_id").count().withColumnRenamed("count", "n")
    assert TL.complete_only(grid, expected, ["map_id"]).count() == 6 and TL.complete_only(grid.filter("tile_row > 0"), expected, ["map_id"]).count() == 0
    assert TL.missing_tiles(grid, grid.filter("tile_row > 0"), ["map_id"]).count() == 3
    rows = spark.createDataFrame([(1, 256, 512, 3, 4)], "map_id long, patch_row long, patch_col long, x long, y long")
    rows.write.parquet(str(tmp_path / "in"))
    ingest.drain(ingest.stitched(ingest.patch_stream(spark, str(tmp_path / "in"), rows.schema.simpleString()[7:-1].replace(":", " "))), str(tmp_path / "out"), str(tmp_path / "state"))
    r = spark.read.parquet(str(tmp_path / "out")).first()
    assert (r.x, r.y) == (515, 260)
    ocr = spark.createDataFrame([("a", 90.0, 0.0, 0.0, 40.0, 20.0), ("b", -1.0, 0.0, 0.0, 9.0, 9.0), ("c", 50.0, 0.0, 0.0, 10.0, 60.0), ("d", 50.0, 0.0, 0.0, 90.0, 31.0)], "text string, conf double, left double, top double, width double, height double")
    assert [r.text for r in L.ocr_filtered(ocr).collect()] == ["a"]


def test_label_and_title_pipelines(spark):
    from mapfold.plans import map_pipelines as P

    ring = lambda *p: F.array(*[G.point(F.lit(float(a)), F.lit(float(b))) for a, b in p])
    patches = spark.createDataFrame([(1, 100, 200, "Claer Lake", 0.9), (1, 0, 0, "123", 0.9), (2, 0, 0, "Lake", 0.05)], "map_id long, patch_row int, patch_col int, text string, score double").withColumn("ring", ring((0, 0), (4, 0), (4, 4), (0, 4)))
    lexicon = spark.createDataFrame([("clear", 20), ("lake", 30)], "name string, cnt long")
    gcps = spark.createDataFrame([(1, k, float(x), float(y), x / 10, y / 10) for k, (x, y) in enumerate([(0, 0), (100, 0), (0, 100)])], "map_id long, gcp_id int, px double, py double, mx double, my double")
    polygons = spark.range(1).select(F.lit(5).alias("polygon_id"), F.lit("Clear Lake Reservoir").alias("name"), ring((19, 9), (21, 9), (21, 11), (19, 11), (19, 9)).alias("geom"))
    rows = {r.text: r for r in P.label_pipeline(patches, lexicon, gcps, polygons).collect()}
    r = rows["Claer Lake"]
    assert set(rows) == {"Claer Lake", "123"} and (r.corrected, r.polygon_ids) == ("clear lake", [5]) and (round(r.lon, 3), round(r.lat, 3)) == (20.2, 10.2)
    topo = spark.createDataFrame([(1, "Rock Springs", "Sweetwater", "Wyoming", -110.0, -109.0, 42.0, 41.0), (2, "Big Bend", "Lake", "Texas", -103.0, -102.0, 30.0, 29.0)], "row_id int, map_name string, county_list string, state string, west double, east double, north double, south double")
    titles = spark.createDataFrame([(1, "Geologic map of the Rock Springs area, Wyoming")], "map_id long, title string")
    corners = spark.createDataFrame([(1, 0, 0), (1, 0, 90), (1, 80, 90), (1, 80, 0)], "map_id long, row int, col int")
    ranked, points = P.locate_titles(titles, topo, corners)
    assert ranked.filter("rank = 1").first().row_id == 1
    got = {r.gcp_id: (r.px, r.py, r.mx, r.my) for r in points.collect()}
    assert got[1] == (0, 0, -110, 42) and got[3] == (90, 80, -109, 41)
