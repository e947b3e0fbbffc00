"""Readers of the file kinds that map pipelines exchange. All take a session and a path Spark can read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mapfold.functions import geometry as G
from mapfold.functions import text as T

POINT = "struct<x:double,y:double>"
LEGEND = "name string, abbreviation string, id string, map_unit string, color string, pattern string, description string, category string"


def geojson(spark: SparkSession, path: str, properties: str, coordinates: str = "array<array<array<double>>>") -> DataFrame:
    """(file, seq, kind, coordinates, properties..) of each feature (SRC1). Unreadable files give no rows here; see unreadable."""
    schema = f"type string, features array<struct<type:string,geometry:struct<type:string,coordinates:{coordinates}>,properties:struct<{_nested(properties)}>>>, _corrupt_record string"
    rows = spark.read.json(path, schema=schema, multiLine=True, mode="PERMISSIVE").withColumn("file", F.input_file_name())
    f = rows.select("file", F.posexplode("features").alias("seq", "f"))
    return f.select("file", "seq", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), "f.properties.*")


def _nested(ddl: str) -> str:
    return ",".join(":".join(x.strip().split(" ", 1)) for x in ddl.split(","))


def outer_ring(coordinates: Column) -> Column:
    """First ring of polygon coordinates as points."""
    return F.transform(coordinates[0], lambda p: G.point(p[0], p[1]))


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """(file, reason) of JSON files that do not parse (SNK8)."""
    rows = spark.read.json(path, schema="_corrupt_record string", multiLine=True).withColumn("file", F.input_file_name())
    return rows.filter("_corrupt_record IS NOT NULL").select("file", F.lit("not JSON").alias("reason"))


def patches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Patch predictions with map, row and column from names like map_row_col.json, of files or of folders key=name (SRC2, TXT24)."""
    rows = spark.read.json(path, schema=schema, multiLine=True).withColumn("file", F.input_file_name())
    part = lambda k: F.regexp_extract("file", r"(?:^|[/=])([^/=]*)_(\d+)_(\d+)\.json(?:/|$)", k)
    return rows.withColumns({"map_name": part(1), "patch_row": part(2).cast("int"), "patch_col": part(3).cast("int")})


def column_oriented(rows: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Columns that are index -> value maps, as one row for each index (SRC3)."""
    # every entry becomes a row and meets those of its index, as a look-up in a map walks through it
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    types = {c: rows.schema[c].dataType for c in columns}
    out = None
    for c in columns:
        value = [F.col("_v").alias(d) if d == c else F.lit(None).cast(types[d].valueType).alias(d) for d in columns]
        part = rows.select(*keys, "_row", F.explode(c).alias("index", "_v")).select(*keys, "_row", "index", *value, F.lit(c == columns[0]).alias("_own"))
        out = part if out is None else out.unionByName(part)
    one = out.groupBy("_row", *keys, "index").agg(*[F.first(c, ignorenulls=True).alias(c) for c in columns], F.max("_own").alias("_own"))
    return one.filter("_own").select(*keys, "index", *columns)


def catalog(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Map catalogue with text ids and control points (SRC4, SRC5, SRC6)."""
    rows = spark.read.csv(path, header=True, sep=sep, schema="external_id string, image_no string, transformation_method string, gcps string", quote='"', escape='"')
    points = "array<struct<location:array<double>,pixel:array<double>>>"
    return rows.withColumns({"external_id": T.catalog_id(F.col("external_id")), "gcps": T.listed(F.col("gcps"), points)})


def layout(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, class_label, box) of layout segments (SRC7)."""
    rows = spark.read.json(path, schema="segments array<struct<class_label:string,bbox:array<double>,poly_bounds:array<array<int>>>>", multiLine=True).withColumn("file", F.input_file_name())
    s = rows.select("file", F.posexplode("segments").alias("seq", "s"))
    b = F.col("s.bbox")
    return s.select("file", "seq", "s.class_label", F.struct(b[0].alias("xmin"), b[1].alias("ymin"), b[2].alias("xmax"), b[3].alias("ymax")).alias("box"), "s.poly_bounds")


def last_of_class(segments: DataFrame, classes: list[str]) -> DataFrame:
    """One box of each class for each map, the last one (SRC7)."""
    return segments.groupBy("file").pivot("class_label", classes).agg(F.max_by("box", "seq"))


def coco(spark: SparkSession, path: str) -> DataFrame:
    """Annotations with their image's name, category 2 left out (SRC8, D8)."""
    schema = "images array<struct<id:int,file_name:string,height:int,width:int>>, annotations array<struct<image_id:int,category_id:int,bbox:array<double>,segmentation:array<array<double>>>>"
    rows = spark.read.json(path, schema=schema, multiLine=True)
    images = rows.select(F.inline("images")).withColumn("file_name", F.url_decode("file_name"))
    notes = rows.select(F.inline("annotations")).filter("category_id != 2")
    b = F.col("bbox")
    box = F.struct(b[0].alias("xmin"), b[1].alias("ymin"), (b[0] + b[2]).alias("xmax"), (b[1] + b[3]).alias("ymax"))
    ring = G.pairs_to_ring(F.coalesce(F.get("segmentation", F.lit(0)), F.array().cast("array<double>")))
    return images.join(notes, images.id == notes.image_id).select("file_name", "height", "width", "category_id", box.alias("box"), ring.alias("ring"))


def polygon_labels(shapes: DataFrame) -> DataFrame:
    """Distinct _poly labels with their box (SRC10). shapes: map_id, shapes array of label and points."""
    s = shapes.select("map_id", F.inline("shapes")).filter(F.col("label").endswith("_poly"))
    xs, ys = F.transform("points", lambda p: p[0]), F.transform("points", lambda p: p[1])
    box = F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))
    return s.withColumn("box", box).groupBy("map_id", "label").agg(F.min("box").alias("box"))


def legend_label(abbreviation: Column, item_id: Column) -> Column:
    """Abbreviation, or the id where it is empty, with _poly (SRC11)."""
    return F.concat(F.coalesce(F.nullif(abbreviation, F.lit("")), item_id), F.lit("_poly"))


def descriptions(rows: DataFrame) -> DataFrame:
    """(map_id, box, description, symbol name) of entries keyed by a box (D11, FLT8). rows: map_id, json."""
    e = rows.select("map_id", F.explode(F.from_json("json", "map<string,string>")).alias("key", "value")).filter(F.col("key").contains(","))
    n = F.from_json(F.col("key"), "array<double>")
    item = F.from_json("value", "description string, `symbol name` string")
    return e.select("map_id", F.struct(n[0].alias("xmin"), n[1].alias("ymin"), n[2].alias("xmax"), n[3].alias("ymax")).alias("box"), item["description"].alias("description"), item["symbol name"].alias("symbol_name"))


def osm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, lat, lon; links: way_id, a, b in both directions) of an OSM extract (SRC12)."""
    nodes = spark.read.format("xml").option("rowTag", "node").schema("_id long, _lat double, _lon double").load(path)
    nodes = nodes.select(F.col("_id").alias("id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"))
    ways = spark.read.format("xml").option("rowTag", "way").schema("_id long, nd array<struct<_ref:long>>").load(path)
    refs = ways.select(F.col("_id").alias("way_id"), F.posexplode("nd").alias("pos", "nd")).select("way_id", "pos", F.col("nd._ref").alias("a"))
    w = Window.partitionBy("way_id").orderBy("pos")
    links = refs.withColumn("b", F.lead("a").over(w)).filter("b IS NOT NULL").select("way_id", "a", "b")
    return nodes, links.unionByName(links.select("way_id", F.col("b").alias("a"), F.col("a").alias("b")))


def aux_control_points(spark: SparkSession, path: str, row_tag: str, values: str) -> DataFrame:
    """(file, x array, y array) of a flat list of target points, even and odd places (SRC13)."""
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(f"{values} array<double>").load(path).withColumn("file", F.input_file_name())
    pick = lambda k: F.filter(values, lambda _, i: i % 2 == k)
    return rows.select("file", pick(0).alias("x"), pick(1).alias("y"))


def geocoded(spark: SparkSession, path: str) -> DataFrame:
    """Geocoder answers, one JSON object a line (SRC14); answers without a place are left out."""
    rows = spark.read.json(path, schema="text string, score double, geometry string, geocoding struct<lat:double,lng:double>").withColumn("file", F.input_file_name())
    return rows.filter("geocoding.lat IS NOT NULL AND geocoding.lng IS NOT NULL").select("file", "text", "score", "geocoding.lat", "geocoding.lng")


def database_polygons(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Polygons of a relational database; filters push down (SRC15)."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def image_pixels(spark: SparkSession, path: str, tile: int = 256) -> DataFrame:
    """(file, row, col, r, g, b) of images (SRC16). Each image is cut into tiles before its pixels are rows."""
    import numpy as np
    import pandas as pd

    def spread(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, -1)
                for y in range(0, r.height, tile):
                    for x in range(0, r.width, tile):
                        part = a[y : y + tile, x : x + tile]
                        rows, cols = np.mgrid[y : y + part.shape[0], x : x + part.shape[1]]
                        ch = [part[..., k if part.shape[2] > 2 else 0].ravel().astype(np.int32) for k in (2, 1, 0)]
                        yield pd.DataFrame({"file": r.origin, "row": rows.ravel().astype(np.int32), "col": cols.ravel().astype(np.int32), "r": ch[0], "g": ch[1], "b": ch[2]})

    images = spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.height", "image.width", "image.data")
    return images.mapInPandas(spread, "file string, row int, col int, r int, g int, b int")


def image_sizes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, height, width), and the files that could not be read (SRC17)."""
    i = spark.read.format("image").load(path).select(F.col("image.origin").alias("file"), "image.height", "image.width")
    return i.filter("height > 0"), i.filter("height <= 0").select("file", F.lit("no image").alias("reason"))


def evaluation_lines(spark: SparkSession, path: str, with_confidence: bool = False) -> DataFrame:
    """(file, ring, confidence, transcription) of lines x1,y1,..####text (SRC18)."""
    rows = spark.read.text(path).withColumn("file", F.input_file_name()).filter("value != ''")
    halves = F.split("value", ",####", 2)
    numbers = F.transform(F.split(halves[0], ","), lambda x: x.try_cast("double"))
    n = F.size(numbers) - (1 if with_confidence else 0)
    confidence = F.element_at(numbers, -1) if with_confidence else F.lit(1.0)
    return rows.select("file", G.pairs_to_ring(F.slice(numbers, F.lit(1), n)).alias("ring"), confidence.alias("confidence"), F.get(halves, F.lit(1)).alias("transcription"))


def key_statistics(spark: SparkSession, path: str, n_first: int, n_second: int) -> DataFrame:
    """(key, first, second): two feature vectors for each key of a statistics table (SRC19)."""
    total = n_first + n_second
    rows = spark.read.csv(path, header=True, schema="key string, " + ", ".join(f"v{k} double" for k in range(total)))
    return rows.select("key", F.array(*[F.col(f"v{k}") for k in range(n_first)]).alias("first"), F.array(*[F.col(f"v{k}") for k in range(n_first, total)]).alias("second"))
