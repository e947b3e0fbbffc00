"""Map tables derived from the given ones by integer arithmetic that SQL repeats exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapfold.functions import geometry as G
from mapfold.session import table

#: The same derivations in SQL, to go in front of a query's own.
POINTS_SQL = """points AS (
  SELECT l_orderkey % 20 AS map_id, min(l_orderkey * 100000000 + l_partkey * 10000 + l_suppkey * 10 + l_linenumber) AS point_id, l_returnflag AS type,
         CAST(l_partkey % 1000 AS DOUBLE) AS x, CAST((l_suppkey * 7 + l_linenumber * 131) % 1000 AS DOUBLE) AS y,
         max(l_quantity) / 50.0 AS score
  FROM lineitem GROUP BY l_orderkey % 20, l_returnflag, l_partkey % 1000, (l_suppkey * 7 + l_linenumber * 131) % 1000)"""
BOXES_SQL = """boxes AS (
  SELECT p_partkey % 20 AS map_id, p_partkey AS box_id, p_name AS name, CAST((p_partkey * 37) % 900 AS DOUBLE) AS xmin, CAST((p_partkey * 91) % 900 AS DOUBLE) AS ymin,
         CAST((p_partkey * 37) % 900 + p_size AS DOUBLE) AS xmax, CAST((p_partkey * 91) % 900 + p_size / 2 + 1 AS DOUBLE) AS ymax FROM (SELECT * REPLACE (p_size - p_size % 2 AS p_size) FROM part))"""
EDGES_SQL = """edges AS (
  SELECT DISTINCT l_orderkey % 20 AS map_id, CAST(least(l_partkey % 500, l_suppkey % 500) AS BIGINT) AS u, CAST(greatest(l_partkey % 500, l_suppkey % 500) AS BIGINT) AS v
  FROM lineitem WHERE l_partkey % 500 <> l_suppkey % 500)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected points: one for each (map, type, place)."""
    x, y = F.col("l_partkey") % 1000, (F.col("l_suppkey") * 7 + F.col("l_linenumber") * 131) % 1000
    key = F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 20).alias("map_id"), F.col("l_returnflag").alias("type"), x.cast("double").alias("x"), y.cast("double").alias("y"), key.alias("k"), "l_quantity")
    return rows.groupBy("map_id", "type", "x", "y").agg(F.min("k").alias("point_id"), (F.max("l_quantity") / 50.0).alias("score"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legend boxes, with their corners also as columns."""
    k, size = F.col("p_partkey"), F.col("p_size") - F.col("p_size") % 2
    x, y = (k * 37) % 900, (k * 91) % 900
    corners = {"xmin": x, "ymin": y, "xmax": x + size, "ymax": y + size / 2 + 1}
    return table(spark, sf_dir, "part").select((k % 20).alias("map_id"), k.alias("box_id"), F.col("p_name").alias("name"), *[c.cast("double").alias(n) for n, c in corners.items()]).withColumn("box", F.struct(*corners))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected line graph of each map, loops and doubles removed."""
    u, v = F.col("l_partkey") % 500, F.col("l_suppkey") % 500
    rows = table(spark, sf_dir, "lineitem").filter(u != v)
    return rows.select((F.col("l_orderkey") % 20).alias("map_id"), F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct()


#: A graph in many small parts, one for each order at most: it grows with the rows.
PARTS_SQL = """parts AS (
  SELECT DISTINCT l_orderkey % 20 AS map_id, l_orderkey * 10 + l_partkey % 5 AS u, l_orderkey * 10 + 5 + l_suppkey % 5 AS v FROM lineitem)"""


def part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected edges between the parts and the suppliers of an order, some more than once."""
    k = F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select((k % 20).alias("map_id"), (k * 10 + F.col("l_partkey") % 5).alias("u"), (k * 10 + 5 + F.col("l_suppkey") % 5).alias("v"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, each edge once."""
    return part_rows(spark, sf_dir).distinct()


def box_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rings: the legend boxes as closed rings."""
    return boxes(spark, sf_dir).select("map_id", "box_id", "name", G.box_ring(F.col("box")).alias("ring"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map areas of three maps out of four; the others have none."""
    k = F.col("map_id")
    box = F.struct((k * 5).cast("double").alias("xmin"), (k * 3).cast("double").alias("ymin"), (950 - k * 4).cast("double").alias("xmax"), (980 - k * 7).cast("double").alias("ymax"))
    return table(spark, sf_dir, "part").select((F.col("p_partkey") % 20).alias("map_id")).distinct().filter("map_id % 4 <> 3").withColumn("box", box)


REGIONS_SQL = """regions AS (
  SELECT DISTINCT p_partkey % 20 AS map_id, (p_partkey % 20) * 5.0 AS rx0, (p_partkey % 20) * 3.0 AS ry0, 950.0 - (p_partkey % 20) * 4 AS rx1, 980.0 - (p_partkey % 20) * 7 AS ry1
  FROM part WHERE (p_partkey % 20) % 4 <> 3)"""


def strikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strike detections: a place and an angle, numbered in input order."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        (k % 20).alias("map_id"), k.alias("strike_seq"), ((k * 13) % 1000 + 0.5).cast("double").alias("x"), ((F.col("o_custkey") * 17) % 1000 + 0.25).cast("double").alias("y"), (k % 360).cast("double").alias("dip")
    )


STRIKES_SQL = """strikes AS (
  SELECT o_orderkey % 20 AS map_id, o_orderkey AS strike_seq, CAST((o_orderkey * 13) % 1000 + 0.5 AS DOUBLE) AS sx, CAST((o_custkey * 17) % 1000 + 0.25 AS DOUBLE) AS sy, CAST(o_orderkey % 360 AS DOUBLE) AS dip
  FROM orders)"""


MASK_SQL = """mask AS (
  SELECT DISTINCT l_orderkey % 20 AS map_id, l_returnflag AS key, CAST(l_partkey % 60 AS INTEGER) AS row, CAST((l_suppkey * 7 + l_linenumber * 131) % 60 AS INTEGER) AS col FROM lineitem)"""
COLORS_SQL = """pixels AS (
  SELECT o_orderkey % 20 AS map_id, o_orderpriority AS key, CAST(o_orderkey // 20 // 100 AS INTEGER) AS row, CAST(o_orderkey // 20 % 100 AS INTEGER) AS col,
         CAST(o_custkey * 7 % 256 AS INTEGER) AS r, CAST(o_custkey * 13 % 256 AS INTEGER) AS g, CAST(o_orderkey * 11 % 256 AS INTEGER) AS b FROM orders)"""


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse masks: map_id, key, row, col."""
    col = (F.col("l_suppkey") * 7 + F.col("l_linenumber") * 131) % 60
    rows = table(spark, sf_dir, "lineitem")
    return rows.select((F.col("l_orderkey") % 20).alias("map_id"), F.col("l_returnflag").alias("key"), (F.col("l_partkey") % 60).cast("int").alias("row"), col.cast("int").alias("col")).distinct()


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with a legend key and colours."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    at = F.floor(k / 20)
    rgb = {"r": c * 7 % 256, "g": c * 13 % 256, "b": k * 11 % 256}
    return table(spark, sf_dir, "orders").select((k % 20).alias("map_id"), F.col("o_orderpriority").alias("key"), F.floor(at / 100).cast("int").alias("row"), (at % 100).cast("int").alias("col"), *[e.cast("int").alias(n) for n, e in rgb.items()])


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets with their size: one for each supplier."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("map_id"), (600 + k * 37 % 3000).cast("int").alias("height"), (700 + k * 53 % 4000).cast("int").alias("width"))


SHEETS_SQL = "sheets AS (SELECT s_suppkey AS map_id, CAST(600 + s_suppkey * 37 % 3000 AS INTEGER) AS height, CAST(700 + s_suppkey * 53 % 4000 AS INTEGER) AS width FROM supplier)"


def gcps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five control points on each of five maps."""
    k, m = F.col("n_nationkey"), F.col("n_regionkey")
    px, py = (k * 97) % 1000, (k * k * 31 + 7) % 800
    return table(spark, sf_dir, "nation").select(
        m.cast("long").alias("map_id"), k.cast("long").alias("gcp_id"), px.cast("double").alias("px"), py.cast("double").alias("py"), (-120.0 + m + px * 0.001 + py * 0.0002).alias("mx"), (45.0 - m - py * 0.0008 + px * 0.0001).alias("my")
    )


GCPS_SQL = """gcps AS (SELECT CAST(n_regionkey AS BIGINT) AS map_id, CAST(n_nationkey AS BIGINT) AS gcp_id, CAST((n_nationkey * 97) % 1000 AS DOUBLE) AS px, CAST((n_nationkey * n_nationkey * 31 + 7) % 800 AS DOUBLE) AS py FROM nation)"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


#: Masks of many small sheets: they grow with the rows.
SHEET_MASK_SQL = """sheet_mask AS (
  SELECT DISTINCT l_orderkey // 500 AS map_id, l_returnflag AS key, CAST(l_partkey * 7 % 24 AS INTEGER) AS row, CAST((l_suppkey * 7 + l_linenumber * 131) % 24 AS INTEGER) AS col FROM lineitem)"""


def sheet_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse masks of 24 x 24 pixels, a sheet for 500 order keys."""
    col = (F.col("l_suppkey") * 7 + F.col("l_linenumber") * 131) % 24
    at = {"map_id": F.floor(F.col("l_orderkey") / 500), "key": F.col("l_returnflag"), "row": (F.col("l_partkey") * 7 % 24).cast("int"), "col": col.cast("int")}
    return table(spark, sf_dir, "lineitem").select(*[c.alias(n) for n, c in at.items()]).distinct()


#: Where the nodes of the graph of parts stand.
PLACES_SQL = "places AS (SELECT map_id, node, CAST(node * 37 % 1000 AS DOUBLE) AS x, CAST(node * 91 % 1000 AS DOUBLE) AS y FROM (SELECT map_id, u AS node FROM parts UNION SELECT map_id, v FROM parts))"


def places(edges: DataFrame) -> DataFrame:
    nodes = edges.select("map_id", F.explode(F.array("u", "v")).alias("node")).distinct()
    return nodes.withColumns({"x": (F.col("node") * 37 % 1000).cast("double"), "y": (F.col("node") * 91 % 1000).cast("double")})
