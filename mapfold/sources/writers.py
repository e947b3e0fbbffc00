"""Results as files: feature collections, delivery tables, annotations."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mapfold.functions import geometry as G


DELIVERED = (
    "map",
    "georeference_meta",
    "ground_control_point",
    "polygon_type",
    "geologic_unit",
    "polygon_feature",
    "point_type",
    "point_feature",
    "line_type",
    "line_feature",
)


def feature(kind: str, coordinates: Column, properties: Column) -> Column:
    return F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"), properties.alias("properties"))


def feature_collections(features: DataFrame, groups: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, json): one collection for each group, an empty one without features (SNK1, SNK2). features: keys, order, feature."""
    own = features.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, F.to_json("feature").alias("f")))), lambda x: x["f"]).alias("f"))
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.coalesce("f", F.array().cast("array<string>")), ","), F.lit("]}"))
    return groups.join(own, keys, "left").select(*keys, text.alias("json"))


def write_collections(collections: DataFrame, path: str, keys: list[str]) -> None:
    """One folder a group; groups that are not among the collections stay as they are."""
    rows = collections.withColumnRenamed("json", "value")
    rows.write.partitionBy(*keys).mode("overwrite").option("partitionOverwriteMode", "dynamic").text(path)


def surrogate_keys(rows: DataFrame, columns: list[str], name: str, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(dimension with ids from 1, rows with the id) of the distinct tuples of some columns (KEY1-KEY3).

    Ids are per map, so ranks are windows of one map's few types. Tuples of a known
    dimension keep their ids, also those that no row has any more; new ones go on after
    the largest id of their map.
    """
    same = lambda a, b: [F.col(f"{a}.map_id") == F.col(f"{b}.map_id")] + [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns]
    by = Window.partitionBy("map_id").orderBy(*columns)
    dim = rows.select("map_id", *columns).distinct()
    if known is None:
        dim = dim.withColumn(name, F.row_number().over(by))
    else:
        old = known.select("map_id", *columns, name).join(rows.select("map_id").distinct(), "map_id", "left_semi")
        last = old.groupBy("map_id").agg(F.max(name).alias("_last"))
        new = dim.alias("n").join(old.alias("o"), same("n", "o"), "left_anti").join(last, "map_id", "left")
        dim = old.unionByName(new.select("map_id", *columns, (F.coalesce("_last", F.lit(0)) + F.row_number().over(by)).cast("int").alias(name)))
    return dim, rows.alias("r").join(dim.alias("d"), same("r", "d")).select("r.*", f"d.{name}")


def delivery_tables(maps: DataFrame, gcps: DataFrame, polygons: DataFrame, points: DataFrame, lines: DataFrame, known: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The ten tables of a delivery with keys that hold (SNK3, SNK4). All inputs have map_id.

    known: the tables of earlier deliveries, whose type and unit ids stay.

    polygons: name, color, pattern, abbreviation, description, category, unit_name, unit_age,
    b_age, t_age, geom; points: type, description, x, y, dip; lines: name, description, dash,
    symbol, geom. Coordinates are those of the inputs: pixel or map frame.
    """
    old = (known or {}).get
    poly_type, p = surrogate_keys(polygons, ["name", "color", "pattern", "abbreviation", "description", "category"], "type_id", old("polygon_type"))
    unit, p = surrogate_keys(p, ["unit_name", "unit_age", "b_age", "t_age"], "unit_id", old("geologic_unit"))
    point_type, q = surrogate_keys(points, ["type", "description"], "type_id", old("point_type"))
    short = lines.withColumn("type_name", F.expr("substring(name, 1, greatest(length(name) - 5, 0))"))
    line_type, s = surrogate_keys(short, ["type_name", "description", "dash", "symbol"], "type_id", old("line_type"))
    number = lambda df, *order: df.withColumn("id", F.row_number().over(Window.partitionBy("map_id").orderBy(*order)))
    meta = gcps.groupBy("map_id").agg(F.count("*").alias("n_points"), F.min("mx").alias("west"), F.max("mx").alias("east"), F.min("my").alias("south"), F.max("my").alias("north"))
    return {
        "map": maps,
        "georeference_meta": meta,
        "ground_control_point": gcps,
        "polygon_type": poly_type,
        "geologic_unit": unit,
        "polygon_feature": number(p, "type_id", "geom").select("map_id", "id", "type_id", "unit_id", "geom"),
        "point_type": point_type,
        "point_feature": number(q, "type_id", "x", "y").select("map_id", "id", "type_id", "x", "y", "dip"),
        "line_type": line_type,
        "line_feature": number(s, "type_id", "geom").select("map_id", "id", "type_id", "name", "geom"),
    }


def write_delivery(tables: dict[str, DataFrame], path: str) -> None:
    """The tables as Parquet, map by map; maps that are not among the delivered ones stay (SNK3, SNK4).

    Every delivery writes its rows beside the earlier ones, under a version of its own, and
    ends with one file that says which maps it holds. read_delivery goes by those files
    alone, so it sees the whole of a map's last finished delivery or of the one before,
    never half of one, and a delivery that broke off or ran twice changes nothing.
    """
    spark = tables["map"].sparkSession
    seen = _deliveries(spark, path)
    number = 1 + (seen.agg(F.max("number")).first()[0] or 0) if seen is not None else 1
    version = uuid.uuid4().hex
    for name, df in tables.items():
        folders = ["version", "map_id"] if len(df.columns) > 1 else ["version"]
        df.withColumn("version", F.lit(version)).write.mode("append").partitionBy(*folders).parquet(f"{path}/{name}")
    told = tables["map"].select("map_id").distinct().select("map_id", F.lit(version).alias("version"), F.lit(number).cast("long").alias("number"))
    told.coalesce(1).write.mode("append").parquet(f"{path}/deliveries")


def _parquet(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path, None where there is none or none of its rows was ever written."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _deliveries(spark: SparkSession, path: str) -> DataFrame | None:
    """(map_id, version, number) of all finished deliveries, None before the first."""
    return _parquet(spark, f"{path}/deliveries")


def read_delivery(spark: SparkSession, path: str, names: tuple[str, ...] = DELIVERED) -> dict[str, DataFrame]:
    """The last finished delivery of every map, table by table, without tables that never had a row.

    Of two deliveries of one number that of the later version name counts.
    """
    seen = _deliveries(spark, path)
    if seen is None:
        return {}
    last = seen.groupBy("map_id").agg(F.max_by("version", F.struct("number", "version")).alias("version"))
    found = {n: _parquet(spark, f"{path}/{n}") for n in names}
    return {n: df.join(last, ["map_id", "version"]).drop("version") for n, df in found.items() if df is not None}


def write_csv(df: DataFrame, path: str) -> None:
    """Arrays and structs as JSON (SNK5)."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(path, header=True)


def web_annotations(labels: DataFrame) -> DataFrame:
    """W3C annotations with an SVG polygon (SNK6). labels: label_id, text, ring."""
    points = F.array_join(F.transform("ring", lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"))), " ")
    svg = F.concat(F.lit('<svg><polygon points="'), points, F.lit('"></polygon></svg>'))
    body = F.array(F.struct(F.lit("TextualBody").alias("type"), F.lit("transcribing").alias("purpose"), F.col("text").alias("value")))
    target = F.struct(F.struct(F.lit("SvgSelector").alias("type"), svg.alias("value")).alias("selector"))
    note = F.struct(F.lit("http://www.w3.org/ns/anno.jsonld").alias("@context"), F.concat(F.lit("#"), F.col("label_id").cast("string")).alias("id"), F.lit("Annotation").alias("type"), body.alias("body"), target.alias("target"))
    return labels.select("label_id", F.to_json(note).alias("json"))


def line_fields(lines: DataFrame) -> DataFrame:
    """The field set of line files (SNK7)."""
    get = lambda c: F.col(c) if c in lines.columns else F.lit(None).cast("string")
    order = Window.partitionBy("map_id").orderBy("name", "geom")
    return lines.select("map_id", F.row_number().over(order).alias("ID"), "name", get("direction").alias("direction"), F.lit("line").alias("type"), get("description").alias("descript"), get("dash").alias("dash"), get("symbol").alias("symbol"), "geom")


def errors(stages: dict[str, DataFrame]) -> DataFrame:
    """(map_id, stage, reason) of every stage's failures (SNK8). Each: map_id, reason."""
    out = None
    for stage, df in stages.items():
        rows = df.select("map_id", F.lit(stage).alias("stage"), "reason")
        out = rows if out is None else out.unionByName(rows)
    return out


def keypoint_pairs(pairs: DataFrame) -> DataFrame:
    """Matched keypoints of each map pair as JSON (SNK11). pairs: geo_id, topo_id, gx, gy, tx, ty."""
    p = F.struct(F.array("gx", "gy").alias("geomap"), F.array("tx", "ty").alias("topomap"))
    return pairs.groupBy("geo_id", "topo_id").agg(F.to_json(F.array_sort(F.collect_list(p))).alias("json"))


def nested_polygons(rows: DataFrame, key: str) -> DataFrame:
    """Polygon records with properties and geometry under polygon_features, empty text as null (SNK12, GEO32)."""
    text = [c for c, t in rows.dtypes if t == "string" and c not in ("map_id", key)]
    n = F.row_number().over(Window.partitionBy("map_id", key).orderBy("seq"))
    rows = rows.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in text} | {"_n": n})
    name = F.format_string("polygon_feature_%s_instance_%d", F.col(key).cast("string"), F.col("_n"))
    inner = F.struct(name.alias("id"), G.rounded(F.col("geom"), 3).alias("polygon_geometry"), *text)
    return rows.groupBy("map_id", key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", inner.alias("f")))), lambda x: x["f"]).alias("polygon_features"))


def competition_legend(items: DataFrame) -> DataFrame:
    """(map_id, json) with label and two-corner box of each legend item (SNK13). items: map_id, id, kind, box."""
    label = F.concat(F.col("id").cast("string"), F.when(F.col("kind") == "polygon", "_poly").otherwise("_ptln"))
    corners = F.array(F.array("box.xmin", "box.ymin"), F.array("box.xmax", "box.ymax"))
    shapes = F.array_sort(F.collect_list(F.struct(label.alias("label"), corners.alias("points"))))
    return items.groupBy("map_id").agg(F.to_json(F.struct(shapes.alias("shapes"))).alias("json"))


def description_records(items: DataFrame, layout: DataFrame) -> DataFrame:
    """(map_id, feature_type, json) keyed by stringified boxes with the layout's boxes (SNK14). layout: map_id, map_content_box, poly_box, ptln_box."""
    key = F.to_json(F.array("box.xmin", "box.ymin", "box.xmax", "box.ymax"))
    value = F.to_json(F.struct("description", F.col("name").alias("symbol name")))
    kinds = layout.withColumn("feature_type", F.explode(F.array(F.lit("line"), F.lit("point"), F.lit("polygon"))))
    # a key counts once, with the least of its values
    keyed = items.groupBy("map_id", "feature_type", key.alias("key")).agg(F.min(value).alias("value"))
    own = keyed.groupBy("map_id", "feature_type").agg(F.collect_list(F.struct("key", "value")).alias("e"))
    both = kinds.join(own, ["map_id", "feature_type"], "left")
    meta = F.array(*[F.struct(F.lit(c).alias("key"), F.to_json(F.col(c)).alias("value")) for c in ("map_content_box", "poly_box", "ptln_box")])
    entries = F.concat(F.coalesce("e", F.array().cast("array<struct<key:string,value:string>>")), meta)
    return both.select("map_id", "feature_type", F.to_json(F.map_from_entries(entries)).alias("json"))


def map_area_record(summary: DataFrame) -> DataFrame:
    """Bounds of the first region of each mask, y negated (SNK15). summary: of components."""
    first = summary.groupBy("map_id").agg(F.min_by(F.struct("col0", "row0", "col1", "row1"), "label").alias("b"))
    return first.select("map_id", F.col("b.col0").alias("xmin"), (-F.col("b.row1")).alias("ymin"), F.col("b.col1").alias("xmax"), (-F.col("b.row0")).alias("ymax"))
