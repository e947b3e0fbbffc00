"""Whole stages over many maps at once, as DataFrames in and out (survey sections 3.2 to 3.5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapfold.functions import geometry as G
from mapfold.functions import text as T
from mapfold.operators import georef, matching, spatial
from mapfold.sources import writers


def stitch_labels(patches: DataFrame) -> DataFrame:
    """Text labels of patches in map coordinates, rings closed, numbered (SRC3, GEO1, GEO6, SET1).

    patches: map_id, patch_row, patch_col (offsets in pixels), text, score, ring.
    """
    ring = G.closed(G.shift_ring(F.col("ring"), F.col("patch_col"), F.col("patch_row")))
    order = Window.partitionBy("map_id").orderBy("patch_row", "patch_col", "text", "score")
    return patches.withColumn("ring", ring).withColumn("label_id", F.row_number().over(order)).select("map_id", "label_id", "text", "score", "ring")


def label_pipeline(patches: DataFrame, lexicon: DataFrame, gcps: DataFrame, polygons: DataFrame, least_score: float = 0.1) -> DataFrame:
    """Stitch, correct spelling, place and link labels of all maps (3.2): map_id, label_id, text, corrected, lon, lat, polygon_ids.

    Words are corrected once each, however many labels have them; labels without control
    points have no place and no link.
    """
    labels = stitch_labels(patches.filter(F.col("score") >= least_score))
    words = labels.filter(~T.ascii_only(F.col("text")).rlike(r"^\d+$")).select(F.explode(F.split("text", r"\s+")).alias("word")).distinct()
    fixed = matching.correct_words(words, lexicon)
    parts = labels.select("map_id", "label_id", F.posexplode(F.split("text", r"\s+")).alias("pos", "word")).join(fixed, "word", "left")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("corrected", "word").alias("w")))), lambda x: x["w"]), " ")
    corrected = parts.groupBy("map_id", "label_id").agg(joined.alias("corrected"))
    coefficients = georef.affine_from_gcps(gcps)
    placed = georef.apply_affine(labels.withColumnRenamed("ring", "geom"), coefficients)
    box = G.ring_bbox(F.col("geom"))
    lon, lat = G.box_center(box["xmin"], box["ymin"], box["xmax"], box["ymax"])
    key = F.struct("map_id", "label_id")
    named = placed.join(corrected, ["map_id", "label_id"]).select(key.alias("label_id"), F.col("corrected").alias("text"), F.col("geom").alias("ring"))
    links = spatial.link_labels(named, polygons).select("label_id.*", "polygon_ids")
    out = labels.drop("ring").join(corrected, ["map_id", "label_id"], "left").join(placed.select("map_id", "label_id", lon.alias("lon"), lat.alias("lat")), ["map_id", "label_id"], "left")
    return out.join(links, ["map_id", "label_id"], "left")


def locate_titles(titles: DataFrame, topo: DataFrame, corners: DataFrame, use_bm25: bool = False) -> tuple[DataFrame, DataFrame]:
    """(ten best sheets of each title, four control points of each map) (3.3, REF5, TXT6-TXT10, WIN1, WIN2).

    titles: map_id, title; topo: row_id, map_name, county_list, state, west, east, north,
    south; corners: map_id, row, col. Titles are cut to the gazetteer's own words first.
    """
    text = T.search_string(F.col("map_name"), F.col("county_list"), F.col("state"))
    gazetteer = topo.select("row_id", F.lower(text).alias("text"))
    known = gazetteer.select(F.explode(F.split("text", r"\s+")).alias("phrase")).distinct()
    toponyms = matching.find_phrases(titles.select(F.col("map_id").alias("text_id"), F.col("title").alias("text")), known)
    asked = toponyms.groupBy(F.col("text_id").alias("query_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "phrase"))), lambda x: x["phrase"]), " ").alias("text"))
    ranked = matching.bm25(asked, gazetteer) if use_bm25 else matching.fuzzy_top_k(asked, gazetteer)
    ranked = ranked.withColumnRenamed("query_id", "map_id")
    best = ranked.filter("rank = 1").join(topo, "row_id").select("map_id", "west", "east", "north", "south")
    return ranked, georef.corner_gcps(georef.ordered_corners(corners), best)


def point_features(patches: DataFrame, regions: DataFrame, text_rings: DataFrame, strikes: DataFrame, strike_types: list[str]) -> DataFrame:
    """Points of all patches in map coordinates, inside the map, off the text, with dip directions, numbered (3.4).

    patches: map_id, patch_row, patch_col, type, score, bbox of four numbers.
    """
    cx, cy = G.box_center_int(*[F.col("bbox")[k] for k in range(4)])
    x, y = G.shift(cx, cy, F.col("patch_col"), F.col("patch_row"))
    order = Window.partitionBy("map_id").orderBy("patch_row", "patch_col", "type", "bbox", "score")
    points = patches.withColumn("point_id", F.row_number().over(order)).select("map_id", "point_id", "type", F.col("score").cast("double").alias("score"), x.cast("double").alias("x"), y.cast("double").alias("y"))
    kept = spatial.points_off_text(spatial.points_in_region(points, regions), text_rings)
    dipped = spatial.copy_dip_direction(kept, strikes, strike_types)
    return dipped.withColumn("feature_id", F.row_number().over(Window.partitionBy("map_id", "type").orderBy("point_id")))


def delivery(maps: DataFrame, gcps: DataFrame, polygons: DataFrame, points: DataFrame, lines: DataFrame, georeferenced: bool = True, known: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The delivery tables, in the map frame through each map's control points or in pixels (3.5)."""
    if georeferenced:
        c = georef.affine_from_gcps(gcps)
        polygons, lines = georef.apply_affine(polygons, c), georef.apply_affine(lines, c)
        placed = georef.apply_affine(points.withColumn("geom", F.array(G.point(F.col("x"), F.col("y")))), c)
        points = placed.withColumns({"x": F.col("geom")[0]["x"], "y": F.col("geom")[0]["y"]}).drop("geom")
    return writers.delivery_tables(maps, gcps, polygons, points, lines, known)
