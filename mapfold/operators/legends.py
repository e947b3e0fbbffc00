"""Legend boxes, layout and table rules: aggregates, windows, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapfold.functions import geometry as G
from mapfold.session import written


def numbered(df: DataFrame, group: list[str], order: list[str], start: int = 0, name: str = "feature_id") -> DataFrame:
    """Serial ids inside groups (AGG1, WIN4)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) + (start - 1))


def all_text(labels: DataFrame) -> DataFrame:
    """All texts of a map in order, one string (AGG2). A map's labels are one sheet's."""
    return labels.groupBy("map_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("text"))


def height_threshold(boxes: DataFrame, sheets: DataFrame) -> DataFrame:
    """min(median, mean) * 0.8 of the heights of boxes under 80 % of the sheet, 20 without any (AGG3, FLT4)."""
    h = F.col("box.ymax") - F.col("box.ymin")
    kept = boxes.join(sheets, "map_id").filter(G.box_area(F.col("box")) <= 0.8 * F.col("height") * F.col("width"))
    t = kept.groupBy("map_id").agg((F.least(F.percentile(h, 0.5), F.avg(h)) * 0.8).alias("threshold"))
    return sheets.select("map_id").join(t, "map_id", "left").fillna(20.0, ["threshold"])


def stretched(boxes: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Boxes scaled by 1.1, low ones stretched to the threshold in height (GEO15)."""
    h = F.col("box.ymax") - F.col("box.ymin")
    sy = F.when(h < F.col("threshold"), F.try_divide(F.col("threshold"), h)).otherwise(F.lit(1.1))
    return boxes.join(thresholds, "map_id").withColumn("box", G.scale_box(F.col("box"), F.lit(1.1), sy)).drop("threshold")


def band_of_median(boxes: DataFrame, share: float = 0.66) -> DataFrame:
    """Boxes whose contour area lies strictly within a share around the median rectangle area of their map (FLT10)."""
    med = boxes.groupBy("map_id").agg(F.percentile(G.box_area(F.col("box")), 0.5).alias("_m"))
    a = F.col("contour_area")
    return boxes.join(med, "map_id").filter((a > F.col("_m") * (1 - share)) & (a < F.col("_m") * (1 + share))).drop("_m")


def ocr_filtered(boxes: DataFrame) -> DataFrame:
    """OCR boxes with a confidence; tall ones shrunk to 0.6, very tall ones dropped (FLT2). boxes: text, conf, left, top, width, height."""
    b = boxes.filter("conf >= 0")
    tall = F.col("height") > 1.5 * F.col("width")
    b = b.withColumns({"top": F.when(tall, F.col("top") + 0.2 * F.col("height")).otherwise(F.col("top")), "height": F.when(tall, 0.6 * F.col("height")).otherwise(F.col("height"))})
    return b.filter("height <= 2 * width AND height <= 30")


def columns_by_gap(boxes: DataFrame, tolerance: float = 40.0) -> DataFrame:
    """Number of the column a box is in: a gap in x over the tolerance starts a new one (WIN7). boxes: map_id, box_id, x."""
    w = Window.partitionBy("map_id").orderBy("x", "box_id")
    new = F.when(F.col("x") - F.lag("x").over(w) > tolerance, 1).otherwise(0)
    return boxes.withColumn("_new", new).withColumn("column", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def column_extent(columns: DataFrame, rois: DataFrame, far: float = 1000.0) -> DataFrame:
    """Right edge of each column: the next one's start if it is far, else the region's (WIN8). columns: map_id, column, x0."""
    nxt = F.lead("x0").over(Window.partitionBy("map_id").orderBy("x0"))
    return columns.withColumn("_n", nxt).join(rois.select("map_id", F.col("box.xmax").alias("_r")), "map_id").withColumn("x1", F.when(F.col("_n") - F.col("x0") > far, F.col("_n")).otherwise(F.col("_r"))).drop("_n", "_r")


def row_limits(boxes: DataFrame, sheets: DataFrame, more: float = 100.0) -> DataFrame:
    """Lower crop limit: the next row's top, at most y2 + 100 and the sheet's height (WIN5). boxes: map_id, column, box_id, y1, y2."""
    nxt = F.lead("y1").over(Window.partitionBy("map_id", "column").orderBy("y1", "y2", "box_id"))
    return boxes.withColumn("_n", nxt).join(sheets.select("map_id", "height"), "map_id").withColumn("limit", F.least(F.col("y2") + more, F.coalesce("_n", F.col("y2") + more), F.col("height"))).drop("_n", "height")


def thirds(boxes: DataFrame) -> DataFrame:
    """Which of three row ranges a box of a column falls in, by rank (WIN6)."""
    w = Window.partitionBy("map_id", "column")
    rank = F.row_number().over(w.orderBy("y1", "box_id")) - 1
    last = F.count("*").over(w) - 1
    cut = lambda k: F.floor(last * k / 3)
    return boxes.withColumn("part", F.when(rank < cut(1), 0).when(rank < cut(2), 1).otherwise(2))


def area_before_drop(areas: DataFrame) -> DataFrame:
    """The region just before the largest drop of sorted areas (WIN9). areas: map_id, region_id, area."""
    w = Window.partitionBy("map_id").orderBy(F.desc("area"), "region_id")
    drop = areas.withColumn("drop", F.col("area") - F.coalesce(F.lead("area").over(w), F.lit(0)))
    return drop.groupBy("map_id").agg(F.max_by("region_id", F.struct("drop", "area", -F.col("region_id"))).alias("region_id"))


def column_vote(boxes: DataFrame, seed: int = 7, tried: int = 7, least: int = 3) -> DataFrame:
    """Columns of which more than three of seven sampled boxes pass (FLT15). boxes: map_id, column, box_id, variance, n_chars."""
    w = Window.partitionBy("map_id", "column").orderBy(F.xxhash64("box_id", F.lit(seed)))
    some = boxes.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= tried)
    passed = some.groupBy("map_id", "column").agg(F.count_if((F.col("variance") >= 100) & (F.col("n_chars") < 1000)).alias("passed"))
    return boxes.join(passed.filter(F.col("passed") > least).select("map_id", "column"), ["map_id", "column"], "left_semi")


def routed_lines(primary: DataFrame, second: DataFrame, words: tuple[str, ...] = ("fault", "thrust")) -> DataFrame:
    """Legend rows with a keyword, from a second source for maps without any in the first (FLT9, FLT18)."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.lower("description").contains(w) | F.lower("symbol").contains(w)
    first = primary.filter(hit)
    return first.unionByName(second.filter(hit).join(first.select("map_id").distinct(), "map_id", "left_anti"))


def sane_geometry(df: DataFrame, least_area: float = 1000.0) -> DataFrame:
    """Polygons that are not empty or tiny (FLT5, FLT6)."""
    return df.filter((F.size("geom") > 0) & (G.ring_area(F.col("geom")) > least_area))


def valid_detections(df: DataFrame, sheets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rings that can be kept, the others with a reason) (FLT17).

    Kept are closed rings inside their sheet that turn clockwise, have an area and neither
    cross nor touch themselves. reason is one of ring_fault, 'outside', 'turns' for the
    wrong way round, or 'missing' for a null ring or a sheet of unknown size.
    """
    d = df.join(sheets, "map_id", "left")
    inside = F.forall("ring", lambda p: (p["x"] >= 0) & (p["y"] >= 0) & (p["x"] <= F.col("width")) & (p["y"] <= F.col("height")))
    missing = F.col("ring").isNull() | inside.isNull()
    reason = F.when(missing, "missing").when(~inside, "outside").otherwise(F.coalesce(G.ring_fault(F.col("ring")), F.when(G.signed_area(F.col("ring")) > 0, "turns")))
    # equal rings on sheets of one size are judged once; as a struct, nulls are equal too
    d = d.withColumn("_k", F.struct("ring", "height", "width"))
    told = written(d.select("_k").distinct().select("_k", F.inline(F.array("_k"))).select("_k", reason.alias("reason")))
    d = d.join(told, "_k").drop("_k")
    return d.filter("reason IS NULL").drop("reason"), d.filter("reason IS NOT NULL")


def search_box(boxes: DataFrame, margin: float = 300.0, right: float = 1800.0) -> DataFrame:
    """Hull of the _line legend boxes of a map with margins (AGG20). boxes: map_id, label, box."""
    b = boxes.filter(F.col("label").endswith("_line"))
    return b.groupBy("map_id").agg((F.min("box.xmin") - margin).alias("xmin"), (F.min("box.ymin") - margin).alias("ymin"), (F.max("box.xmax") + right).alias("xmax"), (F.max("box.ymax") + margin).alias("ymax"))


def polygon_items(shapes: DataFrame, maps: DataFrame) -> DataFrame:
    """Polygon legend items of each map, 0 without any (AGG19). shapes: map_id, label."""
    n = shapes.groupBy("map_id").agg(F.count_if(F.col("label").contains("_poly")).alias("n"))
    return maps.select("map_id").join(n, "map_id", "left").fillna(0, ["n"])


def merged_dictionaries(rows: DataFrame) -> DataFrame:
    """One value for each key of a map, later regions win (SET8). rows: map_id, roi_seq, key, value."""
    return rows.groupBy("map_id", "key").agg(F.max_by("value", "roi_seq").alias("value"))


def shared_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both on the columns they share (SET1, SET2)."""
    both = [c for c in a.columns if c in b.columns]
    return a.select(*both).unionByName(b.select(*both))


def snapped(points: DataFrame) -> DataFrame:
    """Distinct places after truncation to integers (SET9)."""
    return points.select("map_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).distinct()


def distinct_models(rows: DataFrame) -> DataFrame:
    """Model files of each map, in first order (SET6). rows: map_id, models array."""
    return rows.select("map_id", F.transform(F.array_distinct("models"), lambda m: F.concat(m, F.lit(".pt"))).alias("models"))


def over_score(df: DataFrame, least: float, score: str = "score") -> DataFrame:
    """Scores may be text (FLT1)."""
    return df.filter(F.try_to_number(F.col(score), F.lit("9.999999")).cast("double") >= least if dict(df.dtypes)[score] == "string" else F.col(score) >= least)


def not_digits(text: Column) -> Column:
    """FLT7."""
    return ~text.rlike(r"^\d+$")


def data_keys(df: DataFrame, key: str = "key") -> DataFrame:
    """Legend keys that are boxes and not metadata: they hold a comma (FLT8)."""
    return df.filter(F.col(key).contains(","))


def with_statistics(tiles: DataFrame, statistics: DataFrame, name: str) -> DataFrame:
    """Tiles with the statistics of the key of their name (JN27). statistics: key and vectors."""
    return tiles.join(statistics.withColumnRenamed("key", name), name)
