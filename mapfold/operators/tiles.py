"""Tilings of sheets. sheets: map_id, height, width."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def even_tiles(sheets: DataFrame, patch: int, stride: int, margin: int = 5) -> DataFrame:
    """Overlapping tiles with evenly spaced starts inside a margin (TIL1)."""
    n = lambda dim: F.greatest(F.floor(F.col(dim) / stride), F.lit(1))

    def start(dim: str, i):
        room = F.col(dim) - 2 * margin - patch
        return (margin + F.coalesce(F.try_divide(i * room, n(dim) - 1), F.lit(0.0))).cast("int")

    t = sheets.withColumn("tile_row", F.explode(F.sequence(F.lit(0).cast("long"), n("height") - 1))).withColumn("tile_col", F.explode(F.sequence(F.lit(0).cast("long"), n("width") - 1)))
    return t.withColumns({"y0": start("height", F.col("tile_row")), "x0": start("width", F.col("tile_col"))})


def grid_tiles(sheets: DataFrame, size: int) -> DataFrame:
    """Fixed grid, edge tiles padded (TIL2)."""
    last = lambda dim: F.ceil(F.col(dim) / size) - 1
    t = sheets.withColumn("tile_row", F.explode(F.sequence(F.lit(0).cast("long"), last("height")))).withColumn("tile_col", F.explode(F.sequence(F.lit(0).cast("long"), last("width"))))
    return t.withColumns({"y0": F.col("tile_row") * size, "x0": F.col("tile_col") * size})


def clipped_tiles(sheets: DataFrame, size: int, template: str) -> DataFrame:
    """Grid tiles cut at the edges, with a URL (TIL4, TIL5)."""
    t = grid_tiles(sheets, size).withColumns({"w": F.least(F.lit(size), F.col("width") - F.col("x0")), "h": F.least(F.lit(size), F.col("height") - F.col("y0"))})
    url = F.lit(template)
    for name in ("map_id", "x0", "y0", "w", "h"):
        url = F.replace(url, F.lit("{" + name + "}"), F.col(name).cast("string"))
    return t.withColumn("url", url)


def complete_only(tiles: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Tiles of groups that have every tile of their grid (TIL3, TIL6). expected: keys, n."""
    have = tiles.groupBy(*keys).agg(F.countDistinct("tile_row", "tile_col").alias("have"))
    good = expected.join(have, keys).filter("have = n").select(*keys)
    return tiles.join(good, keys, "left_semi")


def missing_tiles(expected: DataFrame, tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Tiles without a prediction (TIL6)."""
    return expected.join(tiles, [*keys, "tile_row", "tile_col"], "left_anti")


def content_tiles(tiles: DataFrame, areas: DataFrame, patch: int, least: int) -> DataFrame:
    """Tiles that overlap their map's content by at least so many pixels (FLT11). areas: map_id, box."""
    w = F.least(F.col("x0") + patch, F.col("box.xmax")) - F.greatest(F.col("x0"), F.col("box.xmin"))
    h = F.least(F.col("y0") + patch, F.col("box.ymax")) - F.greatest(F.col("y0"), F.col("box.ymin"))
    # shuffled: the areas grow with the maps, and Spark would size them by their compressed files and broadcast them
    return tiles.join(areas.hint("merge"), "map_id").filter((w > 0) & (h > 0) & (w * h >= least)).drop("box")


def graph_patches(tiles: DataFrame, edges: DataFrame, patch: int, least_edges: int = 5) -> DataFrame:
    """Edges with both ends in a tile, in its coordinates from 0 to 1 (TIL7, FLT12, GEO28). edges: map_id, ax, ay, bx, by."""
    side = float(patch)
    t = tiles.select("map_id", "tile_row", "tile_col", "x0", "y0")
    t = t.withColumn("_cx", F.explode(F.sequence(F.floor(F.col("x0") / side), F.floor((F.col("x0") + patch) / side)))).withColumn("_cy", F.explode(F.sequence(F.floor(F.col("y0") / side), F.floor((F.col("y0") + patch) / side))))
    e = edges.withColumns({"_cx": F.floor(F.col("ax") / side), "_cy": F.floor(F.col("ay") / side)})
    inside = lambda x, y: F.col(x).between(F.col("x0"), F.col("x0") + patch) & F.col(y).between(F.col("y0"), F.col("y0") + patch)
    hit = t.join(e, ["map_id", "_cx", "_cy"]).filter(inside("ax", "ay") & inside("bx", "by"))
    unit = lambda c, o: ((F.col(c) - F.col(o)) / patch).alias(c)
    hit = hit.select("map_id", "tile_row", "tile_col", unit("ax", "x0"), unit("ay", "y0"), unit("bx", "x0"), unit("by", "y0"))
    keys = ["map_id", "tile_row", "tile_col"]
    return hit.join(hit.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= least_edges).select(*keys), keys, "left_semi")


def split_large(runs: DataFrame, summary: DataFrame, limit: int = 3000, cell: int = 500) -> DataFrame:
    """Labels of components over limit on both sides, by grid cell (TIL8). Rows: map_id, key, label, row, col."""
    keys = ["map_id", "key", "label"]
    big = summary.filter((F.col("row1") - F.col("row0") > limit) & (F.col("col1") - F.col("col0") > limit)).select(*keys, F.lit(True).alias("_big"))
    part = F.when(F.col("_big"), F.struct(F.floor(F.col("row") / cell).alias("r"), F.floor(F.col("col") / cell).alias("c")))
    return runs.join(big, keys, "left").withColumn("part", part).drop("_big")


def tile_counts(sheets: DataFrame, size: int = 2048) -> DataFrame:
    """Tiles of each map and in all (AGG17)."""
    n = F.ceil(F.col("height") / size) * F.ceil(F.col("width") / size)
    return sheets.select("map_id", n.alias("n")).rollup("map_id").agg(F.sum("n").alias("n"))
