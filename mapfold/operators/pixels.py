"""Pixel analytics on sparse tables.

pixels: map_id, row, col, r, g, b. masks: map_id, key, row, col, one row for each set pixel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapfold.functions import geometry as G
from mapfold.operators.components import connected_components
from mapfold.operators.run_labels import run_labels
from mapfold.operators.spatial import cell_join
from mapfold.session import written

KEYS = ["map_id", "key"]
AT = [*KEYS, "row", "col"]
BAND_BITS = 9  #: bits of a row's number inside a band, whose components are found by one task


def color_mask(pixels: DataFrame, colors: DataFrame, spread: int) -> DataFrame:
    """Pixels within spread of a legend colour on all channels (RAS1). colors: map_id, key, r, g, b; few per map."""
    c = colors.select("map_id", "key", *[F.col(x).alias("_" + x) for x in "rgb"])
    near = [F.col(x).between(F.greatest(F.lit(0), F.col("_" + x) - spread), F.least(F.lit(255), F.col("_" + x) + spread)) for x in "rgb"]
    return pixels.join(c, "map_id").filter(near[0] & near[1] & near[2]).select(*AT)


def hsv_mask(pixels: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int], second=None) -> DataFrame:
    """Pixels inside one or either of two HSV ranges (RAS2)."""
    h, s, v = G.hsv(F.col("r"), F.col("g"), F.col("b"))

    def inside(a, b) -> Column:
        return h.between(a[0], b[0]) & s.between(a[1], b[1]) & v.between(a[2], b[2])

    return pixels.filter(inside(low, high) | (inside(*second) if second else F.lit(False)))


def mask_runs(mask: DataFrame) -> DataFrame:
    """(map_id, key, row, c0, c1): runs of set pixels in a row (gaps and islands)."""
    order = Window.partitionBy(*KEYS, "row").orderBy("col")
    return mask.select(*AT).distinct().withColumn("_g", F.col("col") - F.row_number().over(order)).groupBy(*KEYS, "row", "_g").agg(F.min("col").alias("c0"), F.max("col").alias("c1")).drop("_g")


def labelled_runs(mask: DataFrame, diagonal: bool = False, bits: int = BAND_BITS) -> DataFrame:
    """Runs with the label of their component: its first run's (row, c0) (RAS3)."""
    rows = mask.select(*AT, F.shiftright("row", bits).alias("_band")).repartition(*KEYS, "_band").distinct()  # one shuffle for all
    order = Window.partitionBy(*KEYS, "_band", "row").orderBy("col")
    islands = rows.withColumn("_g", F.col("col") - F.row_number().over(order)).groupBy(*KEYS, "_band", "row", "_g")
    return _labelled(islands.agg(F.min("col").alias("c0"), F.max("col").alias("c1")).drop("_g"), diagonal, bits)


def _labelled(runs: DataFrame, diagonal: bool, bits: int = BAND_BITS) -> DataFrame:
    """runs (map_id, key, _band, row, c0, c1), dealt by band, with the label of their component.

    Components are found band by band; where some go on in the next band, their parts are
    joined in rounds.
    """
    reach = 1 if diagonal else 0
    at = [*KEYS, "_band", "row", "c0", "c1"]
    kinds = {c: runs.schema[c].dataType.simpleString() for c in at}
    told = ", ".join([*(f"{c} {k}" for c, k in kinds.items()), f"lrow {kinds['row']}", f"lcol {kinds['c0']}"])
    found = written(runs.select(*at).sortWithinPartitions(*at).mapInArrow(run_labels(reach), told))
    step = 64  # columns of a join cell
    spread = lambda df: df.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("c0") / step), F.floor((F.col("c1") + reach) / step))))
    edge = lambda row: F.pmod(row, F.lit(1 << bits)) == 0
    node = lambda p: F.struct("map_id", "key", F.col(p + "row").alias("row"), F.col(p + "col").alias("col"))
    above = spread(found.filter(edge(F.col("row") + 1))).select(*KEYS, (F.col("row") + 1).alias("row"), F.col("c0").alias("a0"), F.col("c1").alias("a1"), F.col("lrow").alias("arow"), F.col("lcol").alias("acol"), "_cell")
    touch = spread(found.filter(edge(F.col("row")))).join(above, [*KEYS, "row", "_cell"]).filter((F.col("c0") <= F.col("a1") + reach) & (F.col("a0") <= F.col("c1") + reach))
    across = touch.select(node("l").alias("a"), node("a").alias("b")).distinct()
    own = F.struct(F.col("lrow").alias("row"), F.col("lcol").alias("col"))
    if across.isEmpty():
        return found.select(*KEYS, "row", "c0", "c1", own.alias("label"))
    joined = connected_components(across).select(F.col("node.map_id").alias("map_id"), F.col("node.key").alias("key"), F.col("node.row").alias("lrow"), F.col("node.col").alias("lcol"), F.struct("component.row", "component.col").alias("label"))
    return found.join(joined, [*KEYS, "lrow", "lcol"], "left").select(*KEYS, "row", "c0", "c1", F.coalesce("label", own).alias("label"))


def component_summary(runs: DataFrame) -> DataFrame:
    """Area, bounding box and centroid of each component (RAS3)."""
    n = F.col("c1") - F.col("c0") + 1
    s = runs.groupBy(*KEYS, "label").agg(F.sum(n).alias("area"), F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("c0").alias("col0"), F.max("c1").alias("col1"), F.sum(n * F.col("row")).alias("_r"), F.sum(n * (F.col("c0") + F.col("c1")) / 2).alias("_c"))
    return s.withColumns({"center_row": F.col("_r") / F.col("area"), "center_col": F.col("_c") / F.col("area")}).drop("_r", "_c")


def pixels_of(runs: DataFrame) -> DataFrame:
    return runs.select(*KEYS, "row", F.explode(F.sequence("c0", "c1")).alias("col"))


def merged_runs(runs: DataFrame) -> DataFrame:
    """Runs (map_id, key, row, c0, c1) of all pixels that some of runs cover."""
    order = Window.partitionBy(*KEYS, "row").orderBy("c0")
    before = F.max("c1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("c0") <= before + 1, 0).otherwise(1)
    islands = runs.select(*KEYS, "row", "c0", "c1", new.alias("_new")).withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*KEYS, "row", "_g").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1")).drop("_g")


def _largest_runs(mask: DataFrame) -> DataFrame:
    runs = labelled_runs(mask)
    best = component_summary(runs).groupBy(*KEYS).agg(F.max_by("label", F.struct("area", F.struct(-F.col("label.row"), -F.col("label.col")))).alias("label"))
    return runs.join(best, [*KEYS, "label"], "left_semi").select(*KEYS, "row", "c0", "c1")


def largest_component(mask: DataFrame) -> DataFrame:
    """Pixels of the largest component of each mask (AGG16, WIN9)."""
    return pixels_of(_largest_runs(mask))


def nearest_palette(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """Palette key of each pixel after a 5 x 5 mean of colour distances (RAS4).

    Beyond its edges a map goes on as its mirror image, the edge pixels included; where
    pixels are missing inside, means are over the neighbours there are. Distances count to
    nine decimals, equal ones go to the first key.
    """
    # keys of one colour are as far from every pixel: the first of them stands for all, so that no rounding parts them
    p = palette.groupBy("map_id", *[F.col(x).alias("_" + x) for x in "rgb"]).agg(F.min("key").alias("key"))
    d = lambda x: F.abs(F.col(x) - F.col("_" + x))
    rgb = F.sqrt(d("r") ** 2 + d("g") ** 2 + d("b") ** 2)
    diff = F.abs((F.col("r") - F.col("g")) - (F.col("_r") - F.col("_g"))) + F.abs((F.col("g") - F.col("b")) - (F.col("_g") - F.col("_b")))
    dist = pixels.join(p, "map_id").select(*AT, (0.95 * rgb + 0.05 * diff).alias("d"))
    ends = pixels.groupBy("map_id").agg(*[f(c).alias(f"_{c}{n}") for c in ("row", "col") for n, f in ((0, F.min), (1, F.max))])
    mirrored = lambda c: F.explode(
        F.filter(F.array(F.col(c), 2 * F.col(f"_{c}0") - 1 - F.col(c), 2 * F.col(f"_{c}1") + 1 - F.col(c)), lambda x: x.between(F.col(f"_{c}0") - 2, F.col(f"_{c}1") + 2))
    )
    dist = dist.join(ends, "map_id").withColumn("row", mirrored("row")).withColumn("col", mirrored("col"))
    around = [(a, b) for a in range(-2, 3) for b in range(-2, 3)]
    moved = dist.select(*KEYS, F.inline(F.array(*[F.struct((F.col("row") + a).alias("row"), (F.col("col") + b).alias("col"), F.col("d").alias("d")) for a, b in around])))
    mean = moved.groupBy(*AT).agg(F.avg("d").alias("d")).join(pixels.select("map_id", "row", "col"), ["map_id", "row", "col"], "left_semi")
    return mean.groupBy("map_id", "row", "col").agg(F.min_by("key", F.struct(F.round("d", 9), "key")).alias("key"))


def filled_rings(rings: DataFrame) -> DataFrame:
    """Pixels inside rings by scanlines (RAS5, SNK10). rings: map_id, key, ring closed; a pixel counts by its place on the line."""
    return _scanned(rings.withColumn("_id", F.monotonically_increasing_id()).select(*KEYS, "_id", F.explode(G.edges(F.col("ring"))).alias("e")))


def filled_polygons(polygons: DataFrame) -> DataFrame:
    """Pixels inside polygons with holes, by scanlines (RAS5). polygons: map_id, key, ring, holes, all closed."""
    rings = polygons.withColumn("_id", F.monotonically_increasing_id()).withColumn("_ring", F.explode(F.concat(F.array("ring"), "holes")))
    return _scanned(rings.select(*KEYS, "_id", F.explode(G.edges(F.col("_ring"))).alias("e")))


def _scanned(e: DataFrame) -> DataFrame:
    """Pixels between every other edge of what shares an _id, line by line."""
    low, high = F.least("e.a.y", "e.b.y"), F.greatest("e.a.y", "e.b.y")
    e = e.filter(F.ceil(low) < F.ceil(high)).withColumn("row", F.explode(F.sequence(F.ceil(low), F.ceil(high) - 1)))
    x = F.col("e.a.x") + (F.col("row") - F.col("e.a.y")) * (F.col("e.b.x") - F.col("e.a.x")) / (F.col("e.b.y") - F.col("e.a.y"))
    order = Window.partitionBy(*KEYS, "_id", "row").orderBy("x")
    spans = e.withColumn("x", x).withColumn("n", F.row_number().over(order)).withColumn("x1", F.lead("x").over(order)).filter("n % 2 = 1 AND x1 IS NOT NULL")
    c0, c1 = F.ceil("x"), F.ceil("x1") - 1
    return pixels_of(merged_runs(spans.filter(c0 <= c1).select(*KEYS, F.col("row").cast("int").alias("row"), c0.cast("int").alias("c0"), c1.cast("int").alias("c1"))))


def without_boxes(mask: DataFrame, boxes: DataFrame, side: float = 64.0) -> DataFrame:
    """Pixels outside every box of their map (RAS6, FLT4). boxes: map_id, box; equal ones count once."""
    b = boxes.select("map_id", F.col("box").alias("_b")).distinct()
    at = mask.select("map_id", "row", "col").distinct()
    x, y = F.col("col").cast("double"), F.col("row").cast("double")
    pairs = cell_join(at, b, ["map_id"], (x, y, x, y), tuple(F.col("_b")[c] for c in ("xmin", "ymin", "xmax", "ymax")), side)
    hit = pairs.filter(G.in_box(x, y, F.col("_b"))).select("map_id", "row", "col").distinct()
    return mask.join(hit.hint("merge"), ["map_id", "row", "col"], "left_anti").select(mask.columns)


def mask_and(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*AT).intersect(b.select(*AT))


def mask_or(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*AT).unionByName(b.select(*AT)).distinct()


def mask_minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*AT).distinct().join(b, AT, "left_anti")


def background(mask: DataFrame, sizes: DataFrame) -> DataFrame:
    """NOT: unset pixels of the frame of each (map, key). sizes: map_id, height, width (RAS7)."""
    frame = mask.select(*KEYS).distinct().join(sizes, "map_id")
    frame = frame.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    return frame.select(*KEYS, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).join(mask, AT, "left_anti")


def _background_runs(runs: DataFrame, sizes: DataFrame, bits: int = BAND_BITS) -> DataFrame:
    """background() of a mask's runs as runs, dealt by band: the gaps between the runs of each row of the frame."""
    frame = runs.select(*KEYS).distinct().join(sizes.select("map_id", F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width")).distinct(), "map_id").filter("height > 0 AND width > 0")
    edge = frame.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).select(*KEYS, "row", F.lit(-1).alias("c0"), F.lit(-1).alias("c1"), "width")
    inside = runs.filter("c1 >= 0 AND key IS NOT NULL").select(*KEYS, F.col("row").cast("int").alias("row"), F.greatest(F.col("c0").cast("int"), F.lit(0)).alias("c0"), F.col("c1").cast("int").alias("c1"), F.lit(None).cast("int").alias("width"))
    every = edge.unionByName(inside).withColumn("_band", F.shiftright("row", bits)).repartition(*KEYS, "_band")
    # frames of several sizes lie over each other; a row's edge comes first, the widest one counts
    order = Window.partitionBy(*KEYS, "_band", "row").orderBy("c0")
    width = F.max("width").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    gaps = every.withColumns({"_to": F.lead("c0").over(order), "_w": width}).select(*KEYS, "_band", "row", (F.col("c1") + 1).alias("c0"), (F.least(F.coalesce("_to", "_w"), "_w") - 1).alias("c1"), "_w")
    return gaps.filter("c0 <= c1 AND _w IS NOT NULL").drop("_w")


def _filled_runs(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """runs and, overlapping none of them, those of the background that the corner does not reach."""
    back = _labelled(_background_runs(runs, sizes), False)
    outside = back.filter("row = 0 AND c0 = 0").select(*KEYS, "label")
    return runs.unionByName(back.join(outside.hint("merge"), [*KEYS, "label"], "left_anti").select(*KEYS, "row", "c0", "c1"))


def holes_filled(mask: DataFrame, sizes: DataFrame) -> DataFrame:
    """The mask and the background that the corner does not reach (RAS8)."""
    return pixels_of(merged_runs(_filled_runs(mask_runs(mask), sizes)))


def _shifts(h: int, w: int) -> Column:
    at = [(a - h // 2, b - w // 2) for a in range(h) for b in range(w)]
    return F.array(*[F.struct((F.col("row") + a).alias("row"), (F.col("col") + b).alias("col")) for a, b in at])


def dilated(mask: DataFrame, h: int = 3, w: int = 3) -> DataFrame:
    """RAS9."""
    return mask.select(*KEYS, F.inline(_shifts(h, w))).distinct()


def eroded(mask: DataFrame, h: int = 3, w: int = 3) -> DataFrame:
    """RAS9: pixels whose whole neighbourhood is set."""
    return mask.select(*AT).distinct().select(*KEYS, F.inline(_shifts(h, w))).groupBy(*AT).agg(F.count("*").alias("n")).filter(F.col("n") == h * w).drop("n")


def opened(mask: DataFrame, h: int = 3, w: int = 3) -> DataFrame:
    return dilated(eroded(mask, h, w), h, w)


def overlap_ratios(mask: DataFrame) -> DataFrame:
    """(map_id, a, b, of_a, of_b): shares of two keys' masks in common (RAS10)."""
    size = mask.groupBy("map_id", "key").agg(F.count("*").alias("n"))
    both = mask.withColumnRenamed("key", "a").join(mask.withColumnRenamed("key", "b"), ["map_id", "row", "col"]).filter("a < b").groupBy("map_id", "a", "b").agg(F.count("*").alias("k"))
    both = both.join(size.select("map_id", F.col("key").alias("a"), F.col("n").alias("na")), ["map_id", "a"]).join(size.select("map_id", F.col("key").alias("b"), F.col("n").alias("nb")), ["map_id", "b"])
    return both.select("map_id", "a", "b", (F.col("k") / F.col("na")).alias("of_a"), (F.col("k") / F.col("nb")).alias("of_b"))


def settled_by_seeds(parts: DataFrame, seeds: DataFrame, near: float = 300.0, factor: float = 2.5) -> DataFrame:
    """Who keeps a disputed component: its own key if a seed of it is near or nearer than factor times the rival's (RAS11).

    parts: map_id, label, own, rival, center_row, center_col; seeds: map_id, key, row, col.
    """
    # places of a map meet once, however many components or seeds stand there
    s = seeds.select("map_id", "key", F.col("row").alias("sr"), F.col("col").alias("sc")).distinct()
    d = G.distance(F.col("center_row"), F.col("center_col"), F.col("sr"), F.col("sc"))
    at = ["center_row", "center_col"]

    def side(who: str, name: str) -> DataFrame:
        keys = ["map_id", who, *at]
        return parts.select(*keys).distinct().join(s.withColumnRenamed("key", who), ["map_id", who]).groupBy(*keys).agg(F.min(d).alias(name)).hint("merge")

    out = parts.join(side("own", "d_own"), ["map_id", "own", *at], "left").join(side("rival", "d_rival"), ["map_id", "rival", *at], "left").select(*parts.columns, "d_own", "d_rival")
    keep = (F.col("d_own") < near) | (F.col("d_own") < factor * F.coalesce("d_rival", F.lit(float("inf"))))
    return out.withColumn("winner", F.when(F.coalesce(keep, F.lit(False)), F.col("own")).otherwise(F.col("rival")))


def quantile_box(pixels: DataFrame, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """Quantiles of the channels of each key's pixels (AGG8, RAS12). pixels with key."""
    q = F.array(F.lit(low), F.lit(0.5), F.lit(high))
    return pixels.groupBy(*KEYS).agg(*[F.percentile(c, q).alias(c) for c in "rgb"])


def bridged_diagonals(mask: DataFrame) -> DataFrame:
    """Pixels that close a diagonal step of a thin line (RAS13): the one right of the upper pixel, from the mask as it is."""
    m = mask.select(*AT)
    down_right = m.join(m.select(*KEYS, (F.col("row") - 1).alias("row"), (F.col("col") - 1).alias("col")), AT).select(*KEYS, "row", (F.col("col") + 1).alias("col"))
    down_left = m.join(m.select(*KEYS, (F.col("row") - 1).alias("row"), (F.col("col") + 1).alias("col")), AT).select(*KEYS, "row", (F.col("col") - 1).alias("col"))
    lone = lambda df, d: df.join(m.select(*KEYS, (F.col("row") - 1).alias("row"), (F.col("col") + d).alias("col")), AT, "left_anti")
    return mask_or(mask, lone(down_right, 1).unionByName(lone(down_left, -1)))


def drawn_lines(lines: DataFrame, width: int = 2) -> DataFrame:
    """Lines as pixels (RAS14). lines: map_id, key, line."""
    p = lines.select(*KEYS, F.explode(G.along(F.col("line"), 1.0)).alias("p"))
    m = p.select(*KEYS, F.floor(F.col("p.y") + 0.5).cast("int").alias("row"), F.floor(F.col("p.x") + 0.5).cast("int").alias("col")).distinct()
    return dilated(m, width, width) if width > 1 else m


def rectangled(mask: DataFrame, allowed: DataFrame) -> DataFrame:
    """Every component as its bounding box, grown by one and cut to the allowed mask (RAS15)."""
    c = component_summary(labelled_runs(mask))
    full = c.select(*KEYS, F.explode(F.sequence("row0", "row1")).alias("row"), "col0", "col1").select(*KEYS, "row", F.explode(F.sequence("col0", "col1")).alias("col"))
    return mask_and(dilated(full), allowed)


def refined_legend_runs(mask: DataFrame, other: DataFrame, sizes: DataFrame) -> DataFrame:
    """The largest region without its holes, and the other legend class, as runs (RAS16)."""
    return merged_runs(_filled_runs(_largest_runs(mask), sizes).unionByName(mask_runs(other)))


def refined_legend(mask: DataFrame, other: DataFrame, sizes: DataFrame) -> DataFrame:
    """The same as pixels (RAS16)."""
    return pixels_of(refined_legend_runs(mask, other, sizes))


def text_mask(rings: DataFrame, right: int = 30) -> DataFrame:
    """Text rings as pixels, drawn out to the right (RAS17)."""
    return filled_rings(rings).select(*KEYS, "row", F.explode(F.sequence(F.col("col"), F.col("col") + right)).alias("col")).distinct()


def points_mask(points: DataFrame) -> DataFrame:
    """Points as pixels (SNK9). points: map_id, type, x, y."""
    return points.select("map_id", F.col("type").alias("key"), F.col("y").cast("int").alias("row"), F.col("x").cast("int").alias("col")).distinct()


def legend_color(pixels: DataFrame) -> DataFrame:
    """Median colour of each key, near-black and near-white pixels set aside, as hex (AGG6); black where nothing is left."""
    keep = lambda c: F.when(~((F.greatest("r", "g", "b") <= 30) | (F.least("r", "g", "b") >= 250)), F.col(c))
    med = [F.coalesce(F.percentile(keep(c), 0.5).cast("int"), F.lit(0)).alias(c) for c in "rgb"]
    return pixels.groupBy(*KEYS).agg(*med).withColumn("color", G.hex_color(F.col("r"), F.col("g"), F.col("b")))


def legend_pattern(pixels: DataFrame, least: float = 30.0) -> DataFrame:
    """solid where the middle two thirds of hues span little, else mixture (AGG7)."""
    h, _, _ = G.hsv(F.col("r"), F.col("g"), F.col("b"))
    q = pixels.groupBy(*KEYS).agg(F.percentile(h, F.array(F.lit(0.16), F.lit(0.84))).alias("q"))
    return q.select(*KEYS, F.when(F.col("q")[1] - F.col("q")[0] < least, "solid").otherwise("mixture").alias("pattern"))


def box_variance(pixels: DataFrame) -> DataFrame:
    """Variance over pixels and channels (AGG9)."""
    return pixels.select(*KEYS, F.explode(F.array("r", "g", "b")).alias("v")).groupBy(*KEYS).agg(F.var_pop("v").alias("variance"))


def area_ratios(pixels: DataFrame) -> DataFrame:
    """Shares of grey and black pixels of a map (AGG10)."""
    spread = F.greatest("r", "g", "b") - F.least("r", "g", "b")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return pixels.groupBy("map_id").agg(share(spread <= 10).alias("gray"), share(F.greatest("r", "g", "b") <= 60).alias("black"), F.count("*").alias("n"))


def color_distances(colors: DataFrame, n: int = 10, pad: float = 180.0) -> DataFrame:
    """The n smallest distances of each key's colour to others of its map, padded (AGG11)."""
    o = colors.select("map_id", F.col("key").alias("_k"), *[F.col(x).alias("_" + x) for x in "rgb"])
    d = F.sqrt(sum(((F.col(x) - F.col("_" + x)) ** 2 for x in "gb"), (F.col("r") - F.col("_r")) ** 2))
    near = colors.join(o, "map_id").filter("key != _k").groupBy(*KEYS).agg(F.slice(F.array_sort(F.collect_list(d)), 1, n).alias("d"))
    out = colors.select(*KEYS).join(near, KEYS, "left").withColumn("d", F.coalesce("d", F.array().cast("array<double>")))
    return out.select(*KEYS, F.slice(F.concat("d", F.array_repeat(F.lit(pad), n)), 1, n).alias("distances"))


def patches_with_pixels(mask: DataFrame, size: int) -> DataFrame:
    """Patches with a set pixel and their share of set ones (AGG21, FLT13)."""
    patch = mask.withColumns({"patch_row": F.floor(F.col("row") / size), "patch_col": F.floor(F.col("col") / size)})
    return patch.groupBy(*KEYS, "patch_row", "patch_col").agg(F.count("*").alias("n")).withColumn("coverage", F.col("n") / (size * size))


def dash_pattern(sizes: DataFrame) -> DataFrame:
    """Dash class of a line from its components' sizes (AGG13). sizes: map_id, key, size.

    Sizes of 2 or less and low outliers go; two clusters by means from 50 and 300; the
    bigger cluster's mean decides. Both clusters under three members: solid.
    """
    s = sizes.filter("size > 2")
    q = s.groupBy(*KEYS).agg(F.percentile("size", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    s = s.join(q, KEYS).filter(F.col("size") >= F.col("q")[0] - 1.5 * (F.col("q")[1] - F.col("q")[0])).select(*KEYS, F.col("size").cast("double").alias("size"))
    grouped = s.groupBy(*KEYS).agg(F.collect_list("size").alias("v"))

    def mean(v: Column, low: bool, a: Column) -> Column:
        own = F.filter(v, lambda x: (F.abs(x - a["lo"]) <= F.abs(x - a["hi"])) == F.lit(low))
        return F.coalesce(F.try_divide(F.aggregate(own, F.lit(0.0), lambda t, x: t + x), F.size(own)), a["lo"] if low else a["hi"])

    means = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.struct(F.lit(50.0).alias("lo"), F.lit(300.0).alias("hi")), lambda a, _: F.struct(mean(F.col("v"), True, a).alias("lo"), mean(F.col("v"), False, a).alias("hi")))
    g = grouped.withColumn("m", means).withColumn("n_lo", F.size(F.filter("v", lambda x: F.abs(x - F.col("m.lo")) <= F.abs(x - F.col("m.hi"))))).withColumn("n_hi", F.size("v") - F.col("n_lo"))
    centre = F.when(F.col("n_lo") >= F.col("n_hi"), F.col("m.lo")).otherwise(F.col("m.hi"))
    kind = F.when((F.col("n_lo") < 3) & (F.col("n_hi") < 3), "solid").when((centre > 15) & (centre < 100), "dashed").when((centre > 0) & (centre <= 15), "dotted").otherwise("solid")
    return sizes.select(*KEYS).distinct().join(g.select(*KEYS, kind.alias("pattern")), KEYS, "left").fillna("solid", ["pattern"])


def dash_pattern_by_rule(sizes: DataFrame) -> DataFrame:
    """The older rule (AGG14)."""
    s = sizes.groupBy(*KEYS).agg(F.avg(F.when(F.col("size") > 5, F.col("size"))).alias("mean"), F.max("size").alias("top"), F.count_if(F.col("size") > 5).alias("n"))
    kind = F.when((F.col("top") > 200) | (F.col("n") <= 1), "solid").when((F.abs(F.col("mean") - 20) < 10) | (F.col("n") >= 4), "dotted").otherwise("dash")
    return s.select(*KEYS, kind.alias("pattern"))
