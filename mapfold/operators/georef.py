"""Georeferencing: control points, transforms, map centres."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapfold.functions import geometry as G
from mapfold.operators.components import connected_components
from mapfold.operators.matching import top_k
from mapfold.operators.spatial import cell_join


def affine_from_gcps(gcps: DataFrame, use_all: bool = False) -> DataFrame:
    """(map_id, a..f) of the affine transform through control points (REF1). gcps: map_id, gcp_id, px, py, mx, my.

    The first three points of a map, or least squares over all: normal-equation sums and a
    closed 3 x 3 solution in columns. Collinear points give nulls.
    """
    if not use_all:
        first = Window.partitionBy("map_id").orderBy("gcp_id")
        gcps = gcps.withColumn("_n", F.row_number().over(first)).filter("_n <= 3")
    s = lambda c: F.sum(c.cast("double"))
    x, y = F.col("px"), F.col("py")
    terms = {"n": F.count("*").cast("double"), "x": s(x), "y": s(y), "xx": s(x * x), "xy": s(x * y), "yy": s(y * y)}
    for m in ("mx", "my"):
        terms |= {m: s(F.col(m)), f"{m}x": s(F.col(m) * x), f"{m}y": s(F.col(m) * y)}
    t = gcps.groupBy("map_id").agg(*[c.alias("_" + k) for k, c in terms.items()])
    v = {k: F.col("_" + k) for k in terms}
    det3 = lambda a, b, c: a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])
    rows = [[v["xx"], v["xy"], v["x"]], [v["xy"], v["yy"], v["y"]], [v["x"], v["y"], v["n"]]]
    whole = det3(*rows)

    def solve(m: str, k: int):
        right = [v[m + "x"], v[m + "y"], v[m]]
        return F.try_divide(det3(*[[right[i] if j == k else rows[i][j] for j in range(3)] for i in range(3)]), whole)

    return t.select("map_id", *[solve(m, k).alias(n) for m, names in (("mx", "abc"), ("my", "def")) for k, n in enumerate(names)])


def apply_affine(features: DataFrame, coefficients: DataFrame, flip_y: bool = False) -> DataFrame:
    """features (map_id, geom) in map coordinates (REF2, GEO9); one row of coefficients a map."""
    c = coefficients.select("map_id", F.struct(*"abcdef").alias("_c"))
    return features.join(c, "map_id").withColumn("geom", G.affine_ring(F.col("geom"), F.col("_c"), flip_y)).drop("_c")


def _spline(r2: np.ndarray) -> np.ndarray:
    return np.where(r2 > 0, r2 * np.log(np.maximum(r2, 1e-300)), 0.0)


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    p, m = pdf[["px", "py"]].to_numpy(float), pdf[["mx", "my"]].to_numpy(float)
    method = pdf["transformation_method"].iloc[0]
    one = np.ones(len(p))
    if method == "tps":
        tail = np.column_stack([one, p])
        k = _spline(((p[:, None] - p[None]) ** 2).sum(-1))
        full = np.block([[k, tail], [tail.T, np.zeros((3, 3))]])
        w = np.linalg.lstsq(full, np.vstack([m, np.zeros((3, 2))]), rcond=None)[0]
        knots = p.ravel()
    else:
        x, y = p.T
        basis = [one, x, y] + ([x * y, x * x, y * y] if method == "polynomial2" else [])
        w, knots = np.linalg.lstsq(np.column_stack(basis), m, rcond=None)[0], np.zeros(0)
    return pd.DataFrame({"map_id": [pdf["map_id"].iloc[0]], "method": [method], "wx": [w[:, 0]], "wy": [w[:, 1]], "knots": [knots]})


def warp(points: DataFrame, gcps: DataFrame) -> DataFrame:
    """points (map_id, x, y) warped by each map's own method, with web Mercator (REF3, GEO11).

    Fitting sees a map's few control points; applying is columns over coefficient arrays.
    gcps carry transformation_method: affine, polynomial2 or tps.
    """
    fit = gcps.groupBy("map_id").applyInPandas(_fit, "map_id long, method string, wx array<double>, wy array<double>, knots array<double>")
    x, y = F.col("x"), F.col("y")
    low, high = F.array(F.lit(1.0), x, y), F.array(F.lit(1.0), x, y, x * y, x * x, y * y)

    def knot(i):
        dx, dy = x - F.get("knots", 2 * i), y - F.get("knots", 2 * i + 1)
        r2 = dx * dx + dy * dy
        return F.when(r2 > 0, r2 * F.log(r2)).otherwise(0.0)

    n = (F.size("knots") / 2).cast("int")
    basis = F.when(F.col("method") == "polynomial2", high).when(F.col("method") == "tps", F.concat(F.transform(F.sequence(F.lit(0), n - 1), knot), low)).otherwise(low)
    dot = lambda w: F.aggregate(F.zip_with("_basis", w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    out = points.join(fit, "map_id").withColumn("_basis", basis).withColumns({"lon": dot("wx"), "lat": dot("wy")})
    mx, my = G.mercator(F.col("lon"), F.col("lat"))
    return out.withColumns({"mx": mx, "my": my}).drop("method", "wx", "wy", "knots", "_basis")


def ordered_corners(corners: DataFrame) -> DataFrame:
    """(map_id, top_left, top_right, bottom_right, bottom_left) of four corners by sum and difference (GEO17)."""
    p, s, d = F.struct("row", "col"), F.col("row") + F.col("col"), F.col("col") - F.col("row")
    return corners.groupBy("map_id").agg(F.min_by(p, s).alias("top_left"), F.max_by(p, d).alias("top_right"), F.max_by(p, s).alias("bottom_right"), F.min_by(p, d).alias("bottom_left"))


def corner_gcps(corners: DataFrame, matches: DataFrame) -> DataFrame:
    """Four control points of each map from its corners and the bounds of its best sheet (GEO18, REF5). matches: map_id, west, east, north, south."""
    at = lambda c, lon, lat: F.struct(F.col(c)["col"].cast("double").alias("px"), F.col(c)["row"].cast("double").alias("py"), F.col(lon).alias("mx"), F.col(lat).alias("my"))
    rows = F.array(at("top_left", "west", "north"), at("top_right", "east", "north"), at("bottom_right", "east", "south"), at("bottom_left", "west", "south"))
    out = corners.join(matches, "map_id").select("map_id", F.posexplode(rows).alias("gcp_id", "g"))
    return out.select("map_id", (F.col("gcp_id") + 1).alias("gcp_id"), "g.*")


def map_bounds(gcps: DataFrame) -> DataFrame:
    """Geographic and image extents of each map (REF6)."""
    return gcps.groupBy("map_id").agg(*[f(c).alias(f"{c}_{n}") for c in ("px", "py", "mx", "my") for n, f in (("min", F.min), ("max", F.max))])


def map_center(places: DataFrame, within_km: float = 1.5, largest: bool = False) -> DataFrame:
    """(map_id, lat, lng): the most central place of a map's first, or largest, cluster (REF7, SET7, GEO21).

    places: map_id, seq, lat, lng. Places up to within_km apart are in one cluster. Cells are
    of latitude and of longitude at 85 degrees at most, so every close pair shares one.
    """
    p = places.filter("lat IS NOT NULL AND lng IS NOT NULL").groupBy("map_id", "lat", "lng").agg(F.min("seq").alias("seq"))
    reach = within_km / 110.0
    stretch = F.greatest(F.cos(F.radians("lat")), F.lit(0.05))
    a = p.select("map_id", F.col("seq").alias("a"), F.col("lat").alias("alat"), F.col("lng").alias("alng"), stretch.alias("_s"))
    b = p.select("map_id", F.col("seq").alias("b"), F.col("lat").alias("blat"), F.col("lng").alias("blng"))
    wide = reach / F.col("_s") * 1.05
    pairs = cell_join(a, b, ["map_id"], (F.col("alng") - wide, F.col("alat"), F.col("alng") + wide, F.col("alat")), (F.col("blng"), F.col("blat"), F.col("blng"), F.col("blat")), max(reach * 4, 0.05), reach)
    close = pairs.filter((F.col("a") < F.col("b")) & (G.great_circle_km(F.col("alat"), F.col("alng"), F.col("blat"), F.col("blng")) <= within_km))
    node = lambda c: F.struct("map_id", F.col(c).alias("seq"))
    comp = connected_components(close.select(node("a").alias("a"), node("b").alias("b"))).select("node.*", F.col("component.seq").alias("cluster"))
    p = p.join(comp, ["map_id", "seq"], "left").withColumn("cluster", F.coalesce("cluster", "seq"))
    stats = p.groupBy("map_id", "cluster").agg(F.count("*").alias("n"), F.avg("lat").alias("clat"), F.avg("lng").alias("clng"))
    rank = F.struct(-F.col("n"), F.col("cluster")) if largest else F.col("cluster")
    chosen = stats.groupBy("map_id").agg(F.min_by(F.struct("cluster", "clat", "clng"), rank).alias("c")).select("map_id", "c.*")
    d = G.great_circle_km(F.col("lat"), F.col("lng"), F.col("clat"), F.col("clng"))
    best = p.join(chosen, ["map_id", "cluster"]).groupBy("map_id").agg(F.min_by(F.struct("lat", "lng"), F.struct(d, "seq")).alias("m"))
    return places.select("map_id").distinct().join(best.select("map_id", "m.*"), "map_id", "left")


def best_base_map(similarities: DataFrame) -> DataFrame:
    """Base map with the highest summed keypoint similarity (REF8). similarities: geo_id, topo_id, sim."""
    total = similarities.groupBy("geo_id", "topo_id").agg(F.sum("sim").alias("sim"))
    return top_k(total, ["geo_id"], "sim", "topo_id", 1).drop("rank")
