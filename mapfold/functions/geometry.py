"""Geometry as Column functions: points are x, y columns or structs, rings arrays of structs.

Everything is built-in expressions, so plans stay in whole-stage code or at least in the
JVM. The survey's operator numbers stand in brackets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6378137.0  #: radius of the web Mercator sphere
EARTH_KM = 6371.0088  #: mean radius for great-circle distances


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def each(ring: Column, f) -> Column:
    """ring with (x, y) of every vertex replaced by f(x, y)."""
    return F.transform(ring, lambda p: point(*f(p["x"], p["y"])))


# --- boxes


def shift(x: Column, y: Column, col_offset: Column, row_offset: Column, row_first: bool = False) -> tuple[Column, Column]:
    """Patch-local to map coordinates (GEO1); lines carry (row, col) pairs, so their offsets swap."""
    return (x + row_offset, y + col_offset) if row_first else (x + col_offset, y + row_offset)


def shift_ring(ring: Column, col_offset: Column, row_offset: Column, row_first: bool = False) -> Column:
    return each(ring, lambda x, y: shift(x, y, col_offset, row_offset, row_first))


def box_center_int(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> tuple[Column, Column]:
    """Centre truncated to pixels (GEO2)."""
    return ((xmin + xmax) / 2).cast("int"), ((ymin + ymax) / 2).cast("int")


def box_center(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> tuple[Column, Column]:
    """Centre (GEO3)."""
    return (xmin + xmax) / 2.0, (ymin + ymax) / 2.0


def ring_bbox(ring: Column) -> Column:
    """Smallest box around a ring (GEO4)."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def box_from_center(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """cxcywh to corners (GEO5)."""
    return F.struct((cx - w / 2).alias("xmin"), (cy - h / 2).alias("ymin"), (cx + w / 2).alias("xmax"), (cy + h / 2).alias("ymax"))


def box_to_center(b: Column) -> Column:
    """Corners to cxcywh (GEO5)."""
    return F.struct(((b["xmin"] + b["xmax"]) / 2).alias("cx"), ((b["ymin"] + b["ymax"]) / 2).alias("cy"), (b["xmax"] - b["xmin"]).alias("w"), (b["ymax"] - b["ymin"]).alias("h"))


def box_ring(b: Column) -> Column:
    """Closed rectangle of a box."""
    corner = lambda x, y: point(b[x], b[y])
    return F.array(corner("xmin", "ymin"), corner("xmax", "ymin"), corner("xmax", "ymax"), corner("xmin", "ymax"), corner("xmin", "ymin"))


def box_area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["xmax"] - b["xmin"]) * F.greatest(F.lit(0.0), b["ymax"] - b["ymin"])


def box_overlap(a: Column, b: Column) -> Column:
    """Area of the intersection."""
    w = F.least(a["xmax"], b["xmax"]) - F.greatest(a["xmin"], b["xmin"])
    h = F.least(a["ymax"], b["ymax"]) - F.greatest(a["ymin"], b["ymin"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def box_iou(a: Column, b: Column, epsilon: float = 0.0) -> Column:
    """Intersection over union (GEO8); epsilon is added to the denominator."""
    inter = box_overlap(a, b)
    return F.try_divide(inter, box_area(a) + box_area(b) - inter + F.lit(epsilon))


def box_giou(a: Column, b: Column) -> Column:
    """Generalised intersection over union (GEO8)."""
    inter = box_overlap(a, b)
    union = box_area(a) + box_area(b) - inter
    hull = (F.greatest(a["xmax"], b["xmax"]) - F.least(a["xmin"], b["xmin"])) * (F.greatest(a["ymax"], b["ymax"]) - F.least(a["ymin"], b["ymin"]))
    return F.try_divide(inter, union) - F.try_divide(hull - union, hull)


def scale_box(b: Column, sx: Column, sy: Column) -> Column:
    """Scaled about its centre (GEO15)."""
    cx, cy = (b["xmin"] + b["xmax"]) / 2, (b["ymin"] + b["ymax"]) / 2
    w, h = (b["xmax"] - b["xmin"]) * sx / 2, (b["ymax"] - b["ymin"]) * sy / 2
    return F.struct((cx - w).alias("xmin"), (cy - h).alias("ymin"), (cx + w).alias("xmax"), (cy + h).alias("ymax"))


def in_box(x: Column, y: Column, b: Column) -> Column:
    """Point in a box, edges included (FLT3, JN4)."""
    return (x >= b["xmin"]) & (x <= b["xmax"]) & (y >= b["ymin"]) & (y <= b["ymax"])


def box_in_roi(box: Column, roi: Column, strict: bool = True) -> Column:
    """Box inside a region (FLT3). strict=False tests the upper left corner only."""
    corner = in_box(box["xmin"], box["ymin"], roi)
    return corner & in_box(box["xmax"], box["ymax"], roi) if strict else corner


# --- rings and lines


def closed(ring: Column) -> Column:
    """The ring with its first vertex again at the end (GEO6)."""
    return F.when(F.size(ring) == 0, ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def edges(ring: Column) -> Column:
    """Pairs (a, b) of consecutive vertices."""
    n = F.size(ring)
    return F.when(n < 2, F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>")).otherwise(
        F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    )


def signed_area(ring: Column) -> Column:
    """Shoelace area of a closed ring, positive when counter-clockwise with y up (GEO7)."""
    return F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def ring_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def clockwise(ring: Column) -> Column:
    """Reversed when counter-clockwise (GEO20)."""
    return F.when(signed_area(ring) > 0, F.reverse(ring)).otherwise(ring)


def valid_ring(ring: Column) -> Column:
    """At least three different places, and an area (GEO20)."""
    return (F.size(F.array_distinct(ring)) >= 3) & (ring_area(ring) > 0)


def ring_fault(ring: Column) -> Column:
    """What is wrong with a closed ring, null if nothing is (GEO20, FLT17).

    'points' under three places, 'open' where it doesn't end at its start, 'spike' where an
    edge turns back over the one before, 'crosses' where two edges that aren't neighbours
    cross, 'touches' where they share a point, 'area' where it has none. Doubled vertices
    count once. Each edge is held against those after its next, so a ring costs its size squared.
    """
    places = F.filter(ring, lambda p, i: (i == 0) | (p != F.get(ring, i - 1)))
    e = edges(places)
    n = F.size(e)
    ends = lambda a: (a["a"]["x"], a["a"]["y"], a["b"]["x"], a["b"]["y"])
    after = lambda i: F.get(e, (i + 1) % n)

    def turns_back(a: Column, b: Column) -> Column:
        ux, uy, vx, vy = a["b"]["x"] - a["a"]["x"], a["b"]["y"] - a["a"]["y"], b["b"]["x"] - b["a"]["x"], b["b"]["y"] - b["a"]["y"]
        return (ux * vy == uy * vx) & (ux * vx + uy * vy < 0)

    # the last edge is a neighbour of the first
    rest = lambda i: F.slice(e, i + 3, F.greatest(n - i - 2 - F.when(i == 0, 1).otherwise(0), F.lit(0)))
    some = lambda test: F.exists(F.transform(e, lambda a, i: F.exists(rest(i), lambda b: test(*ends(a), *ends(b)))), lambda x: x)
    spike = F.exists(F.transform(e, lambda a, i: turns_back(a, after(i))), lambda x: x)
    fault = F.when(F.size(F.array_distinct(ring)) < 3, "points").when(F.element_at(ring, 1) != F.element_at(ring, -1), "open")
    return fault.when(spike, "spike").when(some(segments_pass), "crosses").when(some(segments_meet), "touches").when(ring_area(ring) == 0, "area")


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test of a point against a closed ring."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = (b["x"] - a["x"]) * F.try_divide(y - a["y"], b["y"] - a["y"]) + a["x"]
        return F.when(((a["y"] > y) != (b["y"] > y)) & (x < at), 1).otherwise(0)

    return F.aggregate(edges(ring), F.lit(0), lambda s, e: s + crosses(e)) % 2 == 1


def swapped(line: Column) -> Column:
    """x and y exchanged (GEO14)."""
    return each(line, lambda x, y: (y, x))


def negated(line: Column) -> Column:
    """y negated (GEO14, REF4)."""
    return each(line, lambda x, y: (x, -y))


def rounded(ring: Column, digits: int = 0) -> Column:
    """Half to even, as Python rounds (GEO16)."""
    return each(ring, lambda x, y: (F.bround(x, digits), F.bround(y, digits)))


def scaled(ring: Column, sx: Column, sy: Column) -> Column:
    """Coordinates of a resized image back to the original (GEO26)."""
    return each(ring, lambda x, y: (x * sx, y * sy))


def line_length(line: Column) -> Column:
    return F.aggregate(edges(line), F.lit(0.0), lambda s, e: s + F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]))


def along(line: Column, step: float) -> Column:
    """Vertices at most step apart: every segment in equal parts (GEO27)."""

    def parts(e: Column) -> Column:
        a, b = e["a"], e["b"]
        n = F.greatest(F.lit(1), F.ceil(F.hypot(b["x"] - a["x"], b["y"] - a["y"]) / step).cast("int"))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: point(a["x"] + (b["x"] - a["x"]) * k / n, a["y"] + (b["y"] - a["y"]) * k / n))

    return F.concat(F.flatten(F.transform(edges(line), parts)), F.slice(line, -1, 1))


def pairs_to_ring(flat: Column) -> Column:
    """[x0, y0, x1, y1, ..] to vertices (SRC9)."""
    n = F.floor(F.size(flat) / 2).cast("int")
    ring = F.transform(F.sequence(F.lit(0), n - 1), lambda i: point(F.get(flat, 2 * i), F.get(flat, 2 * i + 1)))
    return F.when(n == 0, F.array().cast("array<struct<x:double,y:double>>")).otherwise(ring)


# --- transforms


def affine(x: Column, y: Column, c: Column) -> tuple[Column, Column]:
    """c holds a, b, c, d, e, f: (a x + b y + c, d x + e y + f) (GEO9)."""
    return c["a"] * x + c["b"] * y + c["c"], c["d"] * x + c["e"] * y + c["f"]


def affine_ring(ring: Column, c: Column, flip_y: bool = False) -> Column:
    return each(ring, lambda x, y: affine(x, -y if flip_y else y, c))


def inverse_affine(x: Column, y: Column, c: Column) -> tuple[Column, Column]:
    """Truncated pixel of a map coordinate (GEO10)."""
    det = c["a"] * c["e"] - c["b"] * c["d"]
    dx, dy = x - c["c"], y - c["f"]
    return F.try_divide(c["e"] * dx - c["b"] * dy, det).cast("int"), F.try_divide(c["a"] * dy - c["d"] * dx, det).cast("int")


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to web Mercator metres (GEO11)."""
    return lon * math.pi * EARTH_M / 180, F.log(F.tan((90 + lat) * math.pi / 360)) * EARTH_M


def inverse_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return x * 180 / (math.pi * EARTH_M), F.atan(F.exp(y / EARTH_M)) * 360 / math.pi - 90


def tile_number(lon: Column, lat: Column, zoom: Column) -> tuple[Column, Column]:
    """Fractional tile column and row (GEO12)."""
    n, rad = F.pow(F.lit(2.0), zoom), F.radians(lat)
    return (lon + 180) / 360 * n, (1 - F.asinh(F.tan(rad)) / math.pi) / 2 * n


def tile_corner(col: Column, row: Column, zoom: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a fractional tile number (GEO12)."""
    n = F.pow(F.lit(2.0), zoom)
    return col / n * 360 - 180, F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * row / n))))


def stitched_lonlat(x: Column, y: Column, col0: Column, row0: Column, zoom: Column, size: int = 256) -> tuple[Column, Column]:
    """Pixel of a stitched tile image to degrees, six decimals (GEO13)."""
    lon, lat = tile_corner(col0 + x / size, row0 + y / size, zoom)
    return F.round(lon, 6), F.round(lat, 6)


def region_pixel(lon: Column, lat: Column, r: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """Degrees to pixels of a region image, y down (GEO31)."""
    return (lon - r["west"]) / (r["east"] - r["west"]) * w, (r["north"] - lat) / (r["north"] - r["south"]) * h


def region_lonlat(x: Column, y: Column, r: Column, w: Column, h: Column) -> tuple[Column, Column]:
    return r["west"] + x / w * (r["east"] - r["west"]), r["north"] - y / h * (r["north"] - r["south"])


# --- distances and directions


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def flat_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in degrees with longitudes shrunk by the cosine of latitude (GEO21)."""
    dx = (lon1 - lon2) * F.cos(F.radians(lat1))
    return F.sqrt((lat1 - lat2) * (lat1 - lat2) + dx * dx)


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    s, t = F.sin((q - p) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(s * s + F.cos(p) * F.cos(q) * t * t)))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Point to segment (GEO22)."""
    dx, dy = bx - ax, by - ay
    t = F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    return distance(px, py, ax + t * dx, ay + t * dy)


def unit(dx: Column, dy: Column) -> tuple[Column, Column]:
    """Direction of length one (GEO23); null for no direction."""
    n = F.sqrt(dx * dx + dy * dy)
    return F.try_divide(dx, n), F.try_divide(dy, n)


def direction_cosine(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.try_divide(ax * bx + ay * by, F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by))


def angle_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """1 - cosine (GEO23)."""
    return 1 - direction_cosine(ax, ay, bx, by)


def _turn(ax, ay, bx, by, cx, cy) -> Column:
    return (cy - ay) * (bx - ax) > (by - ay) * (cx - ax)


def segments_cross(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Proper intersection of two segments (GEO24)."""
    return (_turn(ax, ay, cx, cy, dx, dy) != _turn(bx, by, cx, cy, dx, dy)) & (_turn(ax, ay, bx, by, cx, cy) != _turn(ax, ay, bx, by, dx, dy))


def _side_of(ax, ay, bx, by, px, py) -> Column:
    return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def segments_pass(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Either segment has its ends strictly on both sides of the other (GEO24)."""
    return (_side_of(ax, ay, bx, by, cx, cy) * _side_of(ax, ay, bx, by, dx, dy) < 0) & (_side_of(cx, cy, dx, dy, ax, ay) * _side_of(cx, cy, dx, dy, bx, by) < 0)


def segments_meet(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Two closed segments share a point, ends and overlaps included (GEO24, JN12)."""

    def on(px, py, qx, qy, x, y) -> Column:
        return (_side_of(px, py, qx, qy, x, y) == 0) & x.between(F.least(px, qx), F.greatest(px, qx)) & y.between(F.least(py, qy), F.greatest(py, qy))

    ends = on(cx, cy, dx, dy, ax, ay) | on(cx, cy, dx, dy, bx, by) | on(ax, ay, bx, by, cx, cy) | on(ax, ay, bx, by, dx, dy)
    return segments_pass(ax, ay, bx, by, cx, cy, dx, dy) | ends


def crossing_point(ax, ay, bx, by, cx, cy, dx, dy) -> tuple[Column, Column]:
    """Where the lines through two segments meet (GEO24); null when parallel."""
    det = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    t = F.try_divide((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx), det)
    return ax + t * (bx - ax), ay + t * (by - ay)


def ray_extension(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Length by which a-b must be extended past b to meet segment c-d, null if it does not (GEO25)."""
    det = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    t = F.try_divide((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx), det)
    u = F.try_divide((cx - ax) * (by - ay) - (cy - ay) * (bx - ax), det)
    return F.when((t >= 1) & (u >= 0) & (u <= 1), (t - 1) * distance(ax, ay, bx, by))


def dip_direction(strike: Column, wrap: bool = False) -> Column:
    """Strike in radians to dip direction in degrees (GEO30); raw, or wrapped to 0..360."""
    d = F.degrees(strike) + 90
    return F.pmod(d, F.lit(360.0)) if wrap else d


# --- colours


def hex_color(r: Column, g: Column, b: Column) -> Column:
    two = lambda c: F.lpad(F.hex(c.cast("int")), 2, "0")
    return F.lower(F.concat(F.lit("#"), two(r), two(g), two(b)))


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue 0..180, saturation and value 0..255 (RAS2)."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = (top - low).cast("double")
    hue = F.when(d == 0, 0.0).when(top == r, 60 * F.try_divide(g - b, d)).when(top == g, 120 + 60 * F.try_divide(b - r, d)).otherwise(240 + 60 * F.try_divide(r - g, d))
    hue = F.when(hue < 0, hue + 360).otherwise(hue)
    return F.round(hue / 2).cast("int"), F.round(F.coalesce(255 * F.try_divide(d, top), F.lit(0.0))).cast("int"), top.cast("int")
