"""Two-point lines of a class merged through the parts of them that other lines' buffers cover.

Lines: keys (a map and a class, say), seg_id, ax, ay, bx, by. Those with a null end or
without a length are no lines and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapfold.operators.components import connected_components
from mapfold.operators.spatial import cell_join, fitted_side
from mapfold.session import written

#: A gap of this share of a line counts as covered, so that rounding opens none.
SLACK = 1e-9
_ENDS = ("ax", "ay", "bx", "by")


def _clipped(low: Column, high: Column) -> tuple[Column, Column]:
    """The part from low to high of a line, nulls where it is empty."""
    t0, t1 = F.greatest(low, F.lit(0.0)), F.least(high, F.lit(1.0))
    return F.when(t0 <= t1, t0), F.when(t0 <= t1, t1)


def _between(at: Column, step: Column, top: Column) -> tuple[Column, Column]:
    """The shares t with 0 <= at + t * step <= top: low and high, low above high where there are none."""
    t, s = F.try_divide(-at, step), F.try_divide(top - at, step)
    always = (at >= 0) & (at <= top)
    low = F.when(step == 0, F.when(always, 0.0).otherwise(2.0)).otherwise(F.least(t, s))
    high = F.when(step == 0, F.when(always, 1.0).otherwise(-1.0)).otherwise(F.greatest(t, s))
    return low, high


def covered_part(line: list[Column], other: list[Column], buffer: float) -> Column:
    """struct(t0, t1): the part of a line within buffer of another, as shares of its length; nulls where there is none.

    The buffer of a line is convex, so the part is one stretch, from the least to the
    greatest share in the disc about either end or in the strip between. Both have a length.
    """
    (ax, ay, bx, by), (cx, cy, dx, dy) = line, other
    ux, uy, wx, wy = bx - ax, by - ay, dx - cx, dy - cy
    square, width = ux * ux + uy * uy, wx * wx + wy * wy

    def disc(x: Column, y: Column) -> tuple[Column, Column]:
        at = ((x - ax) * ux + (y - ay) * uy) / square
        off = ((x - ax) * uy - (y - ay) * ux) * ((x - ax) * uy - (y - ay) * ux) / square
        half = F.sqrt(F.greatest(buffer * buffer - off, F.lit(0.0)) / square)
        t0, t1 = _clipped(at - half, at + half)
        return F.when(off <= buffer * buffer, t0), F.when(off <= buffer * buffer, t1)

    along = _between((ax - cx) * wx + (ay - cy) * wy, ux * wx + uy * wy, width)
    reach = buffer * F.sqrt(width)
    across = _between((ay - cy) * wx - (ax - cx) * wy + reach, uy * wx - ux * wy, 2 * reach)
    strip = _clipped(F.greatest(along[0], across[0]), F.least(along[1], across[1]))
    found = (disc(cx, cy), disc(dx, dy), strip)  # least and greatest pass over the nulls of empty parts
    return F.struct(F.least(*[p[0] for p in found]).alias("t0"), F.greatest(*[p[1] for p in found]).alias("t1"))


def _box(prefix: str) -> tuple[Column, ...]:
    ax, ay, bx, by = (prefix + e for e in _ENDS)
    return F.least(ax, bx), F.least(ay, by), F.greatest(ax, bx), F.greatest(ay, by)


def _sound(lines: DataFrame) -> DataFrame:
    return lines.dropna(subset=list(_ENDS)).filter("ax != bx OR ay != by")


def _two_sides(lines: DataFrame, keys: list[str]) -> list[DataFrame]:
    return [lines.select(*keys, F.col("seg_id").alias(i), *[F.col(e).alias(p + e) for e in _ENDS]) for p, i in (("_l", "seg_id"), ("_r", "other"))]


def _near(a: tuple[Column, ...], b: tuple[Column, ...], reach: float = 0.0) -> Column:
    """The boxes come within reach of each other."""
    return (a[0] <= b[2] + reach) & (b[0] - reach <= a[2]) & (a[1] <= b[3] + reach) & (b[1] - reach <= a[3])


def covered_parts(lines: DataFrame, keys: list[str], buffer: float, side: float = 64.0) -> DataFrame:
    """(keys, seg_id, other, longer, t0, t1): the part of each line that each other line of its keys covers.

    longer says that the other line is longer, or as long with a smaller seg_id.
    """
    l, r = _two_sides(_sound(lines), keys)  # noqa: E741
    side = fitted_side(_sound(lines), keys, _box(""), side, buffer)
    pairs = cell_join(l, r, keys, _box("_l"), _box("_r"), side, buffer).filter("seg_id != other").filter(_near(_box("_l"), _box("_r"), buffer))
    own, far = ([F.col(p + e) for e in _ENDS] for p in ("_l", "_r"))
    square = lambda c: (c[2] - c[0]) * (c[2] - c[0]) + (c[3] - c[1]) * (c[3] - c[1])
    longer = (square(far) > square(own)) | ((square(far) == square(own)) & (F.col("other") < F.col("seg_id")))
    parts = pairs.select(*keys, "seg_id", "other", longer.alias("longer"), covered_part(own, far, buffer).alias("_p"))
    # inline instead of a filter, which would work out the part twice
    return parts.select(*keys, "seg_id", "other", "longer", F.inline(F.when(F.col("_p.t1") > F.col("_p.t0"), F.array("_p"))))


def _whole(parts: DataFrame, line: list[str], **counted: Column) -> DataFrame:
    """line with a flag for each kind of counted parts: their union leaves no gap in the line (gaps and islands)."""
    order = Window.partitionBy(*line).orderBy("t0", "t1").rowsBetween(Window.unboundedPreceding, -1)
    reached = {f"_to_{n}": F.coalesce(F.max(F.when(c, F.col("t1"))).over(order), F.lit(0.0)) for n, c in counted.items()}
    flags = [
        (~F.bool_or(c & (F.col("t0") > F.col(f"_to_{n}") + SLACK)) & (F.coalesce(F.max(F.when(c, F.col("t1"))), F.lit(0.0)) >= 1 - SLACK)).alias(n)
        for n, c in counted.items()
    ]
    return parts.withColumns(reached).groupBy(*line).agg(*flags)


def without_covered(lines: DataFrame, keys: list[str], buffer: float, side: float = 64.0) -> DataFrame:
    """Lines without those that the lines left, longer or shorter, cover between them (GRF18).

    The rule doesn't depend on the order of rows: from the shortest line on (of equally long
    ones the greatest seg_id first) a line goes where the union of the parts within buffer
    of lines that are still there is the whole of it. All at once in rounds: a line goes as
    soon as lines sure to stay for its turn cover it (longer ones, and shorter ones that have
    stayed), and stays as soon as the ones that may still be there don't; each round settles
    the shortest open line at least. seg_id is unique within keys. A line that is left out
    may have been covered by lines that went later, so what is left can be further away than
    buffer where lines drift.
    """
    line = [*keys, "seg_id"]
    lines = _sound(lines)
    parts = written(covered_parts(lines, keys, buffer, side))
    open_, gone, settled = parts, None, None
    while True:
        if settled is None:
            state = open_.withColumn("stays", F.lit(None).cast("boolean"))
        else:
            state = open_.join(settled, [*keys, "other"], "left")
        sure, may = F.col("longer") | F.coalesce("stays", F.lit(False)), F.col("longer") | F.coalesce("stays", F.lit(True))
        verdicts = written(_whole(state, line, covered=sure, coverable=may))
        now = verdicts.filter("covered OR NOT coverable")
        lost = verdicts.filter("covered").select(*line)
        gone = lost if gone is None else gone.unionByName(lost)
        fresh = now.select(*keys, F.col("seg_id").alias("other"), (~F.col("covered")).alias("stays"))
        settled = fresh if settled is None else settled.unionByName(fresh)
        if verdicts.filter("coverable AND NOT covered").isEmpty():
            return lines.join(gone, line, "left_anti")
        open_ = written(open_.join(now.select(*line), line, "left_anti"))


def touching_groups(lines: DataFrame, keys: list[str], side: float = 64.0) -> DataFrame:
    """lines with group, the least seg_id among the lines of the same keys that touch or cross one after the other (AGG15)."""
    lines = _sound(lines)
    l, r = _two_sides(lines, keys)  # noqa: E741
    side = fitted_side(lines, keys, _box(""), side)
    pairs = cell_join(l, r, keys, _box("_l"), _box("_r"), side).filter("seg_id < other")
    (ax, ay, bx, by), (cx, cy, dx, dy) = ([F.col(p + e) for e in _ENDS] for p in ("_l", "_r"))

    def turn(px, py, qx, qy, x, y) -> Column:
        return F.signum((qx - px) * (y - py) - (qy - py) * (x - px))

    # with boxes that meet, ends on both sides or on the line mean a common point, for parallel lines too
    meet = _near(_box("_l"), _box("_r"))
    apart = lambda p, q: turn(*p, *q[:2]) * turn(*p, *q[2:]) > 0
    touch = meet & ~apart((ax, ay, bx, by), (cx, cy, dx, dy)) & ~apart((cx, cy, dx, dy), (ax, ay, bx, by))
    node = lambda c: F.struct(*keys, F.col(c).alias("seg_id"))
    found = connected_components(pairs.filter(touch).select(node("seg_id").alias("a"), node("other").alias("b")))
    named = found.select(*[F.col(f"node.{k}").alias(k) for k in keys], F.col("node.seg_id").alias("seg_id"), F.col("component.seg_id").alias("group"))
    return lines.join(named, [*keys, "seg_id"], "left").withColumn("group", F.coalesce("group", "seg_id"))


def merged_by_class(lines: DataFrame, keys: list[str], buffer: float, side: float = 64.0) -> DataFrame:
    """Lines that are left of each class, with the group of those that touch (AGG15, GRF18)."""
    return touching_groups(written(without_covered(lines, keys, buffer, side)), keys, side)
