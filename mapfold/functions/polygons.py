"""Areas of polygon intersections (GEO7), for pairs that a box join has already narrowed.

A ring is cut into triangles by ears, and triangles of both rings are clipped against each
other, so concave rings are exact too; convex rings stay whole. Rings must not cross
themselves.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from mapfold.functions import geometry as G

Points = list[tuple[float, float]]


def _area(p: Points) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1], strict=True)) / 2


def _side(a, b, p) -> float:
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def _open(ring) -> Points:
    """Vertices counter-clockwise, without the closing one and doubles."""
    p = [(q["x"], q["y"]) for q in ring]
    p = [q for k, q in enumerate(p) if q != p[k - 1]]
    return p[::-1] if len(p) > 2 and _area(p) < 0 else p


def convex_parts(p: Points) -> list[Points]:
    """p itself when convex, else triangles."""
    n = len(p)
    if n < 3:
        return []
    if all(_side(p[k - 2], p[k - 1], p[k]) >= 0 for k in range(n)):
        return [p]
    rest, out = list(p), []
    while len(rest) > 3:
        for k in range(len(rest)):
            a, b, c = rest[k - 1], rest[k], rest[(k + 1) % len(rest)]
            if _side(a, b, c) <= 0:
                continue
            if not any(_side(a, b, q) >= 0 and _side(b, c, q) >= 0 and _side(c, a, q) >= 0 for q in rest if q not in (a, b, c)):
                out.append([a, b, c])
                del rest[k]
                break
        else:
            rest.pop()  # only flat corners are left
    return [*out, rest]


def clip(p: Points, window: Points) -> Points:
    """The part of p inside a convex window."""
    for a, b in zip(window, window[1:] + window[:1], strict=True):
        out = []
        for s, e in zip(p[-1:] + p[:-1], p, strict=True):
            ds, de = _side(a, b, s), _side(a, b, e)
            if (ds < 0) != (de < 0):
                t = ds / (ds - de)
                out.append((s[0] + t * (e[0] - s[0]), s[1] + t * (e[1] - s[1])))
            if de >= 0:
                out.append(e)
        p = out
        if not p:
            break
    return p


def overlap(a, b) -> float:
    return sum(abs(_area(c)) for x in convex_parts(_open(a)) for y in convex_parts(_open(b)) if len(c := clip(x, y)) > 2)


@F.pandas_udf(DoubleType())
def intersection_area(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else overlap(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def ring_iou(a: Column, b: Column) -> Column:
    inter = intersection_area(a, b)
    return F.try_divide(inter, G.ring_area(a) + G.ring_area(b) - inter)


def union_area(a: Column, b: Column) -> Column:
    return G.ring_area(a) + G.ring_area(b) - intersection_area(a, b)
