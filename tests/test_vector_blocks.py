"""Blocks of vectors as matrices find what comparing pair by pair finds, odd rows and copies included."""

from __future__ import annotations

import math

import numpy as np
import pytest

from mapfold.operators import vector_blocks as VB
from mapfold.operators import vector_lists as VL
from mapfold.operators import vectors as V


def plainly(queries, rows, k):
    """Distances component by component; a null one is last, NaN before it."""
    out = []
    for q, x in queries:
        scored = []
        for i, y in rows:
            if i == q:
                continue
            short = x is None or y is None or len(x) != len(y) or any(c is None for c in x + y)
            s = 0.0
            for a, b in () if short else zip(x, y, strict=True):
                s += (a - b) * (a - b)
            scored.append((short, not short and math.isnan(s), None if short or math.isnan(s) else math.sqrt(s), i))
        scored.sort(key=lambda t: (t[0], t[1], 0.0 if t[2] is None else t[2], t[3]))
        out += [(q, n + 1, t[3], t[2]) for n, t in enumerate(scored[:k])]
    return sorted(out, key=lambda t: t[:2])


@pytest.mark.parametrize("size", [1 << 22, 64])
def test_blocks_against_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(V, "ROW_COMPONENTS", size)
    monkeypatch.setattr(V, "QUERY_COMPONENTS", size)
    monkeypatch.setattr(VL, "ROW_COMPONENTS", size)
    monkeypatch.setattr(VL, "QUERY_COMPONENTS", size)
    r = np.random.default_rng(3)
    rows = [(k, [float(v) for v in r.integers(0, 3, 4)]) for k in range(150)] + [(200 + k, [1.0, 1.0, 2.0, 0.0]) for k in range(40)]
    odd = [(300, None), (301, [1.0, None, 0.0, 1.0]), (302, [math.nan, 0.0, 0.0, 0.0]), (303, [math.inf, 0.0, 0.0, 0.0]), (304, [1.0, 2.0])]
    told = lambda df: sorted(((x.query_id, x["rank"], x.id, None if x.distance is None or math.isnan(x.distance) else x.distance) for x in df.collect()), key=lambda t: t[:2])
    frame = lambda x: spark.createDataFrame(x, "id long, vec array<double>")
    asked = rows[::15] + odd
    assert told(V.nearest(frame(asked), frame(rows + odd), 6, 3)) == plainly(asked, rows + odd, 6)
    some = [x for x in rows + odd if x[1] is not None]
    assert told(VL.nearest_by_lists(frame(asked), frame(rows + odd), 6)) == plainly([x for x in asked if x[1] is not None], some, 6)
    assert told(V.nearest(frame(asked), frame(rows[:3] + odd), 6)) == plainly(asked, rows[:3] + odd, 6)
    assert V.nearest(frame(asked), frame([]), 6).count() == 0


def test_copies_are_not_listed():
    r = np.random.default_rng(1)
    b = np.concatenate([np.repeat(r.normal(size=(3, 8)), 5000, axis=0), r.normal(size=(100, 8))])
    some = VB._few_copies(b, 4)
    assert len(some) == 115 and set(range(5)) <= set(some.tolist())
    assert len(VB.nearest_rows(b[:50], b[some], 4)[0]) < 50 * 12
