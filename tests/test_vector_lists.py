"""Inverted lists find what comparing everything finds."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mapfold.operators import vector_lists as VL
from mapfold.operators import vectors as V


@pytest.mark.parametrize("spread", [0.3, 50.0])
def test_lists_against_all_rows(spark, spread):
    r = np.random.default_rng(5)
    centres = r.normal(size=(9, 8)) * 10
    rows = [(k, [float(v) for v in centres[k % 9] + r.normal(size=8) * spread], k) for k in range(400)]
    rows += [(900 + k, rows[3][1], 0) for k in range(6)] + [(999, None, 0)]
    base = spark.createDataFrame(rows, "id long, vec array<double>, list int")
    queries = base.filter((F.col("id") % 20 == 3) | (F.col("id") > 903))
    told = lambda df: sorted((x.query_id, x.rank, x.id, round(x.distance, 9)) for x in df.collect())
    want = told(V.nearest(queries.filter("vec IS NOT NULL"), base.filter("vec IS NOT NULL"), 7))
    assert told(VL.nearest_by_lists(queries, base, 7)) == want
    assert told(VL.nearest_by_lists(queries, base, 7, probes=1)) == want
    assert VL.nearest_by_lists(queries, base.filter("false"), 7).count() == 0


def test_far_lists_are_not_looked_into():
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(size=(200, 4)) + c for c in r.normal(size=(12, 4)) * 60])
    at = VL.centroids(x, 48)
    own, off = VL._nearest(x, at)
    radius = np.array([off[own == k].max(initial=0) for k in range(48)])
    d = VL._distances(x[:50], at)
    near = np.sort(VL._distances(x[:50], x), axis=1)[:, 8]
    assert ((d - radius <= near[:, None]).sum(1) < 24).mean() > 0.9
