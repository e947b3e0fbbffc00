"""Joins over a fitted quadtree give the pairs that cells give, with even groups."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mapfold.operators import quadtree as Q
from mapfold.operators import spatial as S


def test_leaves_of_boxes():
    r = np.random.default_rng(3)
    x, y = np.concatenate([r.random(900) * 3 + 500, r.random(100) * 1000]), np.concatenate([r.random(900) * 3 + 500, r.random(100) * 1000])
    tree = Q.split(np.zeros(1000, np.int64), x, y, 40)
    row, leaf = tree.touched(x, y, x, y)
    assert (row == np.arange(1000)).all() and np.bincount(leaf).max() <= 40
    x1, y1 = x + r.random(1000) * 50, y + r.random(1000) * 50
    row, leaf = tree.touched(x, y, x1, y1)
    mine = {}
    for a, b in zip(row.tolist(), leaf.tolist(), strict=True):
        mine.setdefault(a, set()).add(b)
    for i in range(0, 1000, 7):  # boxes that meet share a leaf, also beyond the tree
        for j in range(i):
            if x[i] <= x1[j] and x[j] <= x1[i] and y[i] <= y1[j] and y[j] <= y1[i]:
                assert mine[i] & mine[j]
    assert Q.split(np.zeros(5, np.int64), np.zeros(5), np.zeros(5), 1).touched(*[np.array([-9.0, np.nan])] * 4)[0].tolist() == [0]


@pytest.mark.parametrize("rows", [0, 3000])
def test_a_crowded_map(spark, rows):
    r = random.Random(1)
    place = lambda k: (1, k, r.random() * 4 + 300, r.random() * 4 + 300) if k % 10 else (k % 7, k, r.random() * 1000, r.random() * 1000)
    points = spark.createDataFrame([place(k) for k in range(rows)] + ([(1, -1, None, 5.0)] if rows else []), "map_id int, point_id int, x double, y double")
    others = points.select("map_id", F.col("point_id").alias("other"), F.col("x").alias("u"), F.col("y").alias("v"))
    tree = Q.fitted(points, ["map_id"], F.col("x"), F.col("y"), 60)
    at = lambda a, b: (F.col(a), F.col(b), F.col(a), F.col(b))
    near = lambda side: S.cell_join(points, others, ["map_id"], at("x", "y"), at("u", "v"), side, 0.05).filter("abs(x - u) <= 0.05 AND abs(y - v) <= 0.05").select("map_id", "point_id", "other")
    got, want = near(tree), near(0.05)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    if rows:
        sizes = points.filter("x IS NOT NULL").withColumn("leaf", F.explode(tree.leaves(*at("x", "y")))).groupBy("map_id", "leaf").count()
        assert sizes.agg(F.max("count")).first()[0] <= 3 * 60
