"""What keeps work in proportion to the input: no broadcasts of sides that grow, copies and crowded places met once."""

from __future__ import annotations

import math
import os
import random

import numpy as np
from pyspark.sql import functions as F

from mapfold.functions import geometry as G
from mapfold.operators import evaluate as E
from mapfold.operators import graphs as GR
from mapfold.operators import matching as M
from mapfold.operators import pixels as P
from mapfold.operators import quadtree as Q
from mapfold.operators import spatial as S
from mapfold.operators import tiles as T
from mapfold.operators import vectors as V


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _box(x, y):
    return F.col(x), F.col(y), F.col(x), F.col(y)


def test_place_joins_are_not_broadcast(spark, tmp_path):
    spark.range(100).selectExpr("id AS map_id", "id AS a", "double(id) AS x", "double(id) AS y").write.parquet(f"{tmp_path}/p")
    left = spark.read.parquet(f"{tmp_path}/p")  # sized by its file, as the given tables are
    right = left.select("map_id", F.col("a").alias("b"), F.col("x").alias("u"), F.col("y").alias("v"))
    for side in (5.0, Q.split(np.zeros(1, np.int64), np.zeros(1), np.zeros(1), 1)):
        assert "Broadcast" not in _plan(S.cell_join(left, right, ["map_id"], _box("x", "y"), _box("u", "v"), side, 1.0))
    areas = left.select("map_id", F.struct(F.lit(0).alias("xmin"), F.lit(0).alias("ymin"), F.lit(9).alias("xmax"), F.lit(9).alias("ymax")).alias("box"))
    tiles = left.select("map_id", F.lit(0).alias("x0"), F.lit(0).alias("y0"))
    found = T.content_tiles(tiles, areas, 9, 1)
    assert "Broadcast" not in _plan(found) and found.count() == 100


def test_even_splits_where_the_sample_ends():
    r = np.random.default_rng(5)
    x, y = r.random(400) * 100, r.random(400) * 100
    tree = Q.split(np.zeros(400, np.int64), x, y, 0.5)  # a sample of one row for many
    row, leaf = tree.touched(x, y, x, y)
    assert np.bincount(leaf, minlength=len(tree.child)).mean() < 1 and tree.size[leaf].max() <= 100 / 16


def test_crowded_strikes_take_the_nearest_point(spark, monkeypatch):
    r = random.Random(2)
    place = lambda n: [(k % 2, k, "A" if k % 3 else "B", r.randrange(300) / 10, r.randrange(300) / 10) for k in range(n)]
    pts, strikes = place(3000) + [(0, 9000, "A", 80.0, 80.0)], [(m, k, x, y, float(k)) for m, k, _, x, y in place(400)] + [(0, 900, 99.0, 80.0, 7.5), (0, 901, 200.0, 200.0, 1.0)]
    last = {}
    for m, k, x, y, dip in sorted(strikes, key=lambda s: s[1]):
        near = min(((math.hypot(x - p[3], y - p[4]), p[1]) for p in pts if p[0] == m and p[2] == "A"), default=(99, 0))
        if near[0] <= 20:
            last[m, near[1]] = dip
    seen = []
    join = S.cell_join
    monkeypatch.setattr(S, "cell_join", lambda *a, **b: seen.append(join(*a, **b)) or seen[-1])
    points = spark.createDataFrame(pts, "map_id int, point_id int, type string, x double, y double")
    for tree in (None, Q.fitted(points, ["map_id"], F.col("x"), F.col("y"), 50)):
        seen.clear()
        got = S.copy_dip_direction(points, spark.createDataFrame(strikes, "map_id int, strike_seq int, x double, y double, dip double"), ["A"], tree=tree)
        assert {(p.map_id, p.point_id): p.dip_direction for p in got.filter("dip_direction IS NOT NULL").collect()} == last and got.count() == len(pts)
        if tree is None:
            assert len(seen) > 1 and sum(p.count() for p in seen) < 400 * 100  # within 20 of most strikes there are a thousand points


def test_copies_of_rings_and_points_meet_once(spark, monkeypatch):
    sides = []
    join = S.cell_join
    monkeypatch.setattr(S, "cell_join", lambda a, b, *rest, **kw: sides.append((a.count(), b.count())) or join(a, b, *rest, **kw))
    points = spark.createDataFrame([(1, k, float(k % 4), 0.5) for k in range(40)] + [(1, 40, None, 1.0)], "map_id int, point_id int, x double, y double")
    box = F.struct(F.lit(0.0).alias("xmin"), F.lit(0.0).alias("ymin"), F.lit(1.5).alias("xmax"), F.lit(1.5).alias("ymax"))
    rings = spark.range(50).select(F.lit(1).alias("map_id"), G.box_ring(box).alias("ring"))
    assert S.points_off_text(points, rings).count() == 21 and S.points_in_rings(points, rings).count() == 20
    assert sides == [(5, 1), (5, 1)]


def test_equal_texts_are_scored_once(spark, monkeypatch):
    names = ["red bolt", "bolt red", "red ring", "old plate", "red"]
    rows = spark.createDataFrame([(k, names[k % 5]) for k in range(100)] + [(100, None)], "row_id int, text string")
    asked = spark.createDataFrame([(k, "red bolt" if k % 2 else "a plate") for k in range(50)], "query_id int, text string")
    scored = []
    best = M.best_rows
    monkeypatch.setattr(M, "best_rows", lambda s, *a: scored.append(s.count()) or best(s, *a))
    ids = lambda df, q: [(r.row_id, r["rank"]) for r in df.filter(f"query_id = {q}").orderBy("rank").collect()]
    fuzzy, bm = M.fuzzy_top_k(asked, rows, 7), M.bm25(asked, rows, 7, digits=9)
    first = [(k, n) for n, k in enumerate((0, 1, 5, 6, 10, 11, 15), 1)]  # both orders of the two words, by row
    assert ids(fuzzy, 1) == first and ids(bm, 49) == first and fuzzy.count() == bm.count() == 350
    assert ids(bm, 0) == [(5 * n - 2, n) for n in range(1, 8)]
    assert max(scored) <= 4  # of 50 times 100 pairs
    places = asked.withColumnRenamed("query_id", "place_id")
    monkeypatch.setattr(S, "best_rows", M.best_rows)
    found = S.place_candidates(places, rows.withColumnRenamed("text", "name"), "Small", 3)
    assert found.count() == 150 and [r.row_id for r in found.filter("place_id = 1").orderBy("rank").collect()] == [0, 1, 5]
    assert max(scored) <= 5


def _counted(monkeypatch, module):
    """Rows of both sides of each cell join that a module makes."""
    sides, join = [], S.cell_join
    monkeypatch.setattr(module, "cell_join", lambda a, b, *rest, **kw: sides.append((a.count(), b.count())) or join(a, b, *rest, **kw))
    return sides


def _struct_box(x0, y0, x1, y1):
    return F.struct(*[F.lit(v).cast("double").alias(n) for n, v in (("xmin", x0), ("ymin", y0), ("xmax", x1), ("ymax", y1))])


def test_copies_of_boxes_are_merged_as_one(spark, monkeypatch):
    sides = _counted(monkeypatch, S)
    rows = spark.range(60).select(F.lit(1).alias("map_id"), F.col("id").alias("box_id"), F.when(F.col("id") < 40, _struct_box(0, 0, 4, 4)).when(F.col("id") < 50, _struct_box(0, 0, 4, 5)).when(F.col("id") < 58, _struct_box(9, 9, 9, 12)).alias("box"))
    got = {r.group: (r.n, r.ymax) for r in E.merged_boxes(rows).collect()}
    assert got == {0: (50, 5.0), **{k: (1, 12.0) for k in range(50, 58)}, 58: (1, None), 59: (1, None)}  # without area or place each for itself
    assert sides == [(12, 12)]


def test_copies_of_lines_patches_and_labels_meet_once(spark, monkeypatch):
    sides = _counted(monkeypatch, S)
    line = F.array(G.point(F.lit(0.0), F.lit(1.0)), G.point(F.lit(3.0), F.lit(1.0)))
    lines = spark.range(30).select(F.lit(1).alias("map_id"), F.col("id").alias("line_id"), F.when(F.col("id") < 29, line).alias("line"))
    patches = spark.range(20).select(F.lit(1).alias("map_id"), (50 - F.col("id")).alias("patch_seq"), _struct_box(1, 0, 2, 2).alias("box"))
    first = S.first_patch_of_line(lines, patches)
    assert first.columns == ["map_id", "line_id", "line", "patch_seq"] and {r.patch_seq for r in first.filter("line_id < 29").collect()} == {31} and first.filter("patch_seq IS NULL").count() == 1
    ring = G.box_ring(_struct_box(0, 0, 2, 2))
    labels = spark.range(30).select(F.col("id").alias("label_id"), F.lit("Red!").alias("text"), ring.alias("ring"))
    polygons = spark.range(20).select(F.col("id").alias("polygon_id"), F.lit("a red rock").alias("name"), ring.alias("geom"))
    assert {tuple(r.polygon_ids) for r in S.link_labels(labels, polygons).collect()} == {tuple(range(20))}
    assert sides == [(2, 1), (1, 1)]


def test_places_of_masks_and_seeds_meet_once(spark, monkeypatch):
    sides = _counted(monkeypatch, P)
    mask = spark.range(40).select(F.lit(1).alias("map_id"), F.concat(F.lit("k"), F.col("id") % 4).alias("key"), F.floor(F.col("id") / 4).cast("int").alias("row"), F.lit(1).alias("col"))
    boxes = spark.range(30).select(F.lit(1).alias("map_id"), _struct_box(0, 0, 2, 4).alias("box"))
    assert P.without_boxes(mask, boxes).count() == 20 and sides == [(10, 1)]
    parts = spark.range(500).select(F.lit(1).alias("map_id"), F.col("id").alias("label"), F.lit("own").alias("own"), F.lit("rival").alias("rival"), (F.col("id") % 5).alias("center_row"), F.lit(0).alias("center_col"))
    seeds = spark.range(400).select(F.lit(1).alias("map_id"), F.when(F.col("id") % 2 == 0, "own").otherwise("rival").alias("key"), (F.col("id") % 2 * 4).alias("row"), F.lit(0).alias("col"))
    told = P.settled_by_seeds(parts, seeds, near=0.5, factor=1.0)
    assert {(r.center_row, r.winner): r.n for r in told.groupBy("center_row", "winner").agg(F.count("*").alias("n")).collect()} == {(0, "own"): 100, (1, "own"): 100, (2, "rival"): 100, (3, "rival"): 100, (4, "rival"): 100}
    assert {tuple(r) for r in told.select("d_own", "d_rival").distinct().collect()} == {(float(k), 4.0 - k) for k in range(5)}


def test_keys_of_one_colour_are_not_parted_by_rounding(spark, monkeypatch):
    pixels = spark.range(400).select(F.lit(1).alias("map_id"), (F.col("id") / 20).cast("int").alias("row"), (F.col("id") % 20).cast("int").alias("col"), *[(F.col("id") * m % 256).cast("int").alias(c) for c, m in (("r", 7), ("g", 13), ("b", 11))])
    palette = spark.createDataFrame([(1, k, 127, 128, 127) for k in "dbac"], "map_id int, key string, r int, g int, b int")
    inner = P.nearest_palette(pixels, palette)
    assert [tuple(r) for r in inner.groupBy("key").count().collect()] == [("a", 400)]
    assert "min(key" in inner._jdf.queryExecution().analyzed().toString()


def test_copies_of_vectors_make_no_pairs(spark):
    r = random.Random(4)
    vecs = [[r.random() - 0.5 for _ in range(4)] for _ in range(6)]
    side = lambda odd: spark.createDataFrame([(0, 2 * k + odd, vecs[k % 3 + 3 * odd], 1.0) for k in range(30)], "block int, patch_idx int, vec array<double>, saliency double")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.hypot(*a) / math.hypot(*b)
    sim = [[cos(vecs[a], vecs[3 + b]) for b in range(3)] for a in range(3)]
    want = {(2 * a, 2 * b + 1) for a in range(3) for b in range(3) if sim[a][b] == max(sim[a]) == max(row[b] for row in sim)}
    found = V.mutual_nearest(side(0), side(1), ["block"], 0.1)
    assert {(p.a, p.b) for p in found.collect()} == want
    assert "min(struct(patch_idx" in found._jdf.queryExecution().analyzed().toString()


def test_rounds_leave_one_table(spark, monkeypatch):
    made, keep = [], GR.written
    monkeypatch.setattr(GR, "written", lambda df: made.append(keep(df)) or made[-1])
    edges = spark.range(30).selectExpr("1 AS map_id", "id AS u", "id + 1 AS v", "1.0D AS length")
    got = GR.bounded_distances(edges, spark.createDataFrame([(1, 0)], "map_id int, start long"), 9.0)
    assert {r.node: r.distance for r in got.collect()} == {k: float(k) for k in range(10)}
    folder = lambda df: df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("//", "/")
    assert len(made) > 9 and [os.path.isdir(folder(df)) for df in made] == [False] * (len(made) - 1) + [True]


def test_hit_rate_makes_no_table_of_positives(spark, monkeypatch):
    from mapfold.plans import map_queries

    seen, rate = [], V.hit_rate
    monkeypatch.setattr(V, "hit_rate", lambda found, positives: seen.append((found.count(), positives.count())) or rate(found, positives))
    row = map_queries.vector_hit_rate(spark, "/root/testdata/sf0.001").first()
    assert row.queries > 0 and seen[0][1] <= seen[0][0] + row.queries
