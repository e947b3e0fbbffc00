"""Joins, graphs, rasters, matching and scores against plain Python."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from mapfold.functions import geometry as G
from mapfold.operators import evaluate as E
from mapfold.operators import georef as R
from mapfold.operators import graphs as GR
from mapfold.operators import legends as L
from mapfold.operators import matching as M
from mapfold.operators import pixels as P
from mapfold.operators import spatial as S
from mapfold.operators import vectors as V
from mapfold.operators.components import connected_components


def roots(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1080)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: v for k, v in roots([e for e in edges if e[0] != e[1]]).items()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_cell_join_is_a_cross_join_with_a_reach(spark):
    rnd = random.Random(2)
    box = lambda: (x := rnd.uniform(-50, 50), y := rnd.uniform(-50, 50), x + rnd.uniform(0, 30), y + rnd.uniform(0, 30))
    a, b = [(k, *box()) for k in range(60)], [(k, *box()) for k in range(60)]
    l, r = (spark.createDataFrame([(1, *x) for x in rows], f"m int, {p} int, {p}0 double, {p}1 double, {p}2 double, {p}3 double") for rows, p in ((a, "a"), (b, "b")))  # noqa: E741
    for side, reach in ((7.0, 0.0), (16.0, 5.0)):
        got = [(x.a, x.b) for x in S.cell_join(l, r, ["m"], tuple(F.col(f"a{k}") for k in range(4)), tuple(F.col(f"b{k}") for k in range(4)), side, reach).filter(f"a2 >= b0 - {reach} AND a0 <= b2 + {reach} AND a3 >= b1 - {reach} AND a1 <= b3 + {reach}").collect()]
        want = [(p[0], q[0]) for p in a for q in b if p[3] >= q[1] - reach and p[1] <= q[3] + reach and p[4] >= q[2] - reach and p[2] <= q[4] + reach]
        assert sorted(got) == sorted(want)


def test_dip_direction_last_strike_wins(spark):
    p = spark.createDataFrame([(1, 1, "A", 0.0, 0.0), (1, 2, "A", 100.0, 0.0), (1, 3, "B", 0.0, 1.0)], "map_id int, point_id int, type string, x double, y double")
    s = spark.createDataFrame([(1, 1, 0.0, 20.0, 10.0), (1, 2, 5.0, 0.0, 20.0), (1, 3, 50.0, 0.0, 30.0)], "map_id int, strike_seq int, x double, y double, dip double")
    got = {r.point_id: r.dip_direction for r in S.copy_dip_direction(p, s, ["A"]).collect()}
    assert got == {1: 20.0, 2: None, 3: None}


def test_text_anti_join_and_regions(spark):
    p = spark.createDataFrame([(1, k, float(x), float(y)) for k, (x, y) in enumerate([(1, 1), (5, 5), (600, 600)])] + [(2, 9, 5.0, 5.0)], "map_id int, point_id int, x double, y double")
    ring = F.array(*[G.point(F.lit(float(a)), F.lit(float(b))) for a, b in ((4, 4), (700, 4), (4, 9), (4, 4))])
    rings = spark.range(1).select(F.lit(1).alias("map_id"), ring.alias("ring"))
    assert {(r.map_id, r.point_id) for r in S.points_off_text(p, rings, 64.0).collect()} == {(1, 0), (1, 2), (2, 9)}
    regions = spark.range(1).select(F.lit(1).alias("map_id"), F.struct(F.lit(0.0).alias("xmin"), F.lit(0.0).alias("ymin"), F.lit(5.0).alias("xmax"), F.lit(5.0).alias("ymax")).alias("box"))
    assert {(r.map_id, r.point_id) for r in S.points_in_region(p, regions).collect()} == {(1, 0), (1, 1), (2, 9)}


def test_entity_links(spark):
    square = lambda x: F.array(*[G.point(F.lit(float(x + a)), F.lit(float(b))) for a, b in ((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))])
    labels = spark.range(1).select(F.inline(F.array(F.struct(F.lit(1).alias("label_id"), F.lit("Clear,").alias("text"), square(0).alias("ring")), F.struct(F.lit(2).alias("label_id"), F.lit("bog").alias("text"), square(0).alias("ring")))))
    polygons = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("polygon_id"), F.lit(n).alias("name"), square(x).alias("geom")) for k, n, x in ((1, "Clear Lake", 2), (2, "Clear Creek", 900), (3, "Mud Lake", 1))])))
    assert {r.label_id: r.polygon_ids for r in S.link_labels(labels, polygons).collect()} == {1: [1], 2: None}


def test_graph_rounds(spark):
    chain = [(1, 1, 2), (1, 2, 3), (1, 3, 4), (1, 4, 5), (1, 3, 9)]
    e = spark.createDataFrame(chain, "map_id int, u long, v long")
    named = {(r.u, r.v): tuple(r.chain) for r in GR.chains(e).collect()}
    assert named[1, 2] == named[2, 3] and named[3, 4] == named[4, 5] and len(set(named.values())) == 3
    assert {(r.u, r.v) for r in GR.without_dead_ends(e).collect()} == {(2, 3), (3, 4)}
    assert GR.without_dead_ends(e, rounds=None).count() == 0
    cut = GR.bridged(e, spark.createDataFrame([(1, 2), (1, 4)], "map_id int, node long"))
    assert {(r.u, r.v) for r in cut.collect()} == {(1, 3), (3, 5), (3, 9)}
    d = {(r.start, r.node): r.distance for r in GR.bounded_distances(e.withColumn("length", F.lit(1.0)), spark.createDataFrame([(1, 1)], "map_id int, start long"), 3.0).collect()}
    assert d == {(1, 1): 0, (1, 2): 1, (1, 3): 2, (1, 4): 3, (1, 9): 3}
    nodes = spark.createDataFrame([(1, k, float(x), 0.0) for k, x in ((1, 0), (2, 0.5), (3, 5), (4, 9), (5, 9.4), (9, 20))], "map_id int, node long, x double, y double")
    assert {(r.u, r.v) for r in GR.conflated(nodes, e, 1.0).collect()} == {(1, 3), (3, 4), (3, 9)}


def test_line_merge_and_sampling(spark):
    s = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 0.0), (1, 2, 1.0, 0.1, 4.0, 0.1), (1, 3, 10.2, 0.0, 20.0, 0.0)], "map_id int, seg_id int, ax double, ay double, bx double, by double")
    kept = {r.seg_id: (r.ax, r.bx) for r in GR.merged_lines(s, 0.5).collect()}
    assert set(kept) == {1, 3} and kept[1][1] == pytest.approx(kept[3][0])
    pts = GR.sampled(s.filter("seg_id = 1"), 4, ["seg_id"]).collect()
    assert sorted(p.x for p in pts) == [0, 2.5, 5, 7.5]


def test_mask_components_and_holes(spark):
    rnd = random.Random(4)
    px = {(r, c) for r in range(14) for c in range(14) if rnd.random() < 0.5}
    mask = spark.createDataFrame([(1, "k", r, c) for r, c in px], "map_id int, key string, row int, col int")
    got = {(r.label.row, r.label.col): (r.area, r.row0, r.col1) for r in P.component_summary(P.labelled_runs(mask)).collect()}
    seen, want = set(), {}
    for p in sorted(px):
        if p in seen:
            continue
        part, todo = {p}, [p]
        while todo:
            r, c = todo.pop()
            for q in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if q in px and q not in part:
                    part.add(q)
                    todo.append(q)
        seen |= part
        want[min(part)] = (len(part), min(r for r, _ in part), max(c for _, c in part))
    assert got == want
    box = spark.createDataFrame([(1, "k", r, c) for r in range(1, 6) for c in range(1, 6) if r in (1, 5) or c in (1, 5)], "map_id int, key string, row int, col int")
    sizes = spark.createDataFrame([(1, 8, 8)], "map_id int, height int, width int")
    assert P.holes_filled(box, sizes).count() == 25


def test_greedy_matching_is_the_sorted_pass(spark):
    rnd = random.Random(6)
    pairs = [(1, rnd.randrange(15), 100 + rnd.randrange(15), float(rnd.randrange(6))) for _ in range(90)]
    pairs = list({(g, a, b): (g, a, b, d) for g, a, b, d in pairs}.values())
    got = {(r.a, r.b) for r in E.greedy_one_to_one(spark.createDataFrame(pairs, "g int, a int, b int, d double"), ["g"], "a", "b", ["d"]).collect()}
    used, want = set(), set()
    for _, a, b, _ in sorted(pairs, key=lambda p: (p[3], p[1], p[2])):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    assert got == want


def test_pixel_f_score(spark):
    m = lambda pts: spark.createDataFrame([(1, "k", r, c) for r, c in pts], "map_id int, key string, row int, col int")
    sizes = spark.createDataFrame([(1, 30, 40)], "map_id int, height int, width int")
    r = E.pixel_f_score(m([(1, 1), (5, 5), (20, 20)]), m([(1, 1), (5, 7)]), 3, sizes).first()
    tp = 1 + 1 - 2 / 50
    assert (r.precision, r.recall) == (pytest.approx(tp / 2), pytest.approx(tp / 3))


def test_average_precision(spark):
    rows = [(1, 0, k, True, s, False, *b) for k, s, b in ((1, 0.9, (0.0, 0.0, 10.0, 10.0)), (2, 0.8, (50.0, 50.0, 60.0, 60.0)), (3, 0.7, (20.0, 20.0, 30.0, 30.0)))]
    rows += [(1, 0, k, False, 0.0, False, *b) for k, b in ((1, (0.0, 0.0, 10.0, 10.0)), (2, (20.0, 20.0, 30.0, 30.0)))]
    b = spark.createDataFrame(rows, "image_id long, class long, box_id long, is_det boolean, score double, ignore boolean, xmin double, ymin double, xmax double, ymax double")
    r = E.average_precision(E.detection_curve(b)).first()
    assert r.ap == pytest.approx((51 * 1.0 + 50 * (2 / 3)) / 101) and r.ar == 1


def test_text_spotting(spark):
    pairs = spark.createDataFrame([(1, 1, 1, 0.9, True), (1, 1, 2, 0.8, False), (1, 2, 2, 0.7, False), (1, 3, 3, 0.5, True)], "image_id int, gt_id int, det_id int, iou double, same_text boolean")
    truth = spark.createDataFrame([(1, 1, True), (1, 2, True), (1, 3, True), (1, 4, False)], "image_id int, gt_id int, care boolean")
    found = spark.createDataFrame([(1, 1, False), (1, 2, False), (1, 3, False), (1, 4, True)], "image_id int, det_id int, dont_care boolean")
    total = E.text_spotting(pairs, truth, found).filter("image_id IS NULL").first()
    assert (total.precision, total.recall) == (pytest.approx(1 / 3), pytest.approx(1 / 3))


def test_phrases(spark):
    t = spark.createDataFrame([(1, "The Rock Springs quadrangle, Sweet"), (2, "")], "text_id int, text string")
    p = spark.createDataFrame([("rock springs",), ("rock",), ("springs quadrangle",), ("sweet water",)], "phrase string")
    assert [(r.pos, r.n, r.phrase) for r in M.find_phrases(t, p).collect()] == [(1, 2, "rock springs")]
    assert {r.phrase for r in M.find_phrases(t, p, ref_last_word=True).collect()} == {"rock springs", "sweet"}


def test_place_filter(spark):
    topo = spark.createDataFrame([(1, "Rock Springs", "Sweetwater", "Wyoming"), (2, "Rock Springs", "Lake", "Wyoming"), (3, "Big Bend", "Lake", "Texas")], "row_id int, map_name string, county string, state string")
    texts = spark.createDataFrame([(1, "Geology of Rock Springs, Sweetwater county, Wyoming"), (2, "rock springs wyoming"), (3, "nothing")], "text_id int, text string")
    got = defaultdict(set)
    for r in M.place_filter(texts, topo).collect():
        got[r.text_id].add(r.row_id)
    assert got == {1: {1}, 2: {1, 2}}


def test_corrections(spark):
    words = spark.createDataFrame([("lakr",), ("Rivr",), ("zzzzzz",), ("lake",)], "word string")
    lex = spark.createDataFrame([("lake", 9), ("lark", 10), ("river", 3), ("rive", 30)], "name string, cnt int")
    got = {r.word: (r.corrected, r.distance) for r in M.correct_words(words, lex).collect()}
    assert got == {"lakr": ("lake", 1), "Rivr": ("rive", 1), "zzzzzz": ("zzzzzz", None), "lake": ("lake", 0)}
    tie = spark.createDataFrame([("cat",)], "word string")
    two = spark.createDataFrame([("bat", 9), ("hat", 10)], "name string, cnt int")
    assert M.correct_words(tie, two).first().corrected == "hat" and M.correct_words(tie, two, string_order=True).first().corrected == "bat"


def test_titles_ages_and_candidates(spark):
    items = spark.createDataFrame([(1, 1, "Faults: ; normal ; thrust with a long description of it"), (1, 2, "inferred")], "map_id int, item_id int, description string")
    assert [r.full for r in M.carry_titles(items).orderBy("item_id", "pos").collect()] == ["Faults normal", "thrust with a long description of it", "Faults inferred"]
    scale = spark.createDataFrame([(0, "Gelasian", "Pleistocene", "Quaternary", 2.58, 1.8), (1, "Piacenzian", "Pliocene", "Neogene", 3.6, 2.58), (2, "Aptian", "Early Cretaceous", "Cretaceous", 121.4, 113.0)], "idx int, age string, epoch string, period string, b_age double, t_age double")
    texts = spark.createDataFrame([(1, "Pliocene and Quaternary gravel"), (2, "no age"), (3, "Cretaceous, Aptian")], "text_id int, text string")
    assert {r.text_id: (r.b_age, r.t_age) for r in M.age_interval(texts, scale).collect()} == {1: (3.6, 1.8), 2: (None, None), 3: (121.4, 113.0)}
    c = spark.createDataFrame([("m", ["A_B_1", "AB_x", "A_B_2"]), ("n", [])], "name string, topos array<string>")
    assert {r.name: (r.kept, r.n) for r in M.deduped_candidates(c).collect()} == {"m": (["A_B_1", "AB_x"], 2), "n": ([], 0)}


def test_georeferencing(spark):
    g = spark.createDataFrame([(1, k, float(x), float(y), 2.0 * x + 3, -1.0 * y + x) for k, (x, y) in enumerate([(0, 0), (10, 0), (0, 10), (7, 9)])] + [(2, k, float(k), float(k), 1.0, 1.0) for k in range(3)], "map_id long, gcp_id int, px double, py double, mx double, my double")
    got = {r.map_id: r for r in R.affine_from_gcps(g).collect()}
    assert (got[1].a, got[1].c, got[1].d, got[1].e) == (pytest.approx(2), pytest.approx(3), pytest.approx(1), pytest.approx(-1)) and got[2].a is None
    for method in ("affine", "polynomial2", "tps"):
        w = R.warp(spark.createDataFrame([(1, 4.0, 5.0)], "map_id long, x double, y double"), g.filter("map_id = 1").withColumn("transformation_method", F.lit(method))).first()
        assert w.lon == pytest.approx(11, abs=1e-6) or method == "polynomial2"


def test_map_center(spark):
    rows = [(1, 0, 40.0, -100.0), (1, 1, 40.01, -100.0), (1, 2, 40.02, -100.0), (1, 3, 41.0, -100.0), (2, 0, None, None)]
    p = spark.createDataFrame(rows, "map_id int, seq int, lat double, lng double")
    assert {r.map_id: r.lat for r in R.map_center(p).collect()} == {1: 40.01, 2: None}


def test_vectors(spark):
    rnd = random.Random(8)
    rows = [(k, [rnd.gauss(0, 1) for _ in range(4)]) for k in range(60)]
    e = spark.createDataFrame(rows, "id long, vec array<double>")
    got = defaultdict(list)
    for r in V.nearest(e.filter("id % 10 = 0"), e, 3, blocks=4).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.id)
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assert got == {q: [k for k, v in sorted(rows, key=lambda kv: d(kv[1], rows[q][1]))[1:4]] for q in range(0, 60, 10)}
    t = V.triplets(spark.createDataFrame([(1, 2), (1, 3), (4, 5)], "anchor long, positive long"), e.select("id")).collect()
    assert len(t) == 3 and all(r.negative not in {1, 2, 3} for r in t if r.anchor == 1)


def test_legend_windows(spark):
    b = spark.createDataFrame([(1, k, float(x)) for k, x in enumerate([0, 10, 45, 100, 141])], "map_id int, box_id int, x double")
    assert [r.column for r in L.columns_by_gap(b).orderBy("x").collect()] == [0, 0, 0, 1, 2]
    a = spark.createDataFrame([(1, 1, 100.0), (1, 2, 90.0), (1, 3, 10.0)], "map_id int, region_id int, area double")
    assert L.area_before_drop(a).first().region_id == 2


def test_dash_patterns(spark):
    rows = [(1, "dash", s) for s in (1, 40, 45, 50, 42, 300)] + [(1, "dot", s) for s in (8, 9, 10, 7)] + [(1, "solid", 900)]
    got = {r.key: r.pattern for r in P.dash_pattern(spark.createDataFrame(rows, "map_id int, key string, size int")).collect()}
    assert got == {"dash": "dashed", "dot": "dotted", "solid": "solid"}
    assert Counter(r.pattern for r in P.dash_pattern_by_rule(spark.createDataFrame(rows, "map_id int, key string, size int")).collect())["solid"] >= 1
