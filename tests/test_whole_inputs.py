"""Queries without SQL work on every row of their tables, held against brute force on small ones."""

import random
from collections import Counter

import pytest

import __spark_entry__ as entry
from mapfold.plans import join_queries

R = random.Random(3)
LINES = [(R.randrange(400), R.randrange(300), R.randrange(20), R.randrange(1, 8), 1.0, R.choice("ANR")) for _ in range(500)]
ORDERS = [(k, R.randrange(60)) for k in range(200)]
VECTORS = [(k, [R.gauss(0, 1) for _ in range(4)], k % 3) for k in range(120)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("whole")
    lineitem = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string"
    for name, schema, rows in (("lineitem", lineitem, LINES), ("orders", "o_orderkey long, o_custkey long", ORDERS), ("embeddings", "vec_id long, embedding array<float>, label int", VECTORS)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(at / f"{name}.parquet"))
    return str(at)


def rows(spark, folder, name):
    return entry.queries()[name](spark, folder).collect()


def test_chains_hold_every_edge(spark, folder):
    edges = {(o * 10 + p % 5, o * 10 + 5 + s % 5) for o, p, s, *_ in LINES}
    assert sum(r.edges for r in rows(spark, folder, "graph_chains")) == len(edges) > 0


def test_conflated_graph_starts_from_every_edge(spark, folder):
    """Nodes closer than 6 become the least of their cluster; edges follow."""
    edges = {(o % 20, min(p, s), max(p, s)) for o, p, s, *_ in LINES if p != s}
    nodes = {(m, n) for m, u, v in edges for n in (u, v)}
    at = lambda n: (n * 37 % 500, n * 91 % 500)
    to = {k: k for k in nodes}
    changed = True
    while changed:
        changed = False
        for m, a in nodes:
            for k, b in nodes:
                if m == k and (at(a)[0] - at(b)[0]) ** 2 + (at(a)[1] - at(b)[1]) ** 2 < 36 and to[m, a] < to[m, b]:
                    to[m, b], changed = to[m, a], True
    want = {(m, *sorted((to[m, u][1], to[m, v][1]))) for m, u, v in edges if to[m, u] != to[m, v]}
    assert {(r.map_id, r.u, r.v) for r in rows(spark, folder, "conflated_graph")} == want


def test_mask_components_hold_every_pixel(spark, folder):
    pixels = {(o % 20, flag, p % 60, (s * 7 + n * 131) % 60) for o, p, s, n, _, flag in LINES}
    area = Counter()
    for r in rows(spark, folder, "mask_components"):
        area[r.map_id, r.key] += r.area
    assert area == Counter((m, f) for m, f, *_ in pixels)


def test_segments_of_every_order(spark, folder):
    whole = {k for k, c in ORDERS if c % 41 != 20 or k % 37 != 18}
    assert {r.seg_id for r in join_queries.segments(spark, folder).collect()} == whole


def test_words_of_every_row(spark, folder):
    def cosine(a, b):
        dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
        return dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5

    got = {r.id: r.words for r in rows(spark, folder, "words_by_similarity")}
    want = {}
    for k, v, label in VECTORS:
        if k % 50 == 0:
            others = sorted((-cosine(v, w), j) for j, w, x in VECTORS if x == label and j != k)
            want[k] = ",".join(str(j) for _, j in others[:3])
    assert got == want


def test_greedy_matching_of_a_long_chain(spark):
    """Falling costs along a chain take one pair a round; what rounds leave is finished by component."""
    from mapfold.operators import evaluate

    n = 60
    pairs = [(1, k // 2 + k % 2, k // 2, float(n - k)) for k in range(n)] + [(2, k, j, float((k * 7 + j * 3) % 5)) for k in range(8) for j in range(8)]
    df = spark.createDataFrame(pairs, "g int, a int, b int, c double")
    want = set()
    for g in (1, 2):
        used_a, used_b = set(), set()
        for c, a, b in sorted((c, a, b) for x, a, b, c in pairs if x == g):
            if a not in used_a and b not in used_b:
                used_a.add(a)
                used_b.add(b)
                want.add((g, a, b))
    for rounds in (1, 3, 200):
        assert {(r.g, r.a, r.b) for r in evaluate.greedy_one_to_one(df, ["g"], "a", "b", ["c"], rounds).collect()} == want


def test_maximum_matching():
    """Against trying every choice."""
    from itertools import combinations

    from mapfold.operators.evaluate import maximum_matching

    for _ in range(200):
        pairs = list({(R.randrange(4), R.randrange(4)) for _ in range(R.randrange(9))})
        best = max((k for k in range(len(pairs) + 1) for some in combinations(pairs, k) if len({a for a, _ in some}) == len({b for _, b in some}) == k), default=0)
        assert maximum_matching(pairs) == best


def test_soft_and_maximum_topo(spark):
    from mapfold.operators import evaluate

    schema = "map_id long, start long, x double, y double, dx double, dy double"
    true = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 0.0), (1, 1, 1.0, 0.0, 1.0, 0.0), (1, 1, 9.0, 0.0, 1.0, 0.0)], schema)
    pred = spark.createDataFrame([(1, 1, 0.6, 0.0, 1.0, 0.0), (1, 1, 1.5, 0.0, 1.0, 0.0)], schema)
    hard = evaluate.topo_one_to_one(true, pred, 1.0).first()
    assert (hard.precision, hard.recall) == (1.0, pytest.approx(2 / 3))
    soft = evaluate.soft_topo(true, pred, 1.0).first()
    # 0.4 apart costs 0.1, then 1.5 from 0 is too far: one pair, one lone predicted point, two lone true ones
    cost = 1.5 * (0.4 - 1 / 3)
    p, r = 1 - (cost + 1.15) / 2.3, 1 - (cost + 2.3) / 3.45
    assert (soft.score, soft.f1) == (pytest.approx(cost + 1.15), pytest.approx(2 * p * r / (p + r)))


def test_paths_longer_than_thirty_edges(spark):
    from mapfold.operators import graphs

    edges = spark.createDataFrame([(1, k, k + 1, 1.0) for k in range(45)], "map_id long, u long, v long, length double")
    starts = spark.createDataFrame([(1, 0)], "map_id long, start long")
    assert {r.node: r.distance for r in graphs.bounded_distances(edges, starts, 40.0).collect()} == {k: float(k) for k in range(41)}
