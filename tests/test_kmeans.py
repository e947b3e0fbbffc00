"""K-means by group against a plain version, and principal axes against a plain decomposition."""

import hashlib
import random

import numpy as np

from mapfold.operators import kmeans as K

SCHEMA = "g int, id long, vec array<double>"


def cloud(n, groups=3, d=6, seed=5):
    r = random.Random(seed)
    return [(k % groups, k, [r.gauss(3 * (k % 4 == c), 1) for c in range(d)]) for k in range(n)]


def plain(rows, k, rounds):
    """cluster and cost of each row of one group, in whole numbers."""
    unit = {i: np.floor(np.array(v) / (np.sqrt(sum(x * x for x in v)) or 1) * K.ONE + 0.5).astype(object) for i, v in rows}
    rank = sorted(unit, key=lambda i: hashlib.md5(f"{i}/1".encode()).hexdigest())[: 64 * k]
    gap = lambda a, b: int(((a - b) ** 2).sum())
    centres = [unit[rank[0]]]
    while len(centres) < k:
        far = max(rank, key=lambda i: min(gap(unit[i], c) for c in centres))
        if not min(gap(unit[far], c) for c in centres):
            break
        centres.append(unit[far])
    best = lambda i: min((gap(unit[i], c), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        at = {i: best(i)[1] for i in unit}
        centres = [sum(m) // len(m) if (m := [unit[i] for i in unit if at[i] == n]) else c for n, c in enumerate(centres)]
    return {i: best(i)[::-1] for i in unit}


def found(df):
    return {(r.g, r.id): (r.cluster, r.cost) for r in df.collect()}


def test_clusters_equal_a_plain_version_in_any_layout(spark):
    rows = cloud(400)
    want = {(g, i): c for g in range(3) for i, c in plain([(i, v) for h, i, v in rows if h == g], 4, 5).items()}
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(K.clusters(df, 4, ["id"], ["g"], 5)) == want
    random.Random(2).shuffle(rows)
    assert found(K.clusters(spark.createDataFrame(rows, SCHEMA).repartition(9), 4, ["id"], ["g"], 5)) == want
    whole = plain([(i, v) for _, i, v in rows], 4, 5)
    assert {i: c for (_, i), c in found(K.clusters(df, 4, ["id"], rounds=5)).items()} == whole


def test_unsound_zero_and_repeated_vectors(spark):
    rows = [(0, 1, None), (0, 2, [1.0, None]), (0, 3, [float("inf"), 1.0]), (0, 4, [float("nan"), 1.0]), (0, 5, [0.0, 0.0]), (0, 6, [1.0, 1.0]), (0, 7, [2.0, 2.0]), (1, 8, [1.0, 0.0])]
    got = found(K.clusters(spark.createDataFrame(rows, SCHEMA), 5, ["id"], ["g"]))
    assert all(got[0, i] == (None, None) for i in (1, 2, 3, 4))
    assert got[0, 6] == got[0, 7] and got[0, 5][0] != got[0, 6][0] and got[1, 8] == (0, 0)
    assert {c for (g, _), (c, _) in got.items() if g == 0} == {None, 0, 1}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    for block in ([], ["g"]):
        assert K.clusters(none, 3, ["id"], block).count() == 0
        assert K.elbow(none, ["id"], block, most=3).count() == 0
        assert K.principal(none, 2, block).count() == 0


def test_elbow_stops_at_the_number_of_bundles(spark):
    r = random.Random(4)
    axis = lambda c: [float(c == p) + r.gauss(0, 0.01) for p in range(8)]
    rows = [(g, k, axis(k % (g + 2))) for g in range(2) for k in range(120)] + [(2, 0, [1.0] * 8)]
    got = {x.g: (x.k, len(x.centres)) for x in K.elbow(spark.createDataFrame(rows, SCHEMA), ["id"], ["g"], most=8).collect()}
    for g in range(2):
        costs = [sum(c for _, c in plain([(i, v) for h, i, v in rows if h == g], k, 20).values()) for k in range(1, 9)]
        assert got[g][0] == next((k for k in range(2, 9) if costs[k - 1] > 0.975 * costs[k - 2]), 8)
        assert costs[g + 1] < 0.01 * costs[0]
    assert got[2] == (1, 1)
    labelled = K.elbow_clusters(spark.createDataFrame(rows, SCHEMA), ["id"], ["g"], most=8)
    assert labelled.filter("cluster IS NULL").count() == 0


def test_spread_pairs_take_the_most_salient_of_each_cluster(spark):
    r = random.Random(6)
    unit = lambda c: [float(c == p) + r.gauss(0, 0.01) for p in range(4)]
    rows = [(g, k, k + 100, unit(k % 3), unit(k % 3), round(r.random(), 3), round(r.random(), 3)) for g in range(2) for k in range(60)]
    df = spark.createDataFrame(rows, "g int, a long, b long, va array<double>, vb array<double>, sa double, sb double")
    got = K.spread_pairs(df, 3, ["g"]).collect()
    for g in range(2):
        own = [x for x in rows if x[0] == g]
        want = sorted((max((x for x in own if x[1] % 3 == c), key=lambda x: ((x[5] + x[6]) / 2, -x[1])) for c in range(3)), key=lambda x: (-(x[5] + x[6]) / 2, x[1]))
        assert [(x.a, x.b) for x in sorted((x for x in got if x.g == g), key=lambda x: x.rank)] == [x[1:3] for x in want]


def test_components_span_the_same_space(spark):
    rows = cloud(300, groups=2, d=5)
    df = spark.createDataFrame([*rows, (0, 999, None), (1, 998, [1.0, None, 2.0, 3.0, 4.0])], SCHEMA).repartition(7)
    for block, groups in ((["g"], [[x for x in rows if x[0] == g] for g in range(2)]), ([], [rows])):
        got = {x.id: x.components for x in K.principal(df, 2, block).collect()}
        assert got[999] is None and got[998] is None
        for own in groups:
            x = np.array([v for _, _, v in own])
            x = x - x.mean(axis=0)
            axes = np.linalg.svd(x, full_matrices=False)[2][:2]
            places = np.array([got[i] for _, i, _ in own])
            assert np.allclose(np.abs(places), np.abs(x @ axes.T), atol=1e-6)


def test_axes_of_one_vector(spark):
    (row,) = K.axes(spark.createDataFrame([(0, 1, [3.0, 4.0])], SCHEMA), 2, ["g"]).collect()
    assert row.mean == [3.0, 4.0] and np.allclose(row.variances, 0)
