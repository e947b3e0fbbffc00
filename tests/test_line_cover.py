"""Lines merged by class against a plain pass over them, shortest first."""

import random

import numpy as np

from mapfold.operators import line_cover as L

SCHEMA = "map_id int, class string, seg_id long, ax double, ay double, bx double, by double"


def far(p, c, d):
    w = d - c
    t = np.clip((p - c) @ w / (w @ w), 0, 1)
    return np.linalg.norm(p - c - t[:, None] * w, axis=1)


def plain(lines, buffer):
    """Ids left: from the shortest on, a line goes where every one of many points of it is near a line still there."""
    at = {i: (np.array(v[:2]), np.array(v[2:])) for i, *v in lines}
    t = np.linspace(0, 1, 4001)[:, None]
    for i in sorted(at, key=lambda i: (((at[i][1] - at[i][0]) ** 2).sum(), -i)):
        a, b = at[i]
        near = np.min([far(a + t * (b - a), *at[o]) for o in at if o != i] or [np.full(4001, np.inf)], axis=0)
        if near.max() <= buffer:
            del at[i]
    return set(at)


def left(df, buffer):
    return {(r.map_id, getattr(r, "class"), r.seg_id) for r in L.without_covered(df, ["map_id", "class"], buffer).collect()}


def test_lines_equal_a_plain_pass_in_any_order(spark):
    r = random.Random(3)
    rows = []
    for k in range(260):
        x, y = r.uniform(0, 60), r.uniform(0, 12)
        rows.append((k % 2, "ab"[k // 2 % 2], k, x, y, x + r.uniform(-25, 25), y + r.uniform(-2, 2)))
    want = set()
    for m in range(2):
        for c in "ab":
            want |= {(m, c, i) for i in plain([x[2:] for x in rows if x[:2] == (m, c)], 2.0)}
    assert 0 < len(want) < len(rows)
    assert left(spark.createDataFrame(rows, SCHEMA), 2.0) == want
    random.Random(1).shuffle(rows)
    assert left(spark.createDataFrame(rows, SCHEMA).repartition(5), 2.0) == want


def test_two_shorter_lines_cover_a_longer_one(spark):
    rows = [(0, "a", 1, 0.0, 0.0, 10.0, 0.0), (0, "a", 2, -4.0, 0.1, 5.0, 0.1), (0, "a", 3, 5.0, 0.1, 14.0, 0.1)]
    assert left(spark.createDataFrame(rows, SCHEMA), 0.5) == {(0, "a", 2), (0, "a", 3)}
    apart = [*rows[:2], (0, "b", *rows[2][2:])]
    assert len(left(spark.createDataFrame(apart, SCHEMA), 0.5)) == 3


def test_repeated_null_and_pointlike_lines(spark):
    rows = [(0, "a", k, 1.0, 1.0, 4.0, 5.0) for k in range(4)] + [(0, "a", 7, None, 0.0, 1.0, 1.0), (0, "a", 8, 2.0, 2.0, 2.0, 2.0), (0, "a", 9, 40.0, 0.0, 50.0, 0.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert left(df, 1.0) == {(0, "a", 0), (0, "a", 9)}
    assert left(df.limit(0), 1.0) == set()


def test_groups_of_touching_lines(spark):
    rows = [
        (0, "a", 5, 0.0, 0.0, 10.0, 0.0), (0, "a", 3, 10.0, 0.0, 10.0, 9.0), (0, "a", 4, 8.0, 4.0, 20.0, 4.0),  # an end and a crossing
        (0, "a", 6, 12.0, 0.0, 20.0, 0.0), (0, "b", 1, 0.0, 0.0, 10.0, 0.0),  # on the same ray without touching, another class
        (0, "a", 8, 0.0, 30.0, 10.0, 30.0), (0, "a", 9, 4.0, 30.0, 20.0, 30.0),  # one along the other
    ]
    got = {(getattr(r, "class"), r.seg_id): r.group for r in L.touching_groups(spark.createDataFrame(rows, SCHEMA), ["map_id", "class"]).collect()}
    assert got == {("a", 5): 3, ("a", 3): 3, ("a", 4): 3, ("a", 6): 6, ("b", 1): 1, ("a", 8): 8, ("a", 9): 8}
