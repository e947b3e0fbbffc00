"""Competing starts: the pass over sorted starts, in rounds."""

from __future__ import annotations

import random

from mapfold.operators import evaluate as E


def test_against_the_sorted_pass(spark):
    r = random.Random(3)
    starts, rivals, want = [], [], set()
    for m in range(4):
        score = {k: r.choice([0.2, 0.5, 0.5, 0.7, 0.85, 0.9, 1.0]) for k in range(40)}
        pairs = {(r.randrange(40), r.randrange(40)) for _ in range(r.choice([20, 60, 150]))} | {(k, k) for k in range(40)}
        near = {k: {b for a, b in pairs if a == k} | {a for a, b in pairs if b == k} for k in score}
        marked = set()
        for k in sorted(score, key=lambda k: (score[k], k), reverse=True):
            if k in marked and score[k] < 0.9:
                continue
            want.add((m, k))
            marked |= near[k]
        starts += [(m, k, s, "x") for k, s in score.items()]
        rivals += [(m, a, b, 1) for a, b in pairs]
    s, p = spark.createDataFrame(starts, "map_id int, start int, score double, a string"), spark.createDataFrame(rivals, "map_id int, a int, b int, start int")
    assert {(x.map_id, x.start) for x in E.without_rivals(s, p).collect()} == want
    assert E.without_rivals(s.filter("false"), p).count() == 0
    alone = spark.createDataFrame([(1, 1, None, "x"), (1, 2, 0.1, "y")], s.schema)
    assert {x.start for x in E.without_rivals(alone, spark.createDataFrame([(1, 1, 2, 0)], p.schema)).collect()} == {2}
