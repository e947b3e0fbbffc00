"""Scores of walk points, many starts in one task, against a plain pass over all pairs."""

import math
import random

import pytest

from mapfold.operators import evaluate as E
from mapfold.operators import run_labels as L
from mapfold.operators import walk_scores as W

SCHEMA = "map_id long, start long, x double, y double, dx double, dy double"


def _points(seed: int, n: int):
    draw = random.Random(seed)
    turns = [(1.0, 0.0), (0.0, 1.0), (0.6, 0.8), (None, None), (0.0, 0.0), (1.0, 0.1)]
    rows = [(draw.randrange(2), draw.choice([1, 2, 3, 4, None]), draw.randrange(12) / 4, draw.choice([0.0, 0.25, 0.5, -0.5]), *draw.choice(turns)) for _ in range(n)]
    return rows + [(None, 1, 0.0, 0.0, 1.0, 0.0), (1, 1, None, 0.0, 1.0, 0.0)] + rows[:9]


def _plain(true, pred, threshold):
    per = {}
    for s, rows in enumerate((true, pred)):
        for m, start, *rest in rows:
            key = (m, start) if start is not None and m is not None else (m, start, s)
            per.setdefault(key, ([], []))[s].append(rest)
    out = {}
    for key, sides in per.items():
        places = [{tuple(r[:2]) for r in side} for side in sides]
        pairs = {}
        for x, y, dx, dy in sides[0] if len(key) == 2 else []:
            for u, v, du, dv in sides[1]:
                if x is not None and u is not None and math.sqrt((x - u) ** 2 + (y - v) ** 2) <= threshold:
                    n = math.hypot(dx, dy) * math.hypot(du, dv) if None not in (dx, du) else 0
                    apart = 1 - abs((dx * du + dy * dv) / n) if n else 9.0
                    pairs[(x, y), (u, v)] = min(apart, pairs.get(((x, y), (u, v)), 9.0))
        cost = {k: max(0.0, 1.5 * (math.dist(*k) - threshold / 3)) + a * threshold * 0.5 for k, a in pairs.items() if a < 0.3 and math.dist(*k) < threshold}
        used, total, taken = set(), 0.0, 0
        for (t, p), c in sorted(cost.items(), key=lambda z: (z[1], z[0])):
            if ("t", t) not in used and ("p", p) not in used:
                used |= {("t", t), ("p", p)}
                total, taken = total + c, taken + 1
        hit = W.maximum_matching([k for k, a in pairs.items() if a < 0.29])
        out.setdefault(key[:2], []).append((len(places[0]), len(places[1]), len({t for t, _ in pairs}), len({p for _, p in pairs}), hit, taken, round(total, 9)))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("rounds", [12, 0])
def test_scores_of_each_start(spark, monkeypatch, rounds):
    monkeypatch.setattr(L, "CHUNK", 25)
    monkeypatch.setattr(W, "ROUNDS", rounds)
    true, pred = _points(1, 90), _points(2, 80)
    got = {}
    for r in E.topo_by_start(*(spark.createDataFrame(x, SCHEMA) for x in (true, pred)), 0.8).collect():
        got.setdefault((r.map_id, r.start), []).append((r.nt, r.np, r.near_t, r.near_p, r.hit, r.taken, round(r.cost, 9)))
    assert {k: sorted(v) for k, v in got.items()} == _plain(true, pred, 0.8)


def test_all_measures_at_once_are_those_of_each(spark):
    true, pred = (spark.createDataFrame(x, SCHEMA).filter("map_id IS NOT NULL") for x in (_points(3, 60), _points(4, 70)))
    whole = {r.map_id: r for r in E.topo_measures(true, pred, 0.8).collect()}
    for f, names in ((E.topo_one_to_one, {"precision": "precision", "recall": "recall"}), (E.simple_topo, {"precision": "p", "recall": "r"}), (E.soft_topo, {"score": "score", "f1": "f1"})):
        for r in f(true, pred, 0.8).collect():
            assert {b: pytest.approx(r[a]) for a, b in names.items()} == {b: whole[r.map_id][b] for b in names.values()}
    assert "MapInArrow" in E.topo_measures(true, pred, 0.8)._jdf.queryExecution().optimizedPlan().toString()  # not a call for each start
    assert E.topo_measures(true.filter("false"), pred, 0.8).count() == 0
