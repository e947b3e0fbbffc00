"""Equal descriptions are scored once, equal rings judged once."""

from __future__ import annotations

from mapfold.operators import legends as L
from mapfold.operators import matching as M


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_equal_descriptions_are_scored_once(spark):
    items = spark.createDataFrame([(k, ("a quarry drawn", "a spring", None)[k % 3]) for k in range(30)], "item_id long, description string")
    categories = spark.createDataFrame([("1", "quarry mine"), ("2", "spring well")], "category string, words string")
    symbols = spark.createDataFrame([("1", "Q", "quarry", "quarry drawn"), ("2", "S", "spring", "spring drawn")], "category string, symbol string, keywords string, text string")
    found = M.choose_symbol(items, categories, symbols)
    assert "keys=[description#" in _plan(found)
    got = {r.item_id: (r.category, r.symbol) for r in found.collect()}
    assert got == {k: (("1", "Q"), ("2", "S"), (None, None))[k % 3] for k in range(30)}


def test_equal_rings_are_judged_once(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    rings = [square, square[::-1], None]
    df = spark.createDataFrame([(k % 2, k, rings[k % 3]) for k in range(30)], "map_id long, box_id long, ring array<struct<x:double,y:double>>")
    sheets = spark.createDataFrame([(0, 10, 10)], "map_id long, height int, width int")
    good, bad = L.valid_detections(df, sheets)
    assert "_k#" in _plan(good)
    assert good.columns == ["map_id", "box_id", "ring", "height", "width"] and bad.columns == [*good.columns, "reason"]
    got = {r.box_id: r.reason for r in bad.collect()} | {r.box_id: None for r in good.collect()}
    assert len(got) == 30 and all(got[k] == "missing" for k in range(30) if k % 2 or k % 3 == 2)
    assert {got[0], got[4]} == {None, "turns"}
