"""Files with many keys cost in proportion to them."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from mapfold.sources import readers as R
from mapfold.sources import writers as W


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_columns_of_a_wide_file_are_not_looked_up(spark):
    rows = spark.createDataFrame([("f", {"0": "a", "1": None}, {"1": [0.5], "7": [0.1]}), ("f", {"0": "b"}, None)], "k string, text map<string,string>, at map<string,array<double>>")
    out = R.column_oriented(rows, ["text", "at"], ["k"])
    assert "element_at" not in _plan(out) and out.columns == ["k", "index", "text", "at"]
    got = sorted(((r["k"], r["index"], r.text, r.at) for r in out.collect()), key=repr)
    assert got == [("f", "0", "a", None), ("f", "0", "b", None), ("f", "1", None, [0.5])]


def test_entries_of_a_description_file_meet_once(spark):
    box = F.struct(F.lit(1.0).alias("xmin"), F.lit(2.0).alias("ymin"), F.lit(3.0).alias("xmax"), F.lit(4.0).alias("ymax"))
    items = spark.range(20).select(F.lit(1).cast("long").alias("map_id"), F.lit("line").alias("feature_type"), box.alias("box"), F.concat(F.lit("d"), F.col("id") + 10).alias("description"), F.lit("s").alias("name"))
    layout = spark.range(1).select(F.lit(1).cast("long").alias("map_id"), *[box.alias(c) for c in ("map_content_box", "poly_box", "ptln_box")])
    out = W.description_records(items.repartition(5), layout)
    assert "filter(" not in _plan(out)
    records = {r.feature_type: json.loads(r.json) for r in out.collect()}
    assert set(records) == {"line", "point", "polygon"} and len(records["point"]) == 3
    assert json.loads(records["line"]["[1.0,2.0,3.0,4.0]"]) == {"description": "d10", "symbol name": "s"}
