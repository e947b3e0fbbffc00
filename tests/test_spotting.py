"""Boxes are matched by shape with the same result as pair by pair."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from mapfold.functions.text import same_transcription
from mapfold.operators import evaluate as E
from mapfold.operators import spatial as S


def test_boxes_are_matched_by_shape_as_pair_by_pair(spark):
    rng = random.Random(3)
    rows = []
    for k in range(120):
        x, y = rng.randrange(6) * 2.0, rng.randrange(3) * 3.0
        rows.append((k % 2, k, k % 7 != 0, (x, y, x + 10.0, y + 8.0), f"w{rng.randrange(2)}"))
    schema = "image_id long, id long, flag boolean, box struct<xmin:double,ymin:double,xmax:double,ymax:double>, text string"
    df = spark.createDataFrame(rows, schema)
    truth = df.filter("id % 3 <> 0").select("image_id", F.col("id").alias("gt_id"), F.col("flag").alias("care"), "box", "text")
    found = df.filter("id % 3 <> 1").select("image_id", F.col("id").alias("det_id"), (~F.col("flag")).alias("dont_care"), "box", "text")
    pairs = S.overlapping_boxes(
        truth.select(F.col("image_id").alias("map_id"), (F.col("gt_id") * 2).alias("box_id"), "box").unionByName(found.select(F.col("image_id").alias("map_id"), (F.col("det_id") * 2 + 1).alias("box_id"), "box")), 0.1
    ).filter("a % 2 <> b % 2")
    even = F.when(F.col("a") % 2 == 0, F.col("a")).otherwise(F.col("b"))
    pairs = pairs.select(F.col("map_id").alias("image_id"), F.floor(even / 2).alias("gt_id"), F.floor((F.col("a") + F.col("b") - even) / 2).alias("det_id"), "iou")
    pairs = pairs.join(truth.select("image_id", "gt_id", F.col("text").alias("t")), ["image_id", "gt_id"]).join(found.select("image_id", "det_id", F.col("text").alias("u")), ["image_id", "det_id"])
    pairs = pairs.select("image_id", "gt_id", "det_id", "iou", same_transcription(F.col("t"), F.col("u")).alias("same_text"))
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(E.box_spotting(truth, found)) == rows(E.text_spotting(pairs, truth.drop("box", "text"), found.drop("box", "text")))
