"""Most similar vectors by matrices, in several parts, against a comparison pair by pair."""

import random

import pytest
from pyspark.sql import functions as F

from mapfold.operators import vectors as V

ODD = [None, [], [0.0, 0.0, 0.0], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 0.0], [1e200, 1.0, 0.0], [1e-200, 0.0, 0.0], [1.0, 2.0], [2.0, 1.0], [1.0, 1.0, 1.0], [2.0, 2.0, 2.0], [-1.0, -1.0, -1.0]]


def _side(spark, seed: int, odd: bool):
    draw = random.Random(seed)
    rows = [(draw.randrange(3), 2 * k + seed, [float(draw.randrange(-3, 4)) for _ in range(3)], draw.random()) for k in range(60)]
    rows += [(None, 900 + seed, [1.0, 2.0, 3.0], 1.0)]
    if odd:
        rows += [(draw.randrange(3), 200 + 2 * k + seed, v, 0.5) for k, v in enumerate(ODD + ODD)]
    return spark.createDataFrame(rows, "block int, patch_idx long, vec array<double>, saliency double")


def _pairwise(left, right):
    one = lambda df, p: df.groupBy("block", F.col("vec").alias("v" + p)).agg(F.min(F.struct("patch_idx", "saliency")).alias("m")).select("block", F.col("m.patch_idx").alias(p), "v" + p, F.col("m.saliency").alias("s" + p))
    l, r = one(left, "a"), one(right, "b")  # noqa: E741
    pairs = l.join(r, "block").withColumn("sim", V.cosine(F.col("va"), F.col("vb")))
    of_a = pairs.groupBy("block", "a").agg(F.max_by("b", F.struct("sim", -F.col("b"))).alias("b"))
    of_b = pairs.groupBy("block", "b").agg(F.max_by("a", F.struct("sim", -F.col("a"))).alias("a"))
    return pairs.join(of_a.join(of_b, ["block", "a", "b"]), ["block", "a", "b"]).filter("sa > 0.1 AND sb > 0.1").select("block", "a", "b", "sim", "sa", "sb")


@pytest.mark.parametrize("odd", [False, True])
@pytest.mark.parametrize("components", [12, 1 << 20])
def test_mutual_matches_are_those_of_all_pairs(spark, monkeypatch, odd, components):
    monkeypatch.setattr(V, "QUERY_COMPONENTS", components)
    left, right = _side(spark, 0, odd), _side(spark, 1, odd)
    found = V.mutual_nearest(left, right, ["block"], 0.1)
    assert sorted(map(str, found.collect())) == sorted(map(str, _pairwise(left, right).collect()))
    plan = V._most_similar(*(df.select("block", F.col("patch_idx").alias(p), F.col("vec").alias("v" + p)) for df, p in ((left, "a"), (right, "b"))), ["block"])._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan  # no row for each pair
    assert V.mutual_nearest(left.filter("false"), right, ["block"], 0.1).count() == 0


@pytest.mark.parametrize("odd", [False, True])
@pytest.mark.parametrize("components", [12, 1 << 20])
def test_the_first_words_are_those_of_the_whole_list(spark, monkeypatch, odd, components):
    monkeypatch.setattr(V, "QUERY_COMPONENTS", components)
    q = _side(spark, 0, odd).filter("patch_idx % 7 <> 3").select("block", F.col("patch_idx").alias("id"), "vec")
    words = _side(spark, 0, odd).unionByName(_side(spark, 0, odd).limit(20)).select("block", F.col("patch_idx").cast("string").alias("word"), "vec")
    alone = spark.createDataFrame([(9, 5000, [1.0, 2.0, 3.0])], q.schema)
    q, words = q.unionByName(alone), words.unionByName(alone.select("block", F.col("id").cast("string").alias("word"), "vec"))
    whole = V.closest_words(q, words, ["block"]).select("block", "id", F.slice(F.array_remove("words", F.col("id").cast("string")), 1, 3).alias("words"))
    assert sorted(map(str, V.closest_few_words(q, words, ["block"], 3).select("block", "id", "words").collect())) == sorted(map(str, whole.collect()))
