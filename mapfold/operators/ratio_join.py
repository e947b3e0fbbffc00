"""Joins of texts by the ratio of their longest common subsequence.

The ratio is 2 * common / both lengths. Two texts of lengths a and b that reach a threshold
t share a subsequence of L = t (a + b) / 2 characters at least, and so many characters.
They also share L - (q - 1)(a + b - 2 L + 1) q-grams at least: a character taken out breaks
q of them, one put in q - 1. Every text names its rarest q-grams, one more than it could do
without, and texts meet by those; what everyone has is named by few. Pairs of q = 2 serve
thresholds over two thirds and texts long enough for the bound to be one; others meet by
single characters. Pairs that fit in length as well are verified by the bit-parallel
subsequence.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapfold.functions.similarity import subsequence_ratio
from mapfold.session import written


def _grams(c: str, q: int) -> Column:
    """The q-grams of a text, each with its number among equal ones, as strings of the form n:gram."""
    places = F.sequence(F.lit(1), F.greatest(F.length(c) - q + 1, F.lit(0)))
    grams = F.when(F.length(c) >= q, F.transform(places, lambda p: F.substring(F.col(c), p, F.lit(q)))).otherwise(F.array().cast("array<string>"))
    ordered = F.array_sort(grams)
    number = lambda g, i: F.concat((i - F.array_position(ordered, g) + 1).cast("string"), F.lit(f":{q}:"), g)
    return F.transform(ordered, number)


def _least(n: Column, threshold: float, q: int) -> Column:
    """q-grams that a text of n characters shares with any partner at least."""
    partner = n * threshold / (2 - threshold)
    common = threshold * (n + partner) / 2
    return F.floor(common - (q - 1) * (n + partner - 2 * common + 1) - 1e-9) + 1


def _named(texts: DataFrame, threshold: float, q: int, side: str) -> DataFrame:
    """(text, n, gram): candidates for the prefix of each text; least says how many it shares."""
    t = texts.select("text", F.length("text").alias("n")).withColumn("least", _least(F.col("n"), threshold, q)).filter("least >= 1")
    return t.select("text", "n", "least", F.explode(_grams("text", q)).alias("gram"), F.lit(side).alias("side"))


def _prefixes(both: DataFrame) -> DataFrame:
    """The rarest grams of each text: as many as it has, less those it shares at least, and one more."""
    frequency = both.groupBy("gram").agg(F.count("*").alias("f"))
    order = Window.partitionBy("side", "text").orderBy("f", "gram")
    total = F.count("*").over(Window.partitionBy("side", "text"))
    ranked = both.join(frequency, "gram").withColumn("at", F.row_number().over(order)).withColumn("of", total)
    return ranked.filter(F.col("at") <= F.col("of") - F.col("least") + 1)


def _pairs(left: DataFrame, right: DataFrame, threshold: float, q: int) -> DataFrame:
    named = written(_prefixes(_named(left, threshold, q, "l").unionByName(_named(right, threshold, q, "r"))))
    l = named.filter("side = 'l'").select("gram", F.col("text").alias("a"), F.col("n").alias("an"))  # noqa: E741
    r = named.filter("side = 'r'").select("gram", F.col("text").alias("b"), F.col("n").alias("bn"))
    fits = 2 * F.least("an", "bn") >= threshold * (F.col("an") + F.col("bn")) - 1e-9
    return l.join(r, "gram").filter(fits).select("a", "b").distinct()


def ratio_join(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, ratio): every pair of different texts of either side whose ratio is threshold or more (TXT8, JN10).

    left, right: text; equal texts of a side count once, nulls and empty texts not at all.
    The threshold is over 0. Lengths and grams are in code points.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be over 0 and at most 1")
    left, right = (df.select("text").filter("text IS NOT NULL AND text <> ''").distinct() for df in (left, right))
    # from so many characters on a text shares a pair of characters with any partner
    long = next((n for n in range(1, 200) if _least_of(n, threshold, 2) >= 1), None) if threshold > 2 / 3 else None
    if long is None:
        found = _pairs(left, right, threshold, 1)
    else:
        size = F.length("text")
        short_l, short_r = left.filter(size < long), right.filter(size < long)
        # partners of short texts are not much longer
        near = math.ceil(long * (2 - threshold) / threshold) + 1
        found = _pairs(left.filter(size >= long), right.filter(size >= long), threshold, 2)
        found = found.unionByName(_pairs(short_l, right.filter(size < near), threshold, 1))
        found = found.unionByName(_pairs(left.filter((size >= long) & (size < near)), short_r, threshold, 1))
    scored = found.withColumn("ratio", subsequence_ratio("a", "b"))
    return scored.filter(F.col("ratio") >= threshold - 1e-12)


def _least_of(n: int, threshold: float, q: int) -> int:
    partner = n * threshold / (2 - threshold)
    common = threshold * (n + partner) / 2
    return math.floor(common - (q - 1) * (n + partner - 2 * common + 1) - 1e-9) + 1


def best_matches(left: DataFrame, right: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(text, match, ratio): for every text of left the most similar of right, of equal ones the first; itself without one (JN10)."""
    best = ratio_join(left, right, threshold).groupBy(F.col("a").alias("text")).agg(F.min(F.struct((-F.col("ratio")).alias("r"), "b")).alias("m"))
    texts = left.select("text").filter("text IS NOT NULL").distinct()
    return texts.join(best, "text", "left").select("text", F.coalesce("m.b", "text").alias("match"), (-F.col("m.r")).alias("ratio"))
