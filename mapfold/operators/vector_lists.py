"""Exact nearest vectors through inverted lists.

Centroids come from a bounded sample; every row stands in the list of its nearest centroid.
A query first looks into the lists whose centroids are nearest, which gives a bound for its
k-th distance, and then into every other list that could hold something closer: one whose
centroid is no farther than the bound and the list's radius together. The sample decides
how much is compared, never what is found.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapfold.operators.vectors import QUERY_COMPONENTS, ROW_COMPONENTS, closest, measured, odd_pairs, parts, sound_and_odd
from mapfold.session import written

SAMPLE = 20_000  #: vectors that centroids are fitted on
LISTS = 1024  #: lists at most
PROBES = 4  #: lists that give the bound


def centroids(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """k means of the sample, from evenly spaced rows; means without rows stay where they are."""
    at = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    for _ in range(rounds):
        own = _nearest(sample, at)[0]
        total, n = np.zeros_like(at), np.bincount(own, minlength=k)
        np.add.at(total, own, sample)
        at = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], at)
    return at


def _distances(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (at * at).sum(1)[None] - 2 * x @ at.T, 0))


def _nearest(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = np.concatenate([_distances(x[k : k + 4096], at).argmin(1) for k in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)
    return own, np.sqrt(((x - at[own]) ** 2).sum(1))


def _rows(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


def nearest_by_lists(queries: DataFrame, base: DataFrame, k: int, exclude_self: bool = True, probes: int = PROBES) -> DataFrame:
    """(query_id, id, distance, rank): exact k nearest by Euclidean distance, ties to the smaller id (VEC1).

    queries, base: id, vec, all of one length; rows without a vector take no part. An empty
    base gives no rows.
    """
    given = base.select("id", "vec").filter("vec IS NOT NULL")
    asking = queries.select("id", "vec").filter("vec IS NOT NULL")
    _, odd, dims = measured(given)
    m, strange, _ = measured(asking, dims)
    known = sound_and_odd(given, dims)[0]
    others = odd_pairs(asking, given, (strange, odd), dims, k, 16, exclude_self)
    first = known.orderBy(F.xxhash64("id")).limit(SAMPLE).collect()
    if not first:
        nothing = queries.select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("distance")).limit(0)
        return _best(reduce(DataFrame.unionByName, others, nothing), k)
    sample = np.array([r["vec"] for r in first], np.float64)
    at = centroids(sample, min(LISTS, max(1, math.isqrt(len(sample)))))

    @F.pandas_udf("struct<list: int, off: double>")
    def placed(vec: pd.Series) -> pd.DataFrame:
        own, off = _nearest(_rows(vec), at) if len(vec) else (np.zeros(0, int), np.zeros(0))
        return pd.DataFrame({"list": own.astype(np.int32), "off": off})

    lists = written(known.withColumn("_p", placed("vec")).select("id", "vec", F.col("_p.list").alias("list"), F.col("_p.off").alias("off")))
    radius, blocks = np.full(len(at), -np.inf), [1] * len(at)
    for r in lists.groupBy("list").agg(F.max("off").alias("r"), F.count("*").alias("n")).collect():  # one row for each list
        radius[r["list"]], blocks[r["list"]] = r["r"], parts(r["n"], dims, ROW_COMPONENTS)
    some = np.flatnonzero(radius > -np.inf)

    @F.pandas_udf("array<struct<list: int, least: double>>")
    def ways(vec: pd.Series) -> pd.Series:
        """Lists by the distance of their centroids, with the least distance of what they hold."""
        out = []
        for d in _distances(_rows(vec), at[some]) if len(vec) else ():
            by = np.argsort(d, kind="stable")
            least = d[by] - radius[some][by] - 1e-6 * (1 + d[by])  # room for rounding
            out.append([{"list": int(a), "least": float(b)} for a, b in zip(some[by], least, strict=True)])
        return pd.Series(out, dtype=object)

    q = written(sound_and_odd(asking, dims)[0].withColumn("ways", ways("vec")))
    # long lists are cut into blocks, and so are the queries
    of_list, of_queries = F.element_at(F.array(*map(F.lit, blocks)), F.col("list") + 1), F.lit(parts(m, dims, QUERY_COMPONENTS))
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))

    def compared(asked: DataFrame) -> DataFrame:
        q = asked.select("id", "vec", "list", own(of_queries).alias("_part"), every(of_list).alias("_block"))
        b = lists.select("id", "vec", "list", own(of_list).alias("_block"), every(of_queries).alias("_part"))
        # the best of each block are enough, so that a query's rows stay few
        return closest(q, b, ["list", "_block", "_part"], k, exclude_self)

    near = q.select("id", "vec", F.explode(F.slice("ways", 1, probes)).alias("w"))
    found = written(_best(compared(near.select("id", "vec", "w.list")), k))
    bound = found.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("distance").alias("bound"))
    rest = q.select("id", "vec", F.explode(F.slice("ways", probes + 1, LISTS)).alias("w")).join(bound, "id", "left")
    rest = rest.filter(F.col("bound").isNull() | (F.col("w.least") <= F.col("bound")))
    more = compared(rest.select("id", "vec", "w.list"))
    return _best(reduce(DataFrame.unionByName, others, found.drop("rank").unionByName(more)), k)


def _best(scored: DataFrame, k: int) -> DataFrame:
    """(query_id, id, distance, rank): the first k of each query."""
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "id", "distance", "rank")
