"""Connected components over an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapfold.session import dropped, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge.

    Each round hangs the larger neighbours of every node on its smallest neighbour, then
    the smaller ones, so paths shrink to stars in a logarithmic number of rounds. Every
    step is an aggregation and an equi-join whose rows never exceed twice the edges, and
    a compressed table in the shared folder cuts lineage once a round; that of the round before is deleted. Loops, repeated edges and null ends are ignored.
    """
    links = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    links = written(links)
    fingerprint = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.col("u"), F.col("v"))).alias("x"), "m")
        last, links = links, written(small.filter("x > m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct())
        dropped(last)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == fingerprint:
            break
        fingerprint = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
