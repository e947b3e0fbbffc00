"""K-means and principal components by group, repeatable whatever the layout of the rows.

Vectors become unit vectors in fixed point, so sums, means and distances are whole numbers
that don't depend on the order in which tasks add them up. Sums of squared distances stay
within 64 bits up to eight thousand million rows a group; beyond that Spark raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapfold.session import written

ONE = 1 << 14


def grid(vec: Column) -> Column:
    """The unit vector of vec in steps of 1 / ONE; a zero vector stays zero. Null for a null vector or one with a null or infinite component."""
    x = F.transform(vec, lambda v: v.cast("double"))
    sound = F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    return F.when(sound, F.transform(x, lambda v: F.floor(F.coalesce(F.try_divide(v, length), F.lit(0.0)) * ONE + 0.5)))


def _gap(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda s, v: s + v)


def _placed(rows: DataFrame, block: list[str], key: list[str]) -> DataFrame:
    """rows (block, key, vec) with a sound vector, in fixed point and with their digest, as a table that every round reads."""
    name = F.concat_ws("/", *[F.col(c).cast("string") for c in key])
    placed = rows.select(*block, *key, grid(F.col("vec")).alias("_f"), F.md5(F.concat(name, F.lit("/1")).cast("binary")).alias("_digest"))
    return written(placed.filter("_f IS NOT NULL"))


def _farthest(k: int):
    """The seeds of one group's sample."""

    def solve(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values("_rank")
        at = np.stack(sample["_f"].to_numpy()).astype(np.int64)
        chosen, near = [0], ((at - at[0]) ** 2).sum(axis=1)
        while len(chosen) < k and near.max() > 0:
            chosen.append(int(near.argmax()))  # of equals the first by rank
            near = np.minimum(near, ((at - at[chosen[-1]]) ** 2).sum(axis=1))
        head = sample.iloc[:1].drop(columns=["_f", "_rank"])
        return head.assign(centres=[[at[i].tolist() for i in chosen]])

    return solve


def _seeds(placed: DataFrame, block: list[str], key: list[str], k: int, per: int = 64) -> DataFrame:
    """(block, centres): in each group up to k vectors that stand far apart, the first ones being the seeds of a smaller k.

    They are looked for in the group's first per * k rows by digest, a bounded sample: the
    first of it, then each time the row farthest from those taken. Groups with fewer
    different vectors get fewer. The rounds afterwards read all rows.
    """
    order = Window.partitionBy(*(block or [F.lit(0)])).orderBy("_digest", *key)
    sample = placed.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= per * k).select(*block, "_f", "_rank")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in placed.select(*block).schema]
    return sample.groupBy(*block).applyInPandas(_farthest(k), ", ".join([*fields, "centres array<array<bigint>>"]))


def _nearest(placed: DataFrame, block: list[str], centres: DataFrame) -> DataFrame:
    """placed with cluster and cost, the squared distance to its nearest centre; of equally near ones the first."""
    c = centres.select(*block, "centres")
    joined = placed.join(c, block) if block else placed.crossJoin(F.broadcast(c))  # one row of k vectors without groups
    gaps = F.transform("centres", lambda c, i: F.struct(_gap(F.col("_f"), c).alias("cost"), i.alias("cluster")))
    return joined.withColumn("_best", F.array_min(gaps)).withColumns({"cluster": F.col("_best.cluster"), "cost": F.col("_best.cost")}).drop("_best", "centres")


def _moved(placed: DataFrame, block: list[str], centres: DataFrame, rounds: int) -> DataFrame:
    """(block, centres) after at most that many rounds over all rows; a centre without rows stays where it is. Ends when none moves."""
    for _ in range(rounds):
        parts = _nearest(placed, block, centres).select(*block, "cluster", F.posexplode("_f").alias("_pos", "_x"))
        sums = parts.groupBy(*block, "cluster", "_pos").agg(F.sum("_x").alias("_s"), F.count("*").alias("_n"))
        means = sums.select(*block, "cluster", F.struct("_pos", F.expr("(_s - pmod(_s, _n)) div _n").alias("_m")).alias("_part"))
        vectors = means.groupBy(*block, "cluster").agg(F.transform(F.array_sort(F.collect_list("_part")), lambda p: p["_m"]).alias("_v"))
        to = vectors.groupBy(*block).agg(F.map_from_entries(F.collect_list(F.struct("cluster", "_v"))).alias("_to"))
        both = centres.join(to, block) if block else centres.crossJoin(to)
        after = F.transform("centres", lambda c, i: F.coalesce(F.try_element_at("_to", i), c))
        both = written(both.select(*block, after.alias("_after"), (after != F.col("centres")).alias("_moves")))
        centres = both.select(*block, F.col("_after").alias("centres"))
        if both.filter("_moves").isEmpty():
            break
    return centres


def _labelled(rows: DataFrame, placed: DataFrame, block: list[str], key: list[str], centres: DataFrame) -> DataFrame:
    found = _nearest(placed, block, centres).select(*block, *key, "cluster", "cost")
    return rows.join(found, [*block, *key], "left")


def clusters(rows: DataFrame, k: int, key: list[str], block: list[str] | None = None, rounds: int = 20) -> DataFrame:
    """rows (block, key, vec, ..) with cluster (from 0) and cost, the squared distance to its mean in steps of 1 / ONE (VEC6).

    Each group of block is clustered by itself. Rows without a sound vector get nulls; key
    is unique in a group. The same rows give the same clusters in any layout.
    """
    block = block or []
    placed = _placed(rows, block, key)
    start = written(_seeds(placed, block, key, k))
    return _labelled(rows, placed, block, key, _moved(placed, block, start, rounds))


def elbow(rows: DataFrame, key: list[str], block: list[str] | None = None, most: int = 14, stop: float = 0.975, rounds: int = 20) -> DataFrame:
    """(block, k, cost, centres): the first k of each group whose cost is over stop times that of k - 1 (VEC6).

    Cost is the sum of squared distances. A group also ends with as many clusters as it has
    seeds, and with most. Groups that have ended take no part in later rounds.
    """
    block = block or []
    placed = _placed(rows, block, key)
    open_ = written(_seeds(placed, block, key, most)).select(*block, F.col("centres").alias("_seeds"), F.lit(None).cast("long").alias("_before"))
    done = None
    for k in range(1, most + 1):
        start = open_.select(*block, F.slice("_seeds", 1, k).alias("centres"))
        centres = _moved(placed, block, start, rounds)
        costs = _nearest(placed, block, centres).groupBy(*block).agg(F.sum("cost").alias("cost"))
        whole = open_.join(centres, block).join(costs, block) if block else open_.crossJoin(centres).crossJoin(costs.filter("cost IS NOT NULL"))
        ends = F.coalesce(F.col("cost") > stop * F.col("_before"), F.lit(False)) | (F.size("_seeds") <= k) | F.lit(k == most)
        whole = written(whole.withColumns({"_ends": ends, "k": F.lit(k)}))
        ended = whole.filter("_ends").select(*block, "k", "cost", "centres")
        done = ended if done is None else done.unionByName(ended)
        open_ = whole.filter("NOT _ends").select(*block, "_seeds", F.col("cost").alias("_before"))
        if open_.isEmpty():
            break
    return done


def elbow_clusters(rows: DataFrame, key: list[str], block: list[str] | None = None, most: int = 14, stop: float = 0.975, rounds: int = 20) -> DataFrame:
    """rows with cluster and cost for the k that elbow finds in their group (VEC6)."""
    block = block or []
    found = written(elbow(rows, key, block, most, stop, rounds))
    return _labelled(rows, _placed(rows, block, key), block, key, found)


def spread_pairs(pairs: DataFrame, k: int, block: list[str], rounds: int = 20) -> DataFrame:
    """(block, a, b, cluster, saliency, rank): of matches those that lie well apart (VEC5, WIN10).

    pairs: block, a, b, va, vb, sa, sb. Both vectors of a pair are laid end to end and
    clustered inside their group; each cluster gives the pair of the highest mean saliency
    (ties: smaller a, then b), ranked in its group. Groups of fewer pairs give all of them
    that differ.
    """
    joint = pairs.select(*block, "a", "b", F.concat("va", "vb").alias("vec"), ((F.col("sa") + F.col("sb")) / 2).alias("saliency"))
    found = clusters(joint, k, ["a", "b"], block, rounds).filter("cluster IS NOT NULL").drop("vec", "cost")
    first = Window.partitionBy(*block, "cluster").orderBy(F.desc("saliency"), "a", "b")
    best = found.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    order = Window.partitionBy(*(block or [F.lit(0)])).orderBy(F.desc("saliency"), "a", "b")
    return best.withColumn("rank", F.row_number().over(order))


def _moments(names: list[str]):
    """Counts, sums and outer products of runs of equal groups, as long as a run lasts in its partition."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total = None, None
        for rows in batches:
            group = list(rows[names].itertuples(index=False, name=None))
            edges = [i for i in range(len(group)) if i == 0 or group[i] != group[i - 1]] + [len(group)]
            for a, b in zip(edges, edges[1:]):
                x = np.stack(rows["_v"].iloc[a:b].to_numpy()).astype(np.float64)
                if total is not None and group[a] != now:
                    yield pd.DataFrame([[*now, total.ravel().tolist()]], columns=[*names, "_sums"])
                    total = None
                x = np.hstack([np.ones((len(x), 1)), x])  # row 0 of the product: count and sums
                now, total = group[a], x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame([[*now, total.ravel().tolist()]], columns=[*names, "_sums"])

    return solve


def _axes(names: list[str], k: int):
    """Mean and first k axes of one group from its summed products."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for row in rows.itertuples(index=False):
                whole = np.asarray(row[-1], dtype=np.float64)
                d = int(np.sqrt(len(whole)))
                whole = whole.reshape(d, d)
                n, mean = whole[0, 0], whole[0, 1:] / whole[0, 0]
                spread, axes = np.linalg.eigh(whole[1:, 1:] / n - np.outer(mean, mean))
                axes = axes[:, ::-1][:, :k].T
                heads = axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)]
                out.append([*row[:-1], mean.tolist(), (axes * np.where(heads < 0, -1.0, 1.0)[:, None]).tolist(), np.maximum(spread[::-1][:k], 0).tolist()])
            yield pd.DataFrame(out, columns=[*names, "mean", "axes", "variances"])

    return solve


def axes(rows: DataFrame, k: int, block: list[str] | None = None) -> DataFrame:
    """(block, mean, axes, variances): the first k principal axes of each group's vectors (VEC7).

    Each partition adds up the outer products of its runs of a group, in order of group, so
    a task holds one matrix; the sums meet by group and place in the matrix. The largest
    part of an axis is positive. Vectors with null or infinite parts take no part; the
    vectors of a group are of one length.
    """
    names = block or ["_all"]
    x = F.transform("vec", lambda v: v.cast("double"))
    sound = F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    base = (rows if block else rows.withColumn("_all", F.lit(0))).filter(sound).select(*names, x.alias("_v"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.select(*names).schema)
    parts = base.sortWithinPartitions(*names).mapInPandas(_moments(names), f"{fields}, _sums array<double>")
    sums = parts.select(*names, F.posexplode("_sums").alias("_pos", "_x")).groupBy(*names, "_pos").agg(F.sum("_x").alias("_s"))
    whole = sums.groupBy(*names).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_s"))), lambda p: p["_s"]).alias("_whole"))
    found = whole.mapInPandas(_axes(names, k), f"{fields}, mean array<double>, axes array<array<double>>, variances array<double>")
    return found if block else found.drop("_all")


def principal(rows: DataFrame, k: int, block: list[str] | None = None) -> DataFrame:
    """rows with components, their places on the first k principal axes of their group (VEC7); null without a sound vector."""
    found = written(axes(rows, k, block)).drop("variances")
    joined = rows.join(found, block, "left") if block else rows.join(F.broadcast(found), how="left")
    sound = F.forall("vec", lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))
    off = F.zip_with("vec", "mean", lambda v, m: v.cast("double") - m)
    on = F.transform("axes", lambda a: F.aggregate(F.zip_with(a, off, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v))
    return joined.withColumn("components", F.when(sound, on)).drop("mean", "axes")
