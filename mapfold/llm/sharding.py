"""Shards of near-equal bytes by sampled splitters.

The key of a row is (digest of its text, doc_id), so equal texts stand together and a hot
text can still be split. Size-weighted key samples give quantile boundaries; records are
dealt into key ranges, ranges that turn out overfull are subdivided with further samples
(three times at most: what is overfull then is only a longer window, not a wrong shard), and the exact running sum of bytes over ranges (prefix of range totals, then a window
inside each range) settles the shard. All of it is DataFrame work.

Groups of equal texts that weigh at most a hundredth of a shard stay in one shard; larger
ones are cut where a shard is full. A null text has no bytes, repeated rows are rows of
their own, an empty table gives an empty result, and further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapfold.session import table, written

LOW = -(1 << 63)
PER_RANGE = 32  # samples that stand for one range
MAX_RANGES = 4096  # bounds what the driver sees: MAX_RANGES * PER_RANGE sampled keys


def _at_most(key_h: Column, key_id: Column, splitters: list[tuple[str, int]]) -> Column:
    """How many splitters are <= the key, by binary search over constant arrays."""
    hs = F.array(*[F.lit(h) for h, _ in splitters])
    ids = F.array(*[F.lit(i).cast("long") for _, i in splitters])
    n, steps = len(splitters), max(1, len(splitters).bit_length())

    def step(acc: Column, half: Column) -> Column:
        probe = acc + half
        inside = probe <= n
        at = F.when(inside, probe).otherwise(1)
        h, i = F.element_at(hs, at), F.element_at(ids, at)
        return F.when(inside & ((h < key_h) | ((h == key_h) & (i <= key_id))), probe).otherwise(acc)

    halves = F.array(*[F.lit(1 << k) for k in reversed(range(steps))])
    return F.aggregate(halves, F.lit(0), step)


def _cut_points(sample: list, per: int) -> list[tuple[str, int]]:
    """Every per-th sampled key. Within one digest only where it spans several cuts (a hot text)."""
    cuts = sorted((r.h, r.k) for r in sample)[per - 1 :: per]
    out = []
    for n, (h, k) in enumerate(cuts):
        hot = (n and cuts[n - 1][0] == h) or (n + 1 < len(cuts) and cuts[n + 1][0] == h)
        out.append((h, k if hot else LOW))
    return sorted(set(out))


def shard_documents(docs: DataFrame, n_shards: int = 40, rows_per_range: int = 250_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs."""
    text = F.coalesce("text", F.lit(""))
    rows = written(
        docs.select(
            "doc_id",
            F.coalesce("doc_id", F.lit(LOW)).alias("k"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.substring(F.md5(text.cast("binary")), 1, 16).alias("h"),
        )
    )
    total = rows.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    all_bytes = total.b or 1
    n_ranges = min(MAX_RANGES, max(4 * n_shards, -(-total.n // rows_per_range)))
    chance = F.pmod(F.xxhash64("h", "k", F.lit(29)), F.lit(1 << 40)) / float(1 << 40)

    def draw(frame: DataFrame, wanted: int, weight: int) -> list:
        return frame.filter(chance < F.col("size") * (wanted / weight)).select("h", "k").collect()

    splitters = _cut_points(draw(rows, n_ranges * PER_RANGE, all_bytes), PER_RANGE) or [("", LOW)]
    for _ in range(3):
        ranged = rows.withColumn("range", _at_most(F.col("h"), F.col("k"), splitters))
        full = 2.5 * all_bytes / n_ranges
        over = ranged.groupBy("range").agg(F.sum("size").alias("b"), F.max("size").alias("m")).filter((F.col("b") > full) & (F.col("b") > 2 * F.col("m"))).collect()
        if not over or len(splitters) >= MAX_RANGES:
            break
        inside = ranged.filter(F.col("range").isin([r.range for r in over]))
        finer = _cut_points(draw(inside, 4 * PER_RANGE * len(over), sum(r.b for r in over)), PER_RANGE)
        further = sorted(set(finer) - set(splitters))
        if not further:
            break
        room = MAX_RANGES - len(splitters)  # beyond it every so many-th further cut is made, all over the keys
        splitters = sorted({*splitters, *further[:: -(-len(further) // room)]})
    hot = sorted({h for h, k in splitters if k != LOW})

    ranged = rows.withColumn("range", _at_most(F.col("h"), F.col("k"), splitters))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = (  # one row a range: MAX_RANGES at most
        ranged.groupBy("range")
        .agg(F.sum("size").alias("b"), F.count("*").alias("n"))
        .select("range", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"))
    )
    in_range = Window.partitionBy("range").orderBy("h", "k")
    group = Window.partitionBy("range", "h")
    start = F.col("bytes_before") + F.coalesce(F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = (
        ranged.join(F.broadcast(bases), "range")
        .withColumn("start", start)
        .withColumn("row", F.col("rows_before") + F.row_number().over(in_range) - 1)
        .withColumn("group_start", F.min("start").over(group))
        .withColumn("group_bytes", F.sum("size").over(group))
    )
    small = (F.col("group_bytes") * (100 * n_shards) <= all_bytes) & (~F.col("h").isin(hot) if hot else F.lit(True))
    place = F.when(small, F.col("group_start")).otherwise(F.col("start"))
    placed = placed.withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(place.cast("decimal(38,0)") * n_shards / F.lit(all_bytes)).cast("int")))
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # one row a shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first_row")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op9_sampled_splitters(spark, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
