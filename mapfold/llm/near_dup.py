"""Near duplicates by MinHash with tensored banding.

A set of word shingles gets two small collections of keys, each key made of two minimum
hashes. Every pair (one key of either collection) names a bucket, so a dozen keys on each
side, 48 minimum hashes, serve 144 tables of four hashes: about the square root of what
independent tables would compute. Two sets of similarity 0.75 miss each other in all
tables once in 10,000 pairs, more similar ones far less often. Two sets can only meet in a
bucket if they share either key, so keys that one set alone has form no buckets.

Candidates are verified on the full sets. First each bucket's members are held against the
member that meets most others, which settles groups of copies with about as many checks as
members. Then only buckets whose members are still in different components are looked at:
finer sketches are compared block by block inside the tasks, and pairs that may be similar
enough are verified too. A pair is looked at in one bucket only, the first of the tensor's
order that both are in. Buckets with the same members count once, as the first of them. Documents with equal
shingle sets are one class from the start and are never paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapfold.llm import textkit
from mapfold.operators.components import connected_components
from mapfold.session import release, table, written

U64 = np.uint64
KEYS = 12  #: keys in each of the two collections
BLOCK = 2048  #: members of a bucket that one task compares at once with as many others
BINS = 1024  #: bytes of a sketch
MEMBERS = 1000  #: members verified against one copy of a pivot's set


def _params() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(75)
    return r.integers(1, 1 << 63, 4 * KEYS, dtype=np.uint64) | U64(1), r.integers(1, 1 << 63, 4 * KEYS, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> Iterator[np.ndarray]:
    """For each row its sorted distinct shingle hashes, of A-Z lower-cased words."""
    data = textkit.LOWER[data]
    starts, ends, first = textkit.words(data, offsets)
    pre = textkit.prefix(textkit.word_hashes(data, starts, ends))
    at = np.arange(len(starts))
    full = textkit.span_hash(pre, at[: max(0, len(at) - size + 1)], at[: max(0, len(at) - size + 1)] + size)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(full[a : b - size + 1])
        elif b > a:
            yield textkit.span_hash(pre, np.array([a]), np.array([b]))
        else:
            yield full[:0]


def signature(shingles: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """48 minimum hashes of 32 bits."""
    low = np.full(len(mul), np.iinfo(np.uint64).max, U64)
    for at in range(0, len(shingles), 1 << 14):  # bounded scratch for very long texts
        np.minimum(low, (shingles[at : at + (1 << 14)] * mul[:, None] + add[:, None]).min(1), out=low)
    return (low >> U64(32)).astype(np.uint32)


def _class_of(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    return int(textkit.mix(s).sum(dtype=U64).view(np.int64)), int(textkit.mix(s ^ U64(0x5555555555555555)).sum(dtype=U64).view(np.int64)) if len(s) else 0


def _sketch(batches):
    mul, add = _params()
    for batch in batches:
        n, one, two, sig = [], [], [], []
        for _, _, data, offsets in textkit.runs(batch):
            for s in shingle_sets(data, offsets):
                a, b = _class_of(s)
                n.append(len(s))
                one.append(a)
                two.append(b)
                sig.append(signature(s, mul, add).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("uid"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "uid", "n_shingles", "c1", "c2", "sig"])


def _halves(sig: np.ndarray) -> np.ndarray:
    sig = sig.astype(U64)
    return textkit.mix(sig[:, ::2] << U64(32) | sig[:, 1::2])


def _half_keys(batches):
    """The 24 keys of each class, from pairs of its minimum hashes; slot tells the place in either collection."""
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, 4 * KEYS)
        half = _halves(sig)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("node").to_numpy(), 2 * KEYS)), pa.array(np.tile(np.arange(2 * KEYS, dtype=np.int32), len(sig))), textkit.as_i64(half.ravel())], ["node", "slot", "half"])


def _buckets(classes: DataFrame) -> DataFrame:
    """(place, key, node): the buckets of each class that another class may share, with their place in the tensor."""
    halves = classes.select("node", "sig").mapInArrow(_half_keys, "node long, slot int, half long")
    twice = halves.groupBy("slot", "half").agg(F.count("*").alias("k")).filter("k > 1").select("slot", "half")
    shared = halves.join(twice, ["slot", "half"]).withColumn("name", F.xxhash64("slot", "half"))
    side = lambda own: F.collect_list(F.when(own, F.struct("slot", "name")))
    sides = shared.groupBy("node").agg(side(F.col("slot") < KEYS).alias("left"), side(F.col("slot") >= KEYS).alias("right"))
    one = lambda x, y: F.struct((x["slot"] * KEYS + y["slot"] - KEYS).alias("place"), F.xxhash64(x["name"], y["name"]).alias("key"))
    pairs = F.flatten(F.transform("left", lambda x: F.transform("right", lambda y: one(x, y))))
    return sides.select("node", F.inline(pairs)).select("place", "key", "node")


def sketch(s: np.ndarray) -> bytes:
    """One byte for each bin: of the least hash in it, 0 if there is none."""
    h = np.sort(textkit.mix(s + U64(0x1234567)))
    bins, at = np.unique(h >> U64(64 - BINS.bit_length() + 1), return_index=True)
    out = np.zeros(BINS, np.uint8)
    out[bins.astype(np.int64)] = 1 + (h[at] >> U64(8)) % U64(255)
    return out.tobytes()


def _sketches(batches):
    """Size, sketch and half keys of each set."""
    mul, add = _params()
    for batch in batches:
        sets = [np.frombuffer(r, U64) for r in batch.column("shingles").to_pylist()]
        halves = [_halves(signature(s, mul, add)[None]).tobytes() for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary()), pa.array(halves, pa.binary())], ["node", "size", "sketch", "halves"])


def _plausible(percent: int):
    """Pairs of a bucket's block that stand in different components and may be similar enough.

    Rows come sorted by bucket and block pair, so one block pair of one bucket is held at a
    time. Sizes bound the similarity exactly. A sketch samples one member of each filled bin
    without putting back, which gives the deviation of the estimate; pairs five deviations
    under the threshold are let go, fewer than one in a million of those at it.
    """
    share = percent / 100

    def pairs(rows):
        ids, labels, side, size = (np.array([r[k] for r in rows]) for k in (1, 2, 3, 4))
        bins = np.frombuffer(b"".join(r[5] for r in rows), np.uint8).reshape(len(rows), -1)
        halves = np.frombuffer(b"".join(r[6] for r in rows), U64).reshape(len(rows), -1)
        l, r = divmod(rows[0][7], KEYS)
        left = np.flatnonzero(side == side.min())
        right = np.flatnonzero(side == side.max())
        for i in left:
            other = right if side.min() != side.max() else right[right > i]
            small, large = np.minimum(size[other], size[i]), np.maximum(size[other], size[i])
            fits = (labels[other] != labels[i]) & (100 * small >= percent * large)
            other, whole = other[fits], (small + large)[fits] / (1 + share)
            if len(other):
                # the first bucket that both are in: no earlier key of either collection agrees
                agree = halves[other] == halves[i]
                here = ~agree[:, :l].any(1) & ~agree[:, KEYS : KEYS + r].any(1)
                other, whole = other[here], whole[here]
            if len(other):
                same = ((bins[other] == bins[i]) & (bins[i] > 0)).sum(1)
                filled = np.maximum(((bins[other] > 0) | (bins[i] > 0)).sum(1), 1)
                deviation = np.sqrt(share * (1 - share) / filled * np.maximum(0, 1 - filled / whole))
                for j in other[same >= (share - 5 * deviation - 0.005) * filled]:
                    yield int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))

    def emit(found):
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    def run(batches):
        held, name = [], None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("name", "node", "label", "side", "size", "sketch", "halves", "place")]
            for row in zip(*columns, strict=True):
                if row[0] != name:
                    if len(held) > 1:
                        yield emit(list(set(pairs(held))))
                    held, name = [], row[0]
                held.append(row)
        if len(held) > 1:
            yield emit(list(set(pairs(held))))

    return run


def _sets(batches):
    """The set of each node; once for repeated rows, which come one after the other."""
    before = None
    for batch in batches:
        nodes = batch.column("node").to_numpy()
        fresh = np.ones(len(nodes), bool)
        fresh[1:] = nodes[1:] != nodes[:-1]
        if len(nodes):
            fresh[0], before = nodes[0] != before, nodes[-1]
        batch, out = batch.filter(pa.array(fresh)), []
        for _, _, data, offsets in textkit.runs(batch):
            out += [s.tobytes() for s in shingle_sets(data, offsets)]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.binary())], ["node", "shingles"])


def _verify(percent: int):
    def run(batches):
        group, pivot = None, None
        for batch in batches:
            a, b = [], []
            for name, node, other, raw in zip(*(batch.column(c).to_pylist() for c in ("name", "a", "b", "shingles")), strict=True):
                s = np.frombuffer(raw, U64)
                if name != group:
                    group, pivot = name, s  # the pivot's own row sorts first
                    continue
                same = len(pivot) + len(s) - len(np.union1d(pivot, s)) if min(len(pivot), len(s)) * 100 >= percent * max(len(pivot), len(s)) else 0
                if 100 * same >= percent * (len(pivot) + len(s) - same):
                    a.append(node)
                    b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough.

    Members travel to their pivot with their sets; a pivot with many members is copied once
    per MEMBERS of them, so that no task gets all members of a hot pivot.
    """
    sized = pairs.groupBy("a").agg(F.count("*").alias("n"))
    parts = sized.withColumn("parts", F.ceil(F.col("n") / MEMBERS).cast("int"))
    members = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    members = members.select(F.struct("a", "part").alias("name"), "a", "b", F.lit(1).alias("later"))
    pivots = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pivots = pivots.select(F.struct("a", "part").alias("name"), "a", F.col("a").alias("b"), F.lit(0).alias("later"))
    rows = members.unionByName(pivots).join(sets.withColumnRenamed("node", "b"), "b")
    rows = rows.select(F.xxhash64("name.a", "name.part").alias("spread"), F.concat_ws(".", "name.a", "name.part").alias("name"), "a", "b", "later", "shingles")
    rows = rows.repartition("spread").sortWithinPartitions("name", "later").select("name", "a", "b", "shingles")
    return rows.mapInArrow(_verify(percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and uid (xxhash64 of doc_id and text) for every row of docs.

    Documents are linked when their sets of 5-word shingles have a Jaccard similarity of
    percent or more; component_id is the smallest doc_id reachable over links. A null or
    empty text has an empty set and is linked with nothing. Repeated rows are linked like
    any equal documents; a null doc_id takes part, but never names a component unless
    all of it is null. Further columns are ignored.
    """
    source = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("uid"), "text")
    rows = written(source.mapInArrow(_sketch, "doc_id long, uid long, n_shingles long, c1 long, c2 long, sig binary"))
    named = rows.filter("n_shingles > 0")
    # node: one row for each distinct set, named by the row that stands for it
    classes = written(named.groupBy("c1", "c2").agg(F.min("doc_id").alias("smallest"), F.min("uid").alias("node"), F.first("sig").alias("sig")))

    buckets = _buckets(classes)
    crowd = F.xxhash64("node"), F.xxhash64("node", F.lit(1))
    shared = buckets.groupBy("place", "key").agg(F.count("*").alias("n"), *(F.bit_xor(c).alias(f"x{k}") for k, c in enumerate(crowd))).filter("n > 1")
    different = shared.groupBy("n", "x0", "x1").agg(F.min(F.struct("place", "key")).alias("first")).select("n", "first.key")
    member = written(buckets.join(different, "key"))
    release(docs.sparkSession)
    met = member.groupBy("node").agg(F.sum("n").alias("met"))
    ranked = member.join(met, "node")
    pivot = written(ranked.groupBy("key").agg(F.max_by("node", F.struct("met", "node")).alias("a")))
    pairs = written(member.join(pivot, "key").filter("a != node").select("a", F.col("node").alias("b")).distinct())

    # a merge join at every size: which documents have candidates is no bounded table
    texts = source.join(member.select(F.col("node").alias("uid")).distinct().hint("merge"), "uid").select(F.col("uid").alias("node"), "text")
    sets = written(texts.mapInArrow(_sets, "node long, shingles binary"))
    links = written(_verified(pairs, sets, percent))

    labels = connected_components(links)
    labelled = member.join(labels, "node", "left").select("place", "key", "node", "n", F.coalesce("component", "node").alias("label"))
    split = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y").select("key")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    open_rows = labelled.join(split, "key").withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    open_rows = open_rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    first, second = F.least("side", "other"), F.greatest("side", "other")
    # every bucket and every block pair of a large one by itself
    open_rows = open_rows.select(F.concat_ws(".", first, second, "key").alias("name"), F.xxhash64("key", first, second).alias("spread"), "node", "label", "side", "place")
    fine = sets.join(open_rows.select("node").distinct(), "node").mapInArrow(_sketches, "node long, size long, sketch binary, halves binary")
    open_rows = open_rows.join(fine, "node").repartition(F.col("spread")).sortWithinPartitions("name").select("name", "node", "label", "side", "size", "sketch", "halves", "place")
    tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    release(docs.sparkSession)
    further = written(open_rows.mapInArrow(_plausible(percent), "a long, b long").distinct().join(tried, ["a", "b"], "left_anti"))
    links = links.unionByName(_verified(further, sets, percent))

    labels = connected_components(written(links))
    members = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = members.groupBy("component").agg(F.min("smallest").alias("component_id"))
    of_class = members.join(smallest, "component").select("c1", "c2", "component_id")
    out = rows.filter("n_shingles > 0").join(of_class, ["c1", "c2"]).select("doc_id", "n_shingles", "component_id", "uid")
    alone = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "uid")
    return out.unionByName(alone).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "uid")


def op2_tensored_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("uid")
