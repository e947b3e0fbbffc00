"""Exact set-similarity join by PartEnum signatures.

Sets are dealt to size bands, each as wide as the similarity allows, so that two sets which
link stand in the same band or in neighbouring ones. Inside a band similarity bounds the
number of shingles that only one of both has, k. The domain of shingle hashes is cut into
n1 = k // 2 + 1 equal ranges: in one of them at most one shingle differs. Each range is cut
into three, so two of the three agree there, and each of the three ways to choose two makes
a signature of what the set holds in them. Sets that link share a signature, always; there
is no chance in it but that of hashes being equal. A set of n shingles has about 0.17 n
signatures for its own band and as many for the next.

Sets that are equal are one class from the start. Of each signature's classes the one that
meets most others is held against the rest on full sets, which settles groups of copies.
Only signatures whose classes are still in different components are looked at again: all
but the largest component's members against all members, block by block inside the tasks.
There a lower bound of the difference, the number of fine ranges whose digests are unequal,
lets pairs go that can't link; it is exact, none that links is let go. What passes is
verified on full sets.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapfold.llm import textkit
from mapfold.llm.near_dup import BLOCK, _class_of, _verified, shingle_sets
from mapfold.operators.components import connected_components
from mapfold.session import table, written

U64 = np.uint64
WAYS = 3  #: pieces of a range; signatures leave out one of them
FINE = 8  #: ranges of the lower bound for each shingle that may differ


@cache
def bands(percent: int) -> list[tuple[int, int, int]]:
    """(smallest size, largest size, shingles that may differ in the band and the one before) of sizes up to 2**36."""
    out, low = [], 1
    while low < 1 << 36:
        high = 100 * low // percent
        out.append((low, high, 2 * high * (100 - percent) // (100 + percent)))
        low = high + 1
    return out


def band_of(size: int, percent: int) -> int:
    return int(np.searchsorted([b[0] for b in bands(percent)], size, "right")) - 1


@cache
def _cuts(pieces: int) -> np.ndarray:
    """Where the domain of 64-bit hashes is cut into equal ranges."""
    return np.array([(n << 64) // pieces for n in range(1, pieces)], U64)


def digests(s: np.ndarray, pieces: int) -> np.ndarray:
    """For each range of the domain a sum over the set's shingles in it; s is sorted."""
    total = np.zeros(len(s) + 1, U64)
    np.cumsum(textkit.mix(s ^ U64(0x5A17)), out=total[1:])
    at = np.concatenate([[0], np.searchsorted(s, _cuts(pieces)), [len(s)]])
    return total[at[1:]] - total[at[:-1]]


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """The set's signatures for its own band and the next, with the band in the last byte."""
    own, out = band_of(len(s), percent), []
    for band in (own, own + 1):
        differ = bands(percent)[band][2]
        if not differ:
            continue  # only equal sets link, and those are one class
        ranges = differ // 2 + 1
        piece = digests(s, WAYS * ranges).reshape(ranges, WAYS)
        rest = textkit.mix(piece.sum(1, dtype=U64)[:, None] - piece)
        name = np.arange(WAYS * ranges, dtype=U64).reshape(ranges, WAYS) + U64(band << 40)
        out.append(textkit.mix(rest ^ textkit.mix(name)).ravel() & ~U64(255) | U64(band))
    return np.concatenate(out) if out else np.zeros(0, U64)


def _measure(size: int, percent: int):
    """For each row its set's size, class and signatures."""

    def run(batches):
        for batch in batches:
            n, one, two, sig = [], [], [], []
            for _, _, data, offsets in textkit.runs(batch):
                for s in shingle_sets(data, offsets, size):
                    a, b = _class_of(s)
                    n.append(len(s))
                    one.append(a)
                    two.append(b)
                    sig.append(signatures(s, percent).tobytes() if len(s) else b"")
            columns = [batch.column("doc_id"), batch.column("uid"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "uid", "n_shingles", "c1", "c2", "sigs"])

    return run


def _keys(batches):
    """A row for each signature of each class."""
    for batch in batches:
        raw = batch.column("sigs").to_pylist()
        node = np.repeat(batch.column("node").to_numpy(), [len(r) // 8 for r in raw])
        key = np.frombuffer(b"".join(raw), np.int64)
        for at in range(0, len(key), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(key[at : at + (1 << 16)]), pa.array(node[at : at + (1 << 16)])], ["key", "node"])


def _met(batches):
    """Of rows sorted by key those whose key another row has; one row is held from batch to batch."""
    key, node, paired = np.zeros(0, np.int64), np.zeros(0, np.int64), False

    def out(chosen, k, n):
        return pa.RecordBatch.from_arrays([pa.array(k[chosen]), pa.array(n[chosen])], ["key", "node"])

    for batch in batches:
        key = np.concatenate([key, batch.column("key").to_numpy()])
        node = np.concatenate([node, batch.column("node").to_numpy()])
        if not len(key):
            continue
        same = key[1:] == key[:-1]
        before = np.concatenate([[paired], same])
        chosen = before.copy()
        chosen[:-1] |= same
        yield out(chosen[:-1], key[:-1], node[:-1])
        key, node, paired = key[-1:], node[-1:], bool(before[-1])
    if paired:
        yield out(np.ones(1, bool), key, node)


def _sets(size: int):
    """The set of each node; once for repeated rows, which come one after the other."""

    def run(batches):
        before = None
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            fresh = np.ones(len(nodes), bool)
            fresh[1:] = nodes[1:] != nodes[:-1]
            if len(nodes):
                fresh[0], before = nodes[0] != before, nodes[-1]
            batch, out = batch.filter(pa.array(fresh)), []
            for _, _, data, offsets in textkit.runs(batch):
                out += [s.tobytes() for s in shingle_sets(data, offsets, size)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.binary())], ["node", "shingles"])

    return run


def fine(s: np.ndarray, band: int, percent: int) -> bytes:
    """One byte for each fine range of the band."""
    return (textkit.mix(digests(s, FINE * bands(percent)[band][2])) >> U64(56)).astype(np.uint8).tobytes()


def _sketches(percent: int):
    """The fine digests of each set, for the band asked for."""

    def run(batches):
        for batch in batches:
            sets = [np.frombuffer(r, U64) for r in batch.column("shingles").to_pylist()]
            sketch = [fine(s, band, percent) for s, band in zip(sets, batch.column("band").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("band"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sketch, pa.binary())], ["node", "band", "size", "sketch"])

    return run


def _possible(percent: int):
    """Pairs of a cell, one from either side, in different components, that the lower bound leaves.

    Rows come sorted by cell, so one cell is held at a time, two blocks at most.
    """

    def pairs(rows):
        ids, labels, side, size = (np.array([r[k] for r in rows]) for k in (1, 2, 3, 4))
        bins = np.frombuffer(b"".join(r[5] for r in rows), np.uint8).reshape(len(rows), -1)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        within = not len(right)
        for i in left:
            other = left[left > i] if within else right
            both, least = size[other] + size[i], np.minimum(size[other], size[i])
            other = other[(labels[other] != labels[i]) & (100 * least >= percent * (both - least))]
            differ = (bins[other] != bins[i]).sum(1)
            for j in other[(100 + percent) * differ <= (100 - percent) * (size[other] + size[i])]:
                yield int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))

    def run(batches):
        held, cell = [], None

        def emit():
            found = list(set(pairs(held))) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("cell", "node", "label", "side", "size", "sketch")), strict=True):
                if row[0] != cell:
                    yield emit()
                    held, cell = [], row[0]
                held.append(row)
        yield emit()

    return run


def _cells(member: DataFrame, labels: DataFrame) -> DataFrame:
    """(cell, node, label, side, band): what is to be compared in the signatures that hold several components.

    The largest component of a signature, its bulk, isn't compared with itself: cells are a
    block of the rest with a block of the bulk, or two blocks of the rest.
    """
    labelled = member.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label"))
    sized = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    per_key = sized.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("bulk"), F.max("n").alias("of_bulk"), (F.sum("n") - F.max("n")).alias("of_rest")).filter("of_rest > 0")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    rows = labelled.join(per_key, "key").withColumn("nb", blocks("of_bulk")).withColumn("nr", blocks("of_rest"))
    rest = rows.filter("label != bulk").withColumn("own", F.pmod(F.xxhash64("node"), F.col("nr")).cast("int"))
    bulk = rows.filter("label = bulk").withColumn("own", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    cell = lambda kind, r, o: F.concat_ws(".", "key", F.lit(kind), r, o).alias("cell")
    shape = lambda df, kind, r, o, side: df.select(cell(kind, r, o), "key", "node", "label", side.cast("int").alias("side"))
    of_rest = shape(rest.withColumn("o", every("nb")), "b", "own", "o", F.lit(0))
    of_bulk = shape(bulk.withColumn("r", every("nr")), "b", "r", "own", F.lit(1))
    low, high = F.least("own", "o"), F.greatest("own", "o")
    among = shape(rest.withColumn("o", every("nr")), "r", low, high, F.when(F.col("own") > F.col("o"), 1).otherwise(0))
    return of_rest.unionByName(of_bulk).unionByName(among).withColumn("band", F.col("key").bitwiseAND(255).cast("int"))


def similar_sets(docs: DataFrame, percent: int = 90, size: int = 3) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs.

    Documents link when their sets of `size`-word shingles (A-Z lower-cased; a shorter text
    is one shingle) have a Jaccard similarity of percent or more; component_id is the
    smallest doc_id reachable over links. A null or empty text has an empty set and links
    with nothing. Repeated rows link like any equal documents; a null doc_id takes part,
    but names a component only if all of it is null. Further columns are ignored; an empty
    table gives an empty result.
    """
    source = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("uid"), "text")
    rows = written(source.mapInArrow(_measure(size, percent), "doc_id long, uid long, n_shingles long, c1 long, c2 long, sigs binary"))
    # node: one for each distinct set, named by the row that stands for it
    classes = written(rows.filter("n_shingles > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("smallest"), F.min("uid").alias("node")))
    # repeated rows have one uid and equal signatures, so the first of a uid stands for all
    told = rows.filter("n_shingles > 0").select(F.col("uid").alias("node"), "sigs").join(classes.select("node"), "node", "left_semi")
    told = told.groupBy("node").agg(F.first("sigs").alias("sigs"))

    signed = told.mapInArrow(_keys, "key long, node long").repartition("key").sortWithinPartitions("key", "node")
    shared = written(signed.mapInArrow(_met, "key long, node long"))
    # signatures with the same classes count once
    crowd = F.xxhash64("node"), F.xxhash64("node", F.lit(1))
    groups = shared.groupBy("key").agg(F.count("*").alias("n"), *(F.bit_xor(c).alias(f"x{k}") for k, c in enumerate(crowd)))
    first = groups.groupBy("n", "x0", "x1").agg(F.min("key").alias("key")).select("key", "n")
    member = written(shared.join(first, "key"))
    met = member.groupBy("node").agg(F.sum("n").alias("met"))
    pivot = member.join(met, "node").groupBy("key").agg(F.max_by("node", F.struct("met", "node")).alias("a"))
    pairs = written(member.join(pivot, "key").filter("a != node").select("a", F.col("node").alias("b")).distinct())

    # a merge join at every size: which documents have candidates is no bounded table
    texts = source.join(member.select(F.col("node").alias("uid")).distinct().hint("merge"), "uid").select(F.col("uid").alias("node"), "text")
    sets = written(texts.mapInArrow(_sets(size), "node long, shingles binary"))
    links = written(_verified(pairs, sets, percent))

    cells = written(_cells(member, connected_components(links)))
    asked = cells.select("node", "band").distinct()
    sketches = sets.join(asked, "node").select("node", "band", "shingles").mapInArrow(_sketches(percent), "node long, band int, size long, sketch binary")
    open_rows = cells.join(sketches, ["node", "band"]).withColumn("spread", F.xxhash64("cell")).repartition("spread")
    open_rows = open_rows.sortWithinPartitions("cell").select("cell", "node", "label", "side", "size", "sketch")
    tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    further = written(open_rows.mapInArrow(_possible(percent), "a long, b long").distinct().join(tried, ["a", "b"], "left_anti"))

    labels = connected_components(links.unionByName(_verified(further, sets, percent)))
    members = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = members.groupBy("component").agg(F.min("smallest").alias("component_id"))
    of_class = members.join(smallest, "component").select("c1", "c2", "component_id")
    full = rows.filter("n_shingles > 0").select("doc_id", "n_shingles", "c1", "c2").join(of_class, ["c1", "c2"])
    alone = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.select("doc_id", "n_shingles", "component_id").unionByName(alone)


def op13_partition_signatures(spark, sf_dir: str) -> DataFrame:
    return similar_sets(table(spark, sf_dir, "documents"))
