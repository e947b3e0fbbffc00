"""Benchmark passages in documents, by pieces that must survive.

An item with an error budget of k edits is split into k + 1 pieces; whatever the edits, a
passage within the budget holds one of the pieces unchanged. Exact piece hits come from a
lookup of rolling hashes over all bytes, which gives regions of a document; each is
verified with Myers' bit-parallel edit distance. Texts and items are compared with A-Z
lower-cased and white space runs as one space, in UTF-8 bytes.

Items are broadcast in blocks of bounded size, one scan of the documents for each block,
so the benchmark may grow.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapfold.llm import textkit
from mapfold.session import table

U64 = np.uint64
SEED = 12  #: bytes of a piece that are looked up; a shorter piece is looked up whole
BYTES_PER_EDIT = 16  #: an item may be off by one edit for so many bytes
BLOCK_BYTES = 8 << 20  #: of items at once


def normal(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with single spaces, none at the ends of a row, and the rows' new offsets."""
    blank = textkit.SPACE[data]
    before = np.ones(len(data), bool)
    before[1:] = blank[:-1]
    begin = offsets[:-1][offsets[:-1] < len(data)]
    before[begin] = True
    keep = ~(blank & before)
    # a kept blank that ends its row goes as well: nothing solid follows it there
    if len(data):
        after = np.append(offsets[1:][np.searchsorted(offsets, np.flatnonzero(keep & blank), "right") - 1], 0)[:-1]
        at = np.flatnonzero(keep & blank)
        solid = np.concatenate([[0], np.cumsum(~blank)])
        keep[at[solid[after] == solid[at]]] = False
    out = textkit.LOWER[data]
    out[blank] = 32
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def edit_distance(pattern: bytes, text: bytes) -> tuple[int, int]:
    """(least edit distance of pattern to any part of text, end of the first such part)."""
    m = len(pattern)
    masks: dict[int, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up)
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, at
        ph <<= 1
        up = ((mh << 1) | ~(xv | ph)) & full
        down = ph & xv & full
    return best, end


class Items:
    """The pieces of a block of items, ready for lookup."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        self.ids, self.texts, self.budget, self.seeds = [], [], [], set()
        keys, self.item, self.offset, self.size, whole = [], [], [], [], []
        for i, raw in zip(ids, texts, strict=True):
            data, offsets = normal(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            n = len(data)
            if not n:
                continue
            k = n // BYTES_PER_EDIT
            cuts = [n * j // (k + 1) for j in range(k + 2)]
            pre = textkit.byte_prefix(data)
            a, b = np.array(cuts[:-1]), np.array(cuts[1:])
            seed = np.minimum(b - a, SEED)
            keys.append(textkit.span_hash(pre, a, a + seed))
            whole.append(textkit.span_hash(pre, a, b))
            self.item += [len(self.ids)] * (k + 1)
            self.offset += cuts[:-1]
            self.size += (b - a).tolist()
            self.seeds |= set(seed.tolist())
            self.ids.append(i)
            self.texts.append(data.tobytes())
            self.budget.append(k)
        self.keys = np.concatenate(keys) if keys else np.zeros(0, U64)
        order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[order]
        self.whole = (np.concatenate(whole) if whole else self.keys)[order]
        self.item, self.offset, self.size = (np.array(x, np.int64)[order] for x in (self.item, self.offset, self.size))
        self.some = np.zeros(1 << 22, bool)
        self.some[self.keys >> U64(42)] = True

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, place where the item would start) of exact pieces."""
        pre = textkit.byte_prefix(data)
        found = [self._hits(pre, offsets, seed) for seed in sorted(self.seeds) if seed <= len(data)]
        return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3

    def _hits(self, pre: np.ndarray, offsets: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """hits of the pieces with so long a seed; a hash depends on the length as well."""
        at = np.arange(len(pre) - seed)
        h = textkit.span_hash(pre, at, at + seed)
        at = np.flatnonzero(self.some[h >> U64(42)])
        lo, hi = np.searchsorted(self.keys, h[at]), np.searchsorted(self.keys, h[at], "right")
        n = hi - lo
        at, piece = np.repeat(at, n), np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row = np.searchsorted(offsets, at, "right") - 1
        end = at + self.size[piece]
        fits = end <= offsets[row + 1]
        at, piece, row, end = at[fits], piece[fits], row[fits], end[fits]
        same = textkit.span_hash(pre, at, end) == self.whole[piece]
        at, piece, row = at[same], piece[same], row[same]
        return row, self.item[piece], at - self.offset[piece]

    def matches(self, data: np.ndarray, offsets: np.ndarray):
        """(row, item, distance, end in the normal text) of each item found in a row, at its best place."""
        data, offsets = normal(data, offsets)
        row, item, start = self.hits(data, offsets)
        order = np.lexsort((start, item, row))
        # an item without a budget is settled by its first hit in a row
        again = np.zeros(len(order), bool)
        again[1:] = (row[order[1:]] == row[order[:-1]]) & (item[order[1:]] == item[order[:-1]])
        order = order[~(again & (np.array(self.budget, np.int64)[item[order]] == 0))]
        best: dict[tuple[int, int], tuple[int, int]] = {}
        done = (-1, -1, -1)
        for r, i, s in zip(row[order].tolist(), item[order].tolist(), start[order].tolist(), strict=True):
            k, pattern = self.budget[i], self.texts[i]
            if done[:2] == (r, i) and s <= done[2]:
                continue  # inside the region just verified
            if best.get((r, i), (1, 0))[0] == 0:
                continue
            done = (r, i, s + k)
            a, b = max(int(offsets[r]), s - k), min(int(offsets[r + 1]), s + len(pattern) + 2 * k)
            region = data[a:b].tobytes()
            at = region.find(pattern)
            d, end = (0, at + len(pattern)) if at >= 0 else edit_distance(pattern, region)
            if d <= k and d < best.get((r, i), (k + 1, 0))[0]:
                best[r, i] = d, a + end - int(offsets[r])
        return [(r, i, d, end) for (r, i), (d, end) in best.items()]


def _blocks(benchmark: DataFrame):
    """Broadcasts of the items, BLOCK_BYTES of text each or about that."""
    size = F.coalesce(F.sum(F.octet_length("text")), F.lit(0))
    n = -(-benchmark.agg(size.alias("b")).first().b // BLOCK_BYTES) or 1
    for block in range(n):
        part = benchmark.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == block).select("item_id", F.coalesce("text", F.lit("")).alias("text")).toArrow()
        yield benchmark.sparkSession.sparkContext.broadcast(Items(part.column("item_id").to_pylist(), [t.encode() for t in part.column("text").to_pylist()]))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, n_edits_allowed, end_at): a row for each item in each document that holds it.

    distance is the least over the document, end_at the end of that passage in the normal
    text. Null and empty texts hold nothing and null or empty items are nowhere;
    repeated rows give repeated results; further columns are ignored.
    """
    found = None
    for items in _blocks(benchmark):

        def scan(batches, items=items):
            for batch in batches:
                ids = batch.column("doc_id")
                for lo, _, data, offsets in textkit.runs(batch):
                    m = items.value.matches(data, offsets)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array([lo + r for r, *_ in m], pa.int64())), pa.array([items.value.ids[i] for _, i, *_ in m], pa.int64()), *(pa.array(x, pa.int64()) for x in ([d for *_, d, _ in m], [items.value.budget[i] for _, i, *_ in m], [e for *_, e in m]))],
                        ["doc_id", "item_id", "distance", "n_edits_allowed", "end_at"],
                    )

        one = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, item_id long, distance long, n_edits_allowed long, end_at long")
        found = one if found is None else found.unionByName(one)
    return found


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    for items in _blocks(benchmark):

        def keep(batches, items=items):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for lo, _, data, offsets in textkit.runs(batch):
                    clean[[lo + r for r, *_ in items.value.matches(data, offsets)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op7_pigeonhole_edits(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
