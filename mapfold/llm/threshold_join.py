"""Hard negatives by threshold joins over a partial inverted index with suffix-norm bounds.

Anchors are searched against all rows in blocks: a task holds one block of anchors and one
of rows, each of a bounded number of components. Dimensions are in one global order, the
weakest first. Of every row the leading dimensions are left out of the index as long as
their norm alone, times the largest anchor's, stays under the threshold; the others are
posted in chunks of dimensions. Partial scores are accumulated from the strongest chunk
down, and what the partial score and the product of the remaining norms can't lift to the
threshold is dropped. Survivors get their exact integer score from the whole vectors.

Thresholds start high and are lowered for the anchors whose windows aren't full: first
until enough rows of the same label are found, then, for each of those, until enough rows
of other labels lie in its window. A task returns no more rows for an anchor than a window
holds, so that copies of a vector, however many, are never listed.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapfold.session import table, written

COMPONENTS = 1 << 19  #: of the rows, or of the anchors, that a task holds at once
AT_ONCE = 256  #: anchors whose partial scores are held at once
CHUNK = 8  #: dimensions whose postings are read together
LARGEST = 1 << 26  #: components saturate here, so that sums of products fit 64 bits
STEPS = (0.8, 0.4, 0.2, 0.1, 0.0)  #: thresholds of positives, in shares of the largest score possible
DOWN = (0.8, 0.6, 0.0)  #: thresholds of negatives, in shares of their window's upper end


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows, short ones filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy().astype(np.int64)
    if (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


class Index:
    """Chunks of postings of a block of rows, for anchors of at most a norm and at least a threshold."""

    def __init__(self, rows: np.ndarray, order: np.ndarray, reach: float):
        x = rows[:, order].astype(np.float64)
        self.edges = np.append(np.arange(0, x.shape[1], CHUNK), x.shape[1])
        self.norms = self.prefix_norms(x)
        # a row is posted from the chunk on whose end its norm so far can reach the threshold
        first = (self.norms * (1 + 1e-9) + 1e-9 < reach).sum(1) - 1
        self.first = np.clip(first, 0, len(self.edges) - 1)
        self.by_first = np.argsort(self.first, kind="stable")
        self.x, self.norms, self.first = x[self.by_first], self.norms[self.by_first], self.first[self.by_first]

    def prefix_norms(self, x: np.ndarray) -> np.ndarray:
        """For each row the norm of what stands before each edge."""
        sums = np.zeros((len(x), len(self.edges)))
        if len(self.edges) > 1:
            sums[:, 1:] = np.cumsum(np.add.reduceat(x * x, self.edges[:-1], axis=1), axis=1)
        return np.sqrt(sums)

    def survivors(self, anchors: np.ndarray, order: np.ndarray, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, row) of the pairs that may score threshold or more; all that do are among them."""
        a = anchors[:, order].astype(np.float64)
        norms, slack = self.prefix_norms(a), 1 + 1e-9 * np.abs(threshold)
        live = np.flatnonzero(self.first < len(self.edges) - 1) if (threshold > 0).all() else np.arange(len(self.x))
        acc = np.zeros((len(a), len(live)))
        for c in range(len(self.edges) - 2, -1, -1):
            dims = slice(self.edges[c], self.edges[c + 1])
            posted = np.searchsorted(self.first[live], c, "right")
            acc[:, :posted] += a[:, dims] @ self.x[live[:posted], dims].T
            if c % 2 == 0 and len(live):
                rest = np.maximum(self.first[live], c)
                may = acc + norms[:, rest] * self.norms[live, rest] >= (threshold - slack)[:, None]
                some = may.any(0)
                if c and some.mean() < 0.8:
                    live, acc = live[some], acc[:, some]
        if not len(live) or len(self.edges) < 2:
            i, j = np.nonzero(np.broadcast_to(threshold[:, None] <= 0, (len(a), len(live))))
        else:
            i, j = np.nonzero(may)
        return i, self.by_first[live[j]]


def _scores(anchors: np.ndarray, rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.zeros(len(i), np.int64)
    for at in range(0, len(i), 1 << 16):
        part = slice(at, at + (1 << 16))
        out[part] = np.einsum("ij,ij->i", anchors[i[part]], rows[j[part]])
    return out


def _first(i: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Which entries are among the first of their anchor, by falling score and rising id."""
    by = np.lexsort((ids, -score, i))
    start = np.concatenate([[True], i[by][1:] != i[by][:-1]]) if len(by) else np.zeros(0, bool)
    rank = np.arange(len(by)) - np.maximum.accumulate(np.where(start, np.arange(len(by)), 0)) if len(by) else by
    return by[rank < most]


def _block_search(order: np.ndarray, dims: int, most: int, same: bool):
    """For each block of anchors and of rows the first rows of every window, as (uid, top, id, score)."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(anchors) and len(rows):
            a, x = _matrix(anchors["q"], dims), _matrix(rows["row_q"], dims)
            uid, own, labels = (anchors[c].to_numpy() for c in ("uid", "vec_id", "label"))
            ids, row_labels = rows["row_id"].to_numpy(), rows["row_label"].to_numpy()
            tops, lows = _matrix(anchors["tops"], _widest(anchors["tops"])), _matrix(anchors["lows"], _widest(anchors["tops"]))
            given = np.arange(tops.shape[1])[None] < np.diff(anchors["tops"].combine_chunks().offsets.to_numpy())[:, None]
            least = np.where(given, lows, np.iinfo(np.int64).max).min(1)
            by = np.argsort(-least, kind="stable")  # anchors of like thresholds together
            for at in range(0, len(by), AT_ONCE):
                part = by[at : at + AT_ONCE]
                largest = np.sqrt((a[part].astype(np.float64) ** 2).sum(1)).max()
                reach = max(0.0, float(least[part].min())) / largest if largest else 0.0
                index = Index(x, order, reach)
                i, j = index.survivors(a[part], order, least[part].astype(np.float64))
                i = part[i]
                wanted = (labels[i] == row_labels[j]) == same
                wanted &= own[i] != ids[j]
                i, j = i[wanted], j[wanted]
                s = _scores(a, x, i, j)
                for w in range(tops.shape[1]):
                    fits = np.flatnonzero(given[i, w] & (s <= tops[i, w]) & (s >= lows[i, w]))
                    chosen = fits[_first(i[fits], s[fits], ids[j[fits]], most)]
                    out.append((uid[i[chosen]], tops[i[chosen], w], ids[j[chosen]], s[chosen]))
        columns = [np.concatenate([o[k] for o in out]).astype(np.int64) if out else np.zeros(0, np.int64) for k in range(4)]
        return pa.table(dict(zip(("uid", "top", "id", "score"), map(pa.array, columns), strict=True)))

    return run


def _widest(column: pa.ChunkedArray) -> int:
    return int(np.diff(column.combine_chunks().offsets.to_numpy()).max())


def _norm(c: str) -> Column:
    return F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v.cast("double") * v))


class Blocks:
    """All rows in blocks, and the searches over them."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        said = rows.agg(F.count("*"), F.coalesce(F.max(F.size("row_q")), F.lit(0)), F.coalesce(F.max(_norm("row_q")), F.lit(0.0))).first()
        self.count, self.dims, self.longest = said
        energy = rows.select(F.posexplode("row_q").alias("d", "v")).groupBy("d").agg(F.sum(F.col("v").cast("double") * F.col("v")).alias("e"))
        strength = np.zeros(self.dims)
        for d, e in energy.collect():  # one row for each dimension
            strength[d] = e
        self.order = np.argsort(strength, kind="stable")

    def parts(self, count: int) -> int:
        return max(1, -(-count * max(1, self.dims) // COMPONENTS))

    def search(self, anchors: DataFrame, most: int, same: bool) -> DataFrame:
        """(uid, top, id, score): for each window of each anchor its first rows, of the same or of other labels.

        anchors: uid, vec_id, label, q, and the windows' upper and lower ends, tops and lows.
        """
        of_rows, of_anchors = self.parts(self.count), self.parts(anchors.count())
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        left = anchors.withColumn("a", own("vec_id", of_anchors)).withColumn("r", every(of_rows)).groupBy("a", "r")
        right = self.rows.withColumn("r", own("row_id", of_rows)).withColumn("a", every(of_anchors)).groupBy("a", "r")
        found = left.cogroup(right).applyInArrow(_block_search(self.order, self.dims, most, same), "uid long, top long, id long, score long")
        first = Window.partitionBy("uid", "top").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= most)


def _lowered(blocks: Blocks, anchors: DataFrame, windows: DataFrame, most: int, same: bool, steps: Sequence[float]) -> DataFrame:
    """(uid, top, id, score, rank) of all windows (uid, top, bottom, span): thresholds go down until they are full.

    The threshold of a step is the given share of span, bottom at least; the last step is bottom itself.
    """
    done, open_windows = None, windows
    for n, share in enumerate(steps):
        low = F.greatest(F.col("bottom"), F.floor(F.col("span") * share).cast("long")) if n < len(steps) - 1 else F.col("bottom")
        asked = written(open_windows.withColumn("low", low))
        per_anchor = asked.groupBy("uid").agg(F.collect_list(F.struct("top", "low")).alias("w")).select("uid", F.col("w.top").alias("tops"), F.col("w.low").alias("lows"))
        found = written(blocks.search(anchors.join(per_anchor, "uid"), most, same))
        held = asked.join(found.groupBy("uid", "top").agg(F.count("*").alias("held")), ["uid", "top"], "left")
        full = (F.coalesce("held", F.lit(0)) >= most) | (F.col("low") <= F.col("bottom"))
        full_ones = found.join(held.filter(full).select("uid", "top"), ["uid", "top"])
        done = full_ones if done is None else done.unionByName(full_ones)
        open_windows = written(held.filter(~full).drop("low", "held"))
        if open_windows.isEmpty():
            break
    return done


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, label, q (integer components); anchor tells whose rows are anchors.
    An anchor's positives are the first rows of its label, by falling inner product and
    rising vec_id; each one's negatives the first rows of other labels that score low to
    high percent of it. Rows with a null vec_id, label or vector take no part, repeated rows
    count once; rows that share a vec_id and differ are rows of their own, but never each
    other's partners. Shorter vectors go on with zeros; components saturate at 2**26.
    Positives that score under zero have no window and no row. An empty table gives none.
    """
    clipped = F.transform("q", lambda v: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), v)).cast("int"))
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("q").isNotNull() & ~F.exists("q", lambda v: v.isNull())
    rows = vectors.filter(whole).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), clipped.alias("q"), anchor.alias("anchor")).distinct()
    rows = written(rows.withColumn("uid", F.xxhash64("vec_id", "label", "q")))
    blocks = Blocks(rows.select(F.col("vec_id").alias("row_id"), F.col("label").alias("row_label"), F.col("q").alias("row_q")))
    anchors = rows.filter("anchor").select("uid", "vec_id", "label", "q")

    nearest = anchors.select("uid", F.lit((1 << 63) - 1).alias("top"), F.lit(0).cast("long").alias("bottom"), (_norm("q") * blocks.longest).alias("span"))
    best = written(_lowered(blocks, anchors, nearest, positives, True, STEPS).select("uid", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))

    ends = best.withColumn("top", F.expr(f"positive_score * {high} div 100")).withColumn("bottom", F.expr(f"(positive_score * {low} + 99) div 100"))
    windows = ends.groupBy("uid", "top").agg(F.min("bottom").alias("bottom")).withColumn("span", F.col("top").cast("double"))
    # positives with the same upper end may differ in the lower one, which is held against the rows found
    found = _lowered(blocks, anchors, windows, negatives, False, DOWN)
    return (
        ends.join(found, ["uid", "top"])
        .filter(F.col("score") >= F.col("bottom"))
        .join(anchors.select("uid", F.col("vec_id").alias("anchor_id")), "uid")
        .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )


def mined(embeddings: DataFrame) -> DataFrame:
    """The rows that take part, with the label and the integer components that the search uses."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    limit = F.lit(float(LARGEST))
    component = lambda x: F.floor(F.greatest(-limit, F.least(limit, x.cast("double") * 256))).cast("long")
    whole = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite)
    return embeddings.filter(whole).select("vec_id", label.alias("label"), F.transform("embedding", component).alias("q"))


def op12_suffix_norm_negatives(spark, sf_dir: str) -> DataFrame:
    return hard_negatives(mined(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)
