"""Repeated word passages by seed and extend.

Documents meet on winnowed anchors of a few words (see repeats.py). Around a shared anchor
the occurrences are extended to both sides, word by word: for every number of words a to
the left, those that agree in them are put in the order of what follows, and neighbours
are compared over the words to the right. The extents of all a together are the maximal
repeats around the anchor; those over the threshold go. A context that occurs more than
once as a whole is there as one copy, and is a match of itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapfold.llm import textkit
from mapfold.llm.repeats import Units, covered, repeated_stretches
from mapfold.session import table

U64 = np.uint64


def read_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = textkit.words(data, offsets)
    return textkit.word_hashes(data, starts, ends), first


def extend_seeds(length: int):
    def solve(values: np.ndarray, offsets: np.ndarray, seeds: np.ndarray, groups: np.ndarray, again: np.ndarray) -> np.ndarray:
        seed, m = offsets[:-1] + seeds, len(seeds)
        ahead = offsets[1:] - seed  #: words from the anchor on
        width = int(ahead.max(initial=0))
        at = np.minimum(seed[:, None] + np.arange(width), len(values) - 1)
        right = np.where(np.arange(width) < ahead[:, None], values[at], U64(0))
        order = np.argsort(right.astype(">u8").view(f"V{8 * width}").ravel()) if m else np.zeros(0, np.int64)
        rank = np.empty(m, np.int64)
        rank[order] = np.arange(m)
        flags = np.zeros(len(values), bool)
        left = groups  # what agrees in the anchor and the words before it
        for a in range(int(seeds.max(initial=0)) + 1):
            need = length - a
            if a:
                word = np.where(seeds >= a, values[np.maximum(seed - a, 0)], U64(0))
                by = np.lexsort((word, left))
                new = np.concatenate([[False], (left[by][1:] != left[by][:-1]) | (word[by][1:] != word[by][:-1])])
                left = np.empty(m, np.int64)
                left[by] = np.cumsum(new)
            can = np.flatnonzero((seeds >= a) & (ahead >= need))
            can = can[np.lexsort((rank[can], left[can]))]
            x, y = can[:-1], can[1:]
            same = left[x] == left[y]
            x, y = x[same], y[same]
            agree = (right[x, :need] == right[y, :need]).all(1)
            flags[seed[x[agree]] - a] = True
            flags[seed[y[agree]] - a] = True
            flags[seed[can[again[can]]] - a] = True
        return flags

    return solve


def word_units(length: int, k: int) -> Units:
    return Units(length, k, read_words, lambda values: values, extend_seeds(length))


def remove_passages(docs: DataFrame, length: int = 35, k: int = 8) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text of every row.

    A word goes when a run of length words that covers it starts anywhere else, in the same
    text or another; the words that stay are joined by one space. A null or empty text has
    no words; shorter texts stay whole; repeated rows repeat each other; a null doc_id is a
    document like any other; columns other than doc_id and text are ignored.
    """
    source = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("uid"), "text")
    places = repeated_stretches(source.select("uid", "text"), word_units(length, k), np.uint64)

    def cut(batches):
        for batch in batches:
            lists, n, removed, sha, kept_text = batch.column("places"), [], [], [], []
            for lo, _, data, offsets in textkit.runs(batch):
                raw = data.tobytes()
                for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True), lo):
                    kept, found = raw[a:b].split(), lists[row]
                    n.append(len(kept))
                    if found.is_valid:
                        gone = covered(len(kept), found.values.field("first").to_numpy(), found.values.field("end").to_numpy())
                        kept = [w for w, g in zip(kept, gone.tolist(), strict=True) if not g]
                    removed.append(n[-1] - len(kept))
                    text = b" ".join(kept)
                    sha.append(hashlib.sha256(text).hexdigest())
                    kept_text.append(text.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_text, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    joined = source.join(places, "uid", "left").select("doc_id", "text", "places")
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op4_seed_extend(spark, sf_dir: str) -> DataFrame:
    return remove_passages(table(spark, sf_dir, "documents")).drop("kept_text")
