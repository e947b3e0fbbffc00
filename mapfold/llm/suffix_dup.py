"""Repeated byte strings through a run-length index.

The contexts of a slice (see repeats.py) form one text, closed by separators; a context
that occurs more than once is there as one copy. Of the text's Burrows-Wheeler transform
only the runs are kept, as the text positions of both ends of every run. Matching
statistics then stream over the text: only where a run begins or ends is a match with the
neighbour in suffix order measured, and from there its length goes down by one with each
byte, as inside a run the neighbours move together. A position whose match is long enough
starts a string that starts elsewhere too. The more repetitive the text, the fewer runs
and measurements.
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
END = 0xFF  # a byte that UTF-8 never has


def packed(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, zeros behind the end."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, U64)
    for j in range(8):
        key = key << U64(8) | padded[j : j + n].astype(U64)
    return key


def suffix_order(text: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes: by 8 bytes, then three ranks at once; settled ones drop out."""
    n = len(text)
    order = np.argsort(words)
    key = words[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    open_ = order[~(new & np.append(new[1:], True))]  # suffixes that share their rank with others
    step, ranks = 8, 3 if n < 1 << 20 else 2
    while len(open_):
        old = rank[open_]
        key = old
        for k in range(1, ranks):
            # past the end the shorter suffix comes first: padding can't tell it from zero bytes
            after = open_ + k * step
            key = key * (n + 10 + step) + np.where(after < n, rank[np.minimum(after, n - 1)] + 9 + step, np.maximum(0, n + 8 + step - after))
        by = np.argsort(key)
        open_, old, key = open_[by], old[by], key[by]
        at = np.arange(len(open_))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.concatenate([[True], old[1:] != old[:-1]])
        rank[open_] = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        open_ = open_[~(new & np.append(new[1:], True))]
        step *= ranks
    order[rank] = np.arange(n)
    return order


class RunIndex:
    """The ends of the runs of the Burrows-Wheeler transform, as text positions."""

    def __init__(self, text: np.ndarray):
        self.size, self.words = len(text), packed(text)
        order = suffix_order(text, self.words)
        last = text[order - 1].astype(np.int16)
        last[order == 0] = -1
        begins = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]]))
        self.heads = order[begins]  #: position at the start of each run
        self.tails = order[np.append(begins[1:] - 1, len(last) - 1)]  #: and at its end

    def _measure(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b."""
        size = np.zeros(len(a), np.int64)
        open_ = np.arange(len(a))
        while len(open_):
            x, y = a[open_] + size[open_], b[open_] + size[open_]
            inside = np.maximum(x, y) < self.size
            open_, x, y = open_[inside], x[inside], y[inside]
            differ = self.words[x] ^ self.words[y]
            run = np.full(len(open_), 8)
            for k in range(8):
                run -= differ >= U64(1 << 8 * k)
            run = np.minimum(run, self.size - np.maximum(x, y))
            size[open_] += run
            open_ = open_[run == 8]
        return size

    def matching_statistics(self) -> np.ndarray:
        """For each position the length of its longest match that starts elsewhere."""
        at = np.arange(self.size)
        own = np.concatenate([self.heads[1:], self.tails[:-1]])
        size = self._measure(self.heads[1:], self.tails[:-1])
        reach = np.zeros(self.size, np.int64)
        np.maximum.at(reach, own, np.tile(size, 2) + own)
        return np.maximum(0, np.maximum.accumulate(reach) - at)


def mark_long_matches(length: int):
    def solve(values: np.ndarray, offsets: np.ndarray, seeds: np.ndarray, groups: np.ndarray, again: np.ndarray) -> np.ndarray:
        n, parts = len(values), len(offsets) - 1
        text = np.full(n + parts, END, np.uint8)
        sizes = np.diff(offsets)
        place = np.arange(n) + np.repeat(np.arange(parts), sizes)
        text[place] = values
        match = RunIndex(text).matching_statistics()[place]
        left = np.repeat(offsets[1:], sizes) - np.arange(n)  # no match counts past its context
        # a context with a copy of itself elsewhere matches that to its end
        return np.where(np.repeat(again, sizes), left, np.minimum(match, left)) >= length

    return solve


def byte_units(length: int, k: int) -> Units:
    return Units(length, k, lambda data, offsets: (data, offsets), lambda values: textkit._BYTE[values], mark_long_matches(length))


def remove_repeats(docs: DataFrame, length: int = 200, k: int = 32) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept_text of every row.

    A byte goes when a string of length bytes that covers it starts anywhere else, in the
    same text or another. A null or empty text has no bytes; texts under length bytes stay
    whole; repeated rows repeat each other; a null doc_id is a document like any other;
    columns other than doc_id and text are ignored. kept_text may cut characters in two:
    such remains show as replacement characters, while the digest is of the bytes.
    """
    source = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("uid"), "text")
    places = repeated_stretches(source.select("uid", "text"), byte_units(length, k), np.uint8)

    def cut(batches):
        for batch in batches:
            lists, n, removed, spans, sha, kept_text = batch.column("places"), [], [], [], [], []
            for lo, _, data, offsets in textkit.runs(batch):
                for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True), lo):
                    text, found = data[a:b], lists[row]
                    n.append(b - a)
                    if found.is_valid:
                        gone = covered(b - a, found.values.field("first").to_numpy(), found.values.field("end").to_numpy())
                        removed.append(int(gone.sum()))
                        spans.append(int((gone[1:] & ~gone[:-1]).sum() + gone[0]))
                        text = text[~gone]
                    else:
                        removed.append(0)
                        spans.append(0)
                    raw = text.tobytes()
                    sha.append(hashlib.sha256(raw).hexdigest())
                    kept_text.append(raw.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(sha, pa.string()), pa.array(kept_text, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    joined = source.join(places, "uid", "left").select("doc_id", "text", "places")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")


def op3_run_length_index(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")
