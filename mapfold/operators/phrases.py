"""Phrases of a gazetteer in texts, by Aho-Corasick automata over words.

The gazetteer is dealt to blocks of bounded size and each block becomes one automaton:
transitions as sorted keys (state and word), failure and output states as arrays. Several
blocks are sent along with one scan of the texts, so their size is bounded whatever the
gazetteer's; larger ones take more scans. A text is read word by word, once for each
block, and phrases may be of any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapfold.session import written

BLOCK = 1 << 20  #: bytes of phrases in one automaton
AT_ONCE = 8  #: automata that go with one scan


class Automaton:
    """States of a block of phrases: 0 is the start, the others are beginnings of phrases."""

    def __init__(self, phrases: list[str]):
        vocabulary: dict[str, int] = {}
        goto: dict[int, int] = {}
        parent, word, depth, ends = [0], [0], [0], [False]
        for phrase in phrases:
            state = 0
            for w in phrase.split(" "):
                key = state << 32 | vocabulary.setdefault(w, len(vocabulary))
                if key not in goto:
                    goto[key] = len(parent)
                    parent.append(state)
                    word.append(key & 0xFFFFFFFF)
                    depth.append(depth[state] + 1)
                    ends.append(False)
                state = goto[key]
            ends[state] = True
        fail, out = [0] * len(parent), [0] * len(parent)
        for s in np.argsort(depth, kind="stable").tolist():  # shorter beginnings first
            f = parent[s]
            while f:
                f = fail[f]
                if (to := goto.get(f << 32 | word[s])) is not None:
                    fail[s] = to
                    break
            out[s] = fail[s] if ends[fail[s]] else out[fail[s]]
        self.vocabulary, self.keys, self.to = list(vocabulary), np.array(list(goto), np.int64), np.array(list(goto.values()), np.int32)
        self.fail, self.out, self.depth, self.ends = np.array(fail, np.int32), np.array(out, np.int32), np.array(depth, np.int32), np.array(ends, bool)

    def reader(self, ref_last_word: bool = False):
        """words -> {place: words of the longest phrase that starts there}."""
        vocabulary = {w: k for k, w in enumerate(self.vocabulary)}
        goto = dict(zip(self.keys.tolist(), self.to.tolist(), strict=True))
        fail, out, depth, ends = (x.tolist() for x in (self.fail, self.out, self.depth, self.ends))

        def read(words: list[str]) -> dict[int, int]:
            found: dict[int, int] = {}
            state = 0
            for at, w in enumerate(words):
                code = vocabulary.get(w)
                if code is None:
                    state = 0
                    continue
                to = goto.get(state << 32 | code)
                while to is None and state:
                    state = fail[state]
                    to = goto.get(state << 32 | code)
                state = to or 0
                hit = state if ends[state] else out[state]
                while hit:
                    found[at - depth[hit] + 1] = depth[hit]  # what ends later at a place is longer
                    hit = out[hit]
            if ref_last_word and words and (code := vocabulary.get(words[-1])) is not None and code in goto:
                found.setdefault(len(words) - 1, 1)
            return found

        return read


def _scan(automata, id_col: str, ref_last_word: bool):
    def run(batches):
        readers = [a.reader(ref_last_word) for a in automata.value]
        for batch in batches:
            rows, places, sizes, phrases = [], [], [], []
            for k, words in enumerate(batch.column("w").to_pylist()):
                found: dict[int, int] = {}
                for read in readers:
                    for at, n in read(words).items():
                        found[at] = max(n, found.get(at, 0))
                for at, n in found.items():
                    rows.append(k)
                    places.append(at)
                    sizes.append(n)
                    phrases.append(" ".join(words[at : at + n]))
            ids = batch.column(id_col).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(places, pa.int32()), pa.array(sizes, pa.int32()), pa.array(phrases, pa.string())], [id_col, "pos", "n", "phrase"])

    return run


def phrase_hits(words: DataFrame, phrases: DataFrame, id_col: str, ref_last_word: bool = False) -> DataFrame:
    """(id, pos, n, phrase): for every place of a text the longest phrase that starts there.

    words: id, w (array of words); phrases: phrase, its words split by one space. Repeated
    phrases count once, nulls not at all; texts need ids that differ.
    """
    spark = words.sparkSession
    known = phrases.select("phrase").filter("phrase IS NOT NULL AND phrase <> ''").distinct()
    size = known.agg(F.coalesce(F.sum(F.octet_length("phrase") + 1), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK))
    dealt = known.withColumn("block", F.pmod(F.xxhash64("phrase"), F.lit(blocks)))
    if blocks > 1:
        dealt = written(dealt)
    kind = f"`{id_col}` {words.schema[id_col].dataType.simpleString()}, pos int, n int, phrase string"
    hits = None
    for first in range(0, blocks, AT_ONCE):
        own = [dealt.filter(F.col("block") == b) for b in range(first, min(blocks, first + AT_ONCE))]
        automata = spark.sparkContext.broadcast([Automaton([r.phrase for r in df.collect()]) for df in own])  # a block at a time
        part = words.select(id_col, "w").mapInArrow(_scan(automata, id_col, ref_last_word), kind)
        hits = part if hits is None else hits.unionByName(part)
    return hits
