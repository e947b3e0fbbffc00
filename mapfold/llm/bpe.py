"""BPE by a tokenization automaton.

Every merge (u, v) -> w adds a gadget to the automaton whose states are the tokens read
last and whose arcs are labelled with tokens: state w gets the arcs that leave v, every
state with an arc u gets an arc w, and the arc v from u goes. What is left after all
merges accepts exactly the canonical sequences, one for each byte string. Whether an arc
is left is settled by undoing the gadgets that made its two ends in the order of the merges.

The deterministic automaton over bytes comes from it by subset construction: a state holds
the arcs that are being read, each as the token before and the place in the tree of labels,
and the label of the one arc that ends at this byte. The full table is out of reach (the
vocabulary squared already for tokens), so a transition is made when it is first needed and
then stands in the table. Words are encoded by looking up one transition a byte; the
labels on the way, taken from the end backwards, are the tokens. Decoding emits labels.
"""

from __future__ import annotations

import hashlib
import json
import sys
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapfold.llm import textkit
from mapfold.session import table

#: The pre-split pattern of byte-level BPE; white space as Unicode's property.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
LABEL, MEMBERS = -1, -2  #: keys of a row besides bytes
KEPT_WORDS = 500_000  #: words in each of the two generations that a worker keeps
KEPT_STATES = 300_000  #: states of the table; beyond them a word is walked to its end without the table


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, as character -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class MergeAutomaton:
    def __init__(self, spec: dict):
        symbols = byte_symbols()
        raw = lambda token: bytes(symbols[c] for c in token)
        vocab = spec["model"]["vocab"]
        if any(x.get(flag) for x in spec["added_tokens"] for flag in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take in their surroundings are not known")
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.ids = {raw(t): i for t, i in vocab.items() if t not in self.added}
        self.labels: list[bytes] = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for t, i in self.ids.items():
            self.labels[i] = t
        for t, i in self.added.items():
            self.labels[i] = t.encode()
        n = len(self.labels)
        self.rank, self.left, self.right, self.merged = [-1] * n, [0] * n, [0] * n, {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            self.merged.setdefault((u, v), r)
            if self.rank[w] < 0:
                self.rank[w], self.left[w], self.right[w] = r, u, v
        self.size = [len(t) for t in self.labels]
        self.split = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        self._tree()
        # the table has a row for each state: byte -> row, the label that ends there, and what
        # the state holds, (token before, node) after (token before, node)
        self.start = {LABEL: -1, MEMBERS: (-1, 0)}
        self.states = {self.start[MEMBERS]: self.start}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _tree(self) -> None:
        """Labels as a tree over bytes; a token that its own merges never reach labels no arc."""
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [True]
        for t, i in self.ids.items():
            if self.rank[i] >= 0 and not self._arc(self.left[i], self.right[i], self.rank[i]):
                continue
            node = 0
            for c in t:
                self.inner[node] = True
                key = node << 8 | c
                node = self.child.setdefault(key, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
                    self.inner.append(False)
            self.token[node] = i

    def _arc(self, x: int, y: int, until: int | None = None) -> bool:
        """Whether token y may follow token x, with the merges before `until`."""
        rank, until = self.rank, len(self.merged) + 1 if until is None else until
        while True:
            r = self.merged.get((x, y))
            if r is not None and r < until:
                return False
            rx, ry = rank[x], rank[y]
            if rx < 0 and ry < 0:
                return True
            if rx >= ry:  # x is the later state: its arcs were copied from those of its right part
                until, x = rx, self.right[x]
                if ry == rx:
                    y = self.left[y]
            else:  # the arc y went wherever an arc of its left part did
                if x == self.left[y] == self.right[y]:
                    return False
                until, y = ry, self.left[y]

    def _step(self, members: tuple[int, ...], byte: int) -> tuple[int, ...]:
        """What a state's arcs become with one byte more; the arc that ends is the token before the last pair."""
        out, label = [], -1
        for x, node in zip(members[::2], members[1::2], strict=True):
            node = self.child.get(node << 8 | byte, 0)
            if node:
                y = self.token[node]
                if y >= 0 and label < 0 and (x < 0 or self._arc(x, y)):
                    label = y
                if self.inner[node]:
                    out += (x, node)
        return (*out, label, 0)

    def _grow(self, row: dict, byte: int) -> dict | None:
        """The row after this one by a byte, entered into the table; none if it is full."""
        members = self._step(row[MEMBERS], byte)
        to = self.states.get(members)
        if to is None:
            if len(self.states) >= KEPT_STATES:
                return None
            to = self.states[members] = {LABEL: members[-2], MEMBERS: members}
        row[byte] = to
        return to

    def encode_word(self, word: bytes) -> list[int]:
        """The labels of the one path for word."""
        row, ended = self.start, []
        for at, c in enumerate(word):
            to = row.get(c) or self._grow(row, c)
            if to is None:
                members = row[MEMBERS]
                for byte in word[at:]:
                    members = self._step(members, byte)
                    ended.append(members[-2])
                break
            row = to
            ended.append(row[LABEL])
        path, at, size = [], len(word), self.size
        while at:
            y = ended[at - 1]
            path.append(y)
            at -= size[y]
        path.reverse()
        return path

    def encode(self, text: str) -> bytes:
        """The ids of text as little-endian unsigned 32-bit integers."""
        out, words = [], self.words
        parts = self.special(text) if self.special else [text]
        for n, part in enumerate(parts):
            if n % 2:
                out.append(np.array([self.added[part]], "<u4").tobytes())
                continue
            split = self.split(part)
            found = list(map(words.get, split))
            for at in [n for n, ids in enumerate(found) if ids is None]:
                found[at] = words.get(split[at]) or self._new_word(split[at])
            out += found
        if len(words) >= KEPT_WORDS:
            self.words, self.older = {}, words
        return b"".join(out)

    def _new_word(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            row = array("I", self.encode_word(word.encode()))
            if sys.byteorder == "big":
                row.byteswap()
            ids = row.tobytes()
        if len(word) <= 64:
            self.words[word] = ids
        return ids

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_automata: dict[str, MergeAutomaton] = {}


def tokenizer_digests(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, one pass without a shuffle.

    A null text is an empty one: no tokens, digests of nothing. Repeated rows give repeated
    results; further columns are ignored. The tokenizer file is read on the driver and
    broadcast: its size is that of a vocabulary, whatever the corpus.
    """
    with open(tokenizer_json, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    key = hashlib.sha256(spec.value.encode()).hexdigest()

    def encode(batches):
        if key not in _automata:
            _automata[key] = MergeAutomaton(json.loads(spec.value))
        automaton = _automata[key]
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for _, _, data, offsets in textkit.runs(batch):
                raw = data.tobytes()
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    ids = automaton.encode(raw[a:b].decode("utf-8", "replace"))
                    n.append(len(ids) // 4)
                    ids_sha.append(sha(ids))
                    text_sha.append(sha(automaton.decode(ids).encode()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_merge_automaton(spark, sf_dir: str) -> DataFrame:
    return tokenizer_digests(table(spark, sf_dir, "documents"), default_tokenizer())
