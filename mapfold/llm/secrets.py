"""Secret scans by one automaton for all rules.

The rules' expressions are compiled together by subset construction and minimised into
transition arrays over byte classes. One pass over a text, from its last byte to its
first, runs the reversed automaton of all rules: the states it passes tell where a match
of which rule starts. From those starts alone the anchored automaton runs forward to the
longest match. Leftmost starts first and no overlaps within a rule give the spans, after
which matches that are too short are dropped.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapfold.llm import textkit
from mapfold.llm.automaton import compile_rules
from mapfold.session import table


@dataclass(frozen=True)
class Rule:
    """A match is head, body and tail; its body must have `least` characters."""

    kind: str
    head: str
    body: str
    tail: str
    least: int

    def starts(self) -> str:
        """What must stand at the start of a match that counts.

        A match that is nothing but a run of one class reaches to the end of the run, so only
        runs that are long enough need to be met; other short matches still use up their text.
        """
        if not self.head and not self.tail and re.fullmatch(r"\[[^]]+\]\+", self.body):
            return self.body[:-1] * max(1, self.least)
        return self.head + self.body + self.tail


_ASSIGN = r"""([pP][aA][sS][sS][wW]([oO][rR][dD]|[dD])|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?"""
#: Rules in the order in which their spans are listed. Of the first three the
#: results are agreed; the others are further kinds.
BASE = (
    Rule("assign", _ASSIGN, "[A-Za-z0-9+/_.=-]+", "", 12),
    Rule("access", "", "AKIA[A-Z0-9]+", "", 18),
    Rule("hex", "", "[0-9a-f]+", "", 16),
)
MORE = (
    Rule("private_key", "", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", "", 0),
    Rule("slack", "", "xox[abprs]-[0-9A-Za-z][0-9A-Za-z-]*", "", 15),
    Rule("login_url", "://[A-Za-z0-9._-]+:", "[A-Za-z0-9._-]+", "@", 6),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.back = compile_rules([r.starts() for r in rules], reverse=True)
        # forward the automaton also tells where a head and where a body may end
        parts = [(n, k, p) for n, r in enumerate(rules) for k, p in enumerate((r.head + r.body + r.tail, r.head, r.head + r.body)) if p]
        self.forward = compile_rules([p for *_, p in parts], anchored=True)
        self.bits = [[0, 0, 0] for _ in rules]
        for bit, (n, k, _) in enumerate(parts):
            self.bits[n][k] = 1 << bit
        classes, arcs, _, ends = self.forward
        width = max(classes) + 1
        self.dead = next(s for s in range(0, len(arcs), width) if not ends[s] and all(t == s for t in arcs[s : s + width]))

    def starts(self, data: bytes) -> list[tuple[int, int]]:
        """(place, bit set of the rules that start there), the last place first."""
        classes, arcs, accept, ends = self.back
        s, out = 0, []
        for at, c in enumerate(data.translate(classes)[::-1], 1):
            s = arcs[s + c]
            if s >= accept:
                out.append((len(data) - at, ends[s]))
        return out

    def longest(self, codes: bytes, start: int, rule: int) -> tuple[int, int]:
        """(end, length of the body) of the longest match of a rule that starts here."""
        _, arcs, accept, ends = self.forward
        whole, head, body = self.bits[rule]
        s, found, begin, close = 0, (start, 0), start, start
        for at in range(start, len(codes)):
            s = arcs[s + codes[at]]
            if s == self.dead:
                break
            if s >= accept:
                e = ends[s]
                if e & body:
                    close = at + 1
                if e & whole:
                    found = at + 1, close - begin
                if e & head:
                    begin = at + 1
        return found

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule number) in code points, by start and then rule."""
        starts = self.starts(data)
        if not starts:
            return []
        codes, out, until = data.translate(self.forward[0]), [], [0] * len(self.rules)
        for at, which in reversed(starts):
            for n, rule in enumerate(self.rules):
                if which >> n & 1 and at >= until[n]:
                    until[n], size = self.longest(codes, at, n)
                    if size >= rule.least:
                        out.append((at, until[n], n))
        if not data.isascii():
            before = np.concatenate([[0], np.cumsum(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)])
            out = [(int(before[a]), int(before[b]), n) for a, b, n in out]
        return out


_scanners: dict[tuple[Rule, ...], Scanner] = {}


def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


def _texts(batch):
    for _, _, data, offsets in textkit.runs(batch):
        raw = data.tobytes()
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            yield raw[a:b]


def secret_digests(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row, one pass without a shuffle.

    A null or empty text has no spans; repeated rows give repeated results; columns other
    than doc_id and text are ignored.
    """

    def scan(batches):
        find, told, base = _scanner(rules), [r.kind for r in rules], len(BASE)
        for batch in batches:
            counts, shas, spans = ([], [], []), [], []
            for text in _texts(batch):
                found = find.spans(text)
                for n in range(3):
                    counts[n].append(sum(k == n for _, _, k in found))
                shas.append(hashlib.sha256(",".join(f"{told[k]}:{a}:{b}" for a, b, k in found if k < base).encode()).hexdigest())
                spans.append(",".join(f"{told[k]}:{a}:{b}" for a, b, k in found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mask: str = "<secret>", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """docs with each run of overlapping spans in text replaced by mask; other texts and all columns stay as they are."""
    columns = docs.columns

    def clean(batches):
        find = _scanner(rules)
        for batch in batches:
            out = []
            for data, null in zip(_texts(batch), batch.column("text").is_null().to_pylist(), strict=True):
                found = find.spans(data)
                if not found:
                    out.append(None if null else data.decode("utf-8", "replace"))
                    continue
                text, parts, at = data.decode("utf-8", "replace"), [], 0
                for a, b, _ in found:
                    if a >= at:
                        parts += [text[at:a], mask]
                    at = max(at, b)
                out.append("".join(parts) + text[at:])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in columns], columns)

    return docs.mapInArrow(clean, docs.schema)


def op8_secret_automaton(spark, sf_dir: str) -> DataFrame:
    return secret_digests(table(spark, sf_dir, "documents"))
