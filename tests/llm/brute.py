"""Plain versions of what the operators compute, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def near(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, component)."""
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def repeats(rows: list, length: int) -> list[list[bool]]:
    """For each sequence which places a repeated window covers."""
    seen = Counter(tuple(r[i : i + length]) for r in rows for i in range(len(r) - length + 1))
    out = []
    for r in rows:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[tuple(r[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def spans(gone: list[bool]) -> int:
    return sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))


def edit_anywhere(pattern: str, text: str) -> int:
    """Least edit distance of pattern to a part of text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        nxt = [i]
        for j, c in enumerate(text, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (p != c)))
        row = nxt
    return min(row)


def repeat_words(words: list[str]) -> int:
    win = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n, got = Counter(win), set()
    for i, w in enumerate(win):
        if n[w] > 1:
            got.update(range(i, i + 5))
    return len(got)


SECRETS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)


def secrets(text: str) -> list[str]:
    found = []
    for n, (kind, rule, group, least) in enumerate(SECRETS):
        found += [(m.start(), n, f"{kind}:{m.start()}:{m.end()}") for m in rule.finditer(text) if len(m.group(group)) >= least]
    return [x[2] for x in sorted(found)]
