"""Regular expressions to one minimal deterministic automaton over byte classes.

Knows literals, \\xNN and escaped characters, classes, groups, |, ?, * and +: what rules
for secrets need. An unanchored automaton restarts at every byte, an anchored one starts
once; the set of rules whose expression ends at a byte is an attribute of the state
reached there. A reversed one reads the bytes from the last to the first, so it tells
where expressions start.
"""

from __future__ import annotations


class _Parser:
    """Builds nodes of a non-deterministic automaton: arcs[n] is (byte set, target), free[n] the targets without a byte."""

    def __init__(self) -> None:
        self.arcs: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def node(self) -> int:
        self.arcs.append([])
        self.free.append([])
        return len(self.arcs) - 1

    def parse(self, pattern: str) -> tuple[int, int]:
        self.text, self.at = pattern, 0
        ends = self.either()
        if self.at != len(pattern):
            raise ValueError(f"unbalanced at {self.at}: {pattern}")
        return ends

    def either(self) -> tuple[int, int]:
        start, end = self.node(), self.node()
        while True:
            a, b = self.row()
            self.free[start].append(a)
            self.free[b].append(end)
            if self.text[self.at : self.at + 1] != "|":
                return start, end
            self.at += 1

    def row(self) -> tuple[int, int]:
        start = end = self.node()
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            a, b = self.item()
            self.free[end].append(a)
            end = b
        return start, end

    def item(self) -> tuple[int, int]:
        if self.text[self.at] == "(":
            self.at += 1
            a, b = self.either()
            self.at += 1
        else:
            a, b = self.node(), self.node()
            self.arcs[a].append((self.one(), b))
        sign = self.text[self.at : self.at + 1]
        if sign and sign in "?*+":
            self.at += 1
            start, end = self.node(), self.node()
            self.free[start].append(a)
            self.free[b].append(end)
            if sign in "?*":
                self.free[start].append(end)
            if sign in "*+":
                self.free[b].append(a)
            return start, end
        return a, b

    def char(self) -> int:
        c = self.text[self.at]
        self.at += 1
        if c != "\\":
            return ord(c)
        c = self.text[self.at]
        self.at += 1
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        if c.isalnum():
            raise ValueError(f"\\{c} is not known")
        return ord(c)

    def one(self) -> frozenset[int]:
        if self.text[self.at] != "[":
            return frozenset([self.char()])
        self.at += 1
        found: set[int] = set()
        while self.text[self.at] != "]":
            low = high = self.char()
            if self.text[self.at] == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                high = self.char()
            found.update(range(low, high + 1))
        self.at += 1
        return frozenset(found)


def _reversed(nfa: _Parser, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Turns every arc around."""
    arcs: list[list[tuple[frozenset[int], int]]] = [[] for _ in nfa.arcs]
    free: list[list[int]] = [[] for _ in nfa.free]
    for n, targets in enumerate(nfa.arcs):
        for byte_set, t in targets:
            arcs[t].append((byte_set, n))
    for n, others in enumerate(nfa.free):
        for t in others:
            free[t].append(n)
    nfa.arcs, nfa.free = arcs, free
    return [(end, start) for start, end in pairs]


def compile_rules(patterns: list[str], anchored: bool = False, reverse: bool = False) -> tuple[bytes, list[int], int, list[int]]:
    """(byte -> class, arcs, first accepting state, rules by state).

    States are numbered in steps of the number of classes, so arcs[state + class] is the
    next one, from state 0; those from the first accepting state on end some rule, and
    rules[state] is the bit set of which.
    """
    nfa = _Parser()
    pairs = [nfa.parse(p) for p in patterns]
    if reverse:
        pairs = _reversed(nfa, pairs)
    accepting = {end: 1 << n for n, (_, end) in enumerate(pairs)}

    def closed(nodes) -> frozenset[int]:
        seen, todo = set(nodes), list(nodes)
        while todo:
            for x in nfa.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    roots = closed([start for start, _ in pairs])
    sets = {s for arcs in nfa.arcs for s, _ in arcs}
    kinds: dict[tuple[bool, ...], int] = {}
    classes = bytes(kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256))
    width = len(kinds)
    sample = [classes.index(k) for k in range(width)]

    # subset construction
    number, order, table = {roots: 0}, [roots], []
    for state in order:
        row = []
        for byte in sample:
            to = closed({t for n in state for s, t in nfa.arcs[n] if byte in s})
            to = to if anchored else to | roots
            if to not in number:
                number[to] = len(order)
                order.append(to)
            row.append(number[to])
        table.append(row)
    ends = [sum({accepting[n] for n in state if n in accepting}) for state in order]

    # minimisation: refine the parts until all states of a part go to the same parts
    part = [sorted(set(ends)).index(e) for e in ends]
    while True:
        found: dict[tuple, int] = {}
        finer = [found.setdefault((part[s], *(part[t] for t in row)), len(found)) for s, row in enumerate(table)]
        if len(found) == len(set(part)):
            break
        part = finer
    chosen = {p: s for s, p in reversed(list(enumerate(part)))}
    ranked = sorted(chosen, key=lambda p: (p != part[0], ends[chosen[p]] != 0, chosen[p]))
    place = {p: n * width for n, p in enumerate(ranked)}
    arcs = [place[part[t]] for p in ranked for t in table[chosen[p]]]
    rules = [ends[chosen[p]] for p in ranked for _ in range(width)]
    first = next((n for n, e in enumerate(rules) if e), len(rules))
    return classes, arcs, first, rules
