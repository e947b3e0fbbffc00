"""Matches of the walk points of many starts at once, over arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from mapfold.operators.run_labels import group_starts, least_reached, whole_groups

ROUNDS = 12  #: rounds of mutual firsts before the pairs that are left are gone through one by one


def maximum_matching(pairs: list[tuple]) -> int:
    """The most pairs that share no end, by augmenting paths."""
    options: dict = {}
    for a, b in pairs:
        options.setdefault(a, []).append(b)
    owner: dict = {}
    mate: dict = {}
    for root in options:
        # breadth first over alternating paths from a free left end
        came, queue, free = {}, [root], None
        for a in queue:
            for b in options[a]:
                if b not in came:
                    came[b] = a
                    if b not in owner:
                        free = b
                        break
                    queue.append(owner[b])
            if free is not None:
                break
        while free is not None:
            a = came[free]
            owner[free], mate[a], free = a, free, mate.get(a)
    return len(owner)


def most_pairs(t: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first pair, size) of a maximum matching in each component of distinct pairs (t, p); t and p are numbers of one set, without one in common."""
    if not len(t):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    root = least_reached(int(max(t.max(), p.max())) + 1, t, p)[t]
    by = np.argsort(root, kind="stable")
    first = np.flatnonzero(np.diff(root[by], prepend=-1))
    ends = np.append(first[1:], len(by))
    size = np.empty(len(first), np.int64)
    sides = []
    for side in (t, p):
        of = np.unique(side, return_index=True)[1]
        sides.append(np.bincount(np.searchsorted(root[by][first], root[of]), minlength=len(first)))
    size = np.minimum(*sides)
    # a single end, or every end with every other: the smaller side; the rest by paths
    for k in np.flatnonzero((size > 1) & (ends - first < sides[0] * sides[1])):
        some = by[first[k] : ends[k]]
        size[k] = maximum_matching(list(zip(t[some].tolist(), p[some].tolist(), strict=True)))
    return by[first], size


def greedy_pairs(t: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Places of the pairs that a pass in the given order takes, each end once."""
    left, taken = np.arange(len(t)), []
    for _ in range(ROUNDS):
        if not len(left):
            break
        firsts = []
        for side in (t[left], p[left]):
            _, at, back = np.unique(side, return_index=True, return_inverse=True)
            firsts.append(at[back] == np.arange(len(left)))
        now = left[firsts[0] & firsts[1]]
        taken.append(now)
        left = left[~(np.isin(t[left], t[now]) | np.isin(p[left], p[now]))]
    used: set[int] = set()
    late = []
    for k, a, b in zip(left.tolist(), t[left].tolist(), p[left].tolist(), strict=True):
        if a not in used and b not in used:
            used |= {a, b}
            late.append(k)
    return np.concatenate([*taken, np.array(late, np.int64)]) if taken or late else np.zeros(0, np.int64)


def _close(group: np.ndarray, x: np.ndarray, y: np.ndarray, t: np.ndarray, p: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(t, p, distance) of the rows t and p of a group at most threshold apart, by square cells."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(t) or not len(p):
        return none
    side = threshold * 1.001 or 1.0
    cx, cy = np.floor(x / side), np.floor(y / side)
    ux, uy = np.unique(cx[p]), np.unique(cy[p])
    key = (group[p] * len(ux) + np.searchsorted(ux, cx[p])) * len(uy) + np.searchsorted(uy, cy[p])
    by = np.argsort(key, kind="stable")
    key, p = key[by], p[by]
    found = []
    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            ix, iy = np.searchsorted(ux, cx[t] + dx), np.searchsorted(uy, cy[t] + dy)
            there = np.flatnonzero((ux[np.minimum(ix, len(ux) - 1)] == cx[t] + dx) & (uy[np.minimum(iy, len(uy) - 1)] == cy[t] + dy))
            asked = (group[t[there]] * len(ux) + ix[there]) * len(uy) + iy[there]
            low, high = np.searchsorted(key, asked, "left"), np.searchsorted(key, asked, "right")
            n = high - low
            a, b = np.repeat(t[there], n), p[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
            d = np.sqrt((x[a] - x[b]) * (x[a] - x[b]) + (y[a] - y[b]) * (y[a] - y[b]))
            near = d <= threshold
            found.append((a[near], b[near], d[near]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _places(group: np.ndarray, true: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row's place in its group and side, a row of each place)."""
    of = x.view(np.int64), y.view(np.int64), true, group
    by = np.lexsort(of)
    new = np.ones(len(by), bool)
    new[1:] = np.any([c[by[1:]] != c[by[:-1]] for c in of], axis=0)
    place = np.empty(len(by), np.int64)
    place[by] = np.cumsum(new) - 1
    return place, by[new]


def start_scores(threshold: float, hard: float, soft: float):
    """A function of batches (map_id, start, x, y, dx, dy, true) in order of map_id and start, a row for each start.

    nt, np: true and predicted places; near_t, near_p: those at most threshold from one of the
    other side; hit: the most pairs whose directions are less than hard apart; taken, cost: the
    pairs below soft that a greedy pass takes, and what they cost (see evaluate.soft_topo).
    """

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["map_id", "start"]):
            begins = group_starts(rows, ["map_id", "start"])
            group, n = np.cumsum(begins) - 1, int(begins.sum())
            x, y, dx, dy = (pc.fill_null(rows[c], np.nan).to_numpy() + 0.0 for c in ("x", "y", "dx", "dy"))
            x[np.isnan(x)] = y[np.isnan(y)] = np.nan
            true = rows["true"].to_numpy()
            place, one = _places(group, true, x, y)
            fit = np.isfinite(x) & np.isfinite(y)
            with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                t, p, d = _close(group, x, y, np.flatnonzero(fit & true), np.flatnonzero(fit & ~true), threshold)
                cosine = (dx[t] * dx[p] + dy[t] * dy[p]) / (np.sqrt(dx[t] * dx[t] + dy[t] * dy[t]) * np.sqrt(dx[p] * dx[p] + dy[p] * dy[p]))
            apart = 1 - np.abs(cosine)
            count = lambda some: np.bincount(group[one[some]], minlength=n)
            told = {"nt": count(true[one]), "np": count(~true[one]), "near_t": count(np.unique(place[t])), "near_p": count(np.unique(place[p]))}
            # of points at one place those count whose directions are least apart
            by = np.lexsort((apart, place[p], place[t]))
            new = np.ones(len(by), bool)
            new[1:] = (place[t[by[1:]]] != place[t[by[:-1]]]) | (place[p[by[1:]]] != place[p[by[:-1]]])
            t, p, d, apart = (c[by[new]] for c in (t, p, d, apart))
            some = np.flatnonzero(apart < hard)
            first, size = most_pairs(place[t[some]], place[p[some]])
            told["hit"] = np.bincount(group[t[some[first]]], weights=size, minlength=n).astype(np.int64)
            some = np.flatnonzero((apart < soft) & (d < threshold))
            cost = np.maximum(0.0, 1.5 * (d - threshold / 3)) + apart * threshold * 0.5
            some = some[np.lexsort((y[p[some]], x[p[some]], y[t[some]], x[t[some]], cost[some]))]
            some = some[greedy_pairs(place[t[some]], place[p[some]])]
            told["taken"] = np.bincount(group[t[some]], minlength=n)
            told["cost"] = np.bincount(group[t[some]], weights=cost[some], minlength=n).astype(np.float64)
            at = np.flatnonzero(begins)
            yield from pa.table({"map_id": rows["map_id"].take(at), "start": rows["start"].take(at), **told}).to_batches()

    return solve
