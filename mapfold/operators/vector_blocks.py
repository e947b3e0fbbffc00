"""The nearest rows of one block of vectors to one block of queries, as matrices.

A matrix product tells roughly how far every row is; the rows that could be among the
nearest by that, with room for rounding, are then measured component by component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

QUERIES, ROWS = 512, 8192  #: sides of the matrices


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = np.concatenate([np.zeros(0), *(c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks)])
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _few_copies(x: np.ndarray, k: int) -> np.ndarray:
    """The places of the rows of x without those that k + 1 equal rows come before."""
    odd = np.random.default_rng(1).integers(1 << 62, size=x.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    by = np.argsort(((x + 0.0).view(np.uint64) * odd).sum(axis=1), kind="stable")
    new = np.ones(len(x), bool)
    new[1:] = (x[by[1:]] != x[by[:-1]]).any(axis=1)
    start = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
    return np.sort(by[np.arange(len(x)) - start <= k])


def nearest_rows(q: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance): for each query all rows that can be among its k + 1 nearest, some more at times."""
    far, bb = (q * q).sum(1), (b * b).sum(1)
    room = 8e-15 * (q.shape[1] + 10) * (far + bb.max(initial=0))
    found = []
    for s in range(0, len(q), QUERIES):
        x, bound, near = q[s : s + QUERIES], np.full(min(QUERIES, len(q) - s), np.inf), []
        own, slack = far[s : s + QUERIES, None], room[s : s + QUERIES]
        for t in range(0, len(b), ROWS):
            d = own + bb[t : t + ROWS] - 2 * (x @ b[t : t + ROWS].T)
            hit = d <= (bound + 2 * slack)[:, None]
            if d.shape[1] > k and np.count_nonzero(hit) > 4 * (k + 1) * len(x):
                bound = np.minimum(bound, np.partition(d, k, axis=1)[:, k])
                hit = d <= (bound + 2 * slack)[:, None]
            i, j = np.divmod(np.flatnonzero(hit), d.shape[1])
            near.append((i, j + t, d[i, j]))
        i, j, d = (np.concatenate(c) for c in zip(*near, strict=True))
        by = np.lexsort((d, i))
        at = np.searchsorted(i[by], np.arange(len(x))) + k
        enough = at < np.searchsorted(i[by], np.arange(len(x)), "right")
        bound[enough] = d[by[at[enough]]]
        keep = d <= (bound + 2 * slack)[i]
        found.append((i[keep] + s, j[keep]))
    i, j = (np.concatenate(c) for c in zip(*found, strict=True))
    total = np.zeros(len(i))
    for c in range(q.shape[1]):  # in the order of the components, as any engine adds them
        off = q[i, c] - b[j, c]
        total += off * off
    return i, j, np.sqrt(total)


def block_search(k: int, exclude_self: bool):
    """A function of two Arrow tables, (query_id, qvec) and (id, vec): (query_id, id, distance) of the k nearest, ties to the smaller id."""

    def search(queries: pa.Table, base: pa.Table) -> pa.Table:
        base = base.sort_by("id")
        if not len(queries) or not len(base):
            return pa.table({"query_id": queries["query_id"].slice(0, 0), "id": base["id"].slice(0, 0), "distance": pa.array([], pa.float64())})
        q, b = _matrix(queries["qvec"]), _matrix(base["vec"])
        some = _few_copies(b, k)
        i, j, d = nearest_rows(q, b[some], k)
        j = some[j]
        if exclude_self:
            apart = queries["query_id"].to_numpy()[i] != base["id"].to_numpy()[j]
            i, j, d = i[apart], j[apart], d[apart]
        by = np.lexsort((j, d, i))
        i, j, d = i[by], j[by], d[by]
        first = np.searchsorted(i, i, "left")
        top = np.arange(len(i)) - first < k
        return pa.table({"query_id": queries["query_id"].take(i[top]), "id": base["id"].take(j[top]), "distance": d[top]})

    return search


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of the rows of a and b, added up in the order of the components, as any engine does."""
    total = np.zeros(len(a))
    for c in range(a.shape[1]):
        total += a[:, c] * b[:, c]
    return total


def similar_rows(q: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine): for each query all rows that can be among its k most similar, some more at times. No row is zero."""
    of_q, of_b = np.sqrt(_in_order(q, q)), np.sqrt(_in_order(b, b))
    i, j, _ = nearest_rows(q / of_q[:, None], b / of_b[:, None], k - 1)  # of unit vectors the most similar are the nearest
    sim = np.empty(len(i))
    for s in range(0, len(i), 1 << 18):
        x, y = i[s : s + (1 << 18)], j[s : s + (1 << 18)]
        sim[s : s + (1 << 18)] = _in_order(q[x], b[y]) / (of_q[x] * of_b[y])
    return i, j, sim


def _first(i: np.ndarray, j: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Places of the k most similar rows j of each i, ties to the smaller j."""
    by = np.lexsort((j, -sim, i))
    return by[np.arange(len(by)) - np.searchsorted(i[by], i[by], "left") < k]


def mutual_search(keys: list[str]):
    """A function of two Arrow tables (keys.., a, va) and (keys.., b, vb) of one group: (keys.., a, b, sim), the most similar b of each a and a of each b."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("a"), right.sort_by("b")
        if not len(left) or not len(right):
            i = j = np.zeros(0, np.int64)
            sim = np.zeros(0)
        else:
            x, y = _matrix(left["va"]).astype(np.float64), _matrix(right["vb"]).astype(np.float64)
            i, j, sim = similar_rows(x, y, 1)
            own = _first(i, j, sim, 1)
            q, p, back = similar_rows(y, x, 1)
            other = _first(q, p, back, 1)
            i, j, sim = (np.concatenate(c) for c in ((i[own], p[other]), (j[own], q[other]), (sim[own], back[other])))
        return pa.table({**{c: left[c].take(i) for c in keys}, "a": left["a"].take(i), "b": right["b"].take(j), "sim": sim})

    return search


def word_search(keys: list[str], k: int):
    """A function of two Arrow tables (keys.., id, name, vec) and (keys.., word, wvec) of one group: (keys.., id, word, sim), the k most similar words of each id but its name."""

    def search(queries: pa.Table, words: pa.Table) -> pa.Table:
        words = words.take(pc.sort_indices(words["word"], null_placement="at_start"))
        if not len(queries) or not len(words):
            i = j = np.zeros(0, np.int64)
            sim = np.zeros(0)
        else:
            own, of = pc.index_in(queries["name"], value_set=words["word"].unique()), pc.index_in(words["word"], value_set=words["word"].unique())
            own, of = (c.to_numpy() if isinstance(c, pa.ChunkedArray) else c.to_numpy(zero_copy_only=False) for c in (pc.fill_null(own, -1), of))
            named = np.bincount(of)[np.unique(own[own >= 0])]  # rows of words that are the name of a query
            most = k + int(named.max(initial=0))
            b = _matrix(words["wvec"]).astype(np.float64)
            some = _few_copies(b, most)
            i, j, sim = similar_rows(_matrix(queries["vec"]).astype(np.float64), b[some], most)
            apart = own[i] != of[some[j]]
            i, j, sim = i[apart], some[j[apart]], sim[apart]
            top = _first(i, j, sim, k)
            i, j, sim = i[top], j[top], sim[top]
        return pa.table({**{c: queries[c].take(i) for c in keys}, "id": queries["id"].take(i), "word": words["word"].take(j), "sim": sim})

    return search
