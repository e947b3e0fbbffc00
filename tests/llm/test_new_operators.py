"""Periodic runs, hard negatives and the set join against their plain versions."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mapfold.llm import near_dup, periodic, set_join, textkit, threshold_join

EXTRA = "doc_id long, text string, uid string, node long, runs int, plain string, `key` int, size int, sigs string, n_words int"


def frame(spark, rows, schema=EXTRA):
    return spark.createDataFrame([(*r, "x", 1, 2, "y", 3, 4, "z", 5) for r in rows], schema)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def runs_of(w):
    """Every run as (start, length, period), by trying each period at each place."""
    n, out = len(w), set()
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(24, 3 * q) and not any(all(w[k] == w[k + r] for k in range(i, i + length - r)) for r in range(1, q)):
                out.add((i, length, q))
            i = max(j, i + 1)
    return out


def repetitive(r, n, letters):
    w: list[str] = []
    while len(w) < n:
        unit = [str(r.randrange(letters)) for _ in range(r.randint(1, max(1, n // 5)))]
        w += (unit * r.randint(1, 8))[: r.randint(1, n)]
        if r.random() < 0.3:
            w += [str(r.randrange(letters + 2)) for _ in range(r.randint(1, 10))]
    return w[:n]


@pytest.mark.parametrize("whole", [64, 1 << 13])
def test_periodic_runs(spark, monkeypatch, whole):
    monkeypatch.setattr(periodic, "WHOLE", whole)
    monkeypatch.setattr(periodic, "_solve", _with_whole(whole, periodic._solve))
    r = random.Random(whole)
    texts = [None, "", " \n\t", "a", "a " * 23, "a " * 24, "ab cd " * 12, "ab cd " * 12 + "ab", "x" * 500, "日本 語 " * 20 + "\x1c \x00 é"]
    texts += [" ".join(repetitive(r, n, letters)) for n in (24, 60, 200, 300) for letters in (1, 2, 3, 40) for _ in range(3)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(7, texts[7]), (None, texts[8]), (None, "b " * 40)]
    got = sorted(periodic.periodic_runs(frame(spark, rows)).collect(), key=str)
    want = []
    for d, t in rows:
        w = words_of(t)
        runs = sorted(runs_of(w), key=lambda x: (x[0], x[2]))
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else (None,) * 3
        gone = {i for a, n, q in runs for i in range(a + q, a + n)}
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{a},{n},{q}\n" for a, n, q in runs), " ".join(x for i, x in enumerate(w) if i not in gone))]
        want.append((d, len(w), len(runs), *best, 1000 * best[1] // best[2] if runs else None, *digest))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert periodic.periodic_runs(frame(spark, rows).filter("false")).count() == 0


def _with_whole(whole, solve):
    def run(batches):
        from mapfold.llm import periodic as own

        kept, own.WHOLE = own.WHOLE, whole  # in the worker
        try:
            yield from solve(batches)
        finally:
            own.WHOLE = kept

    return run


def test_tiles_hold_every_run():
    r = random.Random(3)
    for whole in (64, 128):
        old, periodic.WHOLE = periodic.WHOLE, whole
        try:
            for _ in range(60):
                w = repetitive(r, r.choice([100, 300, 700]), r.choice([1, 2, 30]))
                ids = np.unique(w, return_inverse=True)[1]
                found = []
                for tile in periodic._tiles(ids):
                    x, p = np.frombuffer(tile["words"], np.int32).astype(np.int64), tile["p"]
                    while p <= tile["top"]:
                        parts = periodic.fragments(x, textkit.prefix(textkit.mix(x.astype(np.uint64))), p, max(p, 8), tile["low"], tile["high"])
                        found += [(q, a + tile["at"], b + tile["at"]) for q, a, b in zip(*parts, strict=True)]
                        p *= 2
                period, first, last = periodic._touching(*(np.array([f[k] for f in found], np.int64) for k in range(3)))
                got = {(a, b - a + q, q) for q, a, b in zip(period.tolist(), first.tolist(), last.tolist(), strict=True) if b - a >= max(2 * q, 24 - q)}
                assert got == runs_of(w)
        finally:
            periodic.WHOLE = old


def test_z_function():
    r = random.Random(1)
    for _ in range(200):
        x = [r.randrange(2) for _ in range(r.randint(1, 40))]
        assert periodic.z_function(x) == [next((k for k in range(len(x) - i) if x[k] != x[i + k]), len(x) - i) for i in range(len(x))]


def negatives(rows):
    """Hard negatives by scoring everything; rows: (vec_id, label, vector)."""
    rows = list(dict.fromkeys((i, l, tuple(v)) for i, l, v in rows if i is not None and l is not None and v is not None and None not in v))
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, l, v in rows:
        if i % 5:
            continue
        scored = sorted((-score(v, w), j, m) for j, m, w in rows if j != i)
        for s, j, m in [x for x in scored if x[2] == l][:5]:
            fits = [(-t, k) for t, k, n in scored if n != l and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(i, j, rank + 1, k, -s, t) for rank, (t, k) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("dims", [1, 5, 24])
def test_hard_negatives(spark, dims):
    r = np.random.default_rng(dims)
    centres = r.normal(size=(6, dims)) * 120
    rows = [(k, int(r.integers(3)), [int(x) for x in centres[r.integers(6)] + r.normal(size=dims) * 25]) for k in range(150)]
    rows += [(k, k % 2, rows[0][2]) for k in range(200, 260)]  # copies under two labels
    rows += [(300, 9, rows[0][2]), (301, 1, None), (302, None, rows[1][2]), (None, 1, rows[1][2]), (303, 1, [None] * dims), (305, 1, [0] * dims), (306, 2, []), (310, 2, [5] * (dims - 1)), rows[5], rows[5]]
    table = spark.createDataFrame([(*x, 1, "u") for x in rows], "vec_id long, label int, q array<int>, anchor int, uid string")
    got = threshold_join.hard_negatives(table, F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, got.collect())) == negatives(rows)
    assert threshold_join.hard_negatives(table.filter("false"), F.col("vec_id") % 5 == 0).count() == 0


def test_the_index_loses_no_pair():
    r = np.random.default_rng(7)
    for sparse in (0.0, 0.8):
        rows = np.rint(r.normal(size=(400, 30)) * 100).astype(np.int64) * (r.random((400, 30)) >= sparse)
        anchors = rows[:40]
        order = np.argsort((rows.astype(float) ** 2).sum(0), kind="stable")
        whole = anchors @ rows.T
        for threshold in (2e5, 8e4, 1e4, 0.0):
            index = threshold_join.Index(rows, order, threshold / np.sqrt((anchors.astype(float) ** 2).sum(1)).max())
            i, j = index.survivors(anchors, order, np.full(len(anchors), threshold))
            found = set(zip(i.tolist(), j.tolist(), strict=True))
            assert {(a, b) for a, b in zip(*np.nonzero(whole >= threshold), strict=True)} <= found
            if threshold == 2e5:
                assert index.first.max() > 0 and len(found) < whole.size // 4  # dimensions are left out and pairs dropped


def test_rows_that_take_part(spark):
    rows = [(7, [0.5, -0.001], 9), (8, [float("nan"), 1.0], 1), (9, [float("inf"), 1.0], 1), (10, [None, 1.0], 1), (11, None, 1), (12, [1.0, 2.0], None), (13, [1e38, -1e38], 3), (14, [], 2)]
    got = threshold_join.mined(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert [(x.vec_id, x.label, x.q) for x in got] == [(7, 0, [128, -1]), (13, 3, [1 << 26, -(1 << 26)]), (14, 3, [])]


def shingles(text, size=3):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words_of(text)]
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components(rows, percent):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted(((d, len(sets[i]), low.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def edited(r, base, edits):
    copy = list(base)
    for _ in range(edits):
        copy[r.randrange(len(copy))] = f"edit{r.randrange(400)}"
    return " ".join(copy)


@pytest.mark.parametrize("block", [3, 2048])
def test_similar_sets(spark, monkeypatch, block):
    monkeypatch.setattr(set_join, "BLOCK", block)
    r = random.Random(block)
    vocabulary = [f"w{k}" for k in range(900)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "One"), (5, "one two"), (6, "a b c"), (None, "a b c"), (None, "z y")]
    for at, (size, copies) in enumerate([(11, 12), (12, 12), (30, 30), (90, 60), (400, 30), (2500, 6)]):
        base = [r.choice(vocabulary) for _ in range(size)]
        rows += [(1000 * at + 100 + k, edited(r, base, r.randint(0, max(1, size // 20)))) for k in range(copies)]
        rows += [(1000 * at + 800 + k, " ".join(base[: size - k])) for k in range(min(6, size - 1))]
    rows += [rows[20]] * 3 + [(9000 + k, rows[30][1]) for k in range(40)]
    got = set_join.similar_sets(frame(spark, rows))
    assert sorted(map(tuple, got.collect()), key=str) == components(rows, 90)
    assert set_join.similar_sets(frame(spark, rows).filter("false")).count() == 0


def test_sets_that_link_share_a_signature():
    r = np.random.default_rng(4)
    for size in (9, 10, 19, 20, 50, 333, 3000):
        for _ in range(120):
            a = np.unique(r.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
            lose = int(r.integers(0, size // 10 + 1))
            b = np.unique(np.concatenate([r.permutation(a)[lose:], r.integers(0, 1 << 63, int(r.integers(0, size // 10 + 1)), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 90 * (len(a) + len(b) - both) and both < max(len(a), len(b)):
                assert len(np.intersect1d(set_join.signatures(a, 90), set_join.signatures(b, 90)))
                band = max(set_join.band_of(len(a), 90), set_join.band_of(len(b), 90))
                fine = [np.frombuffer(set_join.fine(s, band, 90), np.uint8) for s in (a, b)]
                assert 19 * (fine[0] != fine[1]).sum() <= len(a) + len(b)


def test_shingle_sets_of_three_words():
    data = np.frombuffer(b"a b c d A B c", np.uint8)
    assert [len(s) for s in near_dup.shingle_sets(data, np.array([0, 7, 13]), 3)] == [2, 1]
