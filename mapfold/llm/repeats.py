"""Repeated passages: what both substring operators share.

A unit is a byte or a word; a passage of `length` units that starts in two places is to be
found wherever it stands. Each passage is owned by its anchor, the leftmost least hash
among its k-grams; equal passages have equal anchors. The passages that an anchor owns in
a row start one after the other, so together they are one stretch of it, its context, and
every passage of a row lies in exactly one context. The work is then

1. anchors that occur once are dropped (counts by anchor hash, partial before the shuffle);
2. of every other anchor the units of one copy of each different context are fetched, with
   the number of times it occurs;
3. a solver marks the passages that start twice among the contexts of an anchor, counting a
   context that occurs more than once as a match of itself. Contexts come sorted by anchor,
   in slices of bounded size. The passages of an anchor with more different contexts than
   LARGEST get a second anchor, their next least k-gram: equal passages have equal ones at
   equal distances, so that both anchors together name smaller groups, whose contexts are
   the stretches of passages that share both. What is still too large gets a third, and so
   on; every group goes through the solver;
4. what is marked goes to all places of its context, and is cut out there.

Joins by anchor and by context spread a hot one over several tasks: what holds at least a
4096th of all occurrences is listed (4096 rows at most, broadcast) with a number of salts.
A row is known by a hash of doc_id and text: repeated rows are occurrences of their own
and all get the same result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapfold.llm import textkit
from mapfold.session import release, written

U64 = np.uint64
SLICE = 1_000  #: contexts that a solver gets at once, more only to complete an anchor
LARGEST = 4_000  #: contexts of one anchor that a solver gets
RUN = 1 << 17  #: bytes of text handled at once, so that the arrays stay in the cache
HOT = 4096  #: an anchor or a context is hot with one occurrence in so many
SALTS = 256  #: tasks that the occurrences of an anchor in every place would go to
_LOW = U64((1 << 24) - 1)


@dataclass(frozen=True)
class Units:
    length: int  #: units of a passage
    k: int  #: units of an anchor
    read: Callable  #: (bytes, row offsets) -> (values, row offsets in units)
    scatter: Callable  #: values -> 64-bit hashes of them
    solve: Callable  #: (values, offsets of contexts, places of their anchors, groups by anchor, repeated as a whole) -> flags: a repeated passage starts here


def contexts_of(hashes: np.ndarray, offsets: np.ndarray, units: Units) -> tuple[np.ndarray, ...]:
    """(row, first unit, anchor, end, anchor hash, context hash) of the contexts of each row of a run."""
    n, length, k = len(hashes), units.length, units.k
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.astype(U64), none.astype(U64)
    pre = textkit.prefix(hashes)
    at = np.arange(n - k + 1)
    grams = textkit.span_hash(pre, at, at + k)
    # 40 bits of the hash, then the place: ties go to the leftmost
    least = textkit.window_min(grams & ~_LOW | at.astype(U64) & _LOW, length - k + 1)
    s = np.arange(n - length + 1)
    row = np.searchsorted(offsets, s, "right") - 1
    s = s[s + length <= offsets[row + 1]]
    if not len(s):
        return none, none, none, none, none.astype(U64), none.astype(U64)
    row = row[s]
    anchor = s + ((least[s] & _LOW).astype(np.int64) - s & int(_LOW))
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]))
    first, anchor, row = s[new], anchor[new], row[new]
    end = s[np.append(new[1:], len(s)) - 1] + length
    whole = textkit.mix(textkit.span_hash(pre, first, end) + (anchor - first).astype(U64))
    return row, first, anchor, end, grams[anchor], whole


def _find(units: Units):
    def run(batches):
        for batch in batches:
            uid = batch.column("uid").to_numpy()
            for lo, _, data, offsets in textkit.runs(batch, limit=RUN):
                values, offsets = units.read(data, offsets)
                row, first, anchor, end, h1, h2 = contexts_of(units.scatter(values), offsets, units)
                base = offsets[row] if len(row) else row
                i32 = lambda x, base=base: pa.array((x - base).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(uid[lo + row]), i32(first), i32(anchor), i32(end), textkit.as_i64(h1), textkit.as_i64(h2)], ["uid", "first", "anchor", "end", "h1", "h2"])

    return run


def _fetch(units: Units):
    """Contexts of each row with their units, from a list of places; once for rows that repeat one after the other."""

    def run(batches):
        before = None
        for batch in batches:
            uids = batch.column("uid").to_numpy()
            fresh = np.ones(len(uids), bool)
            fresh[1:] = uids[1:] != uids[:-1]
            if len(uids):
                fresh[0], before = uids[0] != before, uids[-1]
            batch = batch.filter(pa.array(fresh))
            lists = batch.column("places")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            field = {c: flat.field(c) for c in ("first", "anchor", "end", "h1", "h2", "n")}
            first, anchor, end = (field[c].to_numpy() for c in ("first", "anchor", "end"))
            at = np.concatenate([[0], np.cumsum(sizes)])
            uid = np.repeat(uids[fresh], sizes)
            for lo, hi, data, offsets in textkit.runs(batch, limit=RUN):
                values, offsets = units.read(data, offsets)
                a, b = at[lo], at[hi]
                base = np.repeat(offsets[:-1], sizes[lo:hi])
                raw = [values[x:y].tobytes() for x, y in zip((first[a:b] + base).tolist(), (end[a:b] + base).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [field["h1"][a:b], field["h2"][a:b], pa.array(uid[a:b]), pa.array(first[a:b]), pa.array(anchor[a:b] - first[a:b]), field["n"][a:b], pa.array(raw, pa.binary())],
                    ["h1", "h2", "uid", "first", "seed", "n", "units"],
                )

    return run


def _stretches(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted starts of passages -> (first, end) of the stretches they cover."""
    if not len(starts):
        return starts, starts
    gap = np.flatnonzero(starts[1:] > starts[:-1] + length)
    return starts[np.concatenate([[0], gap + 1])], starts[np.append(gap, len(starts) - 1)] + length


_SOLVED = "uid long, first int, end int, h1 long, h2 long"


def _solve(units: Units, dtype):
    """Stretches that repeat: (uid, first, end) in contexts that occur once, (h1, h2) for contexts that occur again as a whole."""

    def solved(held):
        sizes = np.array([len(r[6]) for r in held]) // np.dtype(dtype).itemsize
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        values = np.frombuffer(b"".join(r[6] for r in held), dtype)
        h1, again = np.array([r[0] for r in held]), np.array([r[5] > 1 for r in held])
        groups = np.cumsum(np.concatenate([[0], h1[1:] != h1[:-1]]))
        flags = units.solve(values, offsets, np.array([r[4] for r in held]), groups, again)
        rows = []
        hits = np.flatnonzero(flags)
        ctx = np.searchsorted(offsets, hits, "right") - 1
        for c, starts in zip(np.unique(ctx).tolist(), np.split(hits, np.flatnonzero(np.diff(ctx)) + 1), strict=True) if len(hits) else ():
            if again[c]:
                rows.append((None, None, None, held[c][0], held[c][1]))
                continue
            for a, b in zip(*_stretches(starts - offsets[c] + held[c][3], units.length), strict=True):
                rows.append((held[c][2], int(a), int(b), None, None))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["uid", "first", "end", "h1", "h2"])

    def run(batches):
        held = []
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "uid", "first", "seed", "n", "units")), strict=True):
                if held and r[:2] == held[-1][:2]:
                    continue  # the same context once more, from a repeated row
                if len(held) >= SLICE and r[0] != held[-1][0]:
                    yield solved(held)
                    held = []
                held.append(r)
        if held:
            yield solved(held)

    return run


_PARTS = "p1 long, p2 long, pn long, h1 long, h2 long, uid long, first int, seed int, used array<int>, units binary"


def _divide(units: Units, dtype, times: int):
    """The contexts of a context: stretches of its passages by their next anchors, each with the context it came from."""
    length, k, none = units.length, units.k, np.iinfo(np.uint64).max

    def parts(h1, seed, used, raw):
        values = np.frombuffer(raw, dtype)
        pre = textkit.prefix(units.scatter(values))
        at = np.arange(len(values) - k + 1)
        grams = textkit.span_hash(pre, at, at + k)
        key = grams & ~_LOW | at.astype(U64) & _LOW
        key[used] = none
        least = textkit.window_min(key, length - k + 1)
        s = np.arange(len(least))
        # with all k-grams used up a passage stands for itself
        spent = least == none
        anchor = np.where(spent, s, (least & _LOW).astype(np.int64))
        name = np.where(spent, textkit.span_hash(pre, s, s + length), grams[anchor])
        new = np.flatnonzero(np.concatenate([[True], spent[1:] | (anchor[1:] != anchor[:-1])]))
        first, end = s[new], s[np.append(new[1:], len(s)) - 1] + length
        anchor, name = anchor[new], name[new]
        group = textkit.mix(np.full(len(new), h1, np.int64).view(U64) + textkit.mix(name) + textkit.mix((anchor - seed).astype(U64)))
        whole = textkit.mix(textkit.span_hash(pre, first, end) + (seed - first).astype(U64))
        for f, e, a, g, w in zip(first.tolist(), end.tolist(), anchor.tolist(), group.view(np.int64).tolist(), whole.view(np.int64).tolist(), strict=True):
            inside = [u - f for u in (*used, a) if f <= u <= e - k]
            yield g, w, f, seed - f, inside, values[f:e].tobytes()

    def divided(h1, seed, used, raw, left):
        for g, w, f, s, u, part in parts(h1, seed, used, raw):
            if left == 1:
                yield g, w, f, s, u, part
            else:
                for g2, w2, f2, s2, u2, part2 in divided(g, s, u, part, left - 1):
                    yield g2, w2, f + f2, s2, u2, part2

    def run(batches):
        for batch in batches:
            rows = []
            for h1, h2, uid, first, seed, used, n, raw in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "uid", "first", "seed", "used", "n", "units")), strict=True):
                rows += [(h1, h2, n, g, w, uid, first + f, s, u, part) for g, w, f, s, u, part in divided(h1, seed, used, raw, times)]
            kinds = [pa.int64()] * 6 + [pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["p1", "p2", "pn", "h1", "h2", "uid", "first", "seed", "used", "units"])

    return run


def _in_groups(fetched: DataFrame, units: Units, dtype) -> DataFrame:
    """What the solver says of all contexts, those of large groups by ever smaller ones. fetched: h1, h2, uid, first, seed, used, n, units."""
    level, passed, told = fetched, [], None
    while True:
        large = written(level.groupBy("h1").agg(F.count("*").alias("m")).filter(F.col("m") > LARGEST).select("h1"))
        more = not large.isEmpty()
        few = level.join(large.hint("merge"), "h1", "left_anti") if more else level
        solved = few.drop("used").repartition("h1").sortWithinPartitions("h1", "h2").mapInArrow(_solve(units, dtype), _SOLVED)
        told = written(solved) if more or passed else solved
        passed.append([level, told, None])
        if not more:
            break
        # copies of a part lie in different contexts; the solver gets one of them, and that there are more
        # twice as many anchors each time, so that few levels are needed
        parts = written(level.join(large.hint("merge"), "h1", "left_semi").mapInArrow(_divide(units, dtype, 1 << len(passed) - 1), _PARTS))
        passed[-1][2] = parts
        one = F.min_by(F.struct("uid", "first", "seed", "used", "units"), F.struct("uid", "first")).alias("one")
        level = written(parts.groupBy("h1", "h2").agg(F.greatest(F.count("*"), F.max("pn")).alias("n"), one).select("h1", "h2", "one.*", "n"))
    # from the smallest groups back: a part that occurs again is marked wherever it came from
    marked = passed[-1][1]
    for _, told, parts in reversed(passed[:-1]):
        again = parts.join(marked.filter("h1 IS NOT NULL").select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
        end = F.col("first") + (F.octet_length("units") / np.dtype(dtype).itemsize).cast("int")
        once = again.filter("pn = 1").select("uid", "first", end.alias("end"), F.lit(None).cast("long").alias("h1"), F.lit(None).cast("long").alias("h2"))
        whole = again.filter("pn > 1").select(F.lit(None).cast("long").alias("uid"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("end"), F.col("p1").alias("h1"), F.col("p2").alias("h2")).distinct()
        marked = written(told.unionByName(marked.filter("uid IS NOT NULL")).unionByName(once).unionByName(whole))
    return marked


def _salted(rows: DataFrame, hot: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """rows with a salt: 0, or one of those of their key if it is hot."""
    salt = F.coalesce(F.pmod(F.xxhash64(*by), F.col("salts")), F.lit(0))
    return rows.join(F.broadcast(hot), keys, "left").withColumn("salt", salt).drop("salts")


def _spread(rows: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """rows once for every salt of their key."""
    salts = F.sequence(F.lit(0), (F.coalesce("salts", F.lit(1)) - 1).cast("int"))
    return rows.join(F.broadcast(hot), keys, "left").withColumn("salt", F.explode(salts)).withColumn("salt", F.col("salt").cast("long")).drop("salts")


def repeated_stretches(source: DataFrame, units: Units, dtype) -> DataFrame:
    """(uid, places array of (first, end)) of the rows of source (uid, text) in which passages repeat."""
    found = source.mapInArrow(_find(units), "uid long, first int, anchor int, end int, h1 long, h2 long")
    twice = written(found.groupBy("h1").agg(F.count("*").alias("k")).filter("k > 1"))
    total = twice.agg(F.coalesce(F.sum("k"), F.lit(1))).first()[0]
    salts = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) * SALTS / total)).cast("long").alias("salts")
    hot = twice.filter(F.col("k") * HOT > total).select("h1", salts("k"))
    shared = written(_salted(found, hot, ["h1"], ["uid", "first"]).join(_spread(twice.select("h1"), hot, ["h1"]), ["h1", "salt"]).drop("salt"))
    release(source.sparkSession)

    contexts = written(shared.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("uid", "first", "anchor", "end")).alias("at")))
    wanted = contexts.select("h1", "h2", "n", "at.*")
    places = wanted.groupBy("uid").agg(F.collect_list(F.struct("first", "anchor", "end", "h1", "h2", "n")).alias("places"))
    texts = source.join(places.hint("merge"), "uid").select("uid", "text", "places")
    fetched = written(texts.mapInArrow(_fetch(units), "h1 long, h2 long, uid long, first int, seed int, n long, units binary"))
    release(source.sparkSession)

    solved = written(_in_groups(fetched.withColumn("used", F.array("seed")), units, dtype))
    release(source.sparkSession)

    heavy = contexts.filter(F.col("n") * HOT > total).select("h1", "h2", salts("n"))
    whole = _spread(solved.filter("h1 IS NOT NULL").select("h1", "h2"), heavy, ["h1", "h2"])
    copies = _salted(shared, heavy, ["h1", "h2"], ["uid", "first"]).join(whole, ["h1", "h2", "salt"]).select("uid", "first", "end")
    stretches = copies.unionByName(solved.filter("uid IS NOT NULL").select("uid", "first", "end"))
    return stretches.groupBy("uid").agg(F.collect_set(F.struct("first", "end")).alias("places"))


def covered(n: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Flags over n units: inside one of the stretches."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, first, 1)
    np.add.at(steps, end, -1)
    return np.cumsum(steps[:-1]) > 0
