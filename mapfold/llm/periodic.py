"""Periodic runs of words, by tiles of each period octave.

Periods are dealt to octaves, [P, 2P) each, and an octave sets boundaries every max(P, 8)
words. A tile is the stretch around its boundaries, as long as the octave's periods need, so
tiles of an octave overlap. At a boundary b the Z-function of the words from b on says for
each period how far the words agree with those a period later, and the Z-function of the
reversed words before b how far they do to the left. Three periods of a run, or its 24
words, always hold two boundaries of the octave, so every run shows as fragments of at most
three steps, each from one tile alone. Fragments are shuffled by document and period, and
what touches is one stretch. Where a whole block at b doesn't agree, by its hash, with the
block a period later, no Z-function is run.

A stretch whose period is a multiple of a smaller one is dropped in its tile: a fragment
covers a period of its run at least, so it has a smaller period exactly if the run has.

Texts of at most WHOLE words are solved where they are read, laid end to end with marks that
equal nothing in between. Longer ones are exploded into tiles, which are written and dealt
to all tasks. Words are compared as 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapfold.llm import textkit
from mapfold.session import table, written

U64 = np.uint64
LEAST, TIMES = 24, 3  #: a run has that many words, and that many periods
STEP = 8  #: the least distance of boundaries
WHOLE = 1 << 13  #: words of a text that are solved without tiles of their own
FRAGMENTS = "array<struct<period: long, first: long, last: long>>"


def z_function(x: list[int]) -> list[int]:
    """For each place how many values from there on equal those from the start on."""
    n = len(x)
    z, left, right = [n] + [0] * (n - 1), 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def octaves(words: int) -> Iterator[tuple[int, int]]:
    """(P, step) of the octaves whose periods a text of so many words can hold."""
    p = 1
    while TIMES * p <= words and words >= LEAST:
        yield p, max(p, STEP)
        p *= 2


def _has_smaller(pre: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the words from start to end, of that period, have one that divides it."""
    out, rest, prime = np.zeros(len(period), bool), period.copy(), 2
    while len(rest) and rest.max() > 1:
        if prime * prime > rest.max():  # what is left is one prime, or one
            tried = np.flatnonzero(rest > 1)
            q = period[tried] // rest[tried]
            rest[:] = 1
        else:
            tried = np.flatnonzero(rest % prime == 0)
            q = period[tried] // prime
            while (again := rest % prime == 0).any():
                rest[again] //= prime
            prime += 1
        a, b = start[tried], end[tried]
        out[tried] |= textkit.span_hash(pre, a, b - q) == textkit.span_hash(pre, a + q, b)
    return out


def fragments(ids: np.ndarray, pre: np.ndarray, p: int, step: int, low: int = 0, high: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(period, first, last) of the places first to last - 1 whose words agree with those a period later.

    ids: the words of a tile. Only boundaries from low to high - 1 are looked at, at multiples of step.
    """
    n = len(ids)
    none = np.zeros(0, np.int64)
    blocks = np.arange(-(-low // step) * step, min(n if high is None else high, n - step - p + 1), step)
    if not len(blocks):
        return none, none, none
    at = np.arange(n - step + 1)
    hashes = np.concatenate([textkit.span_hash(pre, at, at + step), textkit.mix(np.arange(2 * p, dtype=U64) + U64(n))])
    later = np.lib.stride_tricks.sliding_window_view(hashes, p)
    hits = []
    for part in np.array_split(blocks, max(1, len(blocks) * p >> 21)):
        k, d = np.nonzero(later[part + p] == hashes[part][:, None])
        hits.append((part[k], d + p))
    start, period = (np.concatenate([h[k] for h in hits]) for k in (0, 1))
    inside = start + period + step <= n
    start, period = start[inside], period[inside]
    own = ~_has_smaller(pre, start, start + step + period, period)
    start, period = start[own], period[own]
    first, last, known, b0 = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), None, -1
    for k, (b, q) in enumerate(zip(start.tolist(), period.tolist(), strict=True)):
        if b != b0:
            b0, back = b, min(step, b)
            right = z_function(ids[b : b + 2 * step + 2 * p].tolist())
            before = ids[b - back : b][::-1].tolist()
            left = z_function([*before, -1, *ids[b - back : b + 2 * p][::-1].tolist()])
            known = (back + 1 + min(2 * p, n - b), back)
        first[k] = b - min(left[known[0] - q], known[1])
        last[k] = b + min(right[q], 2 * step)
    return period, first, last


def _touching(period: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fragments of a period that overlap or touch become one."""
    by = np.lexsort((last, first, period))
    period, first, last = period[by], first[by], last[by]
    if not len(by):
        return period, first, last
    fresh = np.ones(len(by), bool)
    lift = (np.cumsum(np.concatenate([[True], period[1:] != period[:-1]])) * (last.max() + 2)).astype(np.int64)
    reach = np.maximum.accumulate(last + lift)
    fresh[1:] = first[1:] + lift[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    return period[at], first[at], np.maximum.reduceat(last, at)


def _joined(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, of_row: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Each row's words with one space between, end to end, and where the rows begin."""
    gaps = ends[:-1][of_row[1:] == of_row[:-1]]
    depth = np.zeros(len(data) + 1, np.int8)
    depth[starts] += 1
    depth[ends] -= 1
    stays = np.cumsum(depth[:-1], dtype=np.int8).astype(bool)
    stays[gaps] = True
    flat = data.copy()
    flat[gaps] = 32
    return flat[stays].tobytes(), np.concatenate([[0], np.cumsum(stays)])[offsets]


def _structs(period, first, last) -> list[dict]:
    return [{"period": int(p), "first": int(a), "last": int(b)} for p, a, b in zip(period, first, last, strict=True)]


def _solve(batches):
    """For each row its words, its text if that is needed again, and its fragments or its tiles."""
    for batch in batches:
        out = {c: [] for c in ("uid", "n_words", "plain", "text", "fragments", "tiles")}
        texts = batch.column("text")
        for lo, hi, data, offsets in textkit.runs(batch):
            starts, ends, rows = textkit.words(data, offsets)
            hashed = textkit.word_hashes(data, starts, ends)
            ids = np.unique(hashed, return_inverse=True)[1].astype(np.int64) if len(hashed) else np.zeros(0, np.int64)
            sizes = np.diff(rows)
            small = sizes <= WHOLE
            # small texts end to end, each with a mark of its own after it
            lengths = np.where(small, sizes, 0) + 1
            base = np.cumsum(lengths) - lengths
            line = np.zeros(int(lengths.sum()), np.int64)
            line[base + lengths - 1] = len(ids) + 1 + np.arange(len(sizes))
            of_row = np.repeat(np.arange(len(sizes)), sizes)
            kept = small[of_row]
            line[(base[of_row] + np.arange(len(ids)) - rows[:-1][of_row])[kept]] = ids[kept]
            pre = textkit.prefix(textkit.mix(line.astype(U64)))
            largest = int(sizes[small].max()) if small.any() else 0
            found = [fragments(line, pre, p, step) for p, step in octaves(largest)]
            period, first, last = _touching(*(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3)))
            row = np.searchsorted(base, first, "right") - 1
            order = np.argsort(row, kind="stable")
            edges = np.searchsorted(row[order], np.arange(len(sizes) + 1))
            raw, joined, cuts = data.tobytes(), *_joined(data, offsets, starts, ends, of_row)
            for k in range(hi - lo):
                a, b = int(rows[k]), int(rows[k + 1])
                mine = order[edges[k] : edges[k + 1]]
                long = not small[k]
                again = long or len(mine) > 0
                text = texts[lo + k].as_py() or ""
                out["uid"].append(hashlib.blake2b(raw[offsets[k] : offsets[k + 1]], digest_size=16).digest() if again else None)
                out["n_words"].append(b - a)
                out["plain"].append(None if again else hashlib.sha256(joined[cuts[k] : cuts[k + 1]]).hexdigest())
                out["text"].append(text if again else None)
                out["fragments"].append(_structs(period[mine], first[mine] - base[k], last[mine] - base[k]))
                out["tiles"].append(_tiles(np.unique(hashed[a:b], return_inverse=True)[1]) if long else [])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(out["uid"], pa.binary()), pa.array(out["n_words"], pa.int64()), pa.array(out["plain"], pa.string()), pa.array(out["text"], pa.string()), pa.array(out["fragments"], _FRAGMENTS), pa.array(out["tiles"], _TILES)],
            ["doc_id", "uid", "n_words", "plain", "text", "fragments", "tiles"],
        )


_FRAGMENTS = pa.list_(pa.struct([("period", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]))
_TILES = pa.list_(pa.struct([("p", pa.int64()), ("top", pa.int64()), ("at", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("words", pa.binary())]))
TILES = "array<struct<p: long, top: long, at: long, low: long, high: long, words: binary>>"


def _tiles(ids: np.ndarray) -> list[dict]:
    """The tiles of a text: octaves up to an eighth of WHOLE share tiles, the others have their own."""
    out, n, words = [], len(ids), ids.astype(np.int32)
    scales = [p for p, _ in octaves(n)]
    shared = [p for p in scales if 8 * p <= WHOLE]
    for low, high in ([(shared[0], shared[-1])] if shared else []) + [(p, p) for p in scales if 8 * p > WHOLE]:
        step = max(high, STEP)
        inner = max(WHOLE, 4 * step)  # a multiple of every step of these octaves
        for b in range(0, n, inner):
            at = max(0, b - step)
            out.append({"p": low, "top": high, "at": at, "low": b - at, "high": min(n, b + inner) - at, "words": words[at : b + inner + 2 * step + 2 * high].tobytes()})
    return out


def _solve_tiles(batches):
    for batch in batches:
        rows = []
        for uid, tile in zip(batch.column("uid").to_pylist(), batch.column("tile").to_pylist(), strict=True):
            ids = np.frombuffer(tile["words"], np.int32).astype(np.int64)
            pre = textkit.prefix(textkit.mix(ids.astype(U64)))
            p, at = tile["p"], tile["at"]
            while p <= tile["top"]:
                # a tile begins at a multiple of its largest step, so that boundaries are the same in all
                found = fragments(ids, pre, p, max(p, STEP), tile["low"], tile["high"])
                for q, a, b in zip(*_touching(*found), strict=True):
                    rows.append((uid, int(q), int(a) + at, int(b) + at))
                p *= 2
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.int64()))], ["uid", "period", "first", "last"])


def _stitched(pieces: DataFrame) -> DataFrame:
    """(uid, start, length, period): runs from fragments, those of a document and period that touch being one stretch."""
    before = Window.partitionBy("uid", "period").orderBy("first", "last")
    reach = F.max("last").over(before.rowsBetween(Window.unboundedPreceding, -1))
    fresh = pieces.withColumn("fresh", F.when(F.col("first") > F.coalesce(reach, F.lit(-1)), 1).otherwise(0))
    stretch = fresh.withColumn("stretch", F.sum("fresh").over(before)).groupBy("uid", "period", "stretch").agg(F.min("first").alias("start"), F.max("last").alias("last"))
    length = F.col("last") - F.col("start") + F.col("period")
    runs = stretch.select("uid", "start", length.alias("length"), "period").filter((F.col("length") >= LEAST) & (F.col("length") >= TIMES * F.col("period")))
    return runs.groupBy("uid", "start", "length").agg(F.min("period").alias("period"))


def _collapse(batches):
    """Digests of the runs and of the words that stay, and the run of the greatest exponent."""
    for batch in batches:
        out = {c: [] for c in ("start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")}
        runs = batch.column("runs").to_pylist()
        for lo, hi, data, offsets in textkit.runs(batch):
            starts, ends, rows = textkit.words(data, offsets)
            raw = data.tobytes()
            for k in range(hi - lo):
                mine = sorted(((r["start"], r["length"], r["period"]) for r in runs[lo + k]), key=lambda r: (r[0], r[2]))
                stays = np.ones(rows[k + 1] - rows[k], bool)
                best = None
                for r in mine:
                    stays[r[0] + r[2] : r[0] + r[1]] = False
                    if best is None or r[1] * best[2] > best[1] * r[2]:
                        best = r  # of equal exponents the one that starts first, then the smaller period
                words = (raw[starts[w] : ends[w]] for w in rows[k] + np.flatnonzero(stays))
                for c, v in zip(("start", "length", "period", "exponent_milli"), (*best, 1000 * best[1] // best[2]) if best else (None,) * 4, strict=True):
                    out[c].append(v)
                out["runs_sha256"].append(hashlib.sha256("".join(f"{a},{b},{p}\n" for a, b, p in mine).encode()).hexdigest())
                out["collapsed_sha256"].append(hashlib.sha256(b" ".join(words)).hexdigest())
        n = pa.array([len(r) for r in runs], pa.int64())
        columns = [batch.column("doc_id"), batch.column("n_words"), n] + [pa.array(v, pa.int64() if k < 4 else pa.string()) for k, v in enumerate(out.values())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_runs", *out])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 for every row.

    A run is a stretch of words with smallest period q, of 24 words and 3 q at least, that
    can't be made longer; the four numbers are those of the run with the greatest exponent,
    null without a run. A word inside a run after its first q words is dropped from the
    collapsed text. A null or empty text has no words and no runs; repeated rows have a row
    each; a null doc_id stays null; further columns are ignored.
    """
    source = docs.select(F.col("doc_id").cast("long"), "text")
    solved = written(source.mapInArrow(_solve, f"doc_id long, uid binary, n_words long, plain string, text string, fragments {FRAGMENTS}, tiles {TILES}"))
    # equal texts have equal runs, so a text counts once
    whole = solved.filter(F.size("fragments") > 0).select("uid", F.explode("fragments").alias("f")).select("uid", "f.*").distinct()
    tiles = solved.filter(F.size("tiles") > 0).select("uid", F.explode("tiles").alias("tile")).repartition(F.xxhash64("uid", "tile.p", "tile.at"))
    long = tiles.mapInArrow(_solve_tiles, "uid binary, period long, first long, last long").distinct()
    runs = _stitched(whole.unionByName(long)).groupBy("uid").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))

    again = solved.filter("uid is not null").select("doc_id", "uid", "n_words", "text").join(runs, "uid", "left")
    again = again.select("doc_id", "n_words", "text", F.coalesce("runs", F.array()).alias("runs"))
    kinds = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    none = F.lit(None).cast("long")
    plain = solved.filter("uid is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_runs"), none.alias("start"), none.alias("length"), none.alias("period"), none.alias("exponent_milli"), F.sha2(F.lit(""), 256).alias("runs_sha256"), F.col("plain").alias("collapsed_sha256"))
    return plain.unionByName(again.mapInArrow(_collapse, kinds))


def with_periods(documents: DataFrame) -> DataFrame:
    """doc_id and text, one text in ten going on periodically from some word on, as crc32 of doc_id tells."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = documents.select("doc_id", "text", h.alias("h"), F.floor(h / 10).cast("long").alias("g"))
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.coalesce(F.size("w"), F.lit(0)))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.when(F.col("n") > 0, 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))))
    word = lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.transform("w", word), " ")).otherwise(F.col("text")).alias("text"))


def op11_octave_tiles(spark, sf_dir: str) -> DataFrame:
    return periodic_runs(with_periods(table(spark, sf_dir, "documents")))
