"""A hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(class | history) * P(place | class, history), and for words without a
place of their own the smoothed share of the word among the rest of its class. Words have a
class each: the most frequent ones and the end of a text one of their own, all others one
by a hash of their last two bytes. The most frequent words of each class have places in it,
one more place is for its other words. Both softmaxes add up weights of hashed features:
the word before, the word before that (a skip), for classes also the pair of their classes.
The number of hashed rows grows with the cube root of the training tokens.

Training takes synchronous rounds. The texts are dealt to rounds by a hash of the document;
in each round all tasks sum, over their texts and under the same weights, how often each
feature saw each class and how often the model expected it. The gradient, observed less
expected, is scaled by the expectation and the number of features that add up, and one
step is taken. Sums do not depend on how the texts lie in partitions, nor do the weights.

Word counts cover all training texts. Words with at least a 2**-20th of all tokens, which
are a million at most, are broadcast; the counts of the rarer ones meet their occurrences
in a join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapfold.llm import textkit
from mapfold.session import table, written

U64 = np.uint64
OWN, BY_ENDING = 16, 16  #: classes of one word each (the last is the end of a text) and of many
CLASSES = OWN + BY_ENDING
PLACES = 16  #: of a class of many words: its most frequent words, the last is for all others
ROUNDS = 4
RATE, MOST, PRIOR = 1.2, 3.0, 2.0  #: of a step; its bound; expected occurrences that weigh against it
NEVER = -60.0  #: weight of what has no word
BLOCK = 64  #: rows of weights that travel together
END, START = U64(0xE0D), U64(0x57A7)  #: stand for the end and the start of a text
HEAD_SHARE = 1 << 20
BATCH = 1 << 15  #: tokens of a softmax at once


@dataclass
class Tokens:
    """The tokens of a run of rows, the end of each text included."""

    hash: np.ndarray
    ending: np.ndarray  #: class by ending; the end of a text has its own class from the start
    row: np.ndarray
    n: np.ndarray  #: tokens by row


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    data = textkit.LOWER[data]
    starts, ends, first = textkit.words(data, offsets)
    hashes = textkit.word_hashes(data, starts, ends)
    tail = data[ends - 1].astype(U64) * U64(257) + data[np.maximum(ends - 2, starts)] if len(ends) else np.zeros(0, U64)
    ending = (textkit.mix(tail) % U64(BY_ENDING)).astype(np.int16) + OWN
    at = first[1:]  # an end goes behind the words of its row
    n = np.diff(first) + 1
    return Tokens(np.insert(hashes, at, END), np.insert(ending, at, OWN - 1), np.repeat(np.arange(len(n)), n), n)


def _count(batches):
    for batch in batches:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _, _, data, offsets in textkit.runs(batch, limit=8 << 20):
            t = tokens_of(data, offsets)
            h, at, c = np.unique(t.hash, return_index=True, return_counts=True)
            found.append((h, t.ending[at], c))
        for h, e, c in found:
            yield pa.RecordBatch.from_arrays([textkit.as_i64(h), pa.array(e.astype(np.int32)), pa.array(c.astype(np.int64))], ["h", "ending", "c"])


@dataclass
class Vocabulary:
    """Broadcast: the frequent words, at most HEAD_SHARE of them."""

    hash: np.ndarray  #: sorted
    count: np.ndarray
    cls: np.ndarray
    place: np.ndarray  #: of the word in its class
    total: int  #: N
    distinct: int  #: V
    class_tokens: np.ndarray
    place_tokens: np.ndarray  #: by class of many words and place
    rest_size: np.ndarray  #: by class: tokens + words without a place, and one for all unknown words

    @property
    def features(self) -> int:
        """Hashed rows for the word before, and as many for the one before that."""
        return 64 + 16 * round(max(self.total, 1) ** (1 / 3))

    def look_up(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(counts of frequent words and 0, classes, places)."""
        if not len(self.hash):
            return np.zeros(len(t.hash), np.int64), t.ending, np.full(len(t.hash), PLACES - 1, np.int16)
        at = np.minimum(np.searchsorted(self.hash, t.hash), len(self.hash) - 1)
        known = self.hash[at] == t.hash
        return np.where(known, self.count[at], 0), np.where(known, self.cls[at], t.ending), np.where(known, self.place[at], PLACES - 1)


@dataclass
class Weights:
    classes: np.ndarray  #: (rows, CLASSES)
    places: np.ndarray  #: (rows, PLACES)


def first_weights(v: Vocabulary) -> Weights:
    """The shares of classes and places as biases, nothing else; classes and places without a word get next to none."""
    n = v.features
    w = Weights(np.zeros((2 * n + (CLASSES + 1) ** 2 + 1, CLASSES), np.float32), np.zeros((2 * n + BY_ENDING, PLACES), np.float32))
    w.classes[-1] = np.log((v.class_tokens + 1) / (v.class_tokens.sum() + CLASSES))
    w.classes[-1, : OWN - 1][v.class_tokens[: OWN - 1] == 0] = NEVER
    w.places[2 * n :] = np.log((v.place_tokens + 1) / (v.place_tokens.sum(1, keepdims=True) + PLACES))
    w.places[2 * n :, :-1][v.place_tokens[:, :-1] == 0] = NEVER
    return w


def histories(t: Tokens, cls: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of weights that add up for each token: those of its class, those of its place (with the class in the hash).

    The bias row comes last. Rows of places of tokens in a class of their own have no meaning.
    """
    first = np.zeros(len(t.hash), bool)
    first[np.cumsum(t.n)[:-1]] = True
    first[:1] = True
    one, two = np.empty_like(t.hash), np.empty_like(t.hash)
    one[1:], one[first] = t.hash[:-1], START
    two[1:], two[first] = one[:-1], START
    c1, c2 = np.empty(len(cls), np.int64), np.empty(len(cls), np.int64)
    c1[1:], c1[first] = cls[:-1], CLASSES
    c2[1:], c2[first] = c1[:-1], CLASSES
    fold = lambda h: ((h >> U64(32)) % U64(n)).astype(np.int64)
    by_class = np.empty((4, len(cls)), np.int64)
    by_class[0] = fold(one)
    by_class[1] = n + fold(two)
    by_class[2] = 2 * n + c1 * (CLASSES + 1) + c2
    by_class[3] = 2 * n + (CLASSES + 1) ** 2
    salt = cls.astype(U64) * U64(0x9E3779B97F4A7C15)
    by_place = np.empty((3, len(cls)), np.int64)
    by_place[0] = fold(textkit.mix(one ^ salt))
    by_place[1] = n + fold(textkit.mix(two + salt))
    by_place[2] = 2 * n + np.maximum(cls.astype(np.int64) - OWN, 0)
    return by_class, by_place


def softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = weights.take(rows[0], 0)
    for r in rows[1:-1]:
        z += weights.take(r, 0)
    bias = rows[-1]
    z += weights[bias[0]] if (bias == bias[0]).all() else weights.take(bias, 0)
    np.exp(z - z.max(1, keepdims=True), out=z)
    z /= z.sum(1, keepdims=True)
    return z


def _sums(expected: np.ndarray, observed: np.ndarray, p: np.ndarray, rows: np.ndarray, label: np.ndarray) -> None:
    """Adds what a batch expects and observes at each of its rows; the bias row needs none."""
    width, by_label = p.shape[1], np.ascontiguousarray(p.T, np.float64)
    place = np.empty(len(expected), np.int64)
    for r in rows[:-1]:
        used = np.flatnonzero(np.bincount(r, minlength=len(expected)))
        place[used] = np.arange(len(used))
        local = place[r]
        expected[used] += np.stack([np.bincount(local, x, len(used)) for x in by_label], 1)
        np.add.at(observed.reshape(-1), r * width + label, 1.0)


def _gather(vocabulary, weights):
    """Sums of a task, in blocks of rows: (kind, block, expected and observed as bytes)."""

    def run(batches):
        w, v = weights.value, vocabulary.value
        sums = [(np.zeros(x.shape), np.zeros(x.shape)) for x in (w.classes, w.places)]
        for batch in batches:
            for _, _, data, offsets in textkit.runs(batch):
                t = tokens_of(data, offsets)
                _, cls, place = v.look_up(t)
                by_class, by_place = histories(t, cls, v.features)
                for at in range(0, len(cls), BATCH):
                    part = slice(at, at + BATCH)
                    _sums(*sums[0], softmax(w.classes, by_class[:, part]), by_class[:, part], cls[part])
                many = np.flatnonzero(cls >= OWN)
                for at in range(0, len(many), BATCH):
                    part = many[at : at + BATCH]
                    _sums(*sums[1], softmax(w.places, by_place[:, part]), by_place[:, part], place[part])
        kind, block, raw = [], [], []
        for k, (expected, observed) in enumerate(sums):
            for b in range(0, len(expected), BLOCK):
                if observed[b : b + BLOCK].any():
                    kind.append(k)
                    block.append(b)
                    raw.append(expected[b : b + BLOCK].tobytes() + observed[b : b + BLOCK].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(block, pa.int32()), pa.array(raw, pa.binary())], ["kind", "block", "sums"])

    return run


def step(expected: np.ndarray, observed: np.ndarray, features: int) -> np.ndarray:
    """What the weights move by: the gradient over what was expected, shared by the features that add up."""
    return RATE / features * np.clip((observed - expected) / (expected + PRIOR), -MOST, MOST)


def _move(batches):
    """Steps of each block over tasks; blocks come sorted."""
    held, total = None, None

    def done():
        expected, observed = total.reshape(2, -1)
        return pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int32()), pa.array([held[1]], pa.int32()), pa.array([step(expected, observed, (3, 2)[held[0]]).tobytes()], pa.binary())], ["kind", "block", "step"])

    for batch in batches:
        for kind, block, raw in zip(*(batch.column(c).to_pylist() for c in ("kind", "block", "sums")), strict=True):
            if (kind, block) != held:
                if held is not None:
                    yield done()
                held, total = (kind, block), 0.0
            total = total + np.frombuffer(raw)
    if held is not None:
        yield done()


_SCORED = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, model double, h long, m long"


def model_logs(t: Tokens, v: Vocabulary, w: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count or 0, log10 probability but for the count of a word without a place, has no place) of each token."""
    count, cls, place = v.look_up(t)
    by_class, by_place = histories(t, cls, v.features)
    logp = np.empty(len(cls))
    for at in range(0, len(cls), BATCH):
        c = cls[at : at + BATCH]
        logp[at : at + BATCH] = np.log(softmax(w.classes, by_class[:, at : at + BATCH])[np.arange(len(c)), c])
    many = np.flatnonzero(cls >= OWN)
    for at in range(0, len(many), BATCH):
        part = many[at : at + BATCH]
        logp[part] += np.log(softmax(w.places, by_place[:, part])[np.arange(len(part)), place[part]])
    logp /= np.log(10)
    rest = (cls >= OWN) & (place == PLACES - 1)
    logp[rest] += (np.log10(count + 1.0) - np.log10(v.rest_size)[cls])[rest]
    return count, logp, rest


def _score(vocabulary, weights):
    """A row for each text, and one for each rare word of a text with h and its occurrences m."""

    def run(batches):
        v, w = vocabulary.value, weights.value
        for batch in batches:
            key, doc_id, held = (batch.column(c) for c in ("key", "doc_id", "held_out"))
            keys = key.to_numpy()
            for lo, hi, data, offsets in textkit.runs(batch):
                t = tokens_of(data, offsets)
                count, logp, _ = model_logs(t, v, w)
                by_row = lambda x, t=t: np.bincount(t.row, x, len(t.n))
                n = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [key[lo:hi], doc_id[lo:hi], held[lo:hi], pa.array(t.n.astype(np.int64)), pa.array(by_row(count > 0).astype(np.int64)), pa.array(by_row(np.log10(count + 1.0))), pa.array(by_row(logp)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())],
                    _NAMES,
                )
                rare = np.flatnonzero(count == 0)
                order = rare[np.lexsort((t.hash[rare], t.row[rare]))]
                new = np.flatnonzero(np.concatenate([[True], (t.hash[order[1:]] != t.hash[order[:-1]]) | (t.row[order[1:]] != t.row[order[:-1]])]) if len(order) else order)
                m = len(new)
                none = [pa.nulls(m, x) for x in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(keys[lo + t.row[order[new]]]), *none, textkit.as_i64(t.hash[order[new]]), pa.array(np.diff(np.append(new, len(order))))], _NAMES)

    return run


_NAMES = [x.split()[0] for x in _SCORED.split(", ")]


def vocabulary_of(counts: DataFrame) -> Vocabulary:
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n = total.n or 0
    head = counts.filter(F.col("c") * HEAD_SHARE >= n).select("h", "ending", "c").toArrow()
    h, c, ending = (head.column(x).to_numpy() for x in ("h", "c", "ending"))
    h = h.astype(np.int64).view(U64)
    order = np.argsort(h)
    h, c, cls = h[order], c[order].astype(np.int64), ending[order].astype(np.int64)
    place = np.full(len(h), PLACES - 1, np.int16)
    tokens, words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy("ending").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():  # a row for each class
        tokens[r.ending] += r.n
        words[r.ending] += r.v
    falling = np.lexsort((h, -c))
    for own, i in enumerate([i for i in falling if h[i] != END][: OWN - 1]):
        for counted, k in ((tokens, c[i]), (words, 1)):
            counted[cls[i]] -= k
            counted[own] += k
        cls[i] = own
    place_tokens = np.zeros((BY_ENDING, PLACES))
    rest_tokens, rest_words = tokens.copy(), words.copy()
    for k in range(OWN, CLASSES):
        top = falling[cls[falling] == k][: PLACES - 1]
        place[top] = np.arange(len(top))
        place_tokens[k - OWN, : len(top)] = c[top]
        rest_tokens[k] -= c[top].sum()
        rest_words[k] -= len(top)
        place_tokens[k - OWN, -1] = rest_tokens[k]
    return Vocabulary(h, c, cls.astype(np.int16), place, n, total.v, tokens, place_tokens, rest_tokens + rest_words + 1)


def fit(train: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Weights:
    """Weights after one step for each round, over the texts that a hash of (key, text) deals to it."""
    spark = train.sparkSession
    weights, shared = first_weights(vocabulary), spark.sparkContext.broadcast(vocabulary)
    for n in range(rounds):
        part = train.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(rounds)) == n).select("text")
        now = spark.sparkContext.broadcast(weights)
        sums = part.mapInArrow(_gather(shared, now), "kind int, block int, sums binary")
        moves = sums.repartition("kind", "block").sortWithinPartitions("kind", "block").mapInArrow(_move, "kind int, block int, step binary").toArrow()  # as large as the weights
        weights = Weights(weights.classes.copy(), weights.places.copy())
        for kind, block, raw in zip(*(moves.column(c).to_pylist() for c in ("kind", "block", "step")), strict=True):
            w = (weights.classes, weights.places)[kind][block : block + BLOCK]
            w += np.frombuffer(raw).reshape(w.shape).astype(np.float32)
        now.unpersist()
    return weights


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Texts whose crc32(doc_id) mod 7 is 2 are held out and scored only. A null or empty text
    is its end alone; a null doc_id hashes as no characters; repeated rows are counted and
    scored each; without training texts every word is unknown and has the log of 1/1 as its
    base. Columns other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2).alias("held_out")
    source = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long"), held, "text")
    train = source.filter("NOT held_out").select("doc_id", "text")
    counts = written(train.select("text").mapInArrow(_count, "h long, ending int, c long").groupBy("h", "ending").agg(F.sum("c").alias("c")))
    vocabulary = vocabulary_of(counts)
    weights = fit(train, vocabulary, rounds)
    shared = spark.sparkContext.broadcast(vocabulary), spark.sparkContext.broadcast(weights)
    scored = written(source.mapInArrow(_score(*shared), _SCORED))
    rare = scored.filter("h IS NOT NULL").select("key", "h", "m").join(counts.select("h", "c"), "h")
    # rare words are never among the places: their counts are part of both scores
    rare = rare.groupBy("key").agg(F.sum("m").alias("more_known"), F.sum(F.col("m") * F.log10(F.col("c") + 1)).alias("more_logs"))
    out = scored.filter("h IS NULL").drop("h", "m").join(rare, "key", "left")
    more = F.coalesce("more_logs", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * F.log10(F.lit(float(vocabulary.total + vocabulary.distinct + 1)))).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )


def op5_maxent_model(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
