"""Phrases of any length by automata, against trying every phrase at every place."""

from __future__ import annotations

import random

from mapfold.operators import matching as M
from mapfold.operators import phrases as P


def longest(words, phrases):
    """place -> words of the longest phrase that starts there."""
    known = {tuple(p.split(" ")) for p in phrases}
    out = {}
    for i in range(len(words)):
        for n in range(1, len(words) - i + 1):
            if tuple(words[i : i + n]) in known:
                out[i] = n
    return out


def greedy(words, phrases):
    found, free, out = longest(words, phrases), 0, []
    for i in sorted(found):
        if i >= free:
            out.append((i, found[i], " ".join(words[i : i + found[i]])))
            free = i + found[i]
    return out


def test_automaton_against_every_place():
    r = random.Random(4)
    for letters in (1, 2, 4):
        for _ in range(150):
            draw = lambda n: [r.choice("abcd"[:letters]) for _ in range(n)]  # noqa: E731, B023
            phrases = [" ".join(draw(r.randint(1, r.choice([2, 6, 30])))) for _ in range(r.randint(0, 12))]
            words = draw(r.randint(0, 60)) + r.choice([[], ["else"]]) + draw(r.randint(0, 40))
            assert P.Automaton(phrases).reader()(words) == longest(words, phrases)


def test_phrases_of_1_to_30_words_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 300)
    monkeypatch.setattr(P, "AT_ONCE", 2)
    r = random.Random(9)
    vocabulary = [f"w{k}" for k in range(12)]
    texts = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 80)))) for k in range(40)] + [(100, None), (101, ""), (102, "...")]
    texts.append((103, " ".join(f"W{k}," for k in range(9)) + " tail"))
    phrases = [" ".join(t.split(" ")[a : a + n]) for _, t in texts[:40] for n in (1 + r.randrange(30),) for a in (r.randrange(5),) if t] + ["w0 w1 w2 w3 w4 w5 w6", None, ""]
    got: dict[int, list] = {}
    found = M.find_phrases(spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame([(p, 1) for p in phrases + phrases[:5]], "phrase string, pos int"))
    for x in found.collect():
        got.setdefault(x.text_id, []).append((x.pos, x.n, x.phrase))
    want = {k: greedy([w for w in (t or "").lower().replace(",", " ").replace(".", " ").split() if w], [p for p in phrases if p]) for k, t in texts}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert (0, 7, "w0 w1 w2 w3 w4 w5 w6") in got[103]


def test_a_last_word_that_begins_a_phrase(spark):
    texts = spark.createDataFrame([(1, "north sweet"), (2, "sweet water"), (3, "sweet"), (4, "water sweet sweet water")], "text_id int, text string")
    phrases = spark.createDataFrame([("Sweet Water Creek",), ("sweet water",)], "phrase string")
    got = sorted((x.text_id, x.pos, x.phrase) for x in M.find_phrases(texts, phrases, ref_last_word=True).collect())
    assert got == [(1, 1, "sweet"), (2, 0, "sweet water"), (3, 0, "sweet"), (4, 2, "sweet water")]
    assert M.find_phrases(texts, phrases.filter("false")).count() == 0
