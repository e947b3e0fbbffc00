"""The join by the ratio of common subsequences against all pairs."""

from __future__ import annotations

import random

import pytest

from mapfold.operators import ratio_join as J


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j] + (x == y), row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_every_pair_over_the_threshold(spark, threshold, monkeypatch):
    r = random.Random(threshold)
    base = ["".join(r.choice("abcdeé ") for _ in range(r.choice([1, 2, 3, 4, 6, 9, 14, 25, 40]))) for _ in range(40)]
    edit = lambda t: "".join(c for c in t if r.random() > 0.15) + r.choice(["", "x", "yz"])
    left = base + [edit(t) for t in base] + ["Qaf", None, "", "the unit", "the unit"]
    right = [edit(t) for t in base] + base[:10] + ["Qaf gravel", "unit the", None, ""]
    frames = [spark.createDataFrame([(t, 1, 2.0) for t in side], "text string, n int, ratio double") for side in (left, right)]
    got = {(x.a, x.b): round(x.ratio, 9) for x in J.ratio_join(*frames, threshold).collect()}
    ratio = lambda a, b: 2 * common(a, b) / (len(a) + len(b))
    assert got == {(a, b): round(ratio(a, b), 9) for a in set(left) if a for b in set(right) if b and ratio(a, b) >= threshold}


def test_a_frequent_word_alone_makes_no_pair(spark, monkeypatch):
    """Texts that share only what all have are not verified."""
    import string

    r = random.Random(1)
    tail = lambda: "".join(r.choice(string.ascii_letters) for _ in range(14))
    left, right = ([("formation " + tail(),) for _ in range(60)] for _ in range(2))
    seen = []
    real = J._pairs
    monkeypatch.setattr(J, "_pairs", lambda *a: seen.append(found := real(*a)) or found)
    frames = [spark.createDataFrame(side, "text string") for side in (left, right)]
    assert J.ratio_join(*frames, 0.9).count() == 0
    assert sum(f.count() for f in seen) < 360  # of 3,600


def test_best_matches(spark):
    left = spark.createDataFrame([("alluvium",), ("zzz",), (None,), ("gravels",)], "text string")
    right = spark.createDataFrame([("gravel",), ("old alluvium",), ("alluviums",), ("alluvium s",)], "text string")
    assert {x.text: x.match for x in J.best_matches(left, right).collect()} == {"alluvium": "alluviums", "zzz": "zzz", "gravels": "gravel"}
    assert J.ratio_join(left.filter("false"), right, 0.5).count() == 0
