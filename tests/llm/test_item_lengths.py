"""Benchmark items of every small length against brute force."""

import random

import numpy as np

from mapfold.llm import decontaminate
from tests.llm import brute


def edited(r: random.Random, item: str, places: list[int]) -> str:
    out = list(item)
    for at in sorted(places, reverse=True):
        out[at : at + 1] = r.choice((["#"], [], ["#", item[at]]))
    return "".join(out)


def test_items_of_1_to_40_bytes():
    r = random.Random(7)
    word = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    items = [word(n) for n in range(1, 41)]
    docs = ["", "zz", *(word(50) for _ in range(4))]
    for item in items:
        n, k = len(item), len(item) // decontaminate.BYTES_PER_EDIT
        docs += ["zz" + item + "zz", item]
        if k:
            cuts = [n * j // (k + 1) for j in range(k + 2)]
            for whole in range(k + 1):  # all pieces but one are spoilt, at either end
                for end in (0, -1):
                    docs.append("zz" + edited(r, item, [cuts[j] if not end else cuts[j + 1] - 1 for j in range(k + 1) if j != whole]) + "zz")
    raw = [d.encode() for d in docs]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    found = decontaminate.Items(list(range(len(items))), [x.encode() for x in items]).matches(data, offsets)
    want = {}
    for d, text in enumerate(docs):
        for i, item in enumerate(items):
            k = brute.edit_anywhere(item, text)
            if k <= len(item) // decontaminate.BYTES_PER_EDIT:
                want[d, i] = k
    assert {(d, i): k for d, i, k, _ in found} == want and len(found) == len(want)
