"""Every pair gets a negative while its anchor has one."""

from mapfold.operators import vectors


def test_pairs_with_few_free_rows(spark):
    pool = spark.range(100)
    pairs = {(1, p) for p in range(2, 97)} | {(3, p) for p in range(100) if p != 3} | {(5, 6), (200, 7)}
    got = vectors.triplets(spark.createDataFrame(sorted(pairs), "anchor long, positive long"), pool).collect()
    assert len(got) == len(pairs) and {(r.anchor, r.positive) for r in got} == pairs
    free = {a: set(range(100)) - {p for b, p in pairs if b == a} - {a} for a in (1, 3, 5, 200)}
    assert all(r.negative in free[r.anchor] if free[r.anchor] else r.negative is None for r in got)
    assert {r.negative for r in got if r.anchor == 1} == free[1]


def test_empty_pool(spark):
    pairs = spark.createDataFrame([(1, 2)], "anchor long, positive long")
    assert [tuple(r) for r in vectors.triplets(pairs, spark.range(0)).collect()] == [(1, 2, None)]
