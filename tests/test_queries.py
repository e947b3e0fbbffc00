"""Registered queries against their SQL on small tables, and the entry point."""

import datetime
import decimal
import random

import duckdb
import pytest

import __spark_entry__ as entry
from mapfold.plans import registry

R = random.Random(11)


def tables():
    word = lambda: R.choice(("small", "red", "blue", "old", "ring", "widget", "bolt", "the", "of"))
    day = datetime.datetime(2000, 1, 1)
    return {
        "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", [(k, f"{word()} {word()}", f"Brand#{k % 25}", R.choice(("ECONOMY", "STANDARD BRASS")), R.randrange(1, 51), 900.0) for k in range(300)]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey int", [(k, f"S{k}", k % 25) for k in range(20)]),
        "customer": ("c_custkey long, c_name string, c_nationkey int", [(k, f"C{k}", k % 25) for k in range(60)]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(k, f"NATION_{k}", k % 5) for k in range(25)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double", [(k, R.randrange(60), f"{k % 5}-P", k * 1.5) for k in range(1500)]),
        "lineitem": (
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string",
            [(R.randrange(1500), R.randrange(300), R.randrange(20), R.randrange(1, 8), float(R.randrange(1, 51)), R.choice("ANR")) for _ in range(4000)],
        ),
        "events": ("event_id long, ts timestamp, user_id long, event_type string, value double, props string", [(k, day, R.randrange(90), "click", 1.0, '{"k": 1}') for k in range(400)]),
        "documents": ("doc_id long, text string, lang string, source string, n_chars long", [(k, " ".join(word() for _ in range(60)), "en", f"src{k % 4}", R.randrange(100, 900)) for k in range(200)]),
        "labels": ("doc_id long, quality int, toxic int", [(k, k % 3 // 2, 0) for k in range(0, 200, 2)]),
        "benchmark": ("item_id long, text string", [(k, " ".join(R.choice(("the", "ofe", "bolts", "widgit", "rng", "of")) for _ in range(12))) for k in range(20)]),
        "conversations": ("conv_id long, turn long, role string, text string", [(k // 4, k % 4, R.choice(("user", "assistant")), f"text {k}") for k in range(60)]),
        "embeddings": ("vec_id long, embedding array<float>, label int", [(k, [R.gauss(0, 1) for _ in range(8)], k % 7) for k in range(200)]),
    }


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    for name, (schema, rows) in tables().items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(at / f"{name}.parquet"))
    return str(at)


@pytest.fixture(scope="module")
def sql(folder):
    con = duckdb.connect()
    for name in tables():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.5f}"
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, folder, sql, name):
    df = registry.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in registry.ORACLE:
        want = sql.sql(registry.ORACLE[name])
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert got == sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall())


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())
