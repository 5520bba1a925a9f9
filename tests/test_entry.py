"""The driver's contract, as far as it can be told without its tables."""

import importlib.util
from pathlib import Path

import pytest

import __spark_entry__ as entry

TABLES = Path("/root/testdata/sf0.001")


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 60


def test_training_data_queries_come_and_go_with_their_subpackage():
    there = bool(importlib.util.find_spec("diffspark.llm") and importlib.util.find_spec("diffspark.llm.queries"))
    assert any(name.startswith("op1_") for name in entry.queries()) == there


@pytest.mark.skipif(not TABLES.exists(), reason="needs the driver's tables")
def test_flagship_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{TABLES}/{name}.parquet'")
    got = {(r["node"], r["cnt"], r["deg"], r["score"]) for r in entry.entry(spark).collect()}
    want = con.execute(f"SELECT node, cnt, deg, score FROM ({entry.oracle_sql()['reach_blocker']})").fetchall()
    assert got == set(want) and len(got) == 10


@pytest.mark.skipif(not TABLES.exists(), reason="needs the driver's tables")
def test_contact_graph_has_every_order_line(spark):
    from diffspark.sources import graphs

    read = lambda name: spark.read.parquet(str(TABLES / f"{name}.parquet"))
    orders = {r["o_orderkey"]: r["o_custkey"] for r in read("orders").collect()}
    pairs = {(orders[r["l_orderkey"]] * 2, r["l_suppkey"] * 2 + 1) for r in read("lineitem").collect() if r["l_orderkey"] in orders}
    assert {(r["src"], r["dst"]) for r in graphs.contact_graph(spark, str(TABLES)).collect()} == pairs | {(b, a) for a, b in pairs}
