"""Bars of nations and regions come from one pass over the trades, and are those that single trades give."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from quantloom.plans.catalog import QUERIES, register
from quantloom.sources import bars as src


@pytest.fixture
def tables(spark, tmp_path):
    """Orders with several lines a day, lines with one key, lines without an order, a day or a key."""
    draw = random.Random(7)
    day = lambda: None if draw.random() < 0.05 else dt.datetime(2024, 1, draw.randint(1, 14), draw.randint(0, 23))
    lines = [(draw.choice([None, *range(60)]), draw.randint(1, 3), draw.randint(1, 3), draw.randint(1, 3), float(draw.randint(1, 9)), draw.randint(100, 999) / 4, day()) for _ in range(1500)]
    made = {
        "lineitem": (lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp"),
        "orders": ([(i, draw.randint(1, 12)) for i in range(50)], "o_orderkey long, o_custkey long"), "customer": ([(i, i % 5) for i in range(1, 11)], "c_custkey long, c_nationkey int"),
        "nation": ([(i, f"N{i}", i % 2) for i in range(4)], "n_nationkey int, n_name string, n_regionkey int"), "region": ([(i, f"R{i}") for i in range(2)], "r_regionkey int, r_name string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("scope", ["n_name", "r_name"])
def test_bars_are_those_of_single_trades(spark, tables, scope):
    t = lambda n: src.table(spark, tables, n)
    rows = t("lineitem").join(t("orders"), F.expr("l_orderkey = o_orderkey")).join(t("customer"), F.expr("o_custkey = c_custkey")).join(t("nation"), F.expr("c_nationkey = n_nationkey")).join(t("region"), F.expr("n_regionkey = r_regionkey"))
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    want = rows.groupBy(F.col(scope).alias("symbol"), F.to_date("l_shipdate").alias("dt")).agg(F.min(key)["price"], F.max(key["price"]), F.min(key["price"]), F.max(key)["price"], F.sum("l_quantity"), F.sum("l_extendedprice"))
    got = src.bars(spark, tables, scope, weekdays=False).drop("turn")
    assert sorted(map(str, got.collect())) and sorted((tuple(r) for r in got.collect()), key=str) == sorted((tuple(r) for r in want.collect()), key=str)


def test_one_pass_for_a_query(spark, tables, monkeypatch):
    passes = []
    made = src.nation_days
    monkeypatch.setattr(src, "nation_days", lambda *a: passes.append(1) or made(*a))
    register("_test_passes")(lambda spark, sf: src.bars(spark, sf).unionByName(src.bars(spark, sf, "r_name", weekdays=False)))
    try:
        assert QUERIES["_test_passes"](spark, tables).count() > 0 and len(passes) == 1
        QUERIES["_test_passes"](spark, tables)
        assert len(passes) == 2  # each call reads the tables as they are then
    finally:
        del QUERIES["_test_passes"]
