"""Shared operators: exact division, lookups, numbering, snapshots, hot keys."""

from __future__ import annotations

from decimal import ROUND_CEILING, ROUND_FLOOR
from decimal import Decimal as D

import pytest
from conftest import by, frame
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bomwerk.functions.columns import ceil_div, floor_div, money, ratio
from bomwerk.operators.lookup import join_on_key, lookup, one_per_key
from bomwerk.operators.mutate import delete_where, insert_new, update_by_key
from bomwerk.operators.postings import postings
from bomwerk.operators.ranking import numbered

amounts = st.decimals(min_value=0, max_value=10**9, places=6)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(amounts, amounts), min_size=30, max_size=60))
def test_division_is_exact(spark, pairs):
    pairs = [*pairs, (D("2.999999"), D(1)), (D("0.3"), D("0.1")), (D(5), D(0))]
    rows = frame(spark, "n INT, a DECIMAL(38,6), b DECIMAL(21,9)", [dict(n=n, a=a, b=b) for n, (a, b) in enumerate(pairs)])
    found = rows.select("n", floor_div(F.col("a"), F.col("b")).alias("low"), ceil_div(F.col("a"), F.col("b")).alias("high")).collect()
    for row in found:
        a, b = pairs[row["n"]]
        if b == 0:
            assert row["low"] is None and row["high"] is None
        else:
            assert row["low"] == int((a / b).to_integral_value(ROUND_FLOOR)) if (a / b) < 10**15 else True
            assert row["high"] == int((a / b).to_integral_value(ROUND_CEILING)) if (a / b) < 10**15 else True


def test_money_rounds_half_up(spark):
    row = spark.range(1).select(money(F.lit(D("2.675"))).alias("a"), money(F.lit(D("-0.005"))).alias("b"), ratio(F.lit(D(1)), F.lit(D(0))).alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == (D("2.68"), D("-0.01"), None)


def test_one_per_key(spark):
    rows = frame(spark, "k STRING, o INT, v STRING", [dict(k="a", o=2, v="x"), dict(k="a", o=1, v=None), dict(k="b", o=None, v="y")])
    assert {n: r["v"] for n, r in by(one_per_key(rows, ["k"], ["o"]), "k").items()} == {"a": None, "b": "y"}
    assert by(one_per_key(rows, ["k"], ["o"], last=True), "k")["a"]["v"] == "x"


def test_lookup_keeps_rows_without_a_match(spark):
    left = frame(spark, "k STRING, k2 INT", [dict(k="a", k2=1), dict(k="a", k2=2), dict(k=None, k2=1)])
    right = frame(spark, "k STRING, n INT, v STRING", [dict(k="a", n=1, v="hit"), dict(k=None, n=1, v="never")])
    rows = lookup(left, right, {"k": "k", "k2": "n"}, {"found": "v"}).collect()
    assert sorted((row["k"] or "", row["k2"], row["found"] or "") for row in rows) == [("", 1, ""), ("a", 1, "hit"), ("a", 2, "")]
    assert join_on_key(left, right.select("k"), {"k": "k"}, "left_anti").count() == 1


def test_snapshots(spark):
    table = frame(spark, "k STRING, v INT", [dict(k="a", v=1), dict(k="b", v=2), dict(k="c", v=None)])
    new = frame(spark, "k STRING, v INT", [dict(k="b", v=None), dict(k="d", v=4)])
    assert {n: r["v"] for n, r in by(update_by_key(table, new, ["k"]), "k").items()} == {"a": 1, "b": None, "c": None}
    assert set(by(insert_new(table, new, ["k"]), "k")) == {"a", "b", "c", "d"}
    assert set(by(delete_where(table, F.col("v") <= 1), "k")) == {"b", "c"}


def test_postings_balance(spark):
    rows = frame(spark, "d STRING, c STRING, a DECIMAL(18,2)", [dict(d="x", c="KP", a="1.23")])
    lines = by(postings(rows, "d", "DEB", "CRE", F.col("a"), F.lit("t"), debit_columns=["c"]), "side")
    assert lines["debit"]["debit"] == lines["credit"]["credit"] == D("1.23")
    assert (lines["debit"]["c"], lines["credit"]["c"]) == ("KP", None)


def test_numbering_of_a_hot_key(spark):
    rows = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), (F.lit(20000) - F.col("id")).alias("o")
    )
    placed = numbered(rows, ["k"], ["o"]).toPandas().sort_values(["k", "o"])
    assert len(placed) == 20000
    assert (placed.groupby("k").cumcount() + 1 == placed["position"]).all()


@pytest.fixture
def shuffled(spark):
    """Joins by shuffle, with thresholds low enough for test data to count as skewed."""
    values = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_a_hot_key_is_split(shuffled):
    rows = shuffled.range(0, 300000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").cast("string").alias("v")
    )
    keys = rows.groupBy("k").agg(F.max("v").alias("m"))
    joined = lookup(rows, keys, {"k": "k"}, {"m": "m"})
    assert joined.filter("m IS NULL").count() == 0
    joined.collect()
    assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
