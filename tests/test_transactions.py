"""Stock transactions in batch and as a stream."""

from __future__ import annotations

from decimal import Decimal as D

import pytest
from conftest import by
from pyspark.sql import functions as F
from test_planning import item, unit

from bomwerk.plans import transactions
from bomwerk.streaming.transactions import read_transactions, start_transactions, txn_stream


@pytest.fixture
def scans(make):
    def scan(name, kind, article, quantity, uom="Stuks"):
        return dict(name=name, creation="2024-01-01 00:00:00", transactie_type=kind, artikel=article, unit=uom, qty=quantity)

    return make(
        item=[item("A", warehouse="W1"), item("S", is_stock_item=0), item("N", warehouse="W9")],
        bin=[
            dict(item_code="A", warehouse="W1", actual_qty=12, valuation_rate="1.005"), dict(item_code="A", warehouse="W2", actual_qty=99, valuation_rate=1),
            dict(item_code="S", warehouse="WH", actual_qty=9, valuation_rate=1),
        ],
        uom_conversion_detail=[unit("A"), unit("A", "Doos", 6, 2)] + [unit("U", f"u{n:02}", 1, 30 - n) for n in range(25)],
        voorraad_transactie=[
            scan("equal", "Uit", "A", 2, "Doos"), scan("over", "Uit", "A", 13), scan("in", "In", "A", 1), scan("in over", "In", "A", 3, "Doos"),
            scan("service", "Uit", "S", 1), scan("no bin", "Uit", "N", 1), scan("no unit", "Uit", "A", 1, "Zak"), scan("zero", "Uit", "A", 0),
            scan("unknown", "Uit", "X", 1),
        ],
    )


def test_lookup(scans):
    rows = by(transactions.txn_lookup(scans), "name")
    assert (rows["equal"]["locatie"], rows["equal"]["actual_qty"], rows["equal"]["reason"]) == ("W1", 12, None)
    reasons = {name: rows[name]["reason"] for name in ("service", "no bin", "unknown")}
    assert reasons == {"service": "no stock item", "no bin": "no stock", "unknown": "no stock item"}


def test_quantity_and_validation(scans):
    assert by(transactions.txn_quantity(scans), "name")["equal"]["aantal"] == 12
    rows = by(transactions.txn_validation(scans), "name")
    assert {name for name, row in rows.items() if row["accepted"]} == {"equal", "in"}
    # a receipt is held to the present stock too
    assert rows["in over"]["reason"] == rows["over"]["reason"] == "more than stock"
    assert rows["no unit"]["reason"] == rows["zero"]["reason"] == "no quantity"
    assert len(rows) == 9


def test_stock_rows_and_postings(scans):
    rows = by(transactions.txn_stock_rows(scans), "name")
    assert (rows["equal"]["purpose"], rows["equal"]["s_warehouse"], rows["equal"]["t_warehouse"]) == ("Material Issue", "W1", None)
    assert (rows["in"]["purpose"], rows["in"]["t_warehouse"]) == ("Material Receipt", "W1")
    posted = by(transactions.txn_postings(scans), "name", "side")
    assert set(posted) == {("equal", "debit"), ("equal", "credit")}
    assert posted["equal", "credit"]["credit"] == posted["equal", "debit"]["debit"] == D("12.06")
    assert posted["equal", "debit"]["text"] == "A  : naam A"


def test_units_are_all_shown(scans):
    def shown(**page):
        return [row["uom"] for row in transactions.txn_units(scans, **page).orderBy("position").collect() if row["item_code"] == "U"]

    assert shown() == [f"u{n:02}" for n in range(24, -1, -1)]
    assert shown(page=20) == [f"u{n:02}" for n in range(24, 4, -1)]


def test_batches_do_not_reduce_the_tables_again(spark, small, tmp_path):
    known = {}
    for name, rows in {**transactions.snapshot(small), "arriving": small["voorraad_transactie"]}.items():
        rows.write.parquet(str(tmp_path / name))
        known[name] = spark.read.parquet(str(tmp_path / name))
    plan = transactions.checked(known, known["arriving"])._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan


def test_stream_equals_batch(spark, small):
    streamed = txn_stream(small, records_per_file=100, files_per_batch=3)
    judged = streamed.filter("outcome <> 'posted'").selectExpr("name", "IF(outcome = 'accepted', 1, 0) AS accepted", "reason")
    batch = transactions.txn_validation(small).select("name", "accepted", "reason")
    assert judged.exceptAll(batch).count() == batch.exceptAll(judged).count() == 0
    posted = streamed.filter("outcome = 'posted'").select("name", "side", "debit", "credit")
    expected = transactions.txn_postings(small).select("name", "side", "debit", "credit")
    assert posted.exceptAll(expected).count() == expected.exceptAll(posted).count() == 0


def test_stream_restart_adds_nothing(spark, scans, tmp_path):
    scans["voorraad_transactie"].write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        arriving = read_transactions(spark, str(tmp_path / "in"), 1)
        start_transactions(scans, arriving, str(tmp_path / "out")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/checked")).count() == 9
    # a late file is judged on the next start
    scans["voorraad_transactie"].limit(1).write.mode("append").parquet(str(tmp_path / "in"))
    start_transactions(scans, read_transactions(spark, str(tmp_path / "in")), str(tmp_path / "out")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/checked")).count() == 10


def test_each_batch_keeps_the_version_it_was_first_judged_by(spark, scans, tmp_path, monkeypatch):
    from bomwerk.sources.snapshots import stored_tables
    from bomwerk.streaming import transactions as stream

    store = stored_tables(spark, str(tmp_path / "erp"), scans, ["item", "bin", "uom_conversion_detail"])
    issue = scans["voorraad_transactie"].filter("name = 'equal'")
    assert issue.count() == 1
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(name):
        issue.withColumn("name", F.lit(name)).write.mode("append").parquet(source)

    def bins(factor):
        return scans["bin"].withColumn("actual_qty", (F.col("actual_qty") * factor).cast("decimal(18,6)"))

    def run():
        start_transactions(store, read_transactions(spark, source, 1), out).awaitTermination()

    def reasons():
        return {r["name"]: r["reason"] for r in spark.read.parquet(f"{out}/checked").select("name", "reason").collect()}

    arrive("first")
    run()
    store.latest().change("sold out").replace("bin", bins(0)).commit()
    arrive("second")
    run()
    assert reasons() == {"first": None, "second": "more than stock"}

    # the third batch fails after it was judged; the stock is refilled before it is tried again
    arrive("third")
    monkeypatch.setattr(stream, "to_post", lambda rows: rows.select(F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.undo()
    store.latest().change("refilled").replace("bin", bins(1)).commit()
    run()
    assert reasons()["third"] == "more than stock"
    arrive("fourth")
    run()
    assert reasons() == {"first": None, "second": "more than stock", "third": "more than stock", "fourth": None}
    labels = {r["batch"]: r["label"] for r in spark.read.json(f"{out}/versions").collect()}
    assert labels == {0: "version-1", 1: "version-2", 2: "version-2", 3: "version-3"}
