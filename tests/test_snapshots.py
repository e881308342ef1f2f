"""Versions of tables: one commit for several, crashes, repeated runs, and what stays untouched."""

from __future__ import annotations

import glob
import os

import pytest
from conftest import SMALL, by, frame
from pyspark.sql import functions as F

from bomwerk.operators.dimensions import batch_ledger
from bomwerk.operators.mutate import delete_where, update_by_key
from bomwerk.plans import numbering, planning, runs
from bomwerk.session import checkpoint_dir, drop_folder, folder_exists, run_folder, scratch
from bomwerk.sources.schemas import SCHEMAS
from bomwerk.sources.snapshots import SnapshotTables, stored_tables


@pytest.fixture
def root(spark):
    return run_folder(spark, "snapshots")


def rows(spark, table, *given):
    return frame(spark, SCHEMAS[table], list(given))


def names(table):
    return sorted(r["name"] for r in table.collect())


def test_a_version_may_be_replaced_by_what_is_made_of_it(spark, root):
    store = SnapshotTables(spark, root)
    assert store.version == 0 and store["uom"].count() == 0
    store = store.change("a").replace("uom", rows(spark, "uom", {"name": "x"}, {"name": "y"})).commit()
    # a result that reads the table it replaces
    after = store.change("b").replace("uom", delete_where(store["uom"], F.col("name") == "x")).commit()
    assert (names(store["uom"]), names(after["uom"]), after.version) == (["x", "y"], ["y"], 2)
    assert names(SnapshotTables(spark, root, version=1)["uom"]) == ["x", "y"]
    with pytest.raises(KeyError):
        SnapshotTables(spark, root, version=9)


def test_crash_before_the_commit_and_rerun(spark, root):
    store = SnapshotTables(spark, root).change("start").replace("quotation", rows(spark, "quotation", {"name": "Q1"})).commit()
    change = store.change("run").append("quotation", rows(spark, "quotation", {"name": "Q2"}))
    boom = rows(spark, "quotation_item", {"name": "L"}).withColumn("idx", F.raise_error(F.lit("disk full")).cast("int"))
    with pytest.raises(Exception, match="disk full"):
        change.append("quotation_item", boom)
    # the header is written, but no reader sees it
    assert names(SnapshotTables(spark, root)["quotation"]) == ["Q1"] and not store.done("run")
    for _ in range(2):
        again = SnapshotTables(spark, root).change("run")
        after = again.append("quotation", rows(spark, "quotation", {"name": "Q2"})).append("quotation_item", rows(spark, "quotation_item", {"name": "L"})).commit()
        assert (names(after["quotation"]), names(after["quotation_item"]), after.version) == (["Q1", "Q2"], ["L"], 2)


def test_a_change_on_an_old_version_is_refused(spark, root):
    store = SnapshotTables(spark, root)
    late = store.change("late").replace("uom", rows(spark, "uom", {"name": "late"}))
    store.change("early").replace("uom", rows(spark, "uom", {"name": "early"})).commit()
    with pytest.raises(RuntimeError):
        late.commit()
    assert names(store.latest()["uom"]) == ["early"]


def _files(root, folders):
    return {path: os.stat(path).st_mtime_ns for folder in folders for path in glob.glob(f"{root.removeprefix('file:')}/{folder}/*.parquet")}


def test_only_buckets_with_a_key_are_written(spark, root):
    table = spark.range(400).select(F.concat(F.lit("P"), "id").alias("name"), F.lit("i").alias("item_code"), F.lit(1).alias("price_list_rate"))
    store = SnapshotTables(spark, root).change("start").replace("item_price", table, "name", 16).commit()
    before = _files(root, store.folders("item_price"))
    assert len(store.folders("item_price")) == 16 and len(before) >= 16
    updates = spark.createDataFrame([("P3", 7), ("P4", None)], "name string, price_list_rate int")
    after = store.change("new rates").rewrite("item_price", updates, lambda old: update_by_key(old, updates, ["name"])).commit()
    kept = set(store.folders("item_price")) & set(after.folders("item_price"))
    assert 14 <= len(kept) <= 15
    assert _files(root, kept).items() <= before.items()
    found = {r["name"]: r["price_list_rate"] for r in after["item_price"].collect()}
    assert found == {f"P{n}": 7 if n == 3 else None if n == 4 else 1 for n in range(400)}
    # appended rows get their bucket with the next rewrite; a bucket may run empty
    more = after.change("more").append("item_price", rows(spark, "item_price", {"name": "new", "item_code": "j"})).commit()
    gone = more.change("less").rewrite("item_price", table.where("id = 5").select("name"), lambda old: delete_where(old, F.col("name") == "P5")).commit()
    assert len(names(gone["item_price"])) == 400 and -1 in more.folders("item_price").values() and -1 not in gone.folders("item_price").values()
    same = gone.change("nothing").rewrite("item_price", table.limit(0).select("name"), lambda old: old.limit(0)).commit()
    assert same.folders("item_price") == gone.folders("item_price")


def test_two_numbering_runs_equal_one(spark, root):
    docs = [{"series": s, "created": f"2024-0{1 + n % 3}-01 00:00:{n:02}", "document": f"{s}{n}"} for n in range(30) for s in ("VB.YY.##", "PM.YY.#####")]
    table = frame(spark, "series STRING, created TIMESTAMP, document STRING", docs)
    store = SnapshotTables(spark, root)
    for run in ("2024-01-15", "2024-01-15", "2024-02-15", "2024-12-01"):
        low = {"2024-01-15": "2000-01-01", "2024-02-15": "2024-01-15", "2024-12-01": "2024-02-15"}[run]
        store = numbering.number_run(store, table.where((F.col("created") >= low) & (F.col("created") < run)), run)
    whole = by(numbering.name_documents(table), "document")
    assert {d: r["name"] for d, r in by(store["document_name"], "document").items()} == {d: r["name"] for d, r in whole.items()}
    assert {r.prefix: r.last_number for r in store["series_counter"].collect()} == {"VB24": 30, "PM24": 30}


def test_ledger_sums_and_entries_since(make, spark, root):
    entries = [dict(item_code=f"i{n % 5}", batch_no=f"R{n % 3}-i-V", warehouse=f"W{n % 2}", actual_qty=n, entry=n // 2) for n in range(60)]
    entries += [dict(item_code="i0", batch_no=None, warehouse="W0", actual_qty=9, entry=3)]
    whole = make(stock_ledger_entry=entries)

    def sums(tables, **nodes):
        return {tuple(v for k, v in sorted(r.asDict().items()) if k != "ledger_qty"): r.ledger_qty for r in batch_ledger(tables, **nodes).collect()}

    store = SnapshotTables(spark, root)
    for n, (low, high) in enumerate(((0, 11), (11, 20), (20, 20), (20, 31))):
        store = store.change(f"in {n}").append("stock_ledger_entry", whole["stock_ledger_entry"].where((F.col("entry") >= low) & (F.col("entry") < high))).commit()
        assert sums(store) == sums({"stock_ledger_entry": whole["stock_ledger_entry"].where(F.col("entry") < high)})
        store = runs.advance_ledger(runs.advance_ledger(store, f"sum {n}"), f"sum {n}")
        assert sums(store) == sums({"stock_ledger_entry": whole["stock_ledger_entry"].where(F.col("entry") < high)})
    nodes = spark.createDataFrame([("N", "W0"), ("all", "W0"), ("all", "W1")], "node string, warehouse string")
    assert sums(store, nodes=nodes) == sums(whole, nodes=nodes)
    # only entries above the mark are read again
    plan = batch_ledger(store)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(entry,29)" in plan


def test_intake_and_orders_add_nothing_when_repeated(spark, small, root):
    store = stored_tables(spark, root, small, ["quotation", "quotation_item", "lead", "item_price", "purchase_order", "purchase_order_item"])
    first = runs.intake(store, small["quote_request"], "monday")
    assert runs.intake(first, small["quote_request"], "monday").version == first.version == runs.intake(store, small["quote_request"], "monday").version
    heads, lines = first["quotation"], first["quotation_item"]
    assert lines.join(heads, lines["parent"] == heads["name"], "left_anti").isEmpty()
    fresh = heads.where(F.col("name").startswith("QTN-REQ"))
    sums = {r["parent"]: r["s"] for r in lines.groupBy("parent").agg(F.sum("amount").alias("s")).collect()}
    assert fresh.count() == heads.count() - small["quotation"].count() > 0
    assert all(r["grand_total"] == sums.get(r["name"], 0) for r in fresh.collect())
    ordered = runs.order_run(first, "1999-06-01", "orders")
    assert ordered["purchase_order"].count() > first["purchase_order"].count()
    again = runs.order_run(ordered, "1999-06-01", "orders again")
    assert again["purchase_order"].count() == ordered["purchase_order"].count()
    assert again["purchase_order_item"].count() == ordered["purchase_order_item"].count()
    assert planning.purchase_order_lines(again, "1999-06-01").isEmpty()


def test_scratch_folders_go_with_their_block(spark, small, tmp_path):
    with scratch(spark) as folder:
        with scratch(spark) as inner:
            runs.ledger_stock(small).write.parquet(str(tmp_path / "out"))
            assert inner.startswith(folder) and folder_exists(spark, inner)
        assert folder_exists(spark, folder) and not folder_exists(spark, inner)
    assert not folder_exists(spark, folder) and not run_folder(spark, "x").startswith(folder)
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0


def test_folders_are_dropped(spark, root):
    SnapshotTables(spark, root).change("a").replace("uom", rows(spark, "uom", {"name": "x"})).commit()
    assert folder_exists(spark, root)
    drop_folder(spark, root)
    assert not folder_exists(spark, root)
    for other in (checkpoint_dir(spark), f"{checkpoint_dir(spark)}/", SMALL):
        with pytest.raises(ValueError):
            drop_folder(spark, other)
