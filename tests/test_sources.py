"""Stored tables, sinks and plan shape."""

from __future__ import annotations

import os
import re

import pytest
from conftest import SMALL, by
from pyspark.sql import functions as F

from bomwerk.operators.shared import Run
from bomwerk.plans import invoices, planning, production, report, rules
from bomwerk.session import checkpoint_dir, folder_exists
from bomwerk.sources.schemas import SCHEMAS
from bomwerk.sources.sinks import save_bucketed, save_laid_out, save_per_supplier, save_report, save_sheet, save_table, save_tables
from bomwerk.sources.tables import CatalogTables, LocalTables, StoredTables


@pytest.fixture(scope="module")
def stored(spark, small, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("erp"))
    save_tables(small, list(SCHEMAS), root)
    return StoredTables(spark, root)


def test_derived_tables_have_the_declared_columns(spark, small):
    for name in SCHEMAS:
        assert set(spark.createDataFrame([], SCHEMAS[name]).columns) <= set(small[name].columns), name


@pytest.mark.parametrize("source", ["orc", "json", "csv"])
def test_formats(spark, small, tmp_path, source):
    save_table(small["item_price"], str(tmp_path / "item_price"), source=source)
    rows = StoredTables(spark, str(tmp_path), source)["item_price"]
    assert rows.exceptAll(small["item_price"]).count() == 0 and rows.count() == small["item_price"].count()


def test_stored_tables_give_the_same_plan_result(small, stored):
    left, right = planning.planning_demand(small), planning.planning_demand(stored)
    assert left.exceptAll(right).count() == right.exceptAll(left).count() == 0


def test_catalog_tables(spark, small, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS erp_test LOCATION '{tmp_path}/db'")
    try:
        small["supplier"].write.mode("overwrite").saveAsTable("erp_test.supplier")
        assert CatalogTables(spark, "erp_test")["supplier"].count() == small["supplier"].count()
    finally:
        spark.sql("DROP DATABASE erp_test CASCADE")


def test_bucketed_tables_join_without_a_shuffle(spark, small, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS erp_buckets LOCATION '{tmp_path}/db'")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        save_bucketed(small, ["quotation", "quotation_item", "productie_module"], "erp_buckets", 4)
        tables = {**{name: small[name] for name in small}, **{n: CatalogTables(spark, "erp_buckets")[n] for n in ("quotation", "quotation_item", "productie_module")}}
        lines = planning.open_lines(tables)
        exchanges = [row for row in lines._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in row]
        # the lines move from their quotation's bucket to their own, where what was made of each is added up
        assert len(exchanges) == 2
        assert lines.exceptAll(planning.open_lines(small)).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE erp_buckets CASCADE")


def test_one_folder_per_supplier(spark, small, tmp_path):
    lines = planning.purchase_order_lines(small, "1999-06-01")
    save_per_supplier(lines, str(tmp_path / "po"))
    folders = [name for name in os.listdir(tmp_path / "po") if name.startswith("supplier=")]
    assert len(folders) == lines.select("supplier").distinct().count()
    assert spark.read.parquet(str(tmp_path / "po")).count() == lines.count()


def test_report_sink(spark, small, tmp_path):
    requests = small["report_request"].filter("quotation = 'QTN-1'")
    save_report(report.bom_stock_report(small, requests), str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).columns[1:3] == ["Item", "Description"]


def test_sheet_sink(spark, small, tmp_path):
    sheet = planning.planning_sheet(small)
    for by in ("supplier", "item_code"):
        save_sheet(sheet, str(tmp_path / by), by)
        found = [row[by] for row in spark.read.option("header", True).csv(str(tmp_path / by)).collect()]
        assert len(found) == sheet.count() and found == sorted(found, reverse=True)


def test_scans_read_only_the_needed_columns(stored):
    plan = planning.planning_demand(stored)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and all("ReadSchema" in line for line in scans)
    items = next(line for line in scans if "/item]" in line or "/item," in line)
    assert "configurator_id" not in items and "PushedFilters: [IsNotNull(bakje_bakje)" in items


def test_layout_skips_folders_and_files(spark, small, tmp_path):
    save_laid_out(small, ["quotation", "quotation_item", "productie_module"], str(tmp_path), files=12)
    laid = LocalTables(spark, {**{n: small[n] for n in ("bom", "item")}, **{n: StoredTables(spark, str(tmp_path))[n] for n in ("quotation", "quotation_item", "productie_module")}})
    found, want = production.open_modules(laid), production.open_modules(small)
    assert found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty()
    plan = found._jdf.queryExecution().executedPlan().toString()
    folders = re.findall(r"PartitionFilters: \[(.*?), PushedFilters", plan)
    assert any("docstatus" in found and "vj_status" in found for found in folders) and any("item_group" in found for found in folders)

    def files(rows):
        return rows.select("_metadata.file_path").distinct().count()

    quotations = laid["quotation"]
    active = (F.col("docstatus") == 1) & F.lower("vj_status").isin(["in productie"])
    # folders of other states are not read, and of these a day is in few files
    assert files(quotations.filter(active)) < files(quotations) / 2
    day = quotations.filter(active).agg(F.min("transaction_date")).first()[0]
    stats = {}
    for row in quotations.filter(active).groupBy("_metadata.file_path").agg(F.min("transaction_date").alias("a"), F.max("transaction_date").alias("b")).collect():
        stats[row.file_path] = row.a <= day <= row.b
    assert 0 < sum(stats.values()) < len(stats)


def test_one_run_stores_its_intermediates_once(spark, stored):
    jobs = (
        invoices.booking_documents, invoices.booking_rejects, invoices.invoice_balance_check, invoices.quote_linked_flag, invoices.direct_relations_to_create,
        lambda t: planning.purchase_order_lines(t, "1999-06-01"), lambda t: planning.purchase_order_headers(t, "1999-06-01"), planning.planning_sheet,
    )
    with Run(stored) as run:
        for job in jobs:
            alone, shared = job(stored), job(run)
            assert alone.exceptAll(shared).isEmpty() and shared.exceptAll(alone).isEmpty()
        assert set(run._stored) == {"leads_linked", "invoice documents", "planning sheet global"}
        plan = invoices.invoice_balance_check(run)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "/sales_invoice" not in plan
        folder = run._folder[1]
        assert folder_exists(spark, folder)
    assert not folder_exists(spark, folder)


def test_directories_are_read_once(stored):
    plan = invoices.down_payment_invoices(stored)._jdf.queryExecution().executedPlan().toString()
    assert sum("FileScan" in line and "/relation]" in line for line in plan.splitlines()) == 1
    assert sum("FileScan" in line and "/lead]" in line for line in plan.splitlines()) == 1


def test_rules_scan_each_table_once(stored):
    for check in (rules.check_foreign_keys, rules.check_unique, rules.check_accepted_values):
        plan = check(stored)._jdf.queryExecution().executedPlan().toString()
        scans = re.findall(r"FileScan.*?Location: \S+\(1 paths?\)\[\S*/(\w+)\]", plan)
        assert len(scans) == len(set(scans)) > 1
        assert plan.count("Exchange") == 1


@pytest.mark.parametrize("name", ["planning_sheet", "module_status", "bom_stock_report", "invoice_group_totals", "check_foreign_keys"])
def test_no_nested_loops(spark, stored, name):
    import __spark_entry__ as entry

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.JOBS[name](stored)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_checkpoint_folder_is_the_sessions(spark):
    assert checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.JOBS) <= set(entry.oracle_sql()) & set(entry.queries())
    assert by(entry.entry(spark), "item_code") and SMALL.endswith("sf0.001")
