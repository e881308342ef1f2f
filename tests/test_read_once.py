"""Jobs of several runs or branches work out the rows they share once."""

from __future__ import annotations

import pytest
from conftest import by, frame
from pyspark.sql import functions as F
from test_planning import bom, item, line, unit
from test_quotes import intake  # noqa: F401

from bomwerk.operators.dimensions import at_nodes, batch_ledger
from bomwerk.plans import numbering, planning, report, runs
from bomwerk.session import run_folder
from bomwerk.sources.snapshots import SnapshotTables


@pytest.fixture
def counted(spark):
    """Rows that count how often they are made, and that count."""
    def counted(rows, column):
        made = spark.sparkContext.accumulator(0)

        def see(value):
            made.add(1)
            return value

        seen = F.udf(see).asNondeterministic()
        return rows.withColumn(column, seen(column)), made

    return counted


def test_intake_reads_its_requests_once(spark, intake, counted):  # noqa: F811
    requests, made = counted(intake["quote_request"], "payload")
    store = runs.intake(SnapshotTables(spark, run_folder(spark, "intake"), over=intake), requests, "monday")
    assert made.value == 8
    heads = by(store["quotation"], "name")
    assert set(heads) == {"QTN-r1", "QTN-r2", "QTN-r3"} and heads["QTN-r1"]["grand_total"] == 122.5 and heads["QTN-r3"]["grand_total"] == 0
    assert {name: row["idx"] for name, row in by(store["quotation_item"], "name").items()} == {
        **{f"QTN-r1-{n}": n for n in (1, 2, 3, 4)}, **{f"QTN-r2-{n}": n for n in (1, 2, 3)}
    }
    assert {name: row["price_list_rate"] for name, row in by(store["item_price"], "name").items()} == {"IP-I1": 90, "IP-I201": 8, "IP-CU00003": 6}


def test_order_runs_share_a_sheet(small, counted, monkeypatch):
    plain = planning._sheet_rows(small, "global").count()
    made = []

    def sheet(tables, guard):
        rows, count = counted(build(tables, guard), "item_code")
        made.append(count)
        return rows

    build = planning._sheet_rows
    monkeypatch.setattr(planning, "_sheet_rows", sheet)
    runs.purchase_order_items_after_run(small, "1999-06-01").count()
    assert sum(count.value for count in made) == plain > 0


def test_documents_are_gathered_once(spark, counted, monkeypatch):
    given = [{"series": s, "created": f"202{n % 2 + 3}-02-01 00:00:{n:02}", "document": f"{s}{n}"} for n in range(20) for s in ("VB.YY.##", "PM.YY.#####")]
    rows, made = counted(frame(spark, "series STRING, created TIMESTAMP, document STRING", given), "document")
    monkeypatch.setattr(numbering, "_documents", lambda tables: rows)
    names = by(numbering.document_numbers_in_runs({}), "document")
    assert made.value == len(given) == len(names)
    assert names["VB.YY.##0"]["name"] == "VB2301" and names["VB.YY.##19"]["name"] == "VB2410"


def test_report_reads_its_requests_once(make, counted):
    tables = make(
        item=[item("P"), item("part"), item("own", has_batch_no=1)], bom=[bom("P")], uom_conversion_detail=[unit("part")],
        bom_explosion_item=[line("P", "part", 1, 2), line("P", "own", 2, 1)],
        bin=[dict(item_code="part", warehouse="W", actual_qty=9, ordered_qty=0)],
        stock_ledger_entry=[dict(item_code="own", batch_no="7-own-HPL1", warehouse="W", actual_qty=3)],
        quotation=[dict(name="Q", klant_referentie="7", hpl_variant="HPL1")],
        located_request=[dict(request_id=f"r{n}", quotation="Q", bom="BOM-P", qty_to_produce=1, warehouse=w) for n, w in enumerate(("W", None, "X"))],
    )
    requests, made = counted(tables["located_request"], "request_id")
    rows = by(report.bom_stock_report(tables, requests), "request_id", "item_code")
    assert made.value == 3
    assert {key: row["in_stock_qty"] for key, row in rows.items()} == {
        ("r0", "part"): 9, ("r0", "own"): 3, ("r1", "part"): 9, ("r1", "own"): 3, ("r2", "part"): None, ("r2", "own"): 0
    }


def test_ledger_of_some_items(spark, make):
    entries = [dict(item_code=i, batch_no=f"7-{i}-HPL1", warehouse=w, actual_qty=q, entry=n) for n, (i, w, q) in enumerate((("a", "W", 1), ("b", "W", 2), ("a", "V", 4), ("a", None, 8)))]
    tables = make(stock_ledger_entry=entries)
    only = frame(spark, "item_code STRING", [{"item_code": "a"}, {"item_code": "a"}])
    assert {key: row["ledger_qty"] for key, row in by(batch_ledger(tables, items=only), "item_code").items()} == {"a": 13}
    nodes = frame(spark, "node STRING, warehouse STRING", [{"node": n, "warehouse": w} for n, w in (("all", "W"), ("all", "V"), ("one", "W"))])
    assert {key: row["ledger_qty"] for key, row in by(batch_ledger(tables, nodes, only), "node", "item_code").items()} == {
        ("", "a"): 13, ("all", "a"): 5, ("one", "a"): 1
    }


def test_stock_is_read_once_for_all_nodes(spark, make, counted):
    bins, made = counted(make(bin=[dict(item_code="a", warehouse=w, actual_qty=q) for w, q in (("W", 1), ("V", 2), (None, 4))])["bin"], "item_code")
    # a node that is given twice counts twice, as in a join
    nodes = frame(spark, "node STRING, warehouse STRING", [{"node": n, "warehouse": w} for n, w in (("all", "W"), ("all", "V"), ("all", "V"))])
    rows = at_nodes(bins, nodes).select("item_code", "node", "warehouse").collect()
    assert made.value == 3
    assert sorted((r.node, r.warehouse or "-") for r in rows) == [("", "-"), ("", "V"), ("", "W"), ("all", "V"), ("all", "V"), ("all", "W")]
