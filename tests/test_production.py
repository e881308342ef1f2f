"""Module checks, issues and the stock report on rows worked out by hand."""

from __future__ import annotations

import datetime
from decimal import Decimal as D

import pytest
from conftest import by
from test_planning import bom, item, line

from bomwerk.plans import production, report


def direct(product, component, idx, quantity, stock_quantity):
    return {**line(product, component, idx, stock_quantity), "qty": quantity}


@pytest.fixture
def shop(make):
    def order(number, product, **values):
        base = dict(name=f"Q1-{number}", parent="Q1", idx=number, docstatus=1, item_code=product, item_name=product, item_group="Modules", qty=4)
        return {**base, **values}

    products = ("OK", "SHORT", "BATCH", "SUB", "EMPTY", "DONE", "FULL")
    return make(
        item=[
            item("plain"), item("gone"), item("batch-x", has_batch_no=1, warehouse="WB"), item("sub", sub_assembly_voorraad=1),
            item("bak", bakje_bakje=1), item("service", is_stock_item=0),
        ],
        bom=[bom(p) for p in products],
        bom_explosion_item=[
            line("OK", "plain", 1, 2), line("OK", "bak", 2, 1), line("OK", "service", 3, 1), line("OK", "sub", 4, 1),
            line("SHORT", "plain", 1, 2), line("SHORT", "gone", 2, 1), line("BATCH", "batch-x", 1, 5), line("DONE", "gone", 1, 1),
            line("FULL", "plain", 1, 1),
        ],
        bom_item=[direct("OK", "sub", 1, 1, 3), direct("SUB", "sub", 1, 9, 1), direct("SUB", "batch-x", 2, 1, 1)],
        bin=[
            dict(item_code="plain", warehouse="W1", actual_qty=9, ordered_qty=0), dict(item_code="plain", warehouse="W2", actual_qty=17, ordered_qty=0),
            dict(item_code="gone", warehouse="W1", actual_qty=-1, ordered_qty=0), dict(item_code="sub", warehouse="W1", actual_qty=8, ordered_qty=0),
            dict(item_code="service", warehouse="W1", actual_qty=50, ordered_qty=0),
        ],
        quotation=[
            dict(name="Q1", docstatus=1, vj_status="In productie", klant_referentie="77", hpl_variant="HPL2", customer_name="K",
                 transaction_date="2024-01-31", levertijd=1),
            dict(name="Q2", docstatus=0, vj_status="In Productie", klant_referentie="78", hpl_variant="HPL2", transaction_date="2024-01-31", levertijd=1),
        ],
        quotation_item=[order(n, p) for n, p in enumerate(products, 1)]
        + [order(8, "OK", item_group="Styling"), order(9, "NOBOM"), order(10, "OK", variant_code="V1", qty=2), {**order(11, "OK"), "parent": "Q2"}],
        productie_module=[
            dict(name="r1", parent="S", offerte="Q1", quotation_item="Q1-7", item_code="FULL", docstatus=1, qty=4, verwerkt=1),
            dict(name="r2", parent="S", offerte="Q1", quotation_item="Q1-1", item_code="OK", docstatus=0, qty="1.5", verwerkt=0),
            dict(name="r3", parent="S", offerte="Q1", quotation_item="Q1-6", item_code="DONE", docstatus=0, qty=1, verwerkt=1),
            dict(name="r4", parent="S", offerte="Q1", quotation_item="Q1-3", item_code="BATCH", docstatus=0, qty=1, verwerkt=None),
            dict(name="r5", parent="S", offerte="Q1", quotation_item="Q1-9", item_code="NOBOM", docstatus=0, qty=1, verwerkt=0),
            dict(name="r6", parent="S", offerte="Q1", quotation_item="Q1-2", item_code="SHORT", docstatus=0, qty=0, verwerkt=0),
            dict(name="r7", parent="S", offerte="Q1", quotation_item="Q1-4", item_code="SUB", docstatus=0, qty=2, verwerkt=0),
        ],
        stock_ledger_entry=[
            dict(item_code="batch-x", batch_no="77-batch-x-HPL2", actual_qty=5, warehouse="W1"),
            dict(item_code="batch-x", batch_no="77-batch-x-HPL2", actual_qty=-3, warehouse="W2"),
            dict(item_code="batch-x", batch_no="78-batch-x-HPL2", actual_qty=99, warehouse="W1"),
            dict(item_code="batch-x", batch_no=None, actual_qty=99, warehouse="W1"),
        ],
        lead=[dict(name="L1", configurator_id="77", lead_name="Jan", snelstart_kostenplaats="KP")],
        warehouse=[
            dict(name="Alle", lft=1, rgt=8), dict(name="Hal", parent_warehouse="Alle", lft=2, rgt=5),
            dict(name="W1", parent_warehouse="Hal", lft=3, rgt=4), dict(name="W2", parent_warehouse="Alle", lft=6, rgt=7),
        ],
        report_request=[
            dict(request_id="a", quotation="Q1", bom="BOM-OK", qty_to_produce=2), dict(request_id="b", quotation="Q1", bom="BOM-BATCH", qty_to_produce=1),
            dict(request_id="c", quotation="Q1", bom="BOM-OK", qty_to_produce=0), dict(request_id="d", quotation="Q1", bom="BOM-OK", qty_to_produce=-1),
            dict(request_id="e", quotation="Q1", bom="BOM-SHORT", qty_to_produce=1), dict(request_id="f", quotation="QX", bom="BOM-OK", qty_to_produce=1),
        ],
    )


def test_open_modules(shop):
    rows = by(production.open_modules(shop), "quotation_item")
    # FULL is finished, line 8 is of another group, 9 has no bill of material, 11 is of a draft quotation
    assert set(rows) == {"Q1-1", "Q1-2", "Q1-3", "Q1-4", "Q1-5", "Q1-6", "Q1-10"}
    assert rows["Q1-1"]["due"] == datetime.date(2024, 2, 29)
    assert rows["Q1-1"]["klaar"] == 0  # the draft row does not count
    assert rows["Q1-10"]["label"] == "OK (V1)"
    ordered = [row["idx"] for row in production.in_due_order(production.open_modules(shop)).collect()]
    assert ordered == sorted(ordered)


def test_material_checks(shop):
    plain = by(production.material_check_plain(shop), "quotation_item", "item_code")
    # 2 per module, 4 modules, largest bin 17
    assert (plain["Q1-1", "plain"]["need"], plain["Q1-1", "plain"]["buildable"]) == (8, 2)
    assert (plain["Q1-2", "gone"]["actual_qty"], plain["Q1-2", "gone"]["buildable"]) == (None, 0)
    assert ("Q1-1", "bak") not in plain and ("Q1-1", "sub") not in plain
    sub = by(production.material_check_subassembly(shop), "quotation_item", "item_code")
    # the check uses qty: 1 x 4 against 8 in stock; 9 x 4 is more than 8
    assert sub["Q1-1", "sub"]["buildable"] == 2 and sub["Q1-4", "sub"]["buildable"] == 0
    batch = by(production.material_check_batch(shop), "quotation_item", "item_code")
    # 5 - 3 of the customer's own batch for a need of 20
    assert batch["Q1-3", "batch-x"]["actual_qty"] == 2 and batch["Q1-3", "batch-x"]["ratio"] == 0.1


def test_module_status(shop):
    rows = {name: row["status"] for name, row in by(production.module_status(shop), "quotation_item").items()}
    assert rows == {
        "Q1-1": "Okay", "Q1-2": "Tekort", "Q1-3": "Okay", "Q1-4": "Tekort", "Q1-5": "No BOM", "Q1-6": "Verwerkt", "Q1-10": "Okay"
    }


def test_subassembly_without_stock_is_short(shop):
    shop["bin"] = shop["bin"].filter("item_code <> 'sub'")
    assert by(production.material_check_subassembly(shop), "quotation_item")["Q1-1"]["buildable"] is None
    assert by(production.module_status(shop), "quotation_item")["Q1-1"]["status"] == "Tekort"


def test_status_covers_every_module_once(small):
    statuses = production.module_status(small)
    modules = production.open_modules(small)
    assert statuses.count() == modules.count() == statuses.select("quotation_item").distinct().count()


def test_issues(shop):
    lines = by(production.material_issue_lines(shop), "production_row", "branch", "item_code")
    assert set(lines) == {("r2", "exploded", "plain"), ("r2", "direct", "sub"), ("r4", "exploded", "batch-x"), ("r7", "direct", "sub")}
    assert lines["r2", "direct", "sub"]["qty"] == D("4.50")  # stock_qty 3 x 1.5
    batch = lines["r4", "exploded", "batch-x"]
    assert (batch["batch_no"], batch["s_warehouse"], batch["uom"]) == ("77-batch-x-HPL2", "WB", None)
    assert lines["r2", "exploded", "plain"]["batch_no"] == "" and lines["r2", "direct", "sub"]["batch_no"] is None
    heads = by(production.material_issue_headers(shop), "production_row")
    assert {name: row["total_outgoing_value"] for name, row in heads.items()} == {"r2": D("7.50"), "r4": 5, "r7": 2}
    postings = by(production.material_issue_postings(shop, "2024-06-01"), "production_row", "side")
    assert len(postings) == 6
    credit, debit = postings["r2", "credit"], postings["r2", "debit"]
    assert (credit["account"], credit["credit"], credit["debit"], credit["cost_centre"]) == ("STOCK", D("7.50"), 0, None)
    assert (debit["account"], debit["debit"], debit["cost_centre"], debit["text"]) == ("WORK_COST", D("7.50"), "KP", "OK Ref: 77")


def test_rows_kept(shop):
    rows = by(production.production_rows_kept(shop), "production_row")
    assert {name: (row["verwerkt"], row["log"]) for name, row in rows.items()} == {
        "r2": (1, "issued"), "r3": (1, None), "r4": (1, "issued"), "r5": (0, "no BOM"), "r7": (1, "issued")
    }


def test_report(shop):
    rows = by(report.bom_stock_report_flag(shop), "request_id", "branch", "item_code")
    # a stocked subassembly appears exploded and direct; the report uses stock_qty
    assert rows["a", "plain", "sub"]["buildable"] == 4 and rows["a", "subassembly", "sub"]["buildable"] == 1
    assert rows["a", "plain", "plain"]["required_qty"] == 4
    assert (rows["b", "batch", "batch-x"]["buildable"], rows["b", "batch", "batch-x"]["flag"]) == (0.4, "green")
    assert (rows["e", "plain", "gone"]["buildable"], rows["e", "plain", "gone"]["flag"]) == (None, "red")
    assert {key[0] for key in rows} == {"a", "b", "e"}
    assert set(by(report.report_rejects(shop), "request_id")) == {"c", "d"}


def test_report_of_a_warehouse(shop):
    rows = by(report.bom_stock_report(shop, warehouse="Hal"), "request_id", "branch", "item_code")
    assert rows["a", "plain", "plain"]["in_stock_qty"] == 9  # not the 17 outside the hall
    assert rows["b", "batch", "batch-x"]["in_stock_qty"] == 5
    unknown = by(report.bom_stock_report(shop, warehouse="nergens"), "request_id", "branch", "item_code")
    assert unknown["a", "plain", "plain"]["in_stock_qty"] is None
