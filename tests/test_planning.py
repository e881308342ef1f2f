"""Planning, replenishment and purchase orders on rows worked out by hand."""

from __future__ import annotations

from decimal import Decimal as D

import pytest
from conftest import by

from bomwerk.plans import export, planning


def item(name, **values):
    base = dict(
        item_name=f"naam {name}", item_group="Modules", stock_uom="Stuks", purchase_uom="Stuks", warehouse="WH",
        safety_stock=0, min_order_qty=1, is_stock_item=1, has_batch_no=0, bakje_bakje=0, sub_assembly_voorraad=0, disabled=0,
    )
    return {"name": name, **base, **values}


def bom(product, **values):
    return {"name": f"BOM-{product}", "item": product, "docstatus": 1, "is_default": 1, "is_active": 1, **values}


def line(product, component, idx, quantity):
    return dict(parent=f"BOM-{product}", parenttype="BOM", idx=idx, item_code=component, item_name=component,
                stock_qty=quantity, stock_uom="Stuks", rate=1)


def unit(name, uom="Stuks", factor=1, idx=1):
    return dict(parent=name, uom=uom, conversion_factor=factor, idx=idx)


@pytest.fixture
def planned(make):
    return make(
        item=[
            item("A", purchase_uom="Doos", safety_stock=10, min_order_qty=5),
            item("B"),
            item("C", safety_stock=4, min_order_qty=2),
            item("D", purchase_uom=None),
            item("E", item_group="Meubelstoffen"),
            item("F", purchase_uom="Doos", safety_stock=6, min_order_qty=3),
            item("G", bakje_bakje=1),
            item("H"),
        ],
        item_supplier=[dict(parent="A", supplier="S1", supplier_part_no="a1"), dict(parent="A", supplier="S2", supplier_part_no="a0")]
        + [dict(parent=n, supplier="S1", supplier_part_no=n) for n in "BCDEFG"],
        uom_conversion_detail=[unit("A"), unit("A", "Doos", 6, 2), unit("F", "Doos", 6)] + [unit(n) for n in "BCDEGH"],
        bom=[bom("P"), bom("OLD", is_active=0)],
        bom_explosion_item=[
            line("P", "A", 1, 2), line("P", "B", 2, 1), line("P", "C", 3, "0.5"), line("P", "D", 4, 1), line("P", "E", 5, 1),
            line("P", "F", 6, 1), line("P", "G", 7, 1), line("P", "H", 8, 1), line("OLD", "A", 1, 99),
        ],
        quotation=[
            dict(name="Q1", docstatus=1, vj_status="In productie", voorraadplanning_compleet=0),
            dict(name="Q2", docstatus=1, vj_status="In Productie", voorraadplanning_compleet=0),
            dict(name="Q3", docstatus=1, vj_status="In productie", voorraadplanning_compleet=1),
            dict(name="Q4", docstatus=1, vj_status="Geleverd", voorraadplanning_compleet=0),
            dict(name="Q5", docstatus=1, vj_status="Klant besteld", voorraadplanning_compleet=None),
        ],
        quotation_item=[
            dict(name="Q1-1", parent="Q1", idx=1, docstatus=1, item_code="P", item_name="kast", qty=5),
            dict(name="Q1-2", parent="Q1", idx=2, docstatus=1, item_code="P", item_name="kast", qty=2),
            dict(name="Q1-3", parent="Q1", idx=3, docstatus=0, item_code="P", item_name="kast", qty=50),
            dict(name="Q2-1", parent="Q2", idx=1, docstatus=1, item_code="P", item_name="kast", qty=1),
            dict(name="Q2-2", parent="Q2", idx=2, docstatus=1, item_code="OLD", item_name="oud", qty=1),
            dict(name="Q3-1", parent="Q3", idx=1, docstatus=1, item_code="P", item_name="kast", qty=7),
            dict(name="Q4-1", parent="Q4", idx=1, docstatus=1, item_code="P", item_name="kast", qty=7),
            dict(name="Q5-1", parent="Q5", idx=1, docstatus=1, item_code="P", item_name="kast", qty=7),
        ],
        productie_module=[
            # a draft row counts as made here
            dict(name="m1", quotation_item="Q1-1", docstatus=0, qty=1), dict(name="m2", quotation_item="Q1-1", docstatus=1, qty=1),
            dict(name="m3", quotation_item="Q1-2", docstatus=1, qty=2),
        ],
        bin=[
            dict(item_code="A", warehouse="W1", actual_qty=4, ordered_qty=1), dict(item_code="A", warehouse="W2", actual_qty=-2, ordered_qty=0),
            dict(item_code="A", warehouse="W3", actual_qty=7, ordered_qty=3),
            dict(item_code="B", warehouse="W1", actual_qty=-5, ordered_qty=0), dict(item_code="B", warehouse="W2", actual_qty=-3, ordered_qty=0),
            dict(item_code="C", warehouse="W1", actual_qty=5, ordered_qty=0), dict(item_code="F", warehouse="W1", actual_qty=3, ordered_qty=0),
        ],
    )


def test_demand_counts_a_need_per_supplier_and_bin(planned):
    rows = by(planning.planning_demand(planned), "item_code")
    # D has no purchase unit, E an excluded group, G is two-bin stock, H has no supplier
    assert set(rows) == {"A", "B", "C", "F"}
    a = rows["A"]
    # 2 per product, 3 + 1 products to make, 2 suppliers x 3 bins; stock is the largest bin
    assert (a["req_qty"], a["stock_qty"], a["order_qty"]) == (48, 7, 3)
    assert a["qty"] == 8  # ceil((38 + 10) / 6)
    assert (a["uom"], a["conversion_factor"], a["supplier"], a["supplier_part_no"]) == ("Doos", 6, "S2", "a1")
    # all bins negative: no stock
    assert (rows["B"]["req_qty"], rows["B"]["stock_qty"], rows["B"]["qty"]) == (8, 0, 8)
    # 3 in hand, 4 wanted: the 3 are added to what is ordered
    assert rows["C"]["qty"] == 7
    # 1 + 6/6 is below the minimum of 3
    assert rows["F"]["qty"] == 3


def test_threshold_is_exact_to_the_last_decimal(spark):
    row = spark.sql(
        "SELECT CAST(-2.000001 AS DECIMAL(38,6)) AS balance_qty, CAST(0 AS DECIMAL(18,6)) AS safety_stock, "
        "CAST(0.333333333 AS DECIMAL(21,9)) AS conversion_factor, CAST(2.000002 AS DECIMAL(18,6)) AS min_order_qty"
    )
    assert row.select(planning._demand_qty().alias("qty")).first()["qty"] == D("2.000002")


def test_exact_demand_counts_a_need_once(planned):
    rows = by(planning.planning_demand_exact(planned), "item_code")
    assert {name: row["req_qty"] for name, row in rows.items()} == {"A": 8, "B": 4, "C": 2, "F": 4}
    assert rows["A"]["qty"] == 5  # 2 + 10/6 is below the minimum


def test_balance(planned):
    rows = by(planning.planning_balance(planned), "item_code")
    assert (rows["A"]["balance"], rows["A"]["status"]) == (D("-38.00"), "red")
    assert (rows["C"]["balance"], rows["C"]["status"]) == (D("3.00"), "green")


def test_pegging_text_and_parts(planned):
    rows = by(planning.planning_pegging(planned), "item_code", "part")
    assert rows["A", 1]["bom_item"] == (
        "Offerte : Q1 Regel : 1 - 3.00 X kast - Aantal Onderdelen = 6.00 ID : BOM-P<br>"
        "Offerte : Q2 Regel : 1 - 1.00 X kast - Aantal Onderdelen = 2.00 ID : BOM-P"
    )
    single = by(planning.planning_pegging(planned, lines_per_part=1), "item_code", "part")
    assert single["A", 1]["bom_item"] + "<br>" + single["A", 2]["bom_item"] == rows["A", 1]["bom_item"]


def test_pegging_parts_hold_every_line_in_order(small):
    whole = by(planning.planning_pegging(small), "item_code", "part")
    parts = by(planning.planning_pegging(small, lines_per_part=7), "item_code", "part")
    joined: dict[str, str] = {}
    for (name, _), row in sorted(parts.items()):
        joined[name] = joined[name] + "<br>" + row["bom_item"] if name in joined else row["bom_item"]
    assert joined == {name: row["bom_item"] for (name, _), row in whole.items()}
    assert all(row["bom_item"].count("<br>") < 7 for row in parts.values())


@pytest.fixture
def stocked(make):
    def tables(quoted: bool):
        return make(
            item=[
                item("low", safety_stock=10, min_order_qty=2, purchase_uom="Doos"), item("none", safety_stock=3, min_order_qty=2),
                item("binlow", safety_stock=5, bakje_bakje=1), item("binnone", safety_stock=5, bakje_bakje=1),
                item("enough", safety_stock=1), item("zero", safety_stock=5, min_order_qty=4, purchase_uom="Zak"),
                item("off", safety_stock=5, disabled=1), item("P", safety_stock=5), item("unset", safety_stock=5, bakje_bakje=None),
            ],
            item_supplier=[dict(parent="low", supplier="S2", supplier_part_no="x")]
            + [dict(parent=n, supplier="S1", supplier_part_no=n) for n in ("low", "none", "binlow", "binnone", "enough", "zero", "off", "P", "unset")],
            uom_conversion_detail=[unit("low", "Doos", 4), unit("zero", "Zak", 0)]
            + [unit(n) for n in ("none", "binlow", "binnone", "enough", "off", "P", "unset")],
            bin=[
                dict(item_code="low", warehouse="W1", actual_qty=1, ordered_qty=2), dict(item_code="low", warehouse="W2", actual_qty=3, ordered_qty=1),
                dict(item_code="binlow", warehouse="W1", actual_qty=2, ordered_qty=0), dict(item_code="enough", warehouse="W1", actual_qty=9, ordered_qty=0),
                dict(item_code="zero", warehouse="W1", actual_qty=1, ordered_qty=0), dict(item_code="off", warehouse="W1", actual_qty=0, ordered_qty=0),
            ],
            bom=[bom("P")],
            bom_explosion_item=[line("P", "none", 1, 1)],
            quotation_item=[dict(name="Q1-1", parent="Q1", idx=1, docstatus=1 if quoted else 0, item_code="P", qty=1)],
        )

    return tables


def test_replenishment(stocked):
    tables = stocked(True)
    rows = by(planning.replenish_stocked(tables), "item_code")
    assert set(rows) == {"low", "zero"}
    # (1 + 3) counted for 2 suppliers
    assert (rows["low"]["stock_qty"], rows["low"]["ordered_qty"], rows["low"]["shortage"]) == (8, 6, D("-2.00"))
    assert (rows["low"]["order_qty"], rows["low"]["conversion_factor"], rows["low"]["supplier"]) == (2, 4, "S2")
    # factor 0 is shown as 1
    assert (rows["zero"]["conversion_factor"], rows["zero"]["order_qty"]) == (1, 4)
    assert by(planning.replenish_unstocked(tables), "item_code")["none"]["shortage"] == D("-3.00")
    assert set(by(planning.replenish_bin_stocked(tables), "item_code")) == {"binlow"}
    assert set(by(planning.replenish_bin_unstocked(tables), "item_code")) == {"binnone"}


def test_guard(stocked):
    tables = stocked(False)
    # P has an exploded bill of material and no submitted quotation
    assert planning.replenish_stocked(tables).count() == 0
    assert planning.replenish_unstocked(tables).count() == 0
    assert planning.replenish_bin_stocked(tables).count() == 1
    assert set(by(planning.replenish_unstocked(tables, guard="per_item"), "item_code")) == set()
    assert set(by(planning.replenish_stocked(tables, guard="per_item"), "item_code")) == {"low", "zero"}
    assert set(by(planning.replenish_unstocked(tables, guard="off"), "item_code")) == {"none"}
    both = by(planning.replenishment(tables), "source", "item_code")
    assert set(both) == {("bin_stocked", "binlow"), ("bin_unstocked", "binnone")}


def test_sheet_is_the_sum_of_its_sources(small):
    sheet = planning.planning_sheet(small)
    counts = {row["source"]: row["count"] for row in sheet.groupBy("source").count().collect()}
    parts = {
        "demand": planning.planning_demand(small), "stocked": planning.replenish_stocked(small),
        "unstocked": planning.replenish_unstocked(small), "bin_stocked": planning.replenish_bin_stocked(small),
        "bin_unstocked": planning.replenish_bin_unstocked(small),
    }
    assert counts == {name: rows.count() for name, rows in parts.items() if rows.count()}
    row = sheet.filter("source = 'stocked'").first()
    assert row["req_qty"] is None


def test_sheet_pegging_holds_every_line(small):
    texts = planning.planning_sheet_pegging(small, lines_per_part=3)
    found = texts.selectExpr("item_code", "explode(split(bom_item, '<br>')) AS line")
    assert texts.filter("part > 1").count() and found.count() == planning.planning_pegging_rows(small).count()
    sheet = planning.planning_sheet(small).filter("source = 'demand'")
    assert sheet.join(texts, "item_code", "left_anti").count() == texts.join(sheet, "item_code", "left_anti").count() == 0


def test_exact_need_is_never_larger(small):
    exact = planning.planning_demand_exact(small).selectExpr("item_code", "req_qty AS once")
    joined = planning.planning_demand(small).join(exact, "item_code")
    assert joined.count() == exact.count()
    assert joined.filter("once > req_qty").count() == 0


def test_purchase_orders(stocked, make, spark):
    tables = stocked(True)
    extra = make(
        purchase_order=[
            dict(name="PO1", supplier="S2", transaction_date="2024-05-01", docstatus=0),
            dict(name="PO2", supplier="S1", transaction_date="2024-05-02", docstatus=0),
            dict(name="PO3", supplier="S1", transaction_date="2024-05-01", docstatus=1),
        ],
        supplier=[dict(name="S1", supplier_name="Een", default_price_list="Inkoop")],
        export_layout=[
            dict(supplier="S1", idx=1, artikel_data="Item Name"), dict(supplier="S1", idx=2, artikel_data="Quantity"),
            dict(supplier="S2", idx=1, artikel_data="Item Code"),
        ],
    )
    tables.update(extra)
    lines = by(planning.purchase_order_lines(tables, "2024-05-01"), "item_code")
    # S2 has a draft on that day, so `low` is left out
    assert set(lines) == {"none", "zero", "binlow", "binnone"}
    assert lines["none"]["stock_qty"] == 0 and lines["none"]["description"] == "naam none"
    heads = by(planning.purchase_order_headers(tables, "2024-05-01"), "supplier")
    assert heads["S1"]["buying_price_list"] == "Inkoop" and heads["S1"]["line_count"] == 4
    cells = by(export.supplier_export(tables, "2024-05-01"), "item_code", "position")
    assert len(cells) == 8
    assert cells["none", 1]["value"] == "naam none" and cells["none", 2]["value"] == "2.000000"
