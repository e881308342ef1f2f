"""Table rules, fetched columns and document names."""

from __future__ import annotations

from conftest import by, frame
from test_planning import item

from bomwerk.plans import numbering, rules


def test_rules(make):
    tables = make(
        item=[item("A", configurator_id="1", stock_type="Custom Inkoop", material="M1"), item("B", configurator_id="1", warehouse="", stock_type="", material=""),
              item("C", stock_type="Anders", material="M9"), item("D", stock_type=None)],
        materiaal_variant=[dict(variant_code="M1", variant_details="x")],
        warehouse=[dict(name="WH", lft=1, rgt=2)],
        voorraad_transactie=[dict(name="1", transactie_type="In", artikel="A", unit="Stuks", qty=1), dict(name="2", transactie_type="Retour", artikel="Z", qty=None)],
    )
    required = by(rules.check_required(tables), "table_name", "column_name")
    assert required["item", "warehouse"]["violations"] == 1 and required["item", "stock_type"]["violations"] == 2
    assert required["voorraad_transactie", "unit"]["violations"] == 1 and required["voorraad_transactie", "qty"]["violations"] == 1
    assert required["klant_portaal", "offerte"]["violations"] == 0  # no rows
    assert set(by(rules.check_unique(tables), "table_name", "column_name", "value")) == {("item", "configurator_id", "1")}
    assert required["item", "naming_series"]["violations"] == 4 and required["productie", "productie_module"]["violations"] == 0
    accepted = by(rules.check_accepted_values(tables), "table_name", "column_name", "value")
    assert set(accepted) == {("item", "stock_type", "Anders"), ("voorraad_transactie", "transactie_type", "Retour")}
    foreign = by(rules.check_foreign_keys(tables), "table_name", "column_name", "value")
    assert set(foreign) == {("item", "material", "M9"), ("voorraad_transactie", "artikel", "Z")}


def test_child_rows_and_layouts(make, small):
    tables = make(
        productie=[dict(name="P1", datum="2024-01-01"), dict(name="P2")], productie_module=[dict(name="r", parent="P1", bom="B9")],
        export_layout=[dict(supplier="S", idx=1, artikel_data="Rate"), dict(supplier="S", idx=1, artikel_data="Unit"), dict(supplier="S", idx=2, artikel_data="Unit")],
    )
    required = by(rules.check_required(tables), "table_name", "column_name")
    assert required["productie", "productie_module"]["violations"] == required["productie", "datum"]["violations"] == 1
    assert [r["value"] for r in rules.check_unique(tables).collect()] == ["S 1"]
    assert ("productie_module", "bom", "B9") in by(rules.check_foreign_keys(tables), "table_name", "column_name", "value")
    # every rule is broken somewhere in the derived tables
    broken = {(r["table_name"], r["column_name"]) for r in rules.check_required(small).filter("violations > 0").collect()}
    assert {("productie", "datum"), ("productie", "productie_module"), ("handeling_activiteit", "handeling_artikelen"), ("item", "naming_series")} <= broken
    links = {(r["table_name"], r["column_name"]) for r in rules.check_foreign_keys(small).collect()}
    assert {("productie_module", "bom"), ("handeling_artikelen", "handeling_activiteit")} <= links
    assert {("voorraad_artikelen", name) for name in ("item_code", "supplier", "uom")} <= links
    assert ("item", "naming_series") in {(r["table_name"], r["column_name"]) for r in rules.check_accepted_values(small).collect()}


def test_fetched_columns(make):
    tables = make(
        item=[item("A", item_group="Basis")], item_group=[dict(name="Basis", item_group_code="B-")],
        klant_portaal=[dict(name="p", offerte="Q1"), dict(name="q", offerte="Q9")], quotation=[dict(name="Q1", customer_name="Jan")],
        voorraad_check=[dict(name="c", item="A", qty=1)], voorraad_transactie=[dict(name="t", artikel="A")],
    )
    portal = by(rules.portal_customer(tables), "name")
    assert portal["p"]["customer_name"] == "Jan" and portal["q"]["customer_name"] is None
    assert by(rules.stock_count_enriched(tables), "name")["c"]["warehouse"] == "WH"
    assert by(rules.txn_enriched(tables), "name")["t"]["artikel_naam"] == "naam A"
    assert by(rules.item_series_fetch(tables), "name")["A"]["naming_series"] == "B-"


def test_names_follow_creation_per_year(spark):
    rows = frame(spark, "series STRING, created TIMESTAMP, document STRING", [
        dict(series="VC.YY.##", created="2023-12-31 23:00:00", document="a"), dict(series="VC.YY.##", created="2024-01-01 00:00:00", document="c"),
        dict(series="VC.YY.##", created="2024-01-01 00:00:00", document="b"), dict(series="VB.YY.######", created="2024-01-01 00:00:00", document="d"),
    ])
    last = frame(spark, "prefix STRING, last_number BIGINT", [dict(prefix="VC24", last_number=98)])
    named = {row["document"]: row["name"] for row in numbering.name_documents(rows, last).collect()}
    # a number too long for the series is not cut
    assert named == {"a": "VC2301", "b": "VC2499", "c": "VC24100", "d": "VB24000001"}


def test_names_are_unique(small):
    names = numbering.document_numbers(small)
    assert names.count() == names.select("name").distinct().count()
