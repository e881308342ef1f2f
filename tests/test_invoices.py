"""Invoices and journals, to the cent."""

from __future__ import annotations

import json
from decimal import Decimal as D

import pytest
from conftest import by

from bomwerk.plans import invoices


@pytest.fixture
def books(make):
    def quote(name, ref, total, taxes, **values):
        base = dict(docstatus=1, klant_referentie=ref, grand_total=total, taxes_and_charges="Laag", total_taxes_and_charges=taxes, snelstart_koppeling=0, transaction_date="2024-01-01")
        return {"name": name, **base, **values}

    def invoice(name, **values):
        base = dict(customer="K1", posting_date="2024-02-01", grand_total="121.00", net_total="100.00", taxes_and_charges="Hoog", total_taxes_and_charges="21.00")
        return {"name": name, **base, **values}

    return make(
        quotation=[
            quote("Q1", "1", "100.15", "10", snelstart_koppeling=1, lead="L1"),  # 30 % is 30.045
            quote("Q2", "1", "200.00", "10", snelstart_koppeling=1, transaction_date="2024-01-02", lead="L1"),
            quote("Q3", "2", "100.00", "0", lead="L2"), quote("Q4", "9", "50.00", "5", lead="L1", docstatus=0, transaction_date="2024-09-09"),
        ],
        lead=[
            dict(name="L1", lead_name="Jan", configurator_id="1", snelstart_relatie="R1", snelstart_kostenplaats="KP1"),
            dict(name="L2", lead_name="Piet", configurator_id="2"), dict(name="L3", lead_name="Los"),
        ],
        customer=[
            dict(name="K1", lead_name="L1"), dict(name="K2", lead_name="L2"), dict(name="K3", snelstart_referentie="R3"), dict(name="K4"),
            dict(name="K5", lead_name="L3"),
        ],
        ledger_account=[dict(grootboek_naam="Omzet", grootboek_code="8000")],
        sales_invoice=[
            invoice("F1", klant_referentie="1", lead_name="L1"), invoice("F2", klant_referentie="2", lead_name="L2"),
            invoice("D1", snelstart_grootboek="Omzet", lead_name="L1"), invoice("D2", customer="K2", lead_name="LX"), invoice("D3", customer="K3", klant_referentie=""),
            invoice("D4", customer="K4", net_total="99.00", total_taxes_and_charges="0"),
        ],
        sales_invoice_item=[
            dict(parent="F1", idx=1, item_group="Basis", quotation="Q2", amount="10.00"), dict(parent="F1", idx=2, item_group="Basis", quotation="Q2", amount="2.50"),
            dict(parent="F1", idx=3, item_group="Custom", quotation="Q1", amount="99.00"), dict(parent="F1", idx=4, item_group="Bus", quotation="Q2", amount="7.00"),
            dict(parent="F1", idx=5, item_group="Modules", quotation="Q2", amount="3.00"),
        ],
        journal=[
            dict(name="J1", customer="K1", posting_date="2024-03-01", grand_total="12.34"), dict(name="J2", customer="K5", posting_date="2024-03-01", grand_total="1"),
            dict(name="J3", customer="K3", posting_date="2024-03-01", grand_total="1"),
        ],
    )


def test_down_payments(books):
    rows = by(invoices.down_payment_invoices(books), "quotation")
    q1 = rows["Q1"]
    # 30.045 rounds up; 21 % of 30.045 is 6.30945
    assert (q1["total"], q1["vat"], q1["line"], q1["relation"], q1["cost_centre"]) == (D("30.05"), D("6.31"), D("23.74"), "R1", "KP1")
    assert (rows["Q3"]["total"], rows["Q3"]["vat"], rows["Q3"]["line"]) == (30, 0, 30)
    assert rows["Q4"]["reason"] == "no lead"


def test_final_invoices(books):
    rows = by(invoices.final_invoices(books), "invoice")
    # the latest booked quotation counts: 121 - 60, 70 % of the taxes
    assert (rows["F1"]["quotation"], rows["F1"]["total"], rows["F1"]["vat"], rows["F1"]["line"]) == ("Q2", 61, D("14.70"), D("46.30"))
    assert rows["F2"]["reason"] == "no booked quotation" and rows["F2"]["total"] is None
    assert set(rows) == {"F1", "F2"}


def test_direct_invoices(books):
    rows = by(invoices.direct_invoices(books), "invoice")
    found = {name: (row["relation"], row["action"], row["reason"]) for name, row in rows.items()}
    assert found == {
        "D1": ("R1", "lead", None), "D2": (None, None, "lead without relation"), "D3": ("R3", "customer", None), "D4": (None, "create", None)
    }
    assert rows["D1"]["account"] == "8000"
    customers = by(invoices.customer_relations(books), "name")
    assert customers["K1"]["snelstart_referentie"] == "R1" and customers["K3"]["snelstart_referentie"] == "R3"


def test_every_invoice_takes_one_route(books):
    routes = {name: row["route"] for name, row in by(invoices.invoice_route(books), "invoice").items()}
    assert routes == {"F1": "final", "F2": "final", "D1": "direct", "D2": "direct", "D3": "direct", "D4": "direct"}


def test_group_totals(books):
    rows = by(invoices.invoice_group_totals(books), "invoice")
    f1 = rows["F1"]
    assert (f1["quotation"], f1["basis_bedrag"], f1["interieur_bedrag"], f1["custom_bedrag"]) == ("Q2", D("12.50"), 3, 0)
    assert rows["D1"]["basis_bedrag"] == 0
    rejects = set(by(invoices.invoice_group_rejects(books), "invoice"))
    assert rejects == {"D2", "D3", "D4"} and not rejects & set(rows)


def test_balance(books, small):
    rows = by(invoices.invoice_balance_check(books), "document")
    assert (rows["D4"]["difference"], rows["D4"]["balanced"], rows["D4"]["calculation"]) == (D("-22.00"), 0, "99.00 + 0.00 = 121.00")
    unbalanced = invoices.invoice_balance_check(small).filter("balanced = 0 AND kind <> 'direct'")
    assert unbalanced.count() == 0


def test_bookings_are_json(books):
    rows = by(invoices.booking_documents(books), "document")
    f1 = json.loads(rows["F1"]["booking"])
    assert f1["btw"] == [{"btwSoort": "Hoog", "btwBedrag": 14.7}] and f1["boekingsregels"][0]["kostenplaats"] == {"id": "KP1"}
    assert json.loads(rows["Q1"]["booking"])["btw"][0]["btwSoort"] == "Laag"
    assert set(rows) == {"Q1", "Q2", "F1", "D1"}


def test_every_document_is_booked_rejected_or_waits(books, small):
    rejects = {name: row["reason"] for name, row in by(invoices.booking_rejects(books), "document").items()}
    assert rejects == {"Q3": "no relation", "Q4": "no lead", "F2": "no booked quotation", "D2": "lead without relation", "D3": "no ledger account", "D4": "no ledger account"}
    booked, left, waiting = (job(small).count() for job in (invoices.booking_documents, invoices.booking_rejects, invoices.direct_relations_to_create))
    assert booked and left and waiting and booked + left + waiting == small["quotation"].count() + small["sales_invoice"].count()
    empty = invoices.booking_documents(small).filter("booking LIKE '%:{}%'")
    assert empty.count() == 0
    kinds = invoices.booking_documents(small).selectExpr("get_json_object(booking, '$.btw[0].btwSoort') AS kind").distinct().count()
    assert kinds >= 3


def test_linked_flag(books):
    rows = by(invoices.quote_linked_flag(books), "name")
    assert {name: row["snelstart_koppeling"] for name, row in rows.items()} == {"Q1": 1, "Q2": 1, "Q3": 0, "Q4": 0}


def test_journals(books, small):
    rows = by(invoices.journal_postings(books), "document", "side")
    assert set(rows) == {("J1", "debit"), ("J1", "credit")}
    assert (rows["J1", "debit"]["account"], rows["J1", "debit"]["debit"], rows["J1", "debit"]["text"]) == ("CLEARING", D("12.34"), "K1 Ref: 1")
    assert set(by(invoices.journal_rejects(books), "document")) == {"J2", "J3"}
    assert len(invoices.journal_documents(books).collect()) == 2
    sums = invoices.journal_postings(small).groupBy("document").agg({"debit": "sum", "credit": "sum"})
    assert sums.filter("`sum(debit)` <> `sum(credit)`").count() == 0
    posted = invoices.journal_postings(small).select("document").distinct().count()
    assert posted + invoices.journal_rejects(small).count() == small["journal"].count()
