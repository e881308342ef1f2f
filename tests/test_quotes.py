"""Quote intake on hand-made payloads."""

from __future__ import annotations

import json
from decimal import Decimal as D

import pytest
from conftest import by
from test_planning import item

from bomwerk.plans import quotes


def payload(configurator, articles, **values):
    root = dict(
        configurator_id=configurator, klant="Jan", contact_email="j@example.org", contact_telefoon="06", adres_klant="Straat 1",
        postcode="1234 AB", plaats="Dorp", offerte_datum="2024-03-05T10:00:00", configurator_link="l", screen_dump_link_1="a",
        screen_dump_link_2="b", basis_bedrag=1.5, interieur_bedrag=2, styling_bedrag=3, accessoires_bedrag=0, **values,
    )
    root["artikelen"] = {"artikelen": [{"artikelen": {
        "sequence": n, "artikel_code": code, "artikel_naam": f"art {code}", "helptext": "h", "variant_code": "V", "variant_naam": "v",
        "aantal": count, "artikel_prijs": price, "afbeelding_link": "i"}} for n, (code, count, price) in enumerate(articles, 1)]}
    return json.dumps({"root": [root]})


@pytest.fixture
def intake(make):
    return make(
        item=[
            item("I1", configurator_id="1", item_group="Bus"), item("I2", configurator_id="2"), item("I201", configurator_id="201"),
            item("I0", configurator_id=None), item("I00", configurator_id=""),
        ],
        lead=[dict(name="L1", configurator_id="10"), dict(name="L0", configurator_id=None)],
        item_price=[
            dict(name="P2", item_code="I2", price_list="Verkoop", currency="EUR", price_list_rate=1, selling=1),
            dict(name="P2b", item_code="I2", price_list="Inkoop", currency="EUR", price_list_rate=9, selling=0),
            dict(name="P9", item_code="I9", price_list="Verkoop", currency="EUR", price_list_rate=9, selling=1),
        ],
        quote_request=[
            dict(request_id="r1", received_at="2024-03-05 10:00:00", payload=payload(10, [(1, 1, 100), (201, 1, 7), (2, 3, "2.50"), (201, 1, 8)])),
            dict(request_id="r2", received_at="2024-03-05 11:00:00", payload=payload(11, [(1, 1, 90), (99, 2, 5), (98, 1, 6)])),
            dict(request_id="r3", received_at="2024-03-05 12:00:00", payload=payload(11, [], klant2="x")),
            dict(request_id="r4", received_at="2024-03-05 12:00:00", payload='{"root":[{"configurator_id":1'),
            dict(request_id="r5", received_at="2024-03-05 12:00:00", payload='{"root":[]}'),
            dict(request_id="r6", received_at="2024-03-05 12:00:00", payload='{"root":[{"configurator_id":1}]}'),
            dict(request_id="r7", received_at="2024-03-05 12:00:00", payload=None),
            dict(request_id="r8", received_at="2024-03-05 12:00:00", payload=payload(12, []).replace("2024-03-05T", "2024-13-05T")),
        ],
    )


def test_lines(intake):
    rows = by(quotes.quote_lines(intake), "request_id", "pos")
    assert len(rows) == 7
    # the last tax article sets the vehicle tax of lines of the taxed group
    assert rows["r1", 0]["bpm"] == 8 and rows["r1", 2]["bpm"] == 0 and rows["r2", 0]["bpm"] == 0
    assert rows["r1", 2]["amount"] == D("7.50")
    unknown = rows["r2", 1]
    assert (unknown["item_code"], unknown["uom"], unknown["item_group"], unknown["warehouse"]) == ("CU00003", "Stuks", "Custom", "Standaard")
    assert {name: row["bpm"] for name, row in by(quotes.quote_bpm(intake), "request_id").items()} == {"r1": 8, "r2": 0, "r3": 0}


def test_rejects_and_archive(intake):
    rejects = {name: row["reason"] for name, row in by(quotes.quote_rejects(intake), "request_id").items()}
    assert rejects == {"r4": "malformed", "r5": "empty", "r6": "incomplete", "r7": "malformed", "r8": "incomplete"}
    assert set(by(quotes.request_archive(intake), "request_id")) == {"r1", "r2", "r3", "r5", "r6", "r8"}


def test_ids_may_be_text(intake, make):
    text = payload("10", [("2", 1, 4)])
    intake["quote_request"] = make(quote_request=[dict(request_id="t", received_at="2024-03-05 10:00:00", payload=text)])["quote_request"]
    assert by(quotes.quote_lines(intake), "request_id")["t"]["item_code"] == "I2"
    assert by(quotes.lead_lookup(intake), "request_id")["t"]["lead"] == "L1"


def test_prices(intake):
    rows = by(quotes.price_upsert(intake), "item_code", "name")
    found = {key: (row["price_list_rate"], row["action"]) for key, row in rows.items()}
    assert found == {
        ("I1", None): (90, "insert"), ("I201", None): (8, "insert"), ("CU00003", None): (6, "insert"),
        ("I2", "P2"): (D("2.50"), "update"), ("I2", "P2b"): (9, "keep"), ("I9", "P9"): (9, "keep"),
    }


def test_leads_and_headers(intake):
    leads = by(quotes.lead_upsert(intake), "configurator_id")
    assert (leads["10"]["lead"], leads["10"]["action"], leads["10"]["lead_name"]) == ("L1", "keep", None)
    assert (leads["11"]["action"], leads["11"]["lead_name"], leads["11"]["customer_details"]) == ("insert", "Jan", "Straat 1<br>1234 AB Dorp")
    heads = by(quotes.quote_headers(intake), "request_id")
    assert {name: row["lead"] for name, row in heads.items()} == {"r1": "L1", "r2": leads["11"]["lead"], "r3": leads["11"]["lead"]}
    assert str(heads["r1"]["transaction_date"]) == "2024-03-05" and heads["r1"]["basis_bedrag"] == D("1.50")
    assert {name: row["lead"] for name, row in by(quotes.lead_lookup(intake), "request_id").items()} == {"r1": "L1", "r2": None, "r3": None}


def test_directories(make):
    tables = make(
        lead=[dict(name="L1", configurator_id="007"), dict(name="L2", configurator_id="8"), dict(name="L3", configurator_id="x"), dict(name="L4")],
        cost_centre=[dict(id="c2", nummer=7), dict(id="c1", nummer=7)],
        relation=[dict(id="r8", relatiecode="8")],
    )
    centres = by(quotes.cost_centre_resolve(tables), "lead")
    assert {n: (r["cost_centre"], r["action"]) for n, r in centres.items()} == {"L1": ("c1", "matched"), "L2": (None, "create"), "L3": (None, "invalid")}
    relations = by(quotes.relation_resolve(tables), "lead")
    assert {n: r["action"] for n, r in relations.items()} == {"L1": "create", "L2": "matched", "L3": "create"}
