"""Fixed schemas of the ERP tables. Nothing is inferred.

Quantities are DECIMAL(18,6), conversion factors DECIMAL(21,9), money DECIMAL(18,2),
flags INT 0/1. Child tables carry ``parent`` and ``idx``.
"""

from __future__ import annotations

QTY = "DECIMAL(18,6)"
MONEY = "DECIMAL(18,2)"

SCHEMAS: dict[str, str] = {
    "item": f"name STRING, item_name STRING, item_group STRING, stock_uom STRING, purchase_uom STRING, "
    f"warehouse STRING, safety_stock {QTY}, min_order_qty {QTY}, is_stock_item INT, has_batch_no INT, "
    f"bakje_bakje INT, sub_assembly_voorraad INT, disabled INT, configurator_id STRING, stock_type STRING, "
    f"material STRING, naming_series STRING",
    "item_supplier": "parent STRING, supplier STRING, supplier_part_no STRING",
    "uom_conversion_detail": "parent STRING, uom STRING, conversion_factor DECIMAL(21,9), idx INT",
    "bom": "name STRING, item STRING, docstatus INT, is_default INT, is_active INT",
    "bom_explosion_item": f"parent STRING, parenttype STRING, idx INT, item_code STRING, item_name STRING, "
    f"stock_qty {QTY}, stock_uom STRING, rate {QTY}",
    "bom_item": f"parent STRING, parenttype STRING, idx INT, item_code STRING, item_name STRING, qty {QTY}, "
    f"stock_qty {QTY}, stock_uom STRING, rate {QTY}",
    "quotation": f"name STRING, docstatus INT, vj_status STRING, voorraadplanning_compleet INT, "
    f"klant_referentie STRING, hpl_variant STRING, transaction_date DATE, levertijd INT, customer_name STRING, "
    f"lead STRING, grand_total {MONEY}, taxes_and_charges STRING, total_taxes_and_charges {MONEY}, snelstart_koppeling INT",
    "quotation_item": f"name STRING, parent STRING, idx INT, docstatus INT, item_code STRING, item_name STRING, "
    f"item_group STRING, variant_code STRING, qty {QTY}, amount {MONEY}",
    "productie_module": f"name STRING, parent STRING, idx INT, docstatus INT, offerte STRING, "
    f"quotation_item STRING, item_code STRING, bom STRING, module STRING, qty {QTY}, verwerkt INT",
    "productie": "name STRING, datum DATE",
    "bin": f"item_code STRING, warehouse STRING, actual_qty {QTY}, ordered_qty {QTY}, valuation_rate {QTY}",
    "stock_ledger_entry": f"item_code STRING, batch_no STRING, warehouse STRING, actual_qty {QTY}, entry LONG",
    "warehouse": "name STRING, parent_warehouse STRING, lft INT, rgt INT",
    "lead": "name STRING, lead_name STRING, configurator_id STRING, email_id STRING, mobile_no STRING, "
    "snelstart_relatie STRING, snelstart_kostenplaats STRING",
    "customer": "name STRING, lead_name STRING, snelstart_referentie STRING",
    "supplier": "name STRING, supplier_name STRING, default_price_list STRING",
    "sales_invoice": f"name STRING, customer STRING, klant_referentie STRING, lead_name STRING, "
    f"posting_date DATE, grand_total {MONEY}, net_total {MONEY}, taxes_and_charges STRING, total_taxes_and_charges {MONEY}, "
    f"snelstart_grootboek STRING",
    "sales_invoice_item": f"parent STRING, idx INT, item_group STRING, quotation STRING, amount {MONEY}",
    "item_price": f"name STRING, item_code STRING, price_list STRING, currency STRING, "
    f"price_list_rate {MONEY}, selling INT",
    "purchase_order": "name STRING, supplier STRING, transaction_date DATE, docstatus INT",
    "purchase_order_item": f"parent STRING, idx INT, item_code STRING, supplier_part_no STRING, schedule_date DATE, "
    f"qty {QTY}, uom STRING, stock_uom STRING, conversion_factor DECIMAL(21,9), description STRING, stock_qty {QTY}",
    "cost_centre": "id STRING, nummer INT",
    "relation": "id STRING, relatiecode STRING",
    "ledger_account": "grootboek_naam STRING, grootboek_code STRING",
    "voorraad_transactie": f"name STRING, creation TIMESTAMP, transactie_type STRING, artikel STRING, "
    f"unit STRING, qty {QTY}",
    "voorraad_check": f"name STRING, posting_date DATE, item STRING, qty {QTY}",
    "klant_portaal": "name STRING, offerte STRING",
    "item_group": "name STRING, item_group_code STRING",
    "export_layout": "supplier STRING, idx INT, artikel_data STRING",
    "journal": f"name STRING, customer STRING, posting_date DATE, grand_total {MONEY}",
    "quote_request": "request_id STRING, received_at TIMESTAMP, payload STRING",
    "report_request": "request_id STRING, quotation STRING, bom STRING, qty_to_produce INT",
    "located_request": "request_id STRING, quotation STRING, bom STRING, qty_to_produce INT, warehouse STRING",
    "artikel_variant": "variant_code STRING, variant_details STRING",
    "materiaal_variant": "variant_code STRING, variant_details STRING",
    "levertijd_categorie": f"levertijd_categorie STRING, levertijd_factor {QTY}",
    "handeling_activiteit": "handeling STRING",
    "routing": "name STRING",
    "uom": "name STRING",
    "voorraad_artikelen": "parent STRING, idx INT, item_code STRING, supplier STRING, uom STRING",
    "handeling_artikelen": "parent STRING, idx INT, handeling_activiteit STRING",
    "klant_updates": "parent STRING, datum DATE, update_tekst STRING",
    "instellingen": f"standaard_uurtarief {MONEY}",
}

# What the runs keep beside the ERP tables: ledger sums and the last entry in them, the
# last number of each series, the names given.
KEPT: dict[str, str] = {
    "batch_stock": "ref STRING, variant STRING, item_code STRING, warehouse STRING, ledger_qty DECIMAL(28,6)",
    "ledger_mark": "upto LONG",
    "series_counter": "prefix STRING, last_number LONG",
    "document_name": "document STRING, series STRING, created TIMESTAMP, name STRING",
}
