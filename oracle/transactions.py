"""Stock transactions, table rules, numbering and export."""

from oracle.planning import LINES
from oracle.production import MEMO_JSON

CHECKED = """
WITH chk AS (
  SELECT t.*, i.name AS item, i.item_name AS artikel_naam, i.stock_uom AS stock_unit, i.warehouse AS locatie, b.actual_qty, b.valuation_rate, u.conversion_factor,
         CASE WHEN t.qty > 0 THEN CAST(t.qty AS DECIMAL(12,2)) * CAST(u.conversion_factor AS DECIMAL(12,2)) END AS aantal, b.item_code AS in_bin
  FROM t_voorraad_transactie t LEFT JOIN t_item i ON i.name = t.artikel AND i.is_stock_item = 1
  LEFT JOIN t_bin b ON b.item_code = i.name AND b.warehouse = i.warehouse
  LEFT JOIN t_uom_conversion_detail u ON u.parent = t.artikel AND u.uom = t.unit),
judged AS (
  SELECT *, CASE WHEN item IS NULL THEN 'no stock item' WHEN in_bin IS NULL THEN 'no stock' END AS scan_reason,
         CASE WHEN item IS NULL THEN 'no stock item' WHEN in_bin IS NULL THEN 'no stock' WHEN aantal IS NULL THEN 'no quantity' WHEN aantal > actual_qty THEN 'more than stock' END AS reason
  FROM chk),
posted AS (
  SELECT name, 'MEMO' AS journal, artikel || '  : ' || artikel_naam AS text, side, CASE side WHEN 'debit' THEN 'WORK_COST' ELSE 'STOCK' END AS account,
         CASE side WHEN 'debit' THEN v ELSE 0 END AS debit, CASE side WHEN 'credit' THEN v ELSE 0 END AS credit
  FROM (SELECT *, unnest(['debit', 'credit']) AS side, round(aantal * CAST(valuation_rate AS DECIMAL(14,6)), 2) AS v FROM judged WHERE reason IS NULL AND transactie_type = 'Uit'))"""

REQUIRED = {
    "artikel_variant": "variant_code variant_details", "export_layout": "supplier artikel_data", "handeling_activiteit": "handeling",
    "handeling_artikelen": "handeling_activiteit", "instellingen": "standaard_uurtarief", "item": "warehouse stock_type naming_series", "klant_portaal": "offerte",
    "klant_updates": "datum update_tekst", "ledger_account": "grootboek_code grootboek_naam", "levertijd_categorie": "levertijd_categorie levertijd_factor",
    "materiaal_variant": "variant_code variant_details", "productie": "datum", "productie_module": "qty", "voorraad_check": "posting_date item qty",
    "voorraad_transactie": "transactie_type unit qty artikel",
}
ROWS = {("productie", "productie_module"): "name", ("handeling_activiteit", "handeling_artikelen"): "handeling"}
UNIQUE = {
    "artikel_variant": "variant_code", "handeling_activiteit": "handeling", "item": "configurator_id", "klant_portaal": "offerte", "lead": "configurator_id",
    "ledger_account": "grootboek_code grootboek_naam", "levertijd_categorie": "levertijd_categorie", "materiaal_variant": "variant_code",
}
ACCEPTED = {
    ("export_layout", "artikel_data"): "'Item Code', 'Supplier Code', 'Item Name', 'Quantity', 'Unit', 'Rate', 'Amount', 'Supplier', 'Supplier Name', 'Purchase Order', 'Transaction Date', 'Schedule Date'",
    ("item", "stock_type"): "'Standaard Inkoop', 'Custom Inkoop'",
    ("item", "naming_series"): "'B-', 'MV1-', 'O-', 'SV-', 'CS-', 'SUB-', 'OK-', 'OH-', 'A-', 'OA-'",
    ("voorraad_transactie", "transactie_type"): "'In', 'Uit'",
}
FOREIGN = {
    ("export_layout", "supplier"): ("supplier", "name"), ("handeling_artikelen", "handeling_activiteit"): ("routing", "name"), ("item", "material"): ("materiaal_variant", "variant_code"), ("item", "warehouse"): ("warehouse", "name"),
    ("item_supplier", "supplier"): ("supplier", "name"), ("klant_portaal", "offerte"): ("quotation", "name"), ("quotation_item", "item_code"): ("item", "name"),
    ("productie_module", "bom"): ("bom", "name"), ("voorraad_artikelen", "item_code"): ("item", "name"),
    ("voorraad_artikelen", "supplier"): ("supplier", "name"), ("voorraad_artikelen", "uom"): ("uom", "name"),
    ("voorraad_check", "item"): ("item", "name"), ("voorraad_transactie", "artikel"): ("item", "name"),
}
VALUE_COLUMNS = "s: table_name column_name value i: violations"


def values(table: str, column: str, where: str = "", having: str = "") -> str:
    return (
        f"SELECT '{table}' AS table_name, '{column}' AS column_name, {column} AS value, count(*) AS violations FROM t_{table} x "
        f"WHERE {column} <> '' {where} GROUP BY {column} {having}"
    )


def union(parts) -> str:
    return "\nUNION ALL ".join(parts)


QUERIES = {
    "txn_lookup": f"""s: name artikel artikel_naam stock_unit locatie n: actual_qty s: reason
{CHECKED}
--main
SELECT * REPLACE (scan_reason AS reason) FROM judged""",
    "txn_units": """s: item_code uom i: position
SELECT parent AS item_code, uom, row_number() OVER (PARTITION BY parent ORDER BY idx) AS position FROM t_uom_conversion_detail""",
    "txn_quantity": f"""s: name artikel unit n: qty conversion_factor aantal
{CHECKED}
--main
SELECT * FROM judged""",
    "txn_validation": f"""s: name transactie_type artikel n: aantal actual_qty i: accepted s: reason
{CHECKED}
--main
SELECT *, CASE WHEN reason IS NULL THEN 1 ELSE 0 END AS accepted FROM judged""",
    "txn_stock_rows": f"""s: name purpose item_code item_name uom i: conversion_factor s: s_warehouse t_warehouse n: qty
{CHECKED}
--main
SELECT name, CASE transactie_type WHEN 'In' THEN 'Material Receipt' ELSE 'Material Issue' END AS purpose, artikel AS item_code, artikel_naam AS item_name, stock_unit AS uom,
       1 AS conversion_factor, CASE WHEN transactie_type <> 'In' THEN locatie END AS s_warehouse, CASE WHEN transactie_type = 'In' THEN locatie END AS t_warehouse, aantal AS qty
FROM judged WHERE reason IS NULL""",
    "txn_postings": f"""s: name journal text side account n: debit credit
{CHECKED}
--main
SELECT * FROM posted""",
    "txn_documents": f"""s: name side booking
{CHECKED}
--main
SELECT name, side, {MEMO_JSON} AS booking FROM (SELECT *, name AS document, DATE '1999-06-01' AS date, NULL::VARCHAR AS cost_centre FROM posted)""",
    "txn_stream": f"""s: name outcome side account n: debit credit s: text reason
{CHECKED}
--main
SELECT name, 'posted' AS outcome, side, account, debit, credit, text, NULL AS reason FROM posted
UNION ALL SELECT name, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END, NULL, NULL, NULL, NULL, NULL, reason FROM judged""",
    "portal_customer": """s: name offerte customer_name
SELECT p.name, p.offerte, (SELECT customer_name FROM t_quotation q WHERE q.name = p.offerte) AS customer_name FROM t_klant_portaal p""",
    "stock_count_enriched": """s: name d: posting_date s: item n: qty s: item_name warehouse
SELECT c.*, i.item_name, i.warehouse FROM t_voorraad_check c LEFT JOIN t_item i ON i.name = c.item""",
    "txn_enriched": """s: name t: creation s: transactie_type artikel unit n: qty s: stock_unit locatie artikel_naam
SELECT t.*, i.stock_uom AS stock_unit, i.warehouse AS locatie, i.item_name AS artikel_naam FROM t_voorraad_transactie t LEFT JOIN t_item i ON i.name = t.artikel""",
    "item_series_fetch": """s: name item_group naming_series
SELECT i.name, i.item_group, g.item_group_code AS naming_series FROM t_item i LEFT JOIN t_item_group g ON g.name = i.item_group""",
    "check_required": "s: table_name column_name i: violations checked_rows\n"
    + union(
        f"SELECT '{table}' AS table_name, '{column}' AS column_name, count(*) FILTER (coalesce(CAST({column} AS VARCHAR), '') = '') AS violations, count(*) AS checked_rows FROM t_{table}"
        for table, columns in REQUIRED.items()
        for column in columns.split()
    )
    + "\nUNION ALL "
    + union(
        f"SELECT '{table}', '{child}', count(*) FILTER ({key} NOT IN (SELECT parent FROM t_{child})), count(*) FROM t_{table}"
        for (table, child), key in ROWS.items()
    ),
    "check_unique": VALUE_COLUMNS
    + "\nSELECT 'export_layout' AS table_name, 'supplier idx' AS column_name, supplier || ' ' || idx AS value, count(*) AS violations FROM t_export_layout GROUP BY 3 HAVING count(*) > 1\nUNION ALL "
    + union(values(table, column, having="HAVING count(*) > 1") for table, columns in UNIQUE.items() for column in columns.split()),
    "check_accepted_values": VALUE_COLUMNS
    + "\n"
    + union(values(table, column, where=f"AND {column} NOT IN ({allowed})") for (table, column), allowed in ACCEPTED.items()),
    "check_foreign_keys": VALUE_COLUMNS
    + "\n"
    + union(
        values(table, column, where=f"AND NOT EXISTS (SELECT 1 FROM t_{target} y WHERE y.{key} = x.{column})")
        for (table, column), (target, key) in FOREIGN.items()
    ),
    "document_numbers": """s: document series t: created s: name
WITH docs AS (
  SELECT 'VB.YY.######' AS series, creation AS created, name AS document, 'VB' AS head, 6 AS digits FROM t_voorraad_transactie
  UNION ALL SELECT 'VC.YY.####', CAST(posting_date AS TIMESTAMP), name, 'VC', 4 FROM t_voorraad_check
  UNION ALL SELECT 'PM.YY.#####', CAST(min(q.transaction_date) AS TIMESTAMP), p.parent, 'PM', 5 FROM t_productie_module p JOIN t_quotation q ON q.name = p.offerte GROUP BY p.parent),
ranked AS (
  SELECT *, head || strftime(created, '%y') AS prefix, CAST(row_number() OVER (PARTITION BY head, year(created) ORDER BY created, document) AS VARCHAR) AS n FROM docs)
--main
SELECT document, series, created, prefix || lpad(n, CAST(greatest(digits, length(n)) AS INTEGER), '0') AS name FROM ranked""",
    "supplier_export": f"""s: supplier source item_code i: position s: column_name value
{LINES}
--main
SELECT p.supplier, p.source, p.item_code, l.idx AS position, l.artikel_data AS column_name,
       CASE l.artikel_data WHEN 'Item Code' THEN p.item_code WHEN 'Supplier Code' THEN p.supplier_part_no WHEN 'Item Name' THEN p.item_name
            WHEN 'Quantity' THEN CAST(CAST(p.qty AS DECIMAL(18,6)) AS VARCHAR) WHEN 'Unit' THEN p.uom WHEN 'Supplier' THEN p.supplier WHEN 'Supplier Name' THEN s.supplier_name
            WHEN 'Purchase Order' THEN p.supplier || '/1999-06-01' WHEN 'Transaction Date' THEN '1999-06-01' WHEN 'Schedule Date' THEN '1999-06-01' END AS value
FROM po p JOIN t_export_layout l ON l.supplier = p.supplier AND l.artikel_data <> 'Kleur' LEFT JOIN t_supplier s ON s.name = p.supplier""",
    "export_layout_rejects": """s: supplier i: idx s: name reason
SELECT supplier, idx, artikel_data AS name, 'unknown column' AS reason FROM t_export_layout WHERE artikel_data = 'Kleur'""",
}
