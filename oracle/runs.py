"""What the runs leave behind, from the tables they started with."""

from oracle.planning import LINES
from oracle.quotes import LEADS
from oracle.transactions import QUERIES as TRANSACTIONS

NEW_LINES = LEADS + """,
new_lines AS (
  SELECT 'QTN-' || request_id || '-' || (pos + 1) AS name, 'QTN-' || request_id AS parent, pos + 1 AS idx, 0 AS docstatus, item_code, 'Artikel ' || partkey AS item_name,
         item_group, 'V' || line AS variant_code, aantal AS qty, aantal * prijs AS amount FROM ql),
new_totals AS (SELECT parent, count(*) AS n, sum(amount) AS total FROM new_lines GROUP BY parent),
old_totals AS (SELECT parent, count(*) AS n, sum(amount) AS total FROM t_quotation_item GROUP BY parent)"""

QUERIES = {
    "quotation_after_intake": f"""s: name i: docstatus s: klant_referentie d: transaction_date s: customer_name lead n: grand_total s: taxes_and_charges n: total_taxes_and_charges i: snelstart_koppeling line_count n: line_total
{NEW_LINES}
--main
SELECT q.name, q.docstatus, q.klant_referentie, q.transaction_date, q.customer_name, q.lead, q.grand_total, q.taxes_and_charges, q.total_taxes_and_charges,
       q.snelstart_koppeling, coalesce(n, 0) AS line_count, total AS line_total
FROM t_quotation q LEFT JOIN old_totals o ON o.parent = q.name
UNION ALL
SELECT 'QTN-' || q.request_id, 0, q.cid, CAST(q.received_at AS DATE), 'Klant ' || q.cid, l.lead, coalesce(t.total, 0), 'VerkopenHoog', round(coalesce(t.total, 0) * 21 / 121, 2), 0,
       coalesce(t.n, 0), t.total
FROM req q JOIN leads l ON l.configurator_id = q.cid LEFT JOIN new_totals t ON t.parent = 'QTN-' || q.request_id""",
    "quotation_lines_after_intake": f"""s: name parent i: idx docstatus s: item_code item_name item_group variant_code n: qty amount
{NEW_LINES}
--main
SELECT name, parent, idx, docstatus, item_code, item_name, item_group, variant_code, qty, amount FROM t_quotation_item
UNION ALL SELECT * FROM new_lines""",
    "purchase_orders_after_run": f"""s: name supplier d: transaction_date i: docstatus line_count
{LINES}
--main
SELECT name, supplier, transaction_date, docstatus, (SELECT count(*) FROM t_purchase_order_item i WHERE i.parent = o.name) AS line_count FROM t_purchase_order o
UNION ALL SELECT supplier || '/1999-06-01', supplier, DATE '1999-06-01', 0, count(*) FROM po GROUP BY supplier""",
    "purchase_order_items_after_run": f"""s: parent i: idx s: item_code supplier_part_no d: schedule_date n: qty s: uom stock_uom n: conversion_factor s: description n: stock_qty
{LINES}
--main
SELECT * FROM t_purchase_order_item
UNION ALL
SELECT supplier || '/1999-06-01', row_number() OVER (PARTITION BY supplier ORDER BY source, item_code), item_code, supplier_part_no, DATE '1999-06-01', qty, uom, stock_uom,
       conversion_factor, item_name, 0 FROM po""",
    "batch_ledger": """s: ref variant item_code n: ledger_qty
SELECT lower(split_part(batch_no, '-', 1)) AS ref, lower(split_part(batch_no, '-', -1)) AS variant, item_code, sum(actual_qty) AS ledger_qty
FROM t_stock_ledger_entry WHERE batch_no IS NOT NULL GROUP BY ALL""",
    "document_numbers_in_runs": TRANSACTIONS["document_numbers"],
    "series_counters": """s: prefix i: last_number
SELECT head || strftime(created, '%y') AS prefix, count(*) AS last_number FROM (
  SELECT creation AS created, 'VB' AS head FROM t_voorraad_transactie
  UNION ALL SELECT CAST(posting_date AS TIMESTAMP), 'VC' FROM t_voorraad_check
  UNION ALL SELECT CAST(min(q.transaction_date) AS TIMESTAMP), 'PM' FROM t_productie_module p JOIN t_quotation q ON q.name = p.offerte GROUP BY p.parent) AS docs
GROUP BY ALL""",
}
