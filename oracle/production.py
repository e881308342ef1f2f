"""Production and report, one subquery per component kind."""

MODULES = """
WITH modules AS (
  SELECT q.name AS quotation, li.name AS quotation_item, li.idx, q.customer_name AS klant, li.item_code, b.name AS bom,
         li.item_name || coalesce(' (' || li.variant_code || ')', '') AS label, li.qty AS besteld, coalesce(p.made, 0) AS klaar,
         q.transaction_date + to_months(q.levertijd) AS due, q.klant_referentie, q.hpl_variant, li.qty - coalesce(p.made, 0) AS todo
  FROM t_quotation_item li JOIN t_quotation q ON q.name = li.parent
  JOIN t_bom b ON b.item = li.item_code AND b.docstatus = 1 AND b.is_default = 1 AND b.is_active = 1
  LEFT JOIN (SELECT quotation_item, sum(qty) AS made FROM t_productie_module WHERE docstatus = 1 GROUP BY ALL) p ON p.quotation_item = li.name
  WHERE q.docstatus = 1 AND lower(q.vj_status) = 'in productie' AND li.item_group IN ('Modules', 'Accessoires', 'Basis')
    AND coalesce(p.made, 0) < li.qty)"""

# need and stock of the exploded or direct components of a set of orders
BIN_CHECK = """
  SELECT m.{key}, x.item_code, x.item_name AS component_name, CAST(x.{quantity} AS DOUBLE) AS per_unit,
         CAST(x.{quantity} AS DOUBLE) * CAST(m.todo AS DOUBLE) AS need, max(s.actual_qty) AS actual_qty,
         max(floor(CAST(s.actual_qty AS DOUBLE) / (CAST(x.{quantity} AS DOUBLE) * CAST(m.todo AS DOUBLE)))) AS buildable
  FROM {orders} m JOIN t_bom{table}item x ON x.parent = m.bom
  JOIN t_item i ON i.name = x.item_code AND i.bakje_bakje <> 1 AND i.has_batch_no <> 1 {flag}
  LEFT JOIN t_bin s ON s.item_code = x.item_code AND s.actual_qty > 0 {where}
  GROUP BY m.{key}, x.item_code, x.item_name, x.{quantity}, m.todo"""
BATCH_CHECK = """
  SELECT m.{key}, x.item_code, x.item_name AS component_name, CAST(x.stock_qty AS DOUBLE) AS per_unit,
         CAST(x.stock_qty AS DOUBLE) * CAST(m.todo AS DOUBLE) AS need, coalesce(sum(g.actual_qty), 0) AS actual_qty,
         CAST(coalesce(sum(g.actual_qty), 0) AS DOUBLE) / (CAST(x.stock_qty AS DOUBLE) * CAST(m.todo AS DOUBLE)) AS ratio
  FROM {orders} m JOIN t_bom_explosion_item x ON x.parent = m.bom
  JOIN t_item i ON i.name = x.item_code AND i.bakje_bakje <> 1 AND i.has_batch_no = 1
  LEFT JOIN t_stock_ledger_entry g ON g.item_code = x.item_code AND split_part(g.batch_no, '-', 1) = m.klant_referentie
    AND split_part(g.batch_no, '-', -1) = m.hpl_variant {where}
  GROUP BY m.{key}, x.item_code, x.item_name, x.stock_qty, m.todo"""


def bins(orders: str, key: str, direct: bool, quantity: str, sub: str, where: str = "") -> str:
    return BIN_CHECK.format(
        orders=orders, key=key, table="_" if direct else "_explosion_", quantity=quantity, where=where,
        flag=f"AND i.sub_assembly_voorraad {sub}" if sub else "",
    )


CHECKS = f"""{MODULES},
plain AS ({bins('modules', 'quotation_item', False, 'stock_qty', '<> 1')}),
subassembly AS ({bins('modules', 'quotation_item', True, 'qty', '= 1')}),
batch AS ({BATCH_CHECK.format(orders='modules', key='quotation_item', where='')})"""

ROWS = """
WITH todo AS (
  SELECT name, offerte, quotation_item, item_code, qty FROM t_productie_module WHERE docstatus = 0 AND qty > 0 AND verwerkt <> 1),
lines AS (
  SELECT p.name AS production_row, 'exploded' AS branch, x.idx, b.name AS bom, x.item_code, round(x.stock_qty * p.qty, 2) AS qty, x.rate,
         x.stock_uom, x.stock_qty, i.warehouse, CASE WHEN i.has_batch_no = 1 THEN q.klant_referentie || '-' || i.name || '-' || q.hpl_variant ELSE '' END AS batch_no
  FROM todo p JOIN t_quotation q ON q.name = p.offerte JOIN t_bom b ON b.item = p.item_code AND b.docstatus = 1 AND b.is_default = 1 AND b.is_active = 1
  JOIN t_bom_explosion_item x ON x.parent = b.name
  JOIN t_item i ON i.name = x.item_code AND i.is_stock_item = 1 AND i.sub_assembly_voorraad <> 1 AND i.bakje_bakje <> 1
  UNION ALL
  SELECT p.name, 'direct', x.idx, b.name, x.item_code, round(x.stock_qty * p.qty, 2), x.rate, x.stock_uom, x.stock_qty, i.warehouse, NULL
  FROM todo p JOIN t_quotation q ON q.name = p.offerte JOIN t_bom b ON b.item = p.item_code AND b.docstatus = 1 AND b.is_default = 1 AND b.is_active = 1
  JOIN t_bom_item x ON x.parent = b.name
  JOIN t_item i ON i.name = x.item_code AND i.is_stock_item = 1 AND i.sub_assembly_voorraad = 1 AND i.bakje_bakje <> 1),
headers AS (
  SELECT p.name AS production_row, p.offerte, p.quotation_item, p.item_code, b.name AS bom_no, p.qty AS fg_completed_qty,
         round(coalesce((SELECT sum(CAST(l.qty AS DECIMAL(12,2)) * CAST(l.rate AS DECIMAL(12,2))) FROM lines l WHERE l.production_row = p.name), 0), 2) AS total_outgoing_value
  FROM todo p JOIN t_bom b ON b.item = p.item_code AND b.docstatus = 1 AND b.is_default = 1 AND b.is_active = 1)"""

REQUESTS = """
WITH wanted AS (
  SELECT r.request_id, r.bom, r.qty_to_produce AS todo, q.klant_referentie, q.hpl_variant
  FROM t_report_request r JOIN t_quotation q ON q.name = r.quotation WHERE r.qty_to_produce > 0)"""

LOCATED = """
WITH inside AS (
  SELECT a.name AS node, list(d.name) AS places FROM t_warehouse a JOIN t_warehouse d ON d.lft >= a.lft AND d.rgt <= a.rgt GROUP BY a.name),
wanted AS (
  SELECT r.request_id, r.bom, r.qty_to_produce AS todo, q.klant_referentie, q.hpl_variant,
         CASE WHEN coalesce(r.warehouse, '') <> '' THEN coalesce(i.places, [r.warehouse]) END AS places
  FROM t_located_request r JOIN t_quotation q ON q.name = r.quotation LEFT JOIN inside i ON i.node = r.warehouse WHERE r.qty_to_produce > 0)"""


def report(where_bin: str = "", where_ledger: str = "", requests: str = REQUESTS) -> str:
    columns = "request_id, '{0}' AS branch, item_code, component_name AS item_name, per_unit AS qty_per_line, need AS required_qty, actual_qty AS in_stock_qty, {1} AS buildable"
    return f"""{requests},
report AS (
  SELECT {columns.format('plain', 'buildable')} FROM ({bins('wanted', 'request_id', False, 'stock_qty', '', where_bin)}) a
  UNION ALL
  SELECT {columns.format('subassembly', 'buildable')} FROM ({bins('wanted', 'request_id', True, 'stock_qty', '= 1', where_bin)}) b
  UNION ALL
  SELECT {columns.format('batch', 'ratio')} FROM ({BATCH_CHECK.format(orders='wanted', key='request_id', where=where_ledger)}) c)"""


REPORT_COLUMNS = "s: request_id branch item_code item_name n: qty_per_line required_qty in_stock_qty buildable"

ISSUE_POSTINGS = f"""{ROWS},
sides AS (
  SELECT h.production_row, DATE '1999-06-01' AS date, 'MEMO' AS journal, li.item_name || ' Ref: ' || q.klant_referentie AS text, side,
         CASE side WHEN 'debit' THEN 'WORK_COST' ELSE 'STOCK' END AS account,
         CASE side WHEN 'debit' THEN total_outgoing_value ELSE 0 END AS debit, CASE side WHEN 'credit' THEN total_outgoing_value ELSE 0 END AS credit,
         CASE side WHEN 'debit' THEN l.snelstart_kostenplaats END AS cost_centre
  FROM (SELECT *, unnest(['debit', 'credit']) AS side FROM headers) h JOIN t_quotation q ON q.name = h.offerte
  JOIN t_quotation_item li ON li.name = h.quotation_item LEFT JOIN t_lead l ON l.configurator_id = q.klant_referentie)"""

# a one-sided booking as JSON text
MEMO_JSON = """'{"datum":"' || CAST(date AS VARCHAR) || '","boekstuk":"' || document || '","omschrijving":"' || text || '","memoriaalBoekingsRegels":[{"omschrijving":"' || text
       || '","grootboek":{"id":"' || account || '"}' || coalesce(',"kostenplaats":{"id":"' || cost_centre || '"}', '') || ',"debet":' || CAST(CAST(debit AS DECIMAL(18,2)) AS VARCHAR)
       || ',"credit":' || CAST(CAST(credit AS DECIMAL(18,2)) AS VARCHAR) || '}],"dagboek":{"id":"MEMO"}}'"""

QUERIES = {
    "open_modules": f"""s: quotation quotation_item i: idx s: klant item_code bom label n: besteld klaar d: due
{MODULES}
--main
SELECT * FROM modules""",
    "material_check_plain": f"""s: quotation_item item_code component_name n: need actual_qty buildable
{CHECKS}
--main
SELECT * REPLACE (coalesce(buildable, 0) AS buildable) FROM plain""",
    "material_check_subassembly": f"""s: quotation_item item_code component_name n: need actual_qty buildable
{CHECKS}
--main
SELECT * FROM subassembly""",
    "material_check_batch": f"""s: quotation_item item_code component_name n: need actual_qty ratio
{CHECKS}
--main
SELECT * FROM batch""",
    "module_status": f"""s: quotation_item quotation item_code bom status i: shortages
{CHECKS},
checks AS (
  SELECT quotation_item, coalesce(buildable, 0) AS v FROM plain UNION ALL SELECT quotation_item, coalesce(buildable, 0) FROM subassembly
  UNION ALL SELECT quotation_item, coalesce(ratio, 0) FROM batch)
--main
SELECT m.quotation_item, m.quotation, m.item_code, m.bom, count(v) FILTER (v <= 0) AS shortages,
       CASE WHEN m.quotation_item IN (SELECT quotation_item FROM t_productie_module WHERE docstatus = 0 AND verwerkt = 1) THEN 'Verwerkt'
            WHEN count(v) = 0 THEN 'No BOM' WHEN min(v) <= 0 THEN 'Tekort' ELSE 'Okay' END AS status
FROM modules m LEFT JOIN checks c ON c.quotation_item = m.quotation_item
GROUP BY m.quotation_item, m.quotation, m.item_code, m.bom""",
    "material_issue_lines": f"""s: production_row branch i: idx s: bom item_code n: qty basic_rate s: uom stock_uom n: stock_qty i: conversion_factor s: s_warehouse batch_no
{ROWS}
--main
SELECT production_row, branch, idx, bom, item_code, qty, rate AS basic_rate, CAST(NULL AS VARCHAR) AS uom, stock_uom, stock_qty, 1 AS conversion_factor,
       warehouse AS s_warehouse, batch_no FROM lines""",
    "material_issue_headers": f"""s: production_row offerte quotation_item item_code bom_no n: fg_completed_qty total_outgoing_value
{ROWS}
--main
SELECT * FROM headers""",
    "material_issue_postings": f"""s: production_row d: date s: journal text side account n: debit credit s: cost_centre
{ISSUE_POSTINGS}
--main
SELECT * FROM sides""",
    "material_issue_documents": f"""s: production_row side booking
{ISSUE_POSTINGS}
--main
SELECT production_row, side, {MEMO_JSON.replace('document', 'production_row')} AS booking FROM sides""",
    "production_rows_kept": """s: production_row offerte quotation_item item_code n: qty i: verwerkt s: log
SELECT p.name AS production_row, p.offerte, p.quotation_item, p.item_code, p.qty,
       CASE WHEN p.verwerkt <> 1 AND b.name IS NOT NULL THEN 1 ELSE p.verwerkt END AS verwerkt,
       CASE WHEN p.verwerkt = 1 THEN NULL WHEN b.name IS NULL THEN 'no BOM' ELSE 'issued' END AS log
FROM t_productie_module p LEFT JOIN t_bom b ON b.item = p.item_code AND b.docstatus = 1 AND b.is_default = 1 AND b.is_active = 1
WHERE p.docstatus = 0 AND p.qty > 0""",
    "bom_stock_report": f"""{REPORT_COLUMNS}
{report()}
--main
SELECT * FROM report""",
    "bom_stock_report_flag": f"""{REPORT_COLUMNS} s: flag
{report()}
--main
SELECT *, CASE WHEN coalesce(buildable, 0) > 0 THEN 'green' ELSE 'red' END AS flag FROM report""",
    "bom_stock_report_warehouse": f"""{REPORT_COLUMNS}
{report("AND s.warehouse IN ('WH-0', 'WH-1')", "AND g.warehouse IN ('WH-0', 'WH-1')")}
--main
SELECT * FROM report""",
    "bom_stock_report_located": f"""{REPORT_COLUMNS}
{report("AND (m.places IS NULL OR list_contains(m.places, s.warehouse))", "AND (m.places IS NULL OR list_contains(m.places, g.warehouse))", LOCATED)}
--main
SELECT * FROM report""",
    "report_rejects": """s: request_id quotation bom i: qty_to_produce
SELECT * FROM t_report_request WHERE NOT qty_to_produce > 0""",
}
