"""Invoices and journals with scalar subqueries in place of joins."""

from oracle.production import MEMO_JSON

LINKED = """
WITH linked AS (
  SELECT l.* REPLACE (coalesce((SELECT id FROM t_relation r WHERE r.relatiecode = l.configurator_id), snelstart_relatie) AS snelstart_relatie,
         coalesce((SELECT id FROM t_cost_centre c WHERE CAST(c.nummer AS VARCHAR) = l.configurator_id), snelstart_kostenplaats) AS snelstart_kostenplaats) FROM t_lead l)"""
DOWN = f"""{LINKED},
down AS (
  SELECT q.name AS quotation, q.transaction_date AS invoice_date, 7 AS term, l.lead_name AS klant_naam, l.snelstart_relatie AS relation, l.snelstart_kostenplaats AS cost_centre,
         CAST(round(q.grand_total * 0.3, 2) AS DECIMAL(18,2)) AS total,
         CASE WHEN q.total_taxes_and_charges > 0 THEN CAST(round(q.grand_total * 0.063, 2) AS DECIMAL(18,2)) ELSE 0 END AS vat, q.taxes_and_charges AS vat_kind,
         CASE WHEN l.name IS NULL THEN 'no lead' END AS reason
  FROM t_quotation q LEFT JOIN linked l ON l.configurator_id = q.klant_referentie)"""
FINAL = f"""{LINKED},
booked AS (
  SELECT klant_referentie, arg_max(name, (transaction_date, name)) AS name, arg_max(grand_total, (transaction_date, name)) AS grand_total
  FROM t_quotation WHERE snelstart_koppeling = 1 GROUP BY 1),
final AS (
  SELECT s.name AS invoice, s.posting_date AS invoice_date, 7 AS term, b.name AS quotation, l.lead_name AS klant_naam, l.snelstart_relatie AS relation,
         l.snelstart_kostenplaats AS cost_centre, CAST(round(b.grand_total * 0.3, 2) AS DECIMAL(18,2)) AS advance,
         s.grand_total - CAST(round(b.grand_total * 0.3, 2) AS DECIMAL(18,2)) AS total,
         CASE WHEN s.total_taxes_and_charges > 0 THEN CAST(round(s.total_taxes_and_charges * 0.7, 2) AS DECIMAL(18,2)) ELSE 0 END AS vat, s.taxes_and_charges AS vat_kind,
         CASE WHEN b.name IS NULL THEN 'no booked quotation' WHEN l.name IS NULL THEN 'no lead' END AS reason
  FROM t_sales_invoice s LEFT JOIN booked b ON b.klant_referentie = s.klant_referentie LEFT JOIN linked l ON l.configurator_id = s.klant_referentie
  WHERE s.klant_referentie IS NOT NULL)"""
DIRECT = f"""{LINKED},
direct AS (
  SELECT s.name AS invoice, s.customer, s.posting_date AS invoice_date, 7 AS term,
         CASE WHEN c.lead_name IS NOT NULL THEN l.snelstart_relatie ELSE c.snelstart_referentie END AS relation, g.grootboek_code AS account,
         s.grand_total AS total, s.net_total AS line, s.total_taxes_and_charges AS vat, s.taxes_and_charges AS vat_kind,
         CASE WHEN l.snelstart_relatie IS NOT NULL THEN 'lead' WHEN c.lead_name IS NOT NULL THEN NULL WHEN c.snelstart_referentie IS NOT NULL THEN 'customer' ELSE 'create' END AS action,
         CASE WHEN c.lead_name IS NOT NULL AND l.snelstart_relatie IS NULL THEN 'lead without relation' END AS reason
  FROM t_sales_invoice s LEFT JOIN t_customer c ON c.name = s.customer LEFT JOIN linked l ON l.name = c.lead_name
  LEFT JOIN t_ledger_account g ON g.grootboek_naam = s.snelstart_grootboek WHERE s.klant_referentie IS NULL)"""
DOCUMENTS = f"""{DOWN},
{FINAL.removeprefix(LINKED + ',').strip()},
{DIRECT.removeprefix(LINKED + ',').strip()},
documents AS (
  SELECT quotation AS document, 'down payment' AS kind, invoice_date, relation, cost_centre, 'REVENUE' AS account, klant_naam AS text, CAST(total AS DECIMAL(18,2)) AS total,
         CAST(total - vat AS DECIMAL(18,2)) AS line, CAST(vat AS DECIMAL(18,2)) AS vat, vat_kind, NULL AS action, reason FROM down
  UNION ALL SELECT invoice, 'final', invoice_date, relation, cost_centre, 'REVENUE', klant_naam, CAST(total AS DECIMAL(18,2)), CAST(total - vat AS DECIMAL(18,2)), CAST(vat AS DECIMAL(18,2)), vat_kind, NULL, reason FROM final
  UNION ALL SELECT invoice, 'direct', invoice_date, relation, NULL, account, customer, CAST(total AS DECIMAL(18,2)), CAST(line AS DECIMAL(18,2)), CAST(vat AS DECIMAL(18,2)), vat_kind, action, reason FROM direct),
judged AS (
  SELECT * EXCLUDE (reason), CASE WHEN reason IS NOT NULL THEN reason WHEN relation IS NULL AND action IS DISTINCT FROM 'create' THEN 'no relation'
         WHEN kind <> 'direct' AND cost_centre IS NULL THEN 'no cost centre' WHEN account IS NULL THEN 'no ledger account'
         WHEN (kind = 'direct' OR vat > 0) AND vat_kind IS NULL THEN 'no VAT kind' END AS reason FROM documents),
bookable AS (SELECT * FROM judged WHERE reason IS NULL AND action IS DISTINCT FROM 'create')"""

GROUPS = """
WITH latest AS (SELECT lead, arg_max(name, (transaction_date, name)) AS quotation FROM t_quotation WHERE docstatus = 1 AND lead IS NOT NULL GROUP BY 1)"""
JOURNALS = """
WITH j AS (
  SELECT v.name AS document, v.customer, v.posting_date, v.grand_total, l.configurator_id AS ref
  FROM t_journal v LEFT JOIN t_customer c ON c.name = v.customer LEFT JOIN t_lead l ON l.name = c.lead_name),
lines AS (
  SELECT document, posting_date, 'MEMO' AS journal, customer || ' Ref: ' || ref AS text, side, CASE side WHEN 'debit' THEN 'CLEARING' ELSE 'REVENUE' END AS account,
         CASE side WHEN 'debit' THEN grand_total ELSE 0 END AS debit, CASE side WHEN 'credit' THEN grand_total ELSE 0 END AS credit
  FROM (SELECT *, unnest(['debit', 'credit']) AS side FROM j) WHERE ref IS NOT NULL)"""

QUERIES = {
    "down_payment_invoices": f"""s: quotation d: invoice_date i: term s: klant_naam relation cost_centre n: total line vat s: vat_kind reason
{DOWN}
--main
SELECT *, total - vat AS line FROM down""",
    "final_invoices": f"""s: invoice d: invoice_date i: term s: quotation klant_naam relation cost_centre n: advance total line vat s: vat_kind reason
{FINAL}
--main
SELECT *, total - vat AS line FROM final""",
    "direct_invoices": f"""s: invoice customer d: invoice_date i: term s: relation account n: total line vat s: vat_kind action reason
{DIRECT}
--main
SELECT * FROM direct""",
    "customer_relations": f"""s: name lead_name snelstart_referentie
{LINKED}
--main
SELECT c.name, c.lead_name, CASE WHEN l.snelstart_relatie IS NOT NULL AND EXISTS (SELECT 1 FROM t_sales_invoice s WHERE s.customer = c.name AND s.klant_referentie IS NULL)
       THEN l.snelstart_relatie ELSE c.snelstart_referentie END AS snelstart_referentie
FROM t_customer c LEFT JOIN linked l ON l.name = c.lead_name""",
    "invoice_route": """s: invoice route
SELECT name AS invoice, CASE WHEN klant_referentie IS NULL THEN 'direct' ELSE 'final' END AS route FROM t_sales_invoice""",
    "invoice_group_totals": f"""s: invoice quotation n: basis_bedrag interieur_bedrag accessoires_bedrag styling_bedrag custom_bedrag
{GROUPS}
--main
SELECT s.name AS invoice, q.quotation, coalesce(sum(amount) FILTER (item_group = 'Basis'), 0) AS basis_bedrag, coalesce(sum(amount) FILTER (item_group = 'Modules'), 0) AS interieur_bedrag,
       coalesce(sum(amount) FILTER (item_group = 'Accessoires'), 0) AS accessoires_bedrag, coalesce(sum(amount) FILTER (item_group = 'Styling'), 0) AS styling_bedrag,
       coalesce(sum(amount) FILTER (item_group = 'Custom'), 0) AS custom_bedrag
FROM t_sales_invoice s JOIN latest q ON q.lead = s.lead_name LEFT JOIN t_sales_invoice_item i ON i.parent = s.name AND i.quotation = q.quotation GROUP BY 1, 2""",
    "invoice_group_rejects": f"""s: invoice lead_name reason
{GROUPS}
--main
SELECT name AS invoice, lead_name, 'no base quotation' AS reason FROM t_sales_invoice WHERE lead_name IS NULL OR lead_name NOT IN (SELECT lead FROM latest)""",
    "invoice_balance_check": f"""s: document kind n: difference i: balanced s: calculation
{DOCUMENTS}
--main
SELECT document, kind, line + vat - total AS difference, CASE WHEN line + vat = total THEN 1 ELSE 0 END AS balanced,
       CAST(line AS VARCHAR) || ' + ' || CAST(vat AS VARCHAR) || ' = ' || CAST(total AS VARCHAR) AS calculation FROM documents WHERE reason IS NULL""",
    "booking_rejects": f"""s: document kind reason
{DOCUMENTS}
--main
SELECT * FROM judged WHERE reason IS NOT NULL""",
    "direct_relations_to_create": f"""s: invoice customer relatiecode naam
{DOCUMENTS}
--main
SELECT document AS invoice, text AS customer, document AS relatiecode, text AS naam FROM judged WHERE reason IS NULL AND action = 'create'""",
    "booking_documents": f"""s: document kind booking
{DOCUMENTS}
--main
SELECT document, kind, '{{"factuurdatum":"' || CAST(invoice_date AS VARCHAR) || '","factuurnummer":"' || document || '","betalingstermijn":7,"klant":{{' || coalesce('"id":"' || relation || '"', '')
       || '}},"factuurbedrag":' || CAST(total AS VARCHAR) || ',"boekingsregels":[{{"omschrijving":"' || text || '","grootboek":{{' || coalesce('"id":"' || account || '"', '') || '}}'
       || CASE WHEN kind = 'direct' THEN '' ELSE ',"kostenplaats":{{' || coalesce('"id":"' || cost_centre || '"', '') || '}}' END || ',"bedrag":' || CAST(line AS VARCHAR) || '}}]'
       || CASE WHEN vat > 0 OR kind = 'direct' THEN ',"btw":[{{"btwSoort":"' || vat_kind || '","btwBedrag":' || CAST(vat AS VARCHAR) || '}}]' ELSE '' END || '}}' AS booking FROM bookable""",
    "quote_linked_flag": f"""s: name i: snelstart_koppeling
{DOCUMENTS}
--main
SELECT name, CASE WHEN name IN (SELECT document FROM bookable WHERE kind = 'down payment') THEN 1 ELSE snelstart_koppeling END AS snelstart_koppeling FROM t_quotation""",
    "journal_postings": f"""s: document d: posting_date s: journal text side account n: debit credit
{JOURNALS}
--main
SELECT * FROM lines""",
    "journal_documents": f"""s: document side booking
{JOURNALS}
--main
SELECT document, side, {MEMO_JSON} AS booking FROM (SELECT *, posting_date AS date, NULL::VARCHAR AS cost_centre FROM lines)""",
    "journal_rejects": f"""s: document customer reason
{JOURNALS}
--main
SELECT document, customer, 'no reference' AS reason FROM j WHERE ref IS NULL""",
}
