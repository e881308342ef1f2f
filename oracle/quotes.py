"""Quote intake from the rows the request texts were made from, without parsing JSON."""

# requests that were written complete, and their lines
READ = """
WITH req AS (
  SELECT 'REQ-' || o_orderkey AS request_id, o_orderkey, CAST(o_custkey AS VARCHAR) AS cid, o_orderdate AS received_at, o_custkey, CAST(o_totalprice AS DECIMAL(12,2)) AS total
  FROM orders WHERE o_orderkey % 97 NOT IN (5, 6)),
art AS (
  SELECT r.request_id, r.received_at, row_number() OVER (PARTITION BY r.request_id ORDER BY a.line) - 1 AS pos, a.line, a.partkey, a.aantal, a.prijs
  FROM req r JOIN t_request_line a ON a.orderkey = r.o_orderkey),
tax AS (
  SELECT r.request_id, r.cid, coalesce((SELECT arg_max(a.prijs, a.line) FROM art a WHERE a.request_id = r.request_id AND a.partkey = 201), 0) AS bpm FROM req r),
ql AS (
  SELECT a.*, coalesce(i.name, 'CU00003') AS item_code, coalesce(i.stock_uom, 'Stuks') AS uom, coalesce(i.item_group, 'Custom') AS item_group,
         coalesce(i.warehouse, 'Standaard') AS warehouse, CASE WHEN i.item_group = 'Bus' THEN t.bpm ELSE 0 END AS bpm
  FROM art a JOIN tax t ON t.request_id = a.request_id
  LEFT JOIN (SELECT configurator_id, arg_min(t_item, name) AS i FROM t_item GROUP BY 1) k ON k.configurator_id = CAST(a.partkey AS VARCHAR)
  LEFT JOIN t_item i ON i.name = k.i.name)"""

LEADS = READ + """,
firsts AS (
  SELECT * FROM req QUALIFY row_number() OVER (PARTITION BY cid ORDER BY received_at, request_id) = 1),
leads AS (
  SELECT f.cid AS configurator_id, coalesce(l.name, 'LD-' || f.cid) AS lead, l.name IS NULL AS fresh, f.* FROM firsts f LEFT JOIN t_lead l ON l.configurator_id = f.cid)"""
ADDRESS = "'Straat ' || (o_orderkey % 100) || '<br>' || (1000 + o_orderkey % 9000) || ' AB Plaats ' || (o_custkey % 25)"

QUERIES = {
    "quote_lines": f"""s: request_id t: received_at i: pos sequence s: item_code item_name description variant_code variant_naam n: qty s: uom i: conversion_factor s: image item_group n: rate amount s: warehouse n: bpm
{READ}
--main
SELECT request_id, received_at, pos, line AS sequence, item_code, 'Artikel ' || partkey AS item_name, 'Regel ' || line AS description, 'V' || line AS variant_code,
       'Variant ' || line AS variant_naam, aantal AS qty, uom, 1 AS conversion_factor, 'https://example.org/i/' || partkey AS image, item_group, prijs AS rate,
       aantal * prijs AS amount, warehouse, bpm FROM ql""",
    "quote_bpm": f"""s: request_id configurator_id n: bpm
{READ}
--main
SELECT request_id, cid AS configurator_id, bpm FROM tax""",
    "price_upsert": f"""s: item_code name price_list currency i: selling buying n: price_list_rate s: action
{READ},
last AS (SELECT item_code, prijs FROM ql QUALIFY row_number() OVER (PARTITION BY item_code ORDER BY received_at DESC, request_id DESC, pos DESC) = 1)
--main
SELECT item_code, name, 'Verkoop' AS price_list, 'EUR' AS currency, 1 AS selling, CASE WHEN name IS NULL THEN 0 END AS buying, coalesce(prijs, price_list_rate) AS price_list_rate,
       CASE WHEN name IS NULL THEN 'insert' WHEN prijs IS NULL THEN 'keep' ELSE 'update' END AS action
FROM t_item_price FULL JOIN last USING (item_code)""",
    "prices_after_intake": f"""s: name item_code price_list currency n: price_list_rate i: selling
{READ},
last AS (SELECT item_code, prijs FROM ql QUALIFY row_number() OVER (PARTITION BY item_code ORDER BY received_at DESC, request_id DESC, pos DESC) = 1)
--main
SELECT coalesce(name, 'IP-' || item_code) AS name, item_code, 'Verkoop' AS price_list, 'EUR' AS currency, coalesce(prijs, price_list_rate) AS price_list_rate, 1 AS selling
FROM t_item_price FULL JOIN last USING (item_code)""",
    "leads_after_intake": f"""s: name lead_name configurator_id email_id mobile_no snelstart_relatie snelstart_kostenplaats
{LEADS}
--main
SELECT * FROM t_lead
UNION ALL SELECT lead, 'Klant ' || cid, configurator_id, 'k' || o_orderkey || '@example.org', '06-' || o_orderkey, NULL, NULL FROM leads WHERE fresh""",
    "lead_upsert": f"""s: configurator_id lead lead_name email_id d: transaction_date s: customer_details mobile_no website status source action
{LEADS}
--main
SELECT configurator_id, lead, CASE WHEN fresh THEN 'Klant ' || cid END AS lead_name, CASE WHEN fresh THEN 'k' || o_orderkey || '@example.org' END AS email_id,
       CASE WHEN fresh THEN received_at END AS transaction_date, CASE WHEN fresh THEN {ADDRESS} END AS customer_details,
       CASE WHEN fresh THEN '06-' || o_orderkey END AS mobile_no, CASE WHEN fresh THEN 'https://example.org/c/' || o_orderkey END AS website,
       CASE WHEN fresh THEN 'Quotation' END AS status, CASE WHEN fresh THEN 'Configurator' END AS source, CASE WHEN fresh THEN 'insert' ELSE 'keep' END AS action
FROM leads""",
    "quote_headers": f"""s: request_id lead quotation_to customer_name d: transaction_date s: remark klant_referentie status lead_source address_display contact_email contact_mobile configurator_link screen_dump_link_1 screen_dump_link_2 currency selling_price_list n: basis_bedrag interieur_bedrag styling_bedrag accessoires_bedrag i: vat_rate vat_included s: payment_terms_template
{LEADS}
--main
SELECT q.request_id, l.lead, 'Lead' AS quotation_to, 'Klant ' || q.cid AS customer_name, q.received_at AS transaction_date,
       'Offerte aangemaakt via configurator ID : ' || q.cid AS remark, q.cid AS klant_referentie, 'Draft' AS status, 'Configurator' AS lead_source,
       {ADDRESS.replace('o_', 'q.o_')} AS address_display, 'k' || q.o_orderkey || '@example.org' AS contact_email, '06-' || q.o_orderkey AS contact_mobile,
       'https://example.org/c/' || q.o_orderkey AS configurator_link, 'https://example.org/s1/' || q.o_orderkey AS screen_dump_link_1,
       'https://example.org/s2/' || q.o_orderkey AS screen_dump_link_2, 'EUR' AS currency, 'Verkoop' AS selling_price_list, q.total AS basis_bedrag,
       q.o_orderkey % 1000 AS interieur_bedrag, q.o_custkey % 1000 AS styling_bedrag, 0 AS accessoires_bedrag, 21 AS vat_rate, 1 AS vat_included,
       'Betaling in 2 termijnen' AS payment_terms_template
FROM req q JOIN leads l ON l.configurator_id = q.cid""",
    "request_archive": """s: request_id t: received_at s: api_data
SELECT request_id, received_at, payload AS api_data FROM t_quote_request WHERE json_valid(payload)""",
    "lead_lookup": f"""s: request_id configurator_id lead
{READ}
--main
SELECT q.request_id, q.cid AS configurator_id, l.name AS lead FROM req q LEFT JOIN t_lead l ON l.configurator_id = q.cid""",
    "quote_rejects": """s: request_id payload reason
SELECT request_id, payload, CASE WHEN json_valid(payload) THEN 'empty' ELSE 'malformed' END AS reason FROM t_quote_request
WHERE NOT json_valid(payload) OR json_array_length(payload, '$.root') = 0""",
    "cost_centre_resolve": """s: lead reference description cost_centre action
SELECT l.name AS lead, l.configurator_id AS reference, l.lead_name AS description, c.id AS cost_centre,
       CASE WHEN TRY_CAST(l.configurator_id AS INTEGER) IS NULL THEN 'invalid' WHEN c.id IS NULL THEN 'create' ELSE 'matched' END AS action
FROM t_lead l LEFT JOIN t_cost_centre c ON c.nummer = TRY_CAST(l.configurator_id AS INTEGER) WHERE l.configurator_id IS NOT NULL""",
    "relation_resolve": """s: lead reference lead_name mobile_no email_id relation action
SELECT l.name AS lead, l.configurator_id AS reference, l.lead_name, l.mobile_no, l.email_id, r.id AS relation, CASE WHEN r.id IS NULL THEN 'create' ELSE 'matched' END AS action
FROM t_lead l LEFT JOIN t_relation r ON r.relatiecode = l.configurator_id WHERE l.configurator_id IS NOT NULL""",
    "leads_linked": """s: name lead_name configurator_id email_id mobile_no snelstart_relatie snelstart_kostenplaats
SELECT l.* REPLACE (coalesce((SELECT id FROM t_relation r WHERE r.relatiecode = l.configurator_id), snelstart_relatie) AS snelstart_relatie,
       coalesce((SELECT id FROM t_cost_centre c WHERE CAST(c.nummer AS VARCHAR) = l.configurator_id), snelstart_kostenplaats) AS snelstart_kostenplaats) FROM t_lead l""",
}
