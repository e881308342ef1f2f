"""ERP tables derived from the star-schema test tables.

One SELECT per table, in SQL both Spark and DuckDB accept, so that a job and its
oracle start from the same rows. All rows of the test tables are used; remainders of
keys only give rows their attributes and decide which items have no bin, no bill of
material, no lead and so on, so that every case of the jobs occurs.

Three words differ per engine: ``EXPLODE[..]`` for a row per array element,
``CONCAT_ROWS(..)`` for an ordered text aggregate, ``DATE_TEXT(..)`` for a day as text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# The ERP table ``x`` is named ``t_x`` in SQL; some share their name with a raw table.
VIEWS: dict[str, str] = {
    "t_item": """
        SELECT CAST(p_partkey AS STRING) AS name, p_name AS item_name,
               CASE p_type WHEN 'STANDARD' THEN 'Modules' WHEN 'ECONOMY' THEN 'Accessoires'
                    WHEN 'MEDIUM' THEN 'Basis' WHEN 'SMALL' THEN 'HPL Onderdelen'
                    WHEN 'LARGE' THEN 'Bus' ELSE 'Styling' END AS item_group,
               'Stuks' AS stock_uom,
               CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 'Doos' ELSE 'Stuks' END AS purchase_uom,
               'WH-' || CAST(p_partkey % 3 AS STRING) AS warehouse,
               CAST(p_size * 20 AS DECIMAL(18,6)) AS safety_stock,
               CAST(1 + p_partkey % 5 AS DECIMAL(18,6)) AS min_order_qty,
               CASE WHEN p_partkey % 20 = 19 THEN 0 ELSE 1 END AS is_stock_item,
               CASE WHEN p_partkey % 7 = 3 THEN 1 ELSE 0 END AS has_batch_no,
               CASE WHEN p_partkey % 11 = 5 THEN 1 ELSE 0 END AS bakje_bakje,
               CASE WHEN p_partkey % 13 = 4 THEN 1 ELSE 0 END AS sub_assembly_voorraad,
               CASE WHEN p_partkey % 50 = 49 THEN 1 ELSE 0 END AS disabled,
               CASE WHEN p_partkey % 40 = 39 THEN CAST(p_partkey - 1 AS STRING) ELSE CAST(p_partkey AS STRING) END AS configurator_id,
               CASE p_partkey % 4 WHEN 0 THEN 'Standaard Inkoop' WHEN 1 THEN 'Custom Inkoop' WHEN 2 THEN NULL ELSE p_brand END AS stock_type,
               CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 'HPL' || CAST(p_partkey % 6 AS STRING) END AS material,
               CASE p_partkey % 9 WHEN 0 THEN 'B-' WHEN 1 THEN 'MV1-' WHEN 2 THEN 'O-' WHEN 3 THEN 'SUB-' WHEN 4 THEN 'OA-' WHEN 5 THEN '' WHEN 6 THEN 'ZZ-' ELSE 'A-' END AS naming_series
        FROM part""",
    "t_item_supplier": """
        SELECT DISTINCT CAST(l_partkey AS STRING) AS parent, 'Supplier#' || CAST(l_suppkey AS STRING) AS supplier,
               'SP-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS supplier_part_no
        FROM lineitem WHERE l_partkey % 23 <> 7""",
    "t_uom_conversion_detail": """
        SELECT CAST(p_partkey AS STRING) AS parent, 'Stuks' AS uom, CAST(1 AS DECIMAL(21,9)) AS conversion_factor, 1 AS idx
        FROM part
        UNION ALL
        SELECT CAST(p_partkey AS STRING) AS parent, 'Doos' AS uom, CAST(2 + p_partkey % 6 AS DECIMAL(21,9)) AS conversion_factor, 2 AS idx
        FROM part WHERE p_partkey % 3 = 0""",
    "t_bom": """
        SELECT 'BOM-' || CAST(p_partkey AS STRING) AS name, CAST(p_partkey AS STRING) AS item, 1 AS docstatus,
               1 AS is_default, CASE WHEN p_partkey % 17 = 0 THEN 0 ELSE 1 END AS is_active
        FROM part WHERE p_type IN ('STANDARD', 'ECONOMY', 'MEDIUM') AND p_partkey % 4 <> 3""",
    "t_bom_explosion_item": """
        SELECT b.parent, 'BOM' AS parenttype, b.k AS idx, CAST(c.p_partkey AS STRING) AS item_code, c.p_name AS item_name,
               CAST(b.k * 0.5 AS DECIMAL(18,6)) AS stock_qty, 'Stuks' AS stock_uom, CAST(c.p_retailprice AS DECIMAL(18,6)) AS rate
        FROM (SELECT 'BOM-' || CAST(p_partkey AS STRING) AS parent, k,
                     (p_partkey * 7 + k * 131) % (SELECT count(*) FROM part) AS component
              FROM (SELECT p_partkey, p_type, EXPLODE[1, 2, 3, 4, 5, 6] AS k FROM part) AS e
              WHERE p_type IN ('STANDARD', 'ECONOMY', 'MEDIUM') AND p_partkey % 4 <> 3 AND p_partkey % 40 <> 8) AS b
        JOIN part AS c ON c.p_partkey = b.component""",
    "t_bom_item": """
        SELECT b.parent, 'BOM' AS parenttype, b.k AS idx, CAST(c.p_partkey AS STRING) AS item_code, c.p_name AS item_name,
               CAST(b.k AS DECIMAL(18,6)) AS qty, CAST(2 * b.k AS DECIMAL(18,6)) AS stock_qty, 'Stuks' AS stock_uom,
               CAST(c.p_retailprice AS DECIMAL(18,6)) AS rate
        FROM (SELECT 'BOM-' || CAST(p_partkey AS STRING) AS parent, k,
                     (p_partkey * 7 + k * 131) % (SELECT count(*) FROM part) AS component
              FROM (SELECT p_partkey, p_type, EXPLODE[1, 3, 7] AS k FROM part) AS e
              WHERE p_type IN ('STANDARD', 'ECONOMY', 'MEDIUM') AND p_partkey % 4 <> 3 AND p_partkey % 40 <> 8) AS b
        JOIN part AS c ON c.p_partkey = b.component""",
    "t_quotation": """
        SELECT 'QTN-' || CAST(o_orderkey AS STRING) AS name, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE 1 END AS docstatus,
               CASE WHEN o_orderstatus = 'P' THEN 'Klant Aanbetaald' WHEN o_orderstatus = 'F' THEN 'Geleverd'
                    WHEN o_orderkey % 2 = 0 THEN 'In productie' ELSE 'In Productie' END AS vj_status,
               CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS voorraadplanning_compleet,
               CAST(o_custkey AS STRING) AS klant_referentie, 'HPL' || CAST(o_orderkey % 4 AS STRING) AS hpl_variant,
               CAST(o_orderdate AS DATE) AS transaction_date, CAST(1 + o_orderkey % 6 AS INT) AS levertijd,
               'Customer#' || CAST(o_custkey AS STRING) AS customer_name,
               CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE 'LEAD-' || CAST(o_custkey AS STRING) END AS lead,
               CAST(o_totalprice AS DECIMAL(18,2)) AS grand_total,
               CASE WHEN o_orderkey % 97 = 1 THEN NULL WHEN o_custkey % 5 = 0 THEN 'Geen' WHEN o_orderkey % 7 = 0 THEN 'Laag' ELSE 'Hoog' END AS taxes_and_charges,
               CASE WHEN o_custkey % 5 = 0 THEN CAST(0 AS DECIMAL(18,2))
                    ELSE CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.173554 AS DECIMAL(8,6)), 2) AS DECIMAL(18,2)) END AS total_taxes_and_charges,
               CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS snelstart_koppeling
        FROM orders""",
    "t_quotation_item": """
        SELECT 'QTN-' || CAST(l.l_orderkey AS STRING) || '-' || CAST(l.l_linenumber AS STRING) AS name,
               'QTN-' || CAST(l.l_orderkey AS STRING) AS parent, l.l_linenumber AS idx,
               CASE WHEN l.l_orderkey % 10 = 0 THEN 0 ELSE 1 END AS docstatus,
               i.name AS item_code, i.item_name, i.item_group,
               CASE WHEN l.l_linenumber % 2 = 0 THEN NULL ELSE 'V' || CAST(l.l_linenumber AS STRING) END AS variant_code,
               l.qty, l.amount
        FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS partkey,
                     CAST(sum(CAST(l_quantity AS DECIMAL(18,6))) AS DECIMAL(18,6)) AS qty,
                     CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS amount
              FROM lineitem GROUP BY l_orderkey, l_linenumber) AS l
        JOIN t_item AS i ON i.name = CAST(l.partkey AS STRING)""",
    "t_productie_module": """
        SELECT CASE WHEN turn = 1 THEN 'PM-' ELSE 'PM2-' END || name AS name, 'PROD-' || parent AS parent, idx,
               CASE WHEN idx % 3 = 0 THEN 1 ELSE 0 END AS docstatus, parent AS offerte, name AS quotation_item, item_code, 'BOM-' || item_code AS bom, item_name AS module,
               CAST(CASE WHEN turn = 2 THEN qty - floor(qty / 2) WHEN idx % 3 = 0 THEN floor(qty / 2) ELSE idx - 1 END AS DECIMAL(18,6)) AS qty,
               CASE WHEN idx % 3 = 0 OR idx = 5 THEN 1 ELSE 0 END AS verwerkt
        FROM (SELECT name, parent, idx, item_code, item_name, qty, EXPLODE[1, 2] AS turn FROM t_quotation_item) AS e
        WHERE turn = 1 OR idx = 6""",
    # production documents, some without a date and some without rows
    "t_productie": """
        SELECT 'PROD-' || name AS name, CASE WHEN grand_total < 20000 THEN NULL ELSE transaction_date END AS datum FROM t_quotation""",
    "t_bin": """
        SELECT CAST(l_partkey AS STRING) AS item_code, 'WH-' || CAST(l_suppkey % 3 AS STRING) AS warehouse,
               CAST(sum(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN -1 ELSE 0 END * CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(18,6)) AS actual_qty,
               CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END * CAST(l_quantity AS DECIMAL(12,2)) * 0.1) AS DECIMAL(18,6)) AS ordered_qty,
               CAST(min(CAST(l_extendedprice AS DECIMAL(12,2))) * 0.013 AS DECIMAL(18,6)) AS valuation_rate
        FROM lineitem WHERE l_partkey % 8 <> 7 GROUP BY l_partkey, l_suppkey % 3""",
    "t_stock_ledger_entry": """
        SELECT CAST(l_partkey AS STRING) AS item_code,
               CAST(o_custkey AS STRING) || '-' || CAST(l_partkey AS STRING) || '-HPL' || CAST(o_orderkey % 4 AS STRING) AS batch_no,
               'WH-' || CAST(l_suppkey % 3 AS STRING) AS warehouse,
               CAST(CASE WHEN l_returnflag = 'A' THEN -1 ELSE 1 END * CAST(l_quantity AS DECIMAL(12,2)) AS DECIMAL(18,6)) AS actual_qty,
               CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS entry
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    # two halls below a root: WH-0 and WH-1 in hall 1, the rest in hall 2
    "t_warehouse": """
        SELECT 'Alle' AS name, CAST(NULL AS STRING) AS parent_warehouse, 0 AS lft, 99 AS rgt FROM region WHERE r_regionkey = 0
        UNION ALL
        SELECT 'Hal 1' AS name, 'Alle' AS parent_warehouse, 1 AS lft, 6 AS rgt FROM region WHERE r_regionkey = 0
        UNION ALL
        SELECT 'Hal 2' AS name, 'Alle' AS parent_warehouse, 7 AS lft, 90 AS rgt FROM region WHERE r_regionkey = 0
        UNION ALL
        SELECT 'WH-' || CAST(r_regionkey AS STRING) AS name, CASE WHEN r_regionkey < 2 THEN 'Hal 1' ELSE 'Hal 2' END AS parent_warehouse,
               CASE WHEN r_regionkey < 2 THEN 2 + 2 * r_regionkey ELSE 8 + 2 * r_regionkey END AS lft,
               CASE WHEN r_regionkey < 2 THEN 3 + 2 * r_regionkey ELSE 9 + 2 * r_regionkey END AS rgt
        FROM region""",
    "t_customer": """
        SELECT 'Customer#' || CAST(c_custkey AS STRING) AS name,
               CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'LEAD-' || CAST(c_custkey AS STRING) END AS lead_name,
               CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'REL-C' || CAST(c_custkey AS STRING) END AS snelstart_referentie
        FROM customer""",
    "t_lead": """
        SELECT 'LEAD-' || CAST(c_custkey AS STRING) AS name, c_name AS lead_name,
               CASE WHEN c_custkey % 37 = 1 THEN NULL WHEN c_custkey % 37 = 2 THEN 'X' || CAST(c_custkey AS STRING)
                    ELSE CAST(c_custkey AS STRING) END AS configurator_id,
               'mail' || CAST(c_custkey AS STRING) || '@example.org' AS email_id, '06-' || CAST(c_custkey AS STRING) AS mobile_no,
               CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'REL-' || CAST(c_custkey AS STRING) END AS snelstart_relatie,
               CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'KP-' || CAST(c_custkey AS STRING) END AS snelstart_kostenplaats
        FROM customer WHERE c_custkey % 4 <> 0""",
    "t_supplier": """
        SELECT 'Supplier#' || CAST(s_suppkey AS STRING) AS name, s_name AS supplier_name,
               CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE 'Inkoop ' || CAST(s_nationkey AS STRING) END AS default_price_list
        FROM supplier""",
    "t_sales_invoice": """
        SELECT 'SINV-' || CAST(o_orderkey AS STRING) AS name, 'Customer#' || CAST(o_custkey AS STRING) AS customer,
               CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_custkey AS STRING) END AS klant_referentie,
               CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE 'LEAD-' || CAST(o_custkey AS STRING) END AS lead_name,
               CAST(o_orderdate AS DATE) AS posting_date, CAST(o_totalprice AS DECIMAL(18,2)) AS grand_total,
               CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.826446 AS DECIMAL(8,6)), 2) AS DECIMAL(18,2)) AS net_total,
               CASE WHEN o_orderkey % 97 = 1 THEN NULL WHEN o_custkey % 5 = 0 THEN 'Geen' WHEN o_orderkey % 7 = 0 THEN 'Laag' ELSE 'Hoog' END AS taxes_and_charges,
               CASE WHEN o_custkey % 5 = 0 THEN CAST(0 AS DECIMAL(18,2))
                    ELSE CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.173554 AS DECIMAL(8,6)), 2) AS DECIMAL(18,2)) END AS total_taxes_and_charges,
               'Omzet ' || CAST(o_custkey % 27 AS STRING) AS snelstart_grootboek
        FROM orders WHERE o_orderstatus = 'F'""",
    "t_sales_invoice_item": """
        SELECT 'SINV-' || CAST(l_orderkey AS STRING) AS parent, l_linenumber AS idx, i.item_group,
               'QTN-' || CAST(l_orderkey AS STRING) AS quotation, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F'
        JOIN t_item AS i ON i.name = CAST(l_partkey AS STRING)""",
    "t_item_price": """
        SELECT 'PRICE-' || CAST(p_partkey AS STRING) AS name, CAST(p_partkey AS STRING) AS item_code, 'Verkoop' AS price_list,
               'EUR' AS currency, CAST(p_retailprice AS DECIMAL(18,2)) AS price_list_rate, 1 AS selling
        FROM part WHERE p_partkey % 2 = 0""",
    "t_purchase_order": """
        SELECT 'PO-' || CAST(s_suppkey AS STRING) AS name, 'Supplier#' || CAST(s_suppkey AS STRING) AS supplier,
               CASE WHEN s_suppkey % 3 = 2 THEN DATE '1999-05-31' ELSE DATE '1999-06-01' END AS transaction_date,
               CASE WHEN s_suppkey % 3 = 1 THEN 1 ELSE 0 END AS docstatus
        FROM supplier""",
    "t_purchase_order_item": """
        SELECT 'PO-' || CAST(s_suppkey AS STRING) AS parent, 1 AS idx, CAST(s_suppkey % 7 AS STRING) AS item_code, CAST(NULL AS STRING) AS supplier_part_no,
               DATE '1999-06-01' AS schedule_date, CAST(1 + s_suppkey % 4 AS DECIMAL(18,6)) AS qty, 'Stuks' AS uom, 'Stuks' AS stock_uom,
               CAST(1 AS DECIMAL(21,9)) AS conversion_factor, 'Oud' AS description, CAST(0 AS DECIMAL(18,6)) AS stock_qty
        FROM supplier""",
    "t_cost_centre": """
        SELECT 'CC-' || CAST(c_custkey AS STRING) AS id, CAST(c_custkey AS INT) AS nummer FROM customer WHERE c_custkey % 2 = 0""",
    "t_relation": """
        SELECT 'RC-' || CAST(c_custkey AS STRING) AS id, CAST(c_custkey AS STRING) AS relatiecode FROM customer WHERE c_custkey % 3 = 1""",
    "t_ledger_account": """
        SELECT 'Omzet ' || CAST(n_nationkey AS STRING) AS grootboek_naam, 'GB-' || CAST(8000 + n_nationkey AS STRING) AS grootboek_code
        FROM nation""",
    "t_voorraad_transactie": """
        SELECT 'TX-' || CAST(event_id AS STRING) AS name, ts AS creation,
               CASE WHEN event_type IN ('signup', 'view') THEN 'In' WHEN event_type = 'error' AND user_id % 10 = 0 THEN 'Retour' ELSE 'Uit' END AS transactie_type,
               CAST((event_id * 13) % ((SELECT count(*) FROM part) + 5) AS STRING) AS artikel,
               CASE WHEN event_id % 4 = 0 THEN 'Doos' ELSE 'Stuks' END AS unit,
               CAST(floor(value / 10) AS DECIMAL(18,6)) AS qty
        FROM events""",
    "t_voorraad_check": """
        SELECT 'TELLING-' || CAST(event_id AS STRING) AS name, CAST(ts AS DATE) AS posting_date,
               CAST((event_id * 17) % ((SELECT count(*) FROM part) + 7) AS STRING) AS item,
               CASE WHEN event_type = 'error' THEN NULL ELSE CAST(value AS DECIMAL(18,6)) END AS qty
        FROM events""",
    "t_klant_portaal": """
        SELECT 'PORTAAL-' || CAST(o_orderkey AS STRING) AS name,
               CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 2 = 1 THEN 'QTN-' || CAST(o_orderkey - 1 AS STRING)
                    WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 9 = 0 THEN 'QTN-OUD-' || CAST(o_orderkey AS STRING)
                    ELSE 'QTN-' || CAST(o_orderkey AS STRING) END AS offerte
        FROM orders""",
    "t_item_group": """
        SELECT DISTINCT item_group AS name,
               CASE item_group WHEN 'Modules' THEN 'MV1-' WHEN 'Accessoires' THEN 'A-' WHEN 'Basis' THEN 'B-'
                    WHEN 'HPL Onderdelen' THEN 'OH-' ELSE 'SV-' END AS item_group_code
        FROM t_item WHERE item_group <> 'Bus'""",
    "t_export_layout": """
        SELECT supplier, CAST(k AS INT) AS idx,
               CASE k WHEN 1 THEN 'Item Code' WHEN 2 THEN 'Supplier Code' WHEN 3 THEN 'Item Name' WHEN 4 THEN 'Quantity'
                    WHEN 5 THEN 'Unit' WHEN 6 THEN 'Rate' WHEN 7 THEN 'Amount' WHEN 8 THEN 'Supplier' WHEN 9 THEN 'Supplier Name'
                    WHEN 10 THEN 'Purchase Order' WHEN 11 THEN 'Transaction Date' WHEN 12 THEN 'Schedule Date' ELSE 'Kleur' END AS artikel_data
        FROM (SELECT 'Supplier#' || CAST(s_suppkey AS STRING) AS supplier, s_suppkey,
                     EXPLODE[1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13] AS k FROM supplier) AS e
        WHERE (s_suppkey + k) % 3 <> 0
        UNION ALL
        SELECT 'Supplier#' || CAST(s_suppkey AS STRING) AS supplier, 1 AS idx, 'Item Code' AS artikel_data FROM supplier WHERE s_suppkey = 1""",
    "t_journal": """
        SELECT 'JV-' || CAST(o_orderkey AS STRING) AS name, 'Customer#' || CAST(o_custkey AS STRING) AS customer,
               CAST(o_orderdate AS DATE) AS posting_date, CAST(o_totalprice AS DECIMAL(18,2)) AS grand_total
        FROM orders WHERE o_orderstatus = 'P'""",
    # order lines as configurator articles; at most seven line numbers per order
    "t_request_line": """
        SELECT l_orderkey AS orderkey, l_linenumber AS line, min(l_partkey) AS partkey,
               CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(12,2)) AS aantal,
               CAST(min(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(12,2)) AS prijs
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    # some requests are cut off or empty
    "t_quote_request": """
        SELECT 'REQ-' || CAST(o_orderkey AS STRING) AS request_id, o_orderdate AS received_at,
               CASE WHEN o_orderkey % 97 = 5 THEN '{"root":[{"configurator_id":' || CAST(o_custkey AS STRING)
                    WHEN o_orderkey % 97 = 6 THEN '{"root":[]}'
                    ELSE '{"root":[{"configurator_id":' || CAST(o_custkey AS STRING)
                      || ',"klant":"Klant ' || CAST(o_custkey AS STRING)
                      || '","contact_email":"k' || CAST(o_orderkey AS STRING) || '@example.org","contact_telefoon":"06-' || CAST(o_orderkey AS STRING)
                      || '","adres_klant":"Straat ' || CAST(o_orderkey % 100 AS STRING) || '","postcode":"' || CAST(1000 + o_orderkey % 9000 AS STRING)
                      || ' AB","plaats":"Plaats ' || CAST(o_custkey % 25 AS STRING)
                      || '","offerte_datum":"' || DATE_TEXT(o_orderdate) || 'T10:00:00","configurator_link":"https://example.org/c/' || CAST(o_orderkey AS STRING)
                      || '","screen_dump_link_1":"https://example.org/s1/' || CAST(o_orderkey AS STRING)
                      || '","screen_dump_link_2":"https://example.org/s2/' || CAST(o_orderkey AS STRING)
                      || '","basis_bedrag":' || CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING)
                      || ',"interieur_bedrag":' || CAST(o_orderkey % 1000 AS STRING)
                      || ',"styling_bedrag":' || CAST(o_custkey % 1000 AS STRING)
                      || ',"accessoires_bedrag":0,"artikelen":{"artikelen":[' || coalesce(articles, '') || ']}}]}' END AS payload
        FROM (SELECT /*+ REPARTITION(o_orderkey) */ * FROM orders) AS o LEFT JOIN (
          SELECT orderkey, CONCAT_ROWS('{"artikelen":{"sequence":' || CAST(line AS STRING) || ',"artikel_code":' || CAST(partkey AS STRING)
                   || ',"artikel_naam":"Artikel ' || CAST(partkey AS STRING) || '","helptext":"Regel ' || CAST(line AS STRING)
                   || '","variant_code":"V' || CAST(line AS STRING) || '","variant_naam":"Variant ' || CAST(line AS STRING)
                   || '","aantal":' || CAST(aantal AS STRING) || ',"artikel_prijs":' || CAST(prijs AS STRING)
                   || ',"afbeelding_link":"https://example.org/i/' || CAST(partkey AS STRING) || '"}}' ORDER BY line) AS articles
          FROM t_request_line GROUP BY orderkey) AS a ON orderkey = o_orderkey""",
    "t_artikel_variant": """
        SELECT 'V' || CAST(n_nationkey % 20 AS STRING) AS variant_code, CASE WHEN n_regionkey = 0 THEN '' ELSE n_name END AS variant_details FROM nation""",
    "t_materiaal_variant": """
        SELECT 'HPL' || CAST(r_regionkey AS STRING) AS variant_code, r_name AS variant_details FROM region""",
    "t_levertijd_categorie": """
        SELECT r_name AS levertijd_categorie, CASE WHEN r_regionkey = 2 THEN NULL ELSE CAST(r_regionkey * 0.5 AS DECIMAL(18,6)) END AS levertijd_factor FROM region""",
    "t_routing": "SELECT n_name AS name FROM nation WHERE n_nationkey % 4 <> 1",
    "t_uom": "SELECT DISTINCT uom AS name FROM t_uom_conversion_detail",
    "t_voorraad_artikelen": """
        SELECT 'PLAN-' || CAST(l_orderkey AS STRING) AS parent, l_linenumber AS idx, CAST(l_partkey + (CASE WHEN l_quantity > 49 THEN 1000000 ELSE 0 END) AS STRING) AS item_code,
               CASE WHEN l_returnflag = 'R' AND l_quantity < 2 THEN 'Supplier#oud' ELSE 'Supplier#' || CAST(l_suppkey AS STRING) END AS supplier,
               CASE WHEN l_linenumber = 7 THEN 'Pallet' ELSE 'Stuks' END AS uom
        FROM lineitem""",
    "t_handeling_activiteit": "SELECT 'Handeling ' || CAST(n_regionkey AS STRING) AS handeling FROM nation UNION ALL SELECT 'Handeling ' || r_name AS handeling FROM region",
    "t_handeling_artikelen": """
        SELECT 'Handeling ' || CAST(n_regionkey AS STRING) AS parent, n_nationkey AS idx,
               CASE WHEN n_nationkey = 3 THEN NULL ELSE n_name END AS handeling_activiteit FROM nation""",
    "t_klant_updates": """
        SELECT 'PORTAAL-' || CAST(user_id AS STRING) AS parent, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(ts AS DATE) END AS datum,
               CASE WHEN event_type = 'click' THEN '' ELSE props END AS update_tekst FROM events""",
    "t_instellingen": "SELECT CAST(67.5 AS DECIMAL(18,2)) AS standaard_uurtarief FROM region WHERE r_regionkey = 0",
    "t_report_request": """
        SELECT name AS request_id, parent AS quotation, 'BOM-' || item_code AS bom, CAST(qty AS INT) - 5 AS qty_to_produce
        FROM t_quotation_item""",
    # the same requests, each for a warehouse, a hall, one that is not in the tree, or all stock
    "t_located_request": """
        SELECT request_id, quotation, bom, qty_to_produce,
               CASE qty_to_produce % 7 WHEN 0 THEN 'Alle' WHEN 1 THEN 'Hal 1' WHEN 2 THEN 'WH-2' WHEN 3 THEN 'Hal 2'
                    WHEN 4 THEN 'Buiten' WHEN 5 THEN '' ELSE NULL END AS warehouse
        FROM t_report_request""",
}


def _dialect(sql: str, engine: str) -> str:
    if engine == "duckdb":
        sql = re.sub(r"EXPLODE\[(.*?)\]", r"unnest([\1])", sql)
        sql = re.sub(r"CONCAT_ROWS\((.*) ORDER BY (\w+)\)", r"string_agg(\1, ',' ORDER BY \2)", sql, flags=re.S)
    else:
        sql = re.sub(r"EXPLODE\[(.*?)\]", r"explode(array(\1))", sql)
        sql = re.sub(r"CONCAT_ROWS\((.*) ORDER BY (\w+)\)", r"listagg(\1, ',') WITHIN GROUP (ORDER BY \2)", sql, flags=re.S)
    return re.sub(r"DATE_TEXT\((\w+)\)", r"CAST(CAST(\1 AS DATE) AS STRING)", sql)


def _needed(sql: str, found: dict[str, None]) -> None:
    """Collect the ERP tables a SQL text mentions, dependencies first."""
    for name in re.findall(r"\bt_[a-z_]+\b", sql):
        if name in VIEWS and name not in found:
            _needed(VIEWS[name], found)
            found[name] = None


def with_views(sql: str) -> str:
    """Put the definitions of all ERP tables a DuckDB query mentions in front of it."""
    found: dict[str, None] = {}
    _needed(sql, found)
    parts = [f"{name} AS ({_dialect(VIEWS[name], "duckdb")})" for name in found]
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join([*parts, body[5:]])
    return "WITH " + ",\n".join(parts) + "\n" + body


class DerivedTables(Mapping[str, DataFrame]):
    """The ERP tables over a folder of star-schema parquet files, lazily.

    Raw and derived tables are temporary views of the session, named after the folder,
    so that a table is listed and analysed once per session.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self._spark = spark
        self._folder = folder.rstrip("/")
        self._prefix = "bomwerk_" + re.sub(r"\W", "_", self._folder).lower() + "_"

    def _view(self, name: str) -> str:
        view = self._prefix + name
        if not self._spark.catalog.tableExists(view):
            if name in RAW:
                rows = self._spark.read.parquet(f"{self._folder}/{name}.parquet")
            else:
                rows = self._spark.sql(self._over_views(_dialect(VIEWS[name], "spark")))
            rows.createOrReplaceTempView(view)
        return view

    def _over_views(self, query: str) -> str:
        """Point the table names of a query (after FROM and JOIN) at the session's views."""
        return re.sub(
            r"\b(FROM|JOIN) (\w+)",
            lambda found: f"{found[1]} {self._view(found[2])} AS {found[2]}"
            if not re.match(r"\s+AS\b", query[found.end():])
            else f"{found[1]} {self._view(found[2])}",
            query,
        )

    def __getitem__(self, name: str) -> DataFrame:
        if f"t_{name}" not in VIEWS:
            raise KeyError(name)
        return self._spark.table(self._view(f"t_{name}"))

    def __iter__(self) -> Iterator[str]:
        return (name[2:] for name in VIEWS)

    def __len__(self) -> int:
        return len(VIEWS)
