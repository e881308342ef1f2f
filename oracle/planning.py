"""Planning, written as the plain join of all tables with one GROUP BY."""

# open quotation lines joined with everything, fanned out by suppliers, bins and units
FANNED = """
WITH todo AS (
  SELECT li.parent, li.idx, li.item_code, li.item_name, li.qty - coalesce(p.done, 0) AS todo
  FROM t_quotation_item li
  JOIN t_quotation q ON q.name = li.parent
  LEFT JOIN (SELECT quotation_item, sum(qty) AS done FROM t_productie_module GROUP BY ALL) p ON p.quotation_item = li.name
  WHERE li.docstatus = 1 AND q.voorraadplanning_compleet <> 1
    AND lower(q.vj_status) IN ('klant aanbetaald', 'klant besteld', 'in productie')
    AND li.qty - coalesce(p.done, 0) > 0),
wide AS (
  SELECT i.name AS item_code, i.item_name, i.purchase_uom, x.stock_uom, u.conversion_factor AS cf, i.safety_stock, i.min_order_qty,
         CAST(x.stock_qty AS DECIMAL(12,4)) * CAST(t.todo AS DECIMAL(14,4)) AS need, s.actual_qty, s.ordered_qty, v.supplier, v.supplier_part_no,
         t.parent, t.idx, t.todo, t.item_name AS product_name, b.name AS bom
  FROM todo t
  JOIN t_bom b ON b.item = t.item_code AND b.docstatus = 1 AND b.is_default = 1 AND b.is_active = 1
  JOIN t_bom_explosion_item x ON x.parent = b.name
  JOIN t_item i ON i.name = x.item_code AND i.bakje_bakje <> 1 AND i.disabled <> 1
   AND i.item_group NOT IN ('HPL Onderdelen', 'Meubelstoffen', 'Gordijnstoffen', 'Vloer Onderdelen')
  JOIN t_uom_conversion_detail u ON u.parent = i.name AND u.uom = i.purchase_uom
  JOIN t_item_supplier v ON v.parent = i.name
  LEFT JOIN t_bin s ON s.item_code = i.name)"""

GROUPED = FANNED + """,
grouped AS (
  SELECT item_code, item_name, max(purchase_uom) AS uom, max(stock_uom) AS stock_uom, max(cf) AS conversion_factor, safety_stock, min_order_qty,
         sum(need) AS req_qty, greatest(coalesce(max(actual_qty), 0), 0) AS stock_qty,
         greatest(coalesce(max(ordered_qty), 0), 0) AS order_qty, max(supplier) AS supplier, max(supplier_part_no) AS supplier_part_no
  FROM wide GROUP BY item_code, item_name, safety_stock, min_order_qty),
planned AS (
  SELECT *, CAST(stock_qty + order_qty - req_qty AS DOUBLE) AS x,
         CASE WHEN stock_qty + order_qty - req_qty >= safety_stock THEN 0
              WHEN abs(CAST(stock_qty + order_qty - req_qty AS DOUBLE)) + CAST(safety_stock AS DOUBLE) / CAST(conversion_factor AS DOUBLE) < min_order_qty THEN CAST(min_order_qty AS DOUBLE)
              ELSE ceil((abs(CAST(stock_qty + order_qty - req_qty AS DOUBLE)) + CAST(safety_stock AS DOUBLE)) / CAST(conversion_factor AS DOUBLE)) END AS qty
  FROM grouped)"""

COLUMNS = (
    "s: item_code item_name uom stock_uom n: conversion_factor safety_stock min_order_qty req_qty stock_qty "
    "order_qty qty s: supplier supplier_part_no"
)
DEMAND = f"""{COLUMNS}
{GROUPED}
--main
SELECT * FROM planned"""
BALANCE = f"""s: item_code n: balance s: status
{GROUPED}
--main
SELECT item_code, round(stock_qty + order_qty - req_qty, 2) AS balance, CASE WHEN x < 0 THEN 'red' ELSE 'green' END AS status FROM planned"""
# without the fan-out the three joined tables become existence checks and subqueries
EXACT = DEMAND.replace(
    "FROM wide GROUP BY",
    "FROM (SELECT * REPLACE (need / count(*) OVER (PARTITION BY item_code, bom, parent, idx) AS need) FROM wide) AS once GROUP BY",
).replace("sum(need) AS req_qty", "CAST(round(sum(need), 4) AS DECIMAL(18,4)) AS req_qty")
PEGGED = FANNED + """,
pegged AS (
  SELECT DISTINCT item_code, parent AS quotation, idx, CAST(round(todo, 2) AS DECIMAL(18,2)) AS todo, product_name AS item_name,
         CAST(round(need, 2) AS DECIMAL(18,2)) AS need, bom FROM wide)"""
PEGGING_ROWS = f"""s: item_code quotation i: idx n: todo s: item_name n: need s: bom
{PEGGED}
--main
SELECT * FROM pegged"""
TEXTS = PEGGED + """,
lines AS (
  SELECT item_code, quotation, idx, 'Offerte : ' || quotation || ' Regel : ' || CAST(idx AS VARCHAR) || ' - ' || CAST(todo AS VARCHAR) || ' X ' || item_name
         || ' - Aantal Onderdelen = ' || CAST(need AS VARCHAR) || ' ID : ' || bom AS text FROM pegged),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_code ORDER BY quotation, idx, text) AS n FROM lines),
texts AS (
  SELECT item_code, (n - 1) // 1000 + 1 AS part, string_agg(text, '<br>' ORDER BY n) AS bom_item FROM ranked GROUP BY ALL)"""
PEGGING = f"""s: item_code bom_item i: part
{TEXTS}
--main
SELECT * FROM texts"""

GUARD = """NOT EXISTS (SELECT 1 FROM t_bom_explosion_item x JOIN t_bom b ON b.name = x.parent
   WHERE NOT EXISTS (SELECT 1 FROM t_quotation_item li WHERE li.item_code = b.item AND li.docstatus = 1))"""
PER_ITEM = """i.name NOT IN (SELECT x.item_code FROM t_bom_explosion_item x JOIN t_bom b ON b.name = x.parent
   WHERE NOT EXISTS (SELECT 1 FROM t_quotation_item li WHERE li.item_code = b.item AND li.docstatus = 1))"""


def replenish_select(stocked: bool, two_bin: bool, guard: str) -> str:
    stock = "sum(s.actual_qty)" if stocked else "CAST(0 AS DECIMAL(18,6))"
    ordered = "sum(s.ordered_qty)" if stocked else "CAST(0 AS DECIMAL(18,6))"
    return f"""
  SELECT i.name AS item_code, i.item_name, i.purchase_uom AS uom, i.stock_uom,
         CASE WHEN max(u.conversion_factor) > 0 THEN max(u.conversion_factor) ELSE 1 END AS conversion_factor,
         i.min_order_qty, {ordered} AS ordered_qty, i.safety_stock, {stock} AS stock_qty,
         CASE WHEN CAST({stock} - i.safety_stock AS DOUBLE) > CAST(i.min_order_qty AS DOUBLE) * CAST(max(u.conversion_factor) AS DOUBLE)
              THEN ceil(abs(CAST({stock} - i.safety_stock AS DOUBLE)) / CAST(max(u.conversion_factor) AS DOUBLE))
              ELSE CAST(i.min_order_qty AS DOUBLE) END AS order_qty,
         max(v.supplier) AS supplier, max(v.supplier_part_no) AS supplier_part_no, round({stock} - i.safety_stock, 2) AS shortage
  FROM t_item i JOIN t_uom_conversion_detail u ON u.parent = i.name AND u.uom = i.purchase_uom
  JOIN t_item_supplier v ON v.parent = i.name {'JOIN t_bin s ON s.item_code = i.name' if stocked else ''}
  WHERE i.is_stock_item = 1 AND i.safety_stock > 0 AND i.disabled <> 1 AND i.bakje_bakje {'=' if two_bin else '<>'} 1
    AND i.item_group NOT IN ('HPL Onderdelen', 'Meubelstoffen', 'Gordijnstoffen', 'Vloer Onderdelen')
    AND NOT EXISTS (SELECT 1 FROM t_bom b WHERE b.item = i.name)
    {'' if stocked else 'AND NOT EXISTS (SELECT 1 FROM t_bin s WHERE s.item_code = i.name)'} {guard and 'AND ' + guard}
  GROUP BY i.name, i.item_name, i.purchase_uom, i.stock_uom, i.min_order_qty, i.safety_stock
  HAVING {stock} - i.safety_stock < 0"""


BRANCHES = {
    "stocked": replenish_select(True, False, GUARD),
    "unstocked": replenish_select(False, False, GUARD),
    "bin_stocked": replenish_select(True, True, ""),
    "bin_unstocked": replenish_select(False, True, ""),
}
REPLENISH_COLUMNS = (
    "s: item_code item_name uom stock_uom n: conversion_factor min_order_qty ordered_qty safety_stock stock_qty "
    "order_qty s: supplier supplier_part_no n: shortage"
)
SHEET = TEXTS + GROUPED.removeprefix(FANNED) + "".join(
    f",\n{name} AS ({sql})" for name, sql in BRANCHES.items()
) + """,
sheet AS (
  SELECT 'demand' AS source, item_code, item_name, uom, stock_uom, safety_stock, min_order_qty, conversion_factor, req_qty, stock_qty, order_qty,
         round(stock_qty + order_qty - req_qty, 2) AS balance, CASE WHEN x < 0 THEN 'red' ELSE 'green' END AS status, qty, supplier, supplier_part_no
  FROM planned""" + "".join(
    f"""
  UNION ALL
  SELECT '{name}', item_code, item_name, uom, stock_uom, safety_stock, min_order_qty, conversion_factor, NULL, stock_qty, ordered_qty,
         shortage, 'red', order_qty, supplier, supplier_part_no FROM {name}"""
    for name in BRANCHES
) + ")"
LINES = SHEET + """,
po AS (
  SELECT * FROM sheet WHERE supplier <> '' AND qty > 0
    AND supplier NOT IN (SELECT supplier FROM t_purchase_order WHERE docstatus = 0 AND transaction_date = DATE '1999-06-01'))"""

QUERIES = {
    "planning_demand": DEMAND,
    "planning_balance": BALANCE,
    "planning_demand_exact": EXACT,
    "planning_pegging_rows": PEGGING_ROWS,
    "planning_pegging": PEGGING,
    "replenish_stocked": f"{REPLENISH_COLUMNS}\n{BRANCHES['stocked']}",
    "replenish_unstocked": f"{REPLENISH_COLUMNS}\n{BRANCHES['unstocked']}",
    "replenish_bin_stocked": f"{REPLENISH_COLUMNS}\n{BRANCHES['bin_stocked']}",
    "replenish_bin_unstocked": f"{REPLENISH_COLUMNS}\n{BRANCHES['bin_unstocked']}",
    "replenish_stocked_per_item": f"{REPLENISH_COLUMNS}\n{replenish_select(True, False, PER_ITEM)}",
    "planning_sheet": f"""s: source item_code item_name uom stock_uom n: safety_stock min_order_qty conversion_factor req_qty stock_qty order_qty balance s: status n: qty s: supplier supplier_part_no
{SHEET}
--main
SELECT * FROM sheet""",
    "planning_sheet_pegging": f"""s: source item_code i: part s: bom_item
{SHEET}
--main
SELECT s.source, t.* FROM texts t JOIN sheet s ON s.source = 'demand' AND s.item_code = t.item_code""",
    "purchase_order_lines": f"""s: supplier source item_code supplier_part_no d: schedule_date n: qty s: uom stock_uom n: conversion_factor s: description n: stock_qty
{LINES}
--main
SELECT supplier, source, item_code, supplier_part_no, DATE '1999-06-01' AS schedule_date, qty, uom, stock_uom, conversion_factor,
       item_name AS description, 0 AS stock_qty FROM po""",
    "purchase_order_headers": f"""s: supplier d: transaction_date s: buying_price_list apply_discount_on n: additional_discount_percentage discount_amount i: line_count
{LINES}
--main
SELECT p.supplier, DATE '1999-06-01' AS transaction_date, max(s.default_price_list) AS buying_price_list, '' AS apply_discount_on,
       0 AS additional_discount_percentage, 0 AS discount_amount, count(*) AS line_count
FROM po p LEFT JOIN t_supplier s ON s.name = p.supplier GROUP BY p.supplier""",
}
