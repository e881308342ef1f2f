"""Supply planning: demand of open quotations, safety stock, purchase orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomwerk.functions.columns import (
    MONEY,
    QTY,
    SUM,
    at_least_zero,
    ceil_div,
    filled,
    isin_ci,
    money,
    qty,
)
from bomwerk.operators.dimensions import (
    Tables,
    active_boms,
    bins_per_item,
    components,
    excluding,
    purchasable,
)
from bomwerk.operators.lookup import join_on_key
from bomwerk.operators.ranking import numbered
from bomwerk.operators.shared import once

# Fixed values of the ERP: quotation states that need material, item groups bought elsewhere.
STATUSES = ("Klant Aanbetaald", "Klant besteld", "In productie")
EXCLUDED_GROUPS = ("HPL Onderdelen", "Meubelstoffen", "Gordijnstoffen", "Vloer Onderdelen")

LINES_PER_PART = 1000

SHEET_COLUMNS = (
    "item_code", "item_name", "uom", "stock_uom", "safety_stock", "min_order_qty",
    "conversion_factor", "req_qty", "stock_qty", "order_qty", "balance", "status", "qty", "supplier",
    "supplier_part_no",
)


def open_lines(tables: Tables, statuses: Sequence[str] = STATUSES) -> DataFrame:
    """Submitted quotation lines with something left to make.

    Production rows count whatever their state (the production sheet itself counts
    submitted ones only).
    """
    quotations = (
        tables["quotation"]
        .filter((F.col("voorraadplanning_compleet") != 1) & isin_ci(F.col("vj_status"), statuses))
        .select(F.col("name").alias("parent"))
    )
    done = (
        tables["productie_module"]
        .filter(F.col("quotation_item").isNotNull())
        .groupBy(F.col("quotation_item").alias("quotation_item"))
        .agg(F.sum("qty").alias("done"))
    )
    lines = (
        tables["quotation_item"]
        .filter(F.col("docstatus") == 1)
        .select(F.col("name").alias("quotation_item"), "parent", "idx", "item_code", "item_name", "qty")
        .join(quotations, "parent", "left_semi")
        .join(done, "quotation_item", "left")
    )
    todo = (F.col("qty") - F.coalesce("done", F.lit(0))).cast("decimal(19,6)")
    return lines.withColumn("todo", todo).filter(F.col("todo") > 0).select(
        "quotation_item", F.col("parent").alias("quotation"), "idx", F.col("item_code").alias("product"),
        "item_name", "todo",
    )


def planned_items(tables: Tables, excluded_groups: Sequence[str]) -> DataFrame:
    """Items the demand planning orders."""
    items = tables["item"].filter((F.col("bakje_bakje") != 1) & (F.col("disabled") != 1))
    items = excluding(items, excluded_groups).select(
        F.col("name").alias("item_code"), "item_name", "purchase_uom", "safety_stock", "min_order_qty"
    )
    return purchasable(tables, items)


def _demand(
    tables: Tables, statuses: Sequence[str], excluded_groups: Sequence[str], fan_out: bool
) -> DataFrame:
    """Need against availability per component, with ``balance_qty`` = available - needed.

    Open quantities are added up per product before the explosion, so the exploded
    rows number products x components, not quotation lines x components.
    """
    per_product = open_lines(tables, statuses).groupBy("product").agg(
        F.sum("todo").cast("decimal(19,6)").alias("todo")
    )
    need = (
        join_on_key(components(tables).join(active_boms(tables), "bom"), per_product, {"product": "product"}, "inner")
        .groupBy("item_code")
        .agg(
            qty(F.sum(F.col("per_unit") * F.col("todo"))).alias("need"),
            F.max("stock_uom").alias("stock_uom"),
        )
    )
    rows = (
        need.join(planned_items(tables, excluded_groups), "item_code")
        .join(bins_per_item(tables), "item_code", "left")
    )
    copies = F.lit(1)
    if fan_out:
        # the reference joins suppliers, bins and units before summing, so a need
        # counts once per combination
        copies = F.col("n_supplier") * F.col("n_unit") * F.coalesce("n_bin", F.lit(1))
    stock, ordered = at_least_zero(F.col("max_actual")), at_least_zero(F.col("max_ordered"))
    return rows.select(
        "item_code",
        "item_name",
        F.col("purchase_uom").alias("uom"),
        "stock_uom",
        "conversion_factor",
        "safety_stock",
        "min_order_qty",
        qty(F.col("need") * copies.cast("decimal(12,0)")).alias("req_qty"),
        qty(stock).alias("stock_qty"),
        qty(ordered).alias("order_qty"),
        "supplier",
        "supplier_part_no",
    ).withColumn("balance_qty", qty(F.col("stock_qty") + F.col("order_qty") - F.col("req_qty")))


def _demand_qty() -> Column:
    """Order proposal. The threshold divides only the safety stock by the factor, the
    proposal divides everything; both are written without a division."""
    balance, safety = F.abs("balance_qty"), F.col("safety_stock")
    factor, least = F.nullif(F.col("conversion_factor"), F.lit(0)), F.col("min_order_qty")
    # narrow enough for products with all 15 decimals
    exact, by = "decimal(19,6)", factor.cast("decimal(17,9)")
    below_least = balance.cast(exact) * by + safety < least.cast(exact) * by
    proposal = F.when(below_least, least.cast(SUM)).otherwise(ceil_div(balance + safety, factor).cast(SUM))
    return F.when(F.col("balance_qty") < safety, proposal).otherwise(F.lit(0).cast(SUM))


def planning_demand(
    tables: Tables,
    statuses: Sequence[str] = STATUSES,
    excluded_groups: Sequence[str] = EXCLUDED_GROUPS,
    fan_out: bool = True,
) -> DataFrame:
    """Per component: need, availability and proposed order quantity."""
    return _demand(tables, statuses, excluded_groups, fan_out).withColumn("qty", _demand_qty()).drop("balance_qty")


def planning_demand_exact(tables: Tables, **params) -> DataFrame:
    """As ``planning_demand``, each need counted once."""
    return planning_demand(tables, fan_out=False, **params)


def _balance() -> list[Column]:
    return [
        F.round("balance_qty", 2).cast("decimal(38,2)").alias("balance"),
        F.when(F.col("balance_qty") < 0, "red").otherwise("green").alias("status"),
    ]


def planning_balance(
    tables: Tables, statuses: Sequence[str] = STATUSES, excluded_groups: Sequence[str] = EXCLUDED_GROUPS
) -> DataFrame:
    """Availability minus need, with its colour."""
    return _demand(tables, statuses, excluded_groups, True).select("item_code", *_balance())


def planning_pegging_rows(
    tables: Tables, statuses: Sequence[str] = STATUSES, excluded_groups: Sequence[str] = EXCLUDED_GROUPS
) -> DataFrame:
    """Which quotation line causes which need: one row per component and line.

    Repeated bill-of-material lines are removed on the small side before the join, so
    the large result needs no distinct.
    """
    wanted = planned_items(tables, excluded_groups).select("item_code")
    lines = components(tables).join(active_boms(tables), "bom")
    per_product = (
        join_on_key(lines, wanted, {"item_code": "item_code"}, "left_semi")
        .select("product", "bom", "item_code", "per_unit")
        .distinct()
    )
    need = F.col("per_unit") * F.col("todo")
    return open_lines(tables, statuses).join(per_product, "product").select(
        "item_code",
        "quotation",
        "idx",
        F.round("todo", 2).cast(MONEY).alias("todo"),
        "item_name",
        F.round(need, 2).cast("decimal(38,2)").alias("need"),
        "bom",
    )


def planning_pegging(
    tables: Tables,
    statuses: Sequence[str] = STATUSES,
    excluded_groups: Sequence[str] = EXCLUDED_GROUPS,
    separator: str = "<br>",
    lines_per_part: int = LINES_PER_PART,
) -> DataFrame:
    """The pegging of a component as text, in quotation order.

    A text holds ``lines_per_part`` lines; a component with more gets further parts,
    so no task ever gathers all lines of a hot component and none are lost.
    """
    # fixed values of the ERP: the words of the text
    text = F.concat(
        F.lit("Offerte : "), "quotation", F.lit(" Regel : "), F.col("idx").cast("string"),
        F.lit(" - "), F.col("todo").cast("string"), F.lit(" X "), "item_name",
        F.lit(" - Aantal Onderdelen = "), F.col("need").cast("string"), F.lit(" ID : "), "bom",
    )
    lines = (
        planning_pegging_rows(tables, statuses, excluded_groups)
        .select("item_code", "quotation", "idx", text.alias("text"))
        .filter(F.col("text").isNotNull())
    )
    part = F.floor((F.col("position") - 1) / lines_per_part) + 1
    in_order = F.array_sort(F.collect_list(F.struct("position", "text")))
    return (
        numbered(lines, ["item_code"], ["quotation", "idx", "text"])
        .groupBy("item_code", part.alias("part"))
        .agg(F.array_join(F.transform(in_order, lambda line: line["text"]), separator).alias("bom_item"))
    )


def _uncovered_boms(tables: Tables) -> DataFrame:
    """Bills of material, with exploded lines, of products nobody has a submitted quotation for."""
    quoted = tables["quotation_item"].filter(F.col("docstatus") == 1).select("item_code").distinct()
    boms = tables["bom"].select(F.col("name").alias("bom"), F.col("item").alias("product"))
    exploded = tables["bom_explosion_item"].select(F.col("parent").alias("bom")).distinct()
    return boms.join(exploded, "bom", "left_semi").join(quoted, F.col("product") == F.col("item_code"), "left_anti")


def replenishment(
    tables: Tables,
    two_bin: bool | None = None,
    stocked: bool | None = None,
    guard: str = "global",
    excluded_groups: Sequence[str] = EXCLUDED_GROUPS,
) -> DataFrame:
    """Items below their safety stock that are no product of a bill of material.

    ``two_bin`` and ``stocked`` (has any bin) choose one of four sources, None takes both
    sides in the same pass; ``source`` names it. ``guard`` concerns items that are not
    two-bin: ``global`` returns none while any unquoted product has an exploded bill of
    material (what the reference does), ``per_item`` leaves out the components of such
    products, ``off`` does neither.
    """
    is_two_bin, has_bin = F.col("bakje_bakje") == 1, F.col("n_bin").isNotNull()
    items = tables["item"].filter(
        (F.col("is_stock_item") == 1)
        & (F.col("safety_stock") > 0)
        & (F.col("disabled") != 1)
        & F.col("bakje_bakje").isNotNull()
    )
    if two_bin is not None:
        items = items.filter(is_two_bin if two_bin else ~is_two_bin)
    items = excluding(items, excluded_groups).select(
        F.col("name").alias("item_code"), "item_name", "stock_uom", "purchase_uom", "safety_stock", "min_order_qty",
        "bakje_bakje",
    )
    products = tables["bom"].select(F.col("item").alias("item_code")).distinct()
    rows = purchasable(tables, items).join(products, "item_code", "left_anti")
    rows = rows.join(bins_per_item(tables), "item_code", "left")
    if stocked is not None:
        rows = rows.filter(has_bin if stocked else ~has_bin)
    if guard == "per_item":
        blocked = components(tables).join(_uncovered_boms(tables), "bom", "left_semi")
        blocked = blocked.select("item_code", F.lit(True).alias("blocked")).distinct()
        rows = rows.join(blocked, "item_code", "left").filter(is_two_bin | F.col("blocked").isNull())
    elif guard == "global" and two_bin is not True:
        rows = rows.filter(is_two_bin | ~_uncovered_boms(tables).exists())
    # sums count once per supplier and unit row, as the reference joins before it sums
    copies = (F.col("n_supplier") * F.col("n_unit")).cast("decimal(12,0)")
    nothing = F.lit(0).cast(SUM)
    rows = rows.withColumn("stock_qty", F.when(has_bin, qty(F.col("sum_actual") * copies)).otherwise(nothing))
    rows = rows.withColumn("ordered_qty", F.when(has_bin, qty(F.col("sum_ordered") * copies)).otherwise(nothing))
    factor, least = F.col("conversion_factor"), F.col("min_order_qty")
    short = F.col("stock_qty") - F.col("safety_stock")
    order = F.when(short > least * factor, ceil_div(F.abs(short), factor).cast(SUM)).otherwise(least.cast(SUM))
    source = F.concat(F.when(is_two_bin, "bin_").otherwise(""), F.when(has_bin, "stocked").otherwise("unstocked"))
    return rows.filter(short < 0).select(
        source.alias("source"),
        "item_code",
        "item_name",
        F.col("purchase_uom").alias("uom"),
        "stock_uom",
        F.when(factor > 0, factor).otherwise(F.lit(1).cast("decimal(21,9)")).alias("conversion_factor"),
        "min_order_qty",
        "ordered_qty",
        "safety_stock",
        "stock_qty",
        order.alias("order_qty"),
        "supplier",
        "supplier_part_no",
        F.round(short, 2).cast("decimal(38,2)").alias("shortage"),
    )


def replenish_stocked(tables: Tables, **params) -> DataFrame:
    return replenishment(tables, two_bin=False, stocked=True, **params).drop("source")


def replenish_unstocked(tables: Tables, **params) -> DataFrame:
    return replenishment(tables, two_bin=False, stocked=False, **params).drop("source")


def replenish_bin_stocked(tables: Tables, **params) -> DataFrame:
    return replenishment(tables, two_bin=True, stocked=True, **params).drop("source")


def replenish_bin_unstocked(tables: Tables, **params) -> DataFrame:
    return replenishment(tables, two_bin=True, stocked=False, **params).drop("source")


def _sheet_rows(tables: Tables, guard: str) -> DataFrame:
    """The sheet with all its columns."""
    def build() -> DataFrame:
        demand = (
            _demand(tables, STATUSES, EXCLUDED_GROUPS, True)
            .withColumn("qty", _demand_qty())
            .select("*", *_balance())
            .drop("balance_qty")
            .withColumn("source", F.lit("demand"))
        )
        # the sheet shows what is on order as order_qty and the proposal as qty
        names = {"order_qty": "qty", "ordered_qty": "order_qty", "shortage": "balance"}
        below_safety = replenishment(tables, guard=guard).withColumnsRenamed(names).withColumn("status", F.lit("red"))
        return demand.unionByName(below_safety, allowMissingColumns=True)

    return once(tables, f"planning sheet {guard}", build)


def planning_sheet(tables: Tables, guard: str = "global") -> DataFrame:
    """All proposals in one schema, with the source each came from.

    The pegging text is a child table, ``planning_sheet_pegging``.
    """
    return _sheet_rows(tables, guard).select("source", *SHEET_COLUMNS)


def planning_sheet_pegging(tables: Tables, lines_per_part: int = LINES_PER_PART) -> DataFrame:
    """The pegging texts of the sheet: a row for each part of each row. Only demand has any."""
    return planning_pegging(tables, lines_per_part=lines_per_part).select(F.lit("demand").alias("source"), "item_code", "part", "bom_item")


def purchase_order_lines(tables: Tables, delivery_date: str, guard: str = "global", sheet: DataFrame | None = None) -> DataFrame:
    """Sheet rows to order, for suppliers without a draft order on the delivery date.

    ``sheet`` has the rows of a planning sheet made before; without one it is planned here.
    """
    day = F.lit(delivery_date).cast("date")
    drafts = (
        tables["purchase_order"]
        .filter((F.col("docstatus") == 0) & (F.col("transaction_date") == day))
        .select("supplier")
        .distinct()
    )
    sheet = _sheet_rows(tables, guard) if sheet is None else sheet
    wanted = sheet.filter(filled(F.col("supplier")) & (F.col("qty") > 0))
    return join_on_key(wanted, drafts, {"supplier": "supplier"}, "left_anti").select(
        "supplier",
        "source",
        "item_code",
        "supplier_part_no",
        day.alias("schedule_date"),
        "qty",
        "uom",
        "stock_uom",
        "conversion_factor",
        F.col("item_name").alias("description"),
        # the reference subtracts the quantity from itself
        F.lit(0).cast(QTY).alias("stock_qty"),
    )


def purchase_order_headers(tables: Tables, delivery_date: str, guard: str = "global") -> DataFrame:
    """One order per supplier with lines."""
    price_lists = tables["supplier"].select(
        F.col("name").alias("supplier"),
        F.when(filled(F.col("default_price_list")), F.col("default_price_list")).alias("buying_price_list"),
    )
    return (
        purchase_order_lines(tables, delivery_date, guard)
        .groupBy("supplier")
        .agg(F.count("*").alias("line_count"))
        .join(price_lists, "supplier", "left")
        .select(
            "supplier",
            F.lit(delivery_date).cast("date").alias("transaction_date"),
            "buying_price_list",
            F.lit("").alias("apply_discount_on"),
            F.lit(0).cast(MONEY).alias("additional_discount_percentage"),
            money(F.lit(0).cast(MONEY)).alias("discount_amount"),
            "line_count",
        )
    )
