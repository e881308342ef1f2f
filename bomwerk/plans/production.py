"""Production: open modules, material checks, issues from stock and their postings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomwerk.functions.columns import MONEY, filled, floor_div, isin_ci, money, qty, ratio
from bomwerk.operators.dimensions import (
    Tables,
    active_boms,
    batch_ledger,
    bins_per_item,
    bom_per_product,
    component_needs,
    components,
)
from bomwerk.operators.lookup import lookup, one_per_key
from bomwerk.operators.mutate import delete_where, update_by_key
from bomwerk.operators.postings import STOCK, WORK_COST, memo_documents, postings

# Fixed values of the ERP.
MODULE_GROUPS = ("Modules", "Accessoires", "Basis")
IN_PRODUCTION = "In Productie"

MODULE_COLUMNS = ("quotation", "quotation_item", "idx", "klant", "item_code", "bom", "label", "besteld", "klaar", "due")


def _modules(tables: Tables, groups: Sequence[str], status: str) -> DataFrame:
    """Open modules with the customer reference and panel variant of their quotation."""
    quotations = (
        tables["quotation"]
        .filter((F.col("docstatus") == 1) & isin_ci(F.col("vj_status"), [status]))
        .select(
            F.col("name").alias("quotation"),
            F.col("customer_name").alias("klant"),
            F.add_months("transaction_date", F.col("levertijd")).alias("due"),
            F.col("klant_referentie").alias("ref"),
            F.col("hpl_variant").alias("variant"),
        )
    )
    made = (
        tables["productie_module"]
        .filter((F.col("docstatus") == 1) & F.col("quotation_item").isNotNull())
        .groupBy("quotation_item")
        .agg(F.sum("qty").alias("made"))
    )
    lines = (
        tables["quotation_item"]
        .filter(isin_ci(F.col("item_group"), groups))
        .select(
            F.col("name").alias("quotation_item"), F.col("parent").alias("quotation"), "idx", "item_code",
            "item_name", "variant_code", F.col("qty").alias("besteld"),
        )
    )
    label = F.when(
        F.col("variant_code").isNotNull(), F.concat("item_name", F.lit(" ("), "variant_code", F.lit(")"))
    ).otherwise(F.col("item_name"))
    # made is counted once per active bill of material of the product
    klaar = qty(F.coalesce("made", F.lit(0)) * F.col("n_bom").cast("decimal(10,0)"))
    lines = (
        lines.join(quotations, "quotation")
        .join(made, "quotation_item", "left")
    )
    lines = lookup(
        lines, bom_per_product(tables), {"item_code": "product"}, {"bom": "bom", "n_bom": "n_bom"}, how="inner"
    )
    return (
        lines.withColumn("klaar", klaar)
        .filter(F.col("klaar") < F.col("besteld"))
        .withColumn("label", label)
        .withColumn("todo", (F.col("besteld") - F.col("klaar")).cast("decimal(19,6)"))
    )


def open_modules(
    tables: Tables, groups: Sequence[str] = MODULE_GROUPS, status: str = IN_PRODUCTION
) -> DataFrame:
    """Ordered modules not fully produced, with the date they are due."""
    return _modules(tables, groups, status).select(*MODULE_COLUMNS)


def in_due_order(modules: DataFrame) -> DataFrame:
    """The order of the production sheet, for a sink that wants one."""
    return modules.orderBy(F.col("due").asc_nulls_first(), "klant", "idx", "item_code")


def check_parts(
    tables: Tables,
    plain_without_subassemblies: bool = True,
    direct_quantity: str = "qty",
    asked: DataFrame | None = None,
    nodes: DataFrame | None = None,
) -> DataFrame:
    """Per (bom, component): its kind, quantity per unit and largest positive bin.

    ``plain`` and ``batch`` come from the exploded lines, ``subassembly`` from the
    direct ones. Bins are joined here, on the side that grows with the catalogue,
    not on the exploded orders. With ``asked``, distinct pairs (node, bom), the parts are
    those of the pairs and the bins those of the warehouse ``nodes``.
    """
    flags = tables["item"].filter(F.col("bakje_bakje") != 1).select(
        F.col("name").alias("item_code"), "has_batch_no", "sub_assembly_voorraad"
    )
    batch, loose = F.col("has_batch_no") == 1, F.col("has_batch_no") != 1
    plain = loose & (F.col("sub_assembly_voorraad") != 1) if plain_without_subassemblies else loose
    exploded = (
        component_needs(tables)
        .join(flags, "item_code")
        .withColumn("kind", F.when(batch, "batch").when(plain, "plain"))
        .filter(F.col("kind").isNotNull())
    )
    direct = (
        component_needs(tables, direct=True, quantity=direct_quantity)
        .join(flags, "item_code")
        .filter(loose & (F.col("sub_assembly_voorraad") == 1))
        .withColumn("kind", F.lit("subassembly"))
    )
    stock = bins_per_item(tables, only_positive=True, nodes=nodes)
    parts = exploded.unionByName(direct).select("bom", "item_code", "component_name", "per_unit", "kind")
    if asked is None:
        return lookup(parts, stock, {"item_code": "item_code"}, {"max_actual": "max_actual"})
    return lookup(asked.join(parts, "bom"), stock, {"node": "node", "item_code": "item_code"}, {"max_actual": "max_actual"})


def from_ledger(needs: DataFrame, tables: Tables, nodes: DataFrame | None = None) -> DataFrame:
    """Add ``actual_qty`` and ``enough`` to batch items: the unfloored share of the need
    that the ledger of this customer and variant covers."""
    needs = needs.withColumn("_ref", F.lower("ref")).withColumn("_variant", F.lower("variant"))
    batch_of = {"_ref": "ref", "_variant": "variant", "item_code": "item_code"} | ({} if nodes is None else {"node": "node"})
    items = tables["item"].filter(F.col("has_batch_no") == 1).select(F.col("name").alias("item_code"))
    needs = lookup(needs, batch_ledger(tables, nodes, items), batch_of, {"ledger_qty": "ledger_qty"})
    booked = F.coalesce("ledger_qty", F.lit(0)).cast("decimal(28,6)")
    return needs.withColumn("actual_qty", booked).withColumn("enough", ratio(booked, F.col("need"))).drop("_ref", "_variant", "ledger_qty")


def from_bins(needs: DataFrame) -> DataFrame:
    """Add ``actual_qty`` and ``enough`` to other items: the whole sets that the largest bin holds."""
    whole = floor_div(F.col("max_actual"), F.col("need")).cast("double")
    return needs.withColumn("actual_qty", F.col("max_actual").cast("decimal(28,6)")).withColumn("enough", whole)


def needs_with_stock(
    orders: DataFrame, parts: DataFrame, need: Column, tables: Tables, nodes: DataFrame | None = None, how: str = "inner"
) -> DataFrame:
    """Orders with every part of their bill of material, its need and its stock.

    The parts are split before they meet the orders, so only batch items go through the
    join with the ledger. With ``how`` left, an order without other parts has one row
    whose part is NULL. With warehouse ``nodes``, orders and parts have a node each.
    """
    is_batch = F.col("kind") == "batch"
    key = ["bom"] if nodes is None else ["node", "bom"]
    loose = orders.join(parts.filter(~is_batch), key, how).withColumn("need", need)
    batch = orders.join(parts.filter(is_batch), key).withColumn("need", need)
    return from_bins(loose).unionByName(from_ledger(batch, tables, nodes))


def _need():
    return (F.col("per_unit") * F.col("todo")).cast("decimal(38,6)")


def _material_check(tables: Tables, kind: str) -> DataFrame:
    parts = check_parts(tables).filter(F.col("kind") == kind)
    needs = _modules(tables, MODULE_GROUPS, IN_PRODUCTION).withColumnRenamed("item_code", "product")
    needs = needs.join(parts, "bom").withColumn("need", _need())
    if kind == "batch":
        return from_ledger(needs, tables).select(
            "quotation_item", "item_code", "component_name", "need", "actual_qty", F.col("enough").alias("ratio")
        )
    whole = floor_div(F.col("max_actual"), F.col("need")).cast("double")
    # a plain component without stock counts 0 sets, a subassembly NULL
    buildable = F.coalesce(whole, F.lit(0.0)) if kind == "plain" else whole
    return needs.select(
        "quotation_item", "item_code", "component_name", "need",
        F.col("max_actual").alias("actual_qty"), buildable.alias("buildable"),
    )


def material_check_plain(tables: Tables) -> DataFrame:
    """Per open module and loose component: need, stock, sets that can be built."""
    return _material_check(tables, "plain")


def material_check_subassembly(tables: Tables) -> DataFrame:
    """The same for stocked subassemblies among the direct components."""
    return _material_check(tables, "subassembly")


def material_check_batch(tables: Tables) -> DataFrame:
    """The same for batch items, whose stock is the customer's own batches."""
    return _material_check(tables, "batch")


def module_status(tables: Tables) -> DataFrame:
    """Verwerkt, No BOM, Tekort or Okay for every open module, in one pass over all its
    components. A component without a value counts as short."""
    modules = _modules(tables, MODULE_GROUPS, IN_PRODUCTION).withColumnRenamed("item_code", "product")
    needs = needs_with_stock(modules, check_parts(tables), _need(), tables, how="left")
    short = F.when(F.col("kind").isNotNull() & (F.coalesce("enough", F.lit(0.0)) <= 0), 1).otherwise(0)
    counted = (
        needs.groupBy("quotation_item", "quotation", "product", "bom")
        .agg(F.count("kind").alias("parts"), F.sum(short).alias("shortages"))
    )
    processed = (
        tables["productie_module"]
        .filter((F.col("docstatus") == 0) & (F.col("verwerkt") == 1))
        .groupBy("quotation_item")
        .agg(F.lit(1).alias("verwerkt"))
    )
    status = (
        F.when(F.col("verwerkt") == 1, "Verwerkt")
        .when(F.col("parts") == 0, "No BOM")
        .when(F.col("shortages") > 0, "Tekort")
        .otherwise("Okay")
    )
    return counted.join(processed, "quotation_item", "left").select(
        "quotation_item", "quotation", F.col("product").alias("item_code"), "bom", status.alias("status"), "shortages"
    )


def draft_rows(tables: Tables) -> DataFrame:
    """Rows of the production sheets being submitted."""
    return tables["productie_module"].filter(F.col("docstatus") == 0)


def _rows_to_issue(rows: DataFrame) -> DataFrame:
    unprocessed = F.coalesce("verwerkt", F.lit(0)) != 1
    return rows.filter((F.col("qty") > 0) & unprocessed).select(
        F.col("name").alias("production_row"), "offerte", "quotation_item", F.col("item_code").alias("product"),
        F.col("qty").alias("made"),
    )


def _issue_parts(tables: Tables) -> DataFrame:
    """What a product takes from stock: exploded components, and stocked subassemblies
    among the direct ones."""
    items = tables["item"].filter((F.col("is_stock_item") == 1) & (F.col("bakje_bakje") != 1)).select(
        F.col("name").alias("item_code"), "has_batch_no", "sub_assembly_voorraad",
        F.col("warehouse").alias("s_warehouse"),
    )
    subassembly = F.col("sub_assembly_voorraad")
    exploded = components(tables).join(items.filter(subassembly != 1), "item_code")
    direct = components(tables, direct=True).join(items.filter(subassembly == 1), "item_code")
    parts = exploded.withColumn("branch", F.lit("exploded")).unionByName(
        direct.withColumn("branch", F.lit("direct"))
    )
    return parts.join(active_boms(tables), "bom")


def _issued():
    return F.round(F.col("stock_qty") * F.col("made"), 2).cast("decimal(30,2)")


def material_issue_lines(tables: Tables, rows: DataFrame | None = None) -> DataFrame:
    """Components to issue per production row."""
    rows = _rows_to_issue(draft_rows(tables) if rows is None else rows)
    quotations = tables["quotation"].select(
        F.col("name").alias("offerte"), F.col("klant_referentie").alias("ref"), F.col("hpl_variant").alias("variant")
    )
    number = F.concat("ref", F.lit("-"), "item_code", F.lit("-"), "variant")
    # the direct branch loses its batch
    batch_no = F.when(F.col("branch") == "exploded", F.when(F.col("has_batch_no") == 1, number).otherwise(""))
    return (
        rows.join(_issue_parts(tables), "product")
        .join(quotations, "offerte")
        .select(
            "production_row", "branch", "idx", "bom", "item_code", _issued().alias("qty"),
            F.col("rate").alias("basic_rate"), F.lit(None).cast("string").alias("uom"), "stock_uom", "stock_qty",
            F.lit(1).alias("conversion_factor"), "s_warehouse", batch_no.alias("batch_no"),
        )
    )


def material_issue_headers(tables: Tables, rows: DataFrame | None = None) -> DataFrame:
    """One issue per production row whose product has a bill of material, valued at its rates."""
    rows = _rows_to_issue(draft_rows(tables) if rows is None else rows)
    quotations = tables["quotation"].select(F.col("name").alias("offerte"), F.lit(True).alias("quoted"))
    parts = _issue_parts(tables).select("product", "stock_qty", "rate")
    value = F.when(F.col("quoted"), _issued() * F.coalesce("rate", F.lit(0)))
    rows = lookup(rows, bom_per_product(tables), {"product": "product"}, {"bom_no": "bom"}, how="inner")
    return (
        rows.join(quotations, "offerte", "left")
        .join(parts, "product", "left")
        .groupBy("production_row", "offerte", "quotation_item", "product", "bom_no", "made")
        .agg(F.coalesce(F.sum(value), F.lit(0)).alias("value"))
        .select(
            "production_row", "offerte", "quotation_item", F.col("product").alias("item_code"), "bom_no",
            F.col("made").alias("fg_completed_qty"), F.round("value", 2).cast("decimal(30,2)").alias("total_outgoing_value"),
        )
    )


def material_issue_postings(tables: Tables, date: str, rows: DataFrame | None = None) -> DataFrame:
    """Stock against work cost, the cost on the cost centre of the customer's lead."""
    leads = one_per_key(
        tables["lead"].filter(filled(F.col("configurator_id"))).select("configurator_id", "name", "snelstart_kostenplaats"),
        ["configurator_id"], ["name"],
    )
    issues = material_issue_headers(tables, rows)
    issues = lookup(issues, tables["quotation"], {"offerte": "name"}, {"ref": "klant_referentie"})
    issues = lookup(issues, tables["quotation_item"], {"quotation_item": "name"}, {"item_name": "item_name"})
    issues = lookup(issues, leads, {"ref": "configurator_id"}, {"cost_centre": "snelstart_kostenplaats"})
    text = F.concat("item_name", F.lit(" Ref: "), "ref")
    return postings(
        issues.withColumn("date", F.lit(date).cast("date")),
        "production_row", WORK_COST, STOCK, F.col("total_outgoing_value").cast(MONEY), text,
        debit_columns=["cost_centre"], keep=["date"],
    )


def material_issue_documents(tables: Tables, date: str, rows: DataFrame | None = None) -> DataFrame:
    """The issue postings as JSON bookings."""
    return memo_documents(material_issue_postings(tables, date, rows), "production_row", "date")


def production_rows_kept(tables: Tables, rows: DataFrame | None = None) -> DataFrame:
    """Production rows after processing: rows without quantity deleted, issued ones marked."""
    rows = draft_rows(tables) if rows is None else rows
    has_bom = bom_per_product(tables).select("product", F.lit(True).alias("has_bom"))
    tried = lookup(_rows_to_issue(rows), has_bom, {"product": "product"}, {"has_bom": "has_bom"}).select(
        F.col("production_row").alias("name"),
        F.when(F.col("has_bom"), 1).alias("verwerkt"),
        F.when(F.col("has_bom"), "issued").otherwise("no BOM").alias("log"),
    )
    kept = delete_where(rows, F.col("qty") <= 0)
    # a row without a bill of material stays as it was, with a log line
    marked = update_by_key(kept, tried.filter(F.col("verwerkt") == 1).select("name", "verwerkt"), ["name"])
    return marked.join(tried.select("name", "log"), "name", "left").select(
        F.col("name").alias("production_row"), "offerte", "quotation_item", "item_code", "qty", "verwerkt", "log"
    )
