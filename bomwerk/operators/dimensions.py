"""Per-item and per-product dimensions: every side of a join reduced to one row per key.

Aggregating before the join keeps the joins one-to-one, so a hot item, supplier or
quotation is combined map-side and never multiplies rows in one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomwerk.operators.intervals import contained
from bomwerk.operators.lookup import join_on_key, lookup

Tables = Mapping[str, DataFrame]


def active_boms(tables: Tables) -> DataFrame:
    """Submitted, active default bills of material: bom, product."""
    return (
        tables["bom"]
        .filter((F.col("docstatus") == 1) & (F.col("is_default") == 1) & (F.col("is_active") == 1))
        .select(F.col("name").alias("bom"), F.col("item").alias("product"))
    )


def bom_per_product(tables: Tables) -> DataFrame:
    """product, bom (one of them), n_bom."""
    return active_boms(tables).groupBy("product").agg(F.max("bom").alias("bom"), F.count("*").alias("n_bom"))


def bins_per_item(tables: Tables, only_positive: bool = False, nodes: DataFrame | None = None) -> DataFrame:
    """item_code with the largest and the total stock over its bins; with ``nodes``, for each of them."""
    bins = tables["bin"]
    if only_positive:
        bins = bins.filter(F.col("actual_qty") > 0)
    return at_nodes(bins, nodes).groupBy(*([] if nodes is None else ["node"]), "item_code").agg(
        F.max("actual_qty").alias("max_actual"),
        F.max("ordered_qty").alias("max_ordered"),
        F.sum("actual_qty").alias("sum_actual"),
        F.sum("ordered_qty").alias("sum_ordered"),
        F.count("*").alias("n_bin"),
    )


def suppliers_per_item(tables: Tables) -> DataFrame:
    return (
        tables["item_supplier"]
        .groupBy(F.col("parent").alias("item_code"))
        .agg(
            F.max("supplier").alias("supplier"),
            F.max("supplier_part_no").alias("supplier_part_no"),
            F.count("*").alias("n_supplier"),
        )
    )


def purchase_units(tables: Tables) -> DataFrame:
    """item_code, unit, conversion_factor, n_unit."""
    return (
        tables["uom_conversion_detail"]
        .groupBy(F.col("parent").alias("item_code"), F.col("uom").alias("unit"))
        .agg(F.max("conversion_factor").alias("conversion_factor"), F.count("*").alias("n_unit"))
    )


def purchasable(tables: Tables, items: DataFrame) -> DataFrame:
    """Items (keyed ``item_code``) that have a supplier and a factor for their purchase unit."""
    units = purchase_units(tables)
    unit_of = (items["item_code"] == units["item_code"]) & (items["purchase_uom"] == units["unit"])
    return (
        items.join(units, unit_of)
        .drop(units["item_code"], units["unit"])
        .join(suppliers_per_item(tables), "item_code")
    )


def components(tables: Tables, direct: bool = False, quantity: str = "stock_qty") -> DataFrame:
    """Bill-of-material lines: exploded to the lowest level, or the direct ones."""
    lines = tables["bom_item" if direct else "bom_explosion_item"].filter(F.col("parenttype") == "BOM")
    return lines.select(
        F.col("parent").alias("bom"),
        "item_code",
        F.col("item_name").alias("component_name"),
        F.col(quantity).alias("per_unit"),
        "stock_qty",
        "stock_uom",
        "rate",
        "idx",
    )


def component_needs(tables: Tables, direct: bool = False, quantity: str = "stock_qty") -> DataFrame:
    """One row per (bom, component). Of repeated lines the smallest positive quantity
    counts, which is the one the largest number of buildable sets comes from."""
    positive = F.when(F.col("per_unit") > 0, F.col("per_unit"))
    return (
        components(tables, direct, quantity)
        .groupBy("bom", "item_code")
        .agg(
            F.coalesce(F.min(positive), F.min("per_unit")).alias("per_unit"),
            F.max("component_name").alias("component_name"),
            F.min("idx").alias("idx"),
        )
    )


def warehouse_nodes(tables: Tables, asked: DataFrame) -> DataFrame:
    """(node, warehouse) for each distinct ``node`` asked for: the warehouses in it, itself included.

    The tree holds each warehouse as a range of numbers that contains those of all below
    it. A name that is not in the tree is that warehouse alone.
    """
    tree = tables["warehouse"].select(F.col("name").alias("warehouse"), "lft", F.col("rgt").alias("_end"))
    spans = tables["warehouse"].select("name", F.col("lft").alias("_low"), F.col("rgt").alias("_high"))
    spans = lookup(asked, spans, {"node": "name"}, {"_low": "_low", "_high": "_high"})
    below = contained(tree, spans, "lft", "_low", "_high").filter(F.col("_end") <= F.col("_high"))
    alone = spans.filter(F.col("_low").isNull()).select("node", F.col("node").alias("warehouse"))
    return below.select("node", "warehouse").unionByName(alone)


def at_nodes(stock: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """Rows that have a ``warehouse``, once for each of ``nodes`` they are in, and once for the node '', which is everywhere.

    The nodes of a warehouse, at most as many as the tree is deep for each name, come as a list, so the stock is read once.
    """
    if nodes is None:
        return stock
    lists = nodes.groupBy("warehouse").agg(F.collect_list("node").alias("_nodes"))
    rows = lookup(stock, lists, {"warehouse": "warehouse"}, {"_nodes": "_nodes"})
    everywhere = F.array(F.lit(""))
    return rows.withColumn("node", F.explode(F.coalesce(F.concat("_nodes", everywhere), everywhere))).drop("_nodes")


def batch_sums(entries: DataFrame) -> DataFrame:
    """Ledger entries of batches, summed: (ref, variant, item_code, warehouse, ledger_qty)."""
    batches = entries.filter(F.col("batch_no").isNotNull()).select(
        F.lower(F.substring_index("batch_no", "-", 1)).alias("ref"), F.lower(F.substring_index("batch_no", "-", -1)).alias("variant"),
        "item_code", "warehouse", F.col("actual_qty").cast("decimal(28,6)").alias("ledger_qty"),
    )
    return add_sums(batches)


def add_sums(sums: DataFrame) -> DataFrame:
    """Sums of the same batch and warehouse as one."""
    return sums.groupBy("ref", "variant", "item_code", "warehouse").agg(F.sum("ledger_qty").cast("decimal(28,6)").alias("ledger_qty"))


def batch_ledger(tables: Tables, nodes: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    """Ledger stock per customer reference, panel variant and item; with ``nodes``, for each of them.

    With ``items`` (item_code) only theirs: the others leave before anything is summed.

    Both parts are cut out of the batch number before the join, so it stays an
    equi-join, and the ledger is summed first, so the join sees one row per key. Tables
    that keep sums up to an entry give those, and only the entries since are read.
    """
    entries, stored = tables["stock_ledger_entry"], None
    if getattr(tables, "has", lambda name: False)("ledger_mark"):
        stored = tables["batch_stock"]
        entries = entries.filter(F.col("entry") > tables["ledger_mark"].first()["upto"])
    if items is not None:
        entries = join_on_key(entries, items, {"item_code": "item_code"}, "left_semi")
        stored = None if stored is None else join_on_key(stored, items, {"item_code": "item_code"}, "left_semi")
    sums = batch_sums(entries)
    if stored is not None:
        sums = sums.unionByName(stored)
    return (
        at_nodes(sums, nodes)
        .groupBy(*([] if nodes is None else ["node"]), "ref", "variant", "item_code")
        .agg(F.sum("ledger_qty").alias("ledger_qty"))
    )


def excluding(items: DataFrame, groups: Iterable[str]) -> DataFrame:
    return items.filter(~F.lower("item_group").isin([group.lower() for group in groups]))
