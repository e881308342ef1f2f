"""Order lines in the column layout each supplier asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomwerk.operators.dimensions import Tables
from bomwerk.plans.planning import purchase_order_lines

# Fixed values of the ERP: the columns a layout can choose from.
EXPORT_COLUMNS = (
    "Item Code", "Supplier Code", "Item Name", "Quantity", "Unit", "Rate", "Amount", "Supplier", "Supplier Name",
    "Purchase Order", "Transaction Date", "Schedule Date",
)


def _values() -> dict[str, Column]:
    """The text of each export column. Planned lines carry no rate: the host prices them."""
    unpriced = F.lit(None).cast("string")
    day = F.col("schedule_date").cast("string")
    sources = (
        F.col("item_code"), F.col("supplier_part_no"), F.col("description"), F.col("qty").cast("string"), F.col("uom"),
        unpriced, unpriced, F.col("supplier"), F.col("supplier_name"), F.concat("supplier", F.lit("/"), day), day, day,
    )
    return dict(zip(EXPORT_COLUMNS, sources, strict=True))


def supplier_export(tables: Tables, delivery_date: str) -> DataFrame:
    """One row per order line and chosen column, numbered as the supplier's layout is."""
    layout = tables["export_layout"].filter(F.col("artikel_data").isin(list(EXPORT_COLUMNS)))
    names = tables["supplier"].select(F.col("name").alias("supplier"), "supplier_name")
    pairs = [part for name, value in _values().items() for part in (F.lit(name), value)]
    lines = purchase_order_lines(tables, delivery_date).join(names, "supplier", "left")
    return lines.withColumn("values", F.create_map(*pairs)).join(layout, "supplier").select(
        "supplier",
        "source",
        "item_code",
        F.col("idx").alias("position"),
        F.col("artikel_data").alias("column_name"),
        F.element_at("values", F.col("artikel_data")).alias("value"),
    )


def export_layout_rejects(tables: Tables) -> DataFrame:
    """Layout rows that name no export column; ``supplier_export`` leaves them out."""
    layout = tables["export_layout"]
    known = F.coalesce(F.col("artikel_data").isin(list(EXPORT_COLUMNS)), F.lit(False))
    return layout.filter(~known).select("supplier", "idx", F.col("artikel_data").alias("name"), F.lit("unknown column").alias("reason"))
