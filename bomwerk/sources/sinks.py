"""Sinks: table snapshots, appends, and one folder per supplier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The stock report's columns as its readers know them.
REPORT_COLUMNS = {
    "item_code": "Item",
    "item_name": "Description",
    "qty_per_line": "Qty per BOM Line",
    "required_qty": "Required Qty",
    "in_stock_qty": "In Stock Qty",
    "buildable": "Enough Parts to Build",
}


def save_table(rows: DataFrame, path: str, mode: str = "overwrite", source: str = "parquet") -> None:
    """Write a table snapshot, or append to a table of headers, lines or archive rows."""
    rows.write.mode(mode).format(source).save(path)


def save_per_supplier(rows: DataFrame, path: str, supplier: str = "supplier", source: str = "parquet") -> None:
    """One folder per supplier.

    The rebalance hint collects a small supplier into one file and splits a large one
    over many tasks.
    """
    rows.hint("rebalance", F.col(supplier)).write.mode("overwrite").partitionBy(supplier).format(source).save(path)


def save_report(rows: DataFrame, path: str, keys: Sequence[str] = ("request_id",)) -> None:
    """The stock report with its column titles, in item order."""
    titled = rows.select(*keys, *[F.col(name).alias(title) for name, title in REPORT_COLUMNS.items()])
    titled.orderBy(*keys, "Item").write.mode("overwrite").option("header", True).csv(path)


def save_sheet(rows: DataFrame, path: str, by: str = "supplier") -> None:
    """The planning sheet by supplier or item code, descending, as its readers know it."""
    rows.orderBy(F.col(by).desc_nulls_last(), "source", "item_code").write.mode("overwrite").option("header", True).csv(path)


def save_tables(tables, names: Sequence[str], root: str, files: int | None = None) -> None:
    """Store tables so that ``StoredTables(spark, root)`` reads them back, in so many files
    or as many as the tables have partitions."""
    for name in names:
        rows = tables[name].repartition(files) if files else tables[name]
        save_table(rows, f"{root.rstrip('/')}/{name}")


# Bucket columns that let the planning joins of the large tables start without a shuffle.
BUCKETS = {
    "quotation": "name", "quotation_item": "parent", "productie_module": "name",
    "bom_explosion_item": "parent", "bom_item": "parent", "bom": "name",
}


def save_bucketed(tables, names: Sequence[str], database: str, buckets: int) -> None:
    """Store tables in a catalog database, bucketed by the key they are joined on most.

    Choose ``buckets`` so that the largest table has some 256 MB per bucket.
    """
    for name in names:
        key = BUCKETS[name]
        rows = tables[name].repartition(buckets, key)
        rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(f"{database}.{name}")


# How large tables are laid out: a folder for each value of the first columns, which the
# jobs filter by, and rows in ranges of the others.
LAYOUT = {
    "quotation": (("docstatus", "vj_status"), ("transaction_date", "name")),
    "quotation_item": (("item_group",), ("parent", "idx")),
    "productie_module": (("docstatus",), ("quotation_item",)),
    "purchase_order": (("docstatus",), ("transaction_date", "supplier")),
    "item": (("is_stock_item", "item_group"), ("name",)),
}


def save_laid_out(tables, names: Sequence[str], root: str, files: int | None = None) -> None:
    """Store tables below ``root`` so that filters on status, group and date skip folders and files.

    Rows are dealt into ``files`` ranges of the columns in ``LAYOUT`` and sorted, so a folder
    has few files and a file a narrow range of dates. A blank value of a folder column
    reads back as NULL, which all filters of the jobs treat alike.
    """
    for name in names:
        by, order = LAYOUT[name]
        ranges = tables[name].repartitionByRange(*([files] if files else []), *by, *order).sortWithinPartitions(*by, *order)
        ranges.write.mode("overwrite").partitionBy(*by).parquet(f"{root.rstrip('/')}/{name}")
