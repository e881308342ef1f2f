"""Stock transactions: scan lookup, units, validation, stock rows and postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomwerk.functions.columns import MONEY
from bomwerk.operators.dimensions import Tables
from bomwerk.operators.lookup import lookup, one_per_key
from bomwerk.operators.postings import STOCK, WORK_COST, memo_documents, postings
from bomwerk.operators.ranking import numbered

# Fixed values of the ERP.
RECEIPT, ISSUE = "Material Receipt", "Material Issue"
IN, OUT = "In", "Uit"


def snapshot(tables: Tables) -> Tables:
    """What transactions are held against, one row per key: items, bins and unit factors."""
    return {
        "items": tables["item"].filter(F.col("is_stock_item") == 1).select("name", "item_name", "stock_uom", "warehouse"),
        "bins": one_per_key(
            tables["bin"].select("item_code", "warehouse", "actual_qty", "valuation_rate"),
            ["item_code", "warehouse"], ["actual_qty", "valuation_rate"],
        ),
        "factors": one_per_key(
            tables["uom_conversion_detail"].select("parent", "uom", "idx", "conversion_factor"), ["parent", "uom"], ["idx", "conversion_factor"]
        ),
    }


def scanned(known: Tables, transactions: DataFrame) -> DataFrame:
    """Transactions with the stock item they name, its warehouse and the stock there.

    ``known`` is a ``snapshot``. Only left joins to one-row-per-key sides, so
    ``transactions`` may be a stream.
    """
    rows = lookup(
        transactions, known["items"], {"artikel": "name"},
        {"item": "name", "artikel_naam": "item_name", "stock_unit": "stock_uom", "locatie": "warehouse"},
    )
    rows = lookup(
        rows, known["bins"].withColumn("has_bin", F.lit(True)), {"item": "item_code", "locatie": "warehouse"},
        {"actual_qty": "actual_qty", "valuation_rate": "valuation_rate", "has_bin": "has_bin"},
    )
    reason = F.when(F.col("item").isNull(), "no stock item").when(F.col("has_bin").isNull(), "no stock")
    return rows.withColumn("reason", reason).drop("item", "has_bin")


def checked(known: Tables, transactions: DataFrame) -> DataFrame:
    """Scanned transactions with ``aantal`` in stock units and the reason of a rejection.

    Receipts are held to the present stock like issues.
    """
    rows = lookup(
        scanned(known, transactions), known["factors"], {"artikel": "parent", "unit": "uom"},
        {"conversion_factor": "conversion_factor"},
    )
    aantal = F.when(F.col("qty") > 0, (F.col("qty") * F.col("conversion_factor")).cast("decimal(28,6)"))
    reason = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col("aantal").isNull(), "no quantity")
        .when(F.col("aantal") > F.col("actual_qty"), "more than stock")
    )
    return rows.withColumn("aantal", aantal).withColumn("reason", reason)


def _checked(tables: Tables) -> DataFrame:
    return checked(snapshot(tables), tables["voorraad_transactie"])


def _accepted(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("reason").isNull())


def to_post(rows: DataFrame) -> DataFrame:
    """Two ledger lines per accepted issue of ``checked`` rows, at the bin's valuation."""
    value = F.round(F.col("aantal") * F.col("valuation_rate"), 2).cast(MONEY)
    text = F.concat("artikel", F.lit("  : "), "artikel_naam")
    issues = _accepted(rows).filter(F.col("transactie_type") == OUT)
    return postings(issues, "name", WORK_COST, STOCK, value, text)


def txn_lookup(tables: Tables) -> DataFrame:
    return scanned(snapshot(tables), tables["voorraad_transactie"]).select(
        "name", "artikel", "artikel_naam", "stock_unit", "locatie", "actual_qty", "reason"
    )


def txn_units(tables: Tables, page: int | None = None) -> DataFrame:
    """The units of each item with their position; the first ``page`` of them if a page is asked for."""
    units = tables["uom_conversion_detail"].groupBy(F.col("parent").alias("item_code"), "uom").agg(F.min("idx").alias("idx"))
    rows = numbered(units, ["item_code"], ["idx", "uom"])
    return (rows if page is None else rows.filter(F.col("position") <= page)).select("item_code", "uom", "position")


def txn_quantity(tables: Tables) -> DataFrame:
    return _checked(tables).select(
        "name", "artikel", "unit", "qty", "conversion_factor", "aantal"
    )


def txn_validation(tables: Tables) -> DataFrame:
    """Accepted when the quantity does not exceed the stock, in either direction."""
    return _checked(tables).select(
        "name", "transactie_type", "artikel", "aantal", "actual_qty",
        F.when(F.col("reason").isNull(), 1).otherwise(0).alias("accepted"), "reason",
    )


def txn_stock_rows(tables: Tables) -> DataFrame:
    """Stock rows of accepted transactions: a receipt into the warehouse or an issue out of it."""
    receipt = F.col("transactie_type") == IN
    return _accepted(_checked(tables)).select(
        "name",
        F.when(receipt, RECEIPT).otherwise(ISSUE).alias("purpose"),
        F.col("artikel").alias("item_code"),
        F.col("artikel_naam").alias("item_name"),
        F.col("stock_unit").alias("uom"),
        F.lit(1).alias("conversion_factor"),
        F.when(~receipt, F.col("locatie")).alias("s_warehouse"),
        F.when(receipt, F.col("locatie")).alias("t_warehouse"),
        F.col("aantal").alias("qty"),
    )


def txn_postings(tables: Tables) -> DataFrame:
    return to_post(_checked(tables))


def txn_documents(tables: Tables, date: str) -> DataFrame:
    """The postings as JSON bookings."""
    return memo_documents(txn_postings(tables).withColumn("date", F.lit(date).cast("date")), "name", "date")
