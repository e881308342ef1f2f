"""Runs that change several tables in one commit: quote intake, purchase orders, the batch ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomwerk.functions.columns import MONEY, money
from bomwerk.operators.dimensions import Tables, add_sums, batch_ledger, batch_sums
from bomwerk.operators.lookup import lookup
from bomwerk.operators.mutate import update_by_key
from bomwerk.operators.ranking import numbered
from bomwerk.operators.shared import Run
from bomwerk.plans.planning import planning_sheet, purchase_order_lines
from bomwerk.plans.quotes import new_leads, price_changes, quote_headers, quote_lines
from bomwerk.session import run_folder
from bomwerk.sources.requests import usable
from bomwerk.sources.snapshots import SnapshotTables, stored_tables

# Fixed value of the ERP: the tax template of a configurator quotation.
TAXES = "VerkopenHoog"
VAT_RATE = 21  # per cent, included in the prices
PRICE_BUCKETS, LEDGER_BUCKETS = 16, 16


def _quotation_name():
    return F.concat(F.lit("QTN-"), "request_id")


def new_quotation_lines(tables: Tables, requests: DataFrame | None = None) -> DataFrame:
    """The child rows of new quotations, numbered as their articles come."""
    return quote_lines(tables, requests).select(
        F.concat(_quotation_name(), F.lit("-"), (F.col("pos") + 1).cast("string")).alias("name"), _quotation_name().alias("parent"),
        (F.col("pos") + 1).alias("idx"), F.lit(0).alias("docstatus"), "item_code", "item_name", "item_group", "variant_code", "qty", "amount",
    )


def new_quotations(tables: Tables, lines: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """A draft quotation per request, with the total of its ``lines`` and the VAT in it."""
    totals = lines.groupBy("parent").agg(F.sum("amount").alias("total"))
    rows = lookup(quote_headers(tables, requests).withColumn("name", _quotation_name()), totals, {"name": "parent"}, {"total": "total"})
    total = F.coalesce("total", F.lit(0)).cast(MONEY)
    return rows.select(
        "name", F.lit(0).alias("docstatus"), F.lit(0).alias("voorraadplanning_compleet"), "klant_referentie", "transaction_date", "customer_name", "lead",
        total.alias("grand_total"), F.lit(TAXES).alias("taxes_and_charges"),
        money(total * VAT_RATE / (100 + VAT_RATE)).alias("total_taxes_and_charges"), F.lit(0).alias("snelstart_koppeling"),
    )


def intake(store: SnapshotTables, requests: DataFrame, run: str) -> SnapshotTables:
    """Leads, prices, quotations and their lines of ``requests``, all in one commit.

    Rows are appended; of the prices only the buckets with a changed rate are written
    anew. A run that has committed is not done again. The requests are read and parsed
    once, and the prices worked out once, for all that is made of them.
    """
    if store.done(run):
        return store.latest()
    with Run(store) as kept:
        parsed = kept.once("requests", lambda: usable(requests).drop("payload"))
        updates, inserts = price_changes(kept, parsed)
        change = store.change(run)
        change.append("quotation_item", new_quotation_lines(kept, parsed))
        change.append("quotation", new_quotations(kept, change.added("quotation_item"), parsed))
        change.append("lead", new_leads(kept, parsed))
        change.rewrite("item_price", updates, lambda rows: update_by_key(rows, updates, ["name"]))
        return change.append("item_price", inserts).commit()


def _after_intake(tables: Tables) -> SnapshotTables:
    """The tables after the intake of all requests, run twice."""
    requests = tables["quote_request"]
    spark = requests.sparkSession
    store = stored_tables(spark, run_folder(spark, "intake"), tables, ["quotation", "quotation_item", "lead"])
    store = store.change("prices").replace("item_price", tables["item_price"], "name", PRICE_BUCKETS).commit()
    for _ in range(2):
        store = intake(store, requests, "intake")
    return store


def quotation_after_intake(tables: Tables) -> DataFrame:
    """The quotations after intake, each with the number and sum of the lines committed with it."""
    store = _after_intake(tables)
    lines = store["quotation_item"].groupBy("parent").agg(F.count("*").alias("line_count"), F.sum("amount").cast(MONEY).alias("line_total"))
    return lookup(store["quotation"], lines, {"name": "parent"}, {"line_count": "line_count", "line_total": "line_total"}).select(
        "name", "docstatus", "klant_referentie", "transaction_date", "customer_name", "lead", "grand_total", "taxes_and_charges",
        "total_taxes_and_charges", "snelstart_koppeling", F.coalesce("line_count", F.lit(0)).alias("line_count"), "line_total",
    )


def quotation_lines_after_intake(tables: Tables) -> DataFrame:
    """The lines of all quotations after intake."""
    return _after_intake(tables)["quotation_item"]


def order_run(store: SnapshotTables, delivery_date: str, run: str, sheet: DataFrame | None = None) -> SnapshotTables:
    """Draft purchase orders and their lines for a delivery date, in one commit.

    A supplier that has a draft for that date gets no other one, so a further run with
    another id adds nothing either. ``sheet`` is a stored planning sheet, where several runs
    order from the same one.
    """
    if store.done(run):
        return store.latest()
    name = F.concat("supplier", F.lit("/"), F.col("schedule_date").cast("string"))
    with Run(store) as kept:
        # numbering reads its rows twice, to find ranges and to place them
        lines = kept.once("order lines", lambda: purchase_order_lines(store, delivery_date, sheet=sheet).withColumn("parent", name))
        change = store.change(run).append("purchase_order_item", numbered(lines, ["parent"], ["source", "item_code"], "idx"))
    day = F.col("schedule_date")
    heads = change.added("purchase_order_item").groupBy("parent", "schedule_date").agg(F.count("*").alias("lines"))
    supplier = F.expr("left(parent, length(parent) - length(CAST(schedule_date AS STRING)) - 1)")
    heads = heads.select(F.col("parent").alias("name"), supplier.alias("supplier"), day.alias("transaction_date"), F.lit(0).alias("docstatus"))
    return change.append("purchase_order", heads).commit()


def _after_orders(tables: Tables, delivery_date: str) -> SnapshotTables:
    spark = tables["purchase_order"].sparkSession
    store = stored_tables(spark, run_folder(spark, "orders"), tables, ["purchase_order", "purchase_order_item"])
    with Run(tables) as kept:
        # orders change nothing that the sheet is made of, so it is planned once
        sheet = kept.once("sheet", lambda: planning_sheet(tables))
        for run in ("first", "first", "second"):
            store = order_run(store, delivery_date, run, sheet)
    return store


def purchase_orders_after_run(tables: Tables, delivery_date: str) -> DataFrame:
    """The purchase orders after the run and its repetition, with the number of their lines."""
    store = _after_orders(tables, delivery_date)
    lines = store["purchase_order_item"].groupBy("parent").agg(F.count("*").alias("line_count"))
    return lookup(store["purchase_order"], lines, {"name": "parent"}, {"line_count": "line_count"}).withColumn("line_count", F.coalesce("line_count", F.lit(0)))


def purchase_order_items_after_run(tables: Tables, delivery_date: str) -> DataFrame:
    """The lines of all purchase orders after the run and its repetition."""
    return _after_orders(tables, delivery_date)["purchase_order_item"]


def advance_ledger(store: SnapshotTables, run: str) -> SnapshotTables:
    """Add the ledger entries since the last run to the stored sums, and move the mark.

    Only entries above the mark are read and only buckets with one of their items written.
    """
    if store.done(run):
        return store.latest()
    entries = store["stock_ledger_entry"]
    mark = store["ledger_mark"].agg(F.max("upto")).first()[0]
    new = entries if mark is None else entries.where(F.col("entry") > mark)
    upto = new.agg(F.max("entry")).first()[0]
    new = new.where(F.col("entry") <= upto)  # what arrives meanwhile is for the next run
    sums = batch_sums(new)
    change = store.change(run)
    if store.has("batch_stock"):
        change.rewrite("batch_stock", sums.select("item_code"), lambda rows: add_sums(rows.unionByName(sums)))
    else:
        change.replace("batch_stock", sums, "item_code", LEDGER_BUCKETS)
    if upto is not None:
        change.replace("ledger_mark", entries.sparkSession.range(1).select(F.lit(upto).alias("upto")))
    return change.commit()


def ledger_stock(tables: Tables) -> DataFrame:
    """Batch stock from sums stored in two runs and the entries since."""
    entries = tables["stock_ledger_entry"]
    spark = entries.sparkSession
    last = entries.agg(F.max("entry")).first()[0] or 0
    store = SnapshotTables(spark, run_folder(spark, "ledger"), over=tables)
    for part, (low, high) in enumerate(((None, last // 3), (last // 3, 2 * last // 3), (2 * last // 3, None))):
        arriving = entries if low is None else entries.where(F.col("entry") > low)
        arriving = arriving if high is None else arriving.where(F.col("entry") <= high)
        store = store.change(f"entries {part}").append("stock_ledger_entry", arriving).commit()
        if high is not None:
            store = advance_ledger(store, f"sums {part}")
    return batch_ledger(store)
