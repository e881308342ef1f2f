"""Document names from series such as ``VB.YY.######``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomwerk.operators.dimensions import Tables
from bomwerk.operators.lookup import lookup
from bomwerk.operators.ranking import numbered
from bomwerk.operators.shared import Run
from bomwerk.session import run_folder
from bomwerk.sources.snapshots import SnapshotTables

# Fixed values of the ERP.
SERIES = {"voorraad_transactie": "VB.YY.######", "productie": "PM.YY.#####", "voorraad_check": "VC.YY.####"}

SECOND_RUN = "2024-01-15"  # where the runs of the registered queries part


def _prefixed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("prefix", F.concat(F.split_part("series", F.lit("."), F.lit(1)), F.date_format("created", "yy")))


def name_documents(rows: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """Name rows (series, created, document) in order of creation.

    ``last`` holds the last number used per prefix (prefix, last_number), as
    ``next_counters`` gives it. A number with more digits than the series has is written
    in full.
    """
    digits = F.split_part("series", F.lit("."), F.lit(3))
    counted = numbered(_prefixed(rows), ["prefix"], ["created", "document"])
    if last is not None:
        counted = lookup(counted, last, {"prefix": "prefix"}, {"last_number": "last_number"})
    else:
        counted = counted.withColumn("last_number", F.lit(0))
    number = F.col("position") + F.coalesce("last_number", F.lit(0))
    text = number.cast("string")
    padded = F.lpad(text, F.greatest(F.length(digits), F.length(text)), F.lit("0"))
    return counted.select("document", "series", "created", F.concat("prefix", padded).alias("name"))


def next_counters(rows: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """The last number per prefix once ``rows`` are named: (prefix, last_number)."""
    used = _prefixed(rows).where(F.col("prefix").isNotNull()).groupBy("prefix").agg(F.count("*").alias("last_number"))
    if last is None:
        return used
    return used.unionByName(last.select("prefix", "last_number")).groupBy("prefix").agg(F.sum("last_number").alias("last_number"))


def _documents(tables: Tables) -> DataFrame:
    transactions = tables["voorraad_transactie"].select(
        F.lit(SERIES["voorraad_transactie"]).alias("series"), F.col("creation").cast("timestamp").alias("created"), F.col("name").alias("document")
    )
    counts = tables["voorraad_check"].select(
        F.lit(SERIES["voorraad_check"]).alias("series"), F.col("posting_date").cast("timestamp").alias("created"), F.col("name").alias("document")
    )
    dates = tables["quotation"].select(F.col("name").alias("offerte"), "transaction_date")
    production = (
        tables["productie_module"].select("parent", "offerte").distinct().join(dates, "offerte")
        .groupBy("parent").agg(F.min("transaction_date").cast("timestamp").alias("created"))
        .select(F.lit(SERIES["productie"]).alias("series"), "created", F.col("parent").alias("document"))
    )
    return transactions.unionByName(counts).unionByName(production)


def document_numbers(tables: Tables, last: DataFrame | None = None) -> DataFrame:
    """Names for stock transactions, production documents and stock counts."""
    return name_documents(_documents(tables), last)


def number_run(store: SnapshotTables, rows: DataFrame, run: str) -> SnapshotTables:
    """Name ``rows`` after the numbers that earlier runs used up, and commit the names and the new counters together."""
    if store.done(run):
        return store.latest()
    last = store["series_counter"]
    return store.change(run).append("document_name", name_documents(rows, last)).replace("series_counter", next_counters(rows, last)).commit()


def _in_runs(tables: Tables) -> SnapshotTables:
    """All documents named in two runs, the second of which goes on where the first ended, and is repeated."""
    with Run(tables) as kept:
        # both runs name and count them, and numbering reads its rows twice
        rows = kept.once("documents", lambda: _documents(tables))
        store = SnapshotTables(rows.sparkSession, run_folder(rows.sparkSession, "series"))
        first = F.coalesce(F.col("created") < F.lit(SECOND_RUN).cast("timestamp"), F.lit(True))
        store = number_run(store, rows.where(first), "first")
        for _ in range(2):
            store = number_run(store, rows.where(~first), "second")
    return store


def series_counters(tables: Tables) -> DataFrame:
    """The last number per prefix after all documents are named, in runs."""
    return _in_runs(tables)["series_counter"]


def document_numbers_in_runs(tables: Tables) -> DataFrame:
    """The names that ``document_numbers`` gives, given in runs."""
    return _in_runs(tables)["document_name"]
