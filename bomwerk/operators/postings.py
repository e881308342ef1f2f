"""Two one-sided ledger lines per document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomwerk.functions.columns import MONEY

# Symbolic account names; a deployment maps them to its own ledger ids.
STOCK = "STOCK"
WORK_COST = "WORK_COST"
REVENUE = "REVENUE"
CLEARING = "CLEARING"
MEMO = "MEMO"


def postings(
    documents: DataFrame,
    document: str,
    debit: str,
    credit: str,
    amount: Column,
    text: Column,
    debit_columns: Sequence[str] = (),
    keep: Sequence[str] = (),
) -> DataFrame:
    """Emit a debit and a credit line for every document row.

    ``debit_columns`` are carried on the debit line only (a cost centre, say),
    ``keep`` on both.
    """
    zero = F.lit(0).cast(MONEY)

    def side(name: str, account: str, is_debit: bool) -> Column:
        return F.struct(
            F.lit(name).alias("side"),
            F.lit(account).alias("account"),
            (amount if is_debit else zero).cast(MONEY).alias("debit"),
            (zero if is_debit else amount).cast(MONEY).alias("credit"),
            *[
                (F.col(column) if is_debit else F.lit(None).cast(documents.schema[column].dataType)).alias(column)
                for column in debit_columns
            ],
        )

    lines = F.array(side("credit", credit, False), side("debit", debit, True))
    return documents.select(
        document, *keep, F.lit(MEMO).alias("journal"), text.alias("text"), F.inline(lines)
    )


def memo_documents(lines: DataFrame, document: str, date: str) -> DataFrame:
    """Postings as one-sided JSON bookings, with the cost centre where the line has one."""
    account = F.struct(F.col("account").alias("id")).alias("grootboek")
    fields = [F.col("text").alias("omschrijving"), account]
    if "cost_centre" in lines.columns:
        centre = F.when(F.col("cost_centre").isNotNull(), F.struct(F.col("cost_centre").alias("id")))
        fields.append(centre.alias("kostenplaats"))
    line = F.struct(*fields, F.col("debit").alias("debet"), F.col("credit"))
    booking = F.struct(
        F.col(date).cast("string").alias("datum"),
        F.col(document).alias("boekstuk"),
        F.col("text").alias("omschrijving"),
        F.array(line).alias("memoriaalBoekingsRegels"),
        F.struct(F.col("journal").alias("id")).alias("dagboek"),
    )
    return lines.select(document, "side", F.to_json(booking).alias("booking"))
