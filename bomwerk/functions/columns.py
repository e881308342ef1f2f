"""Column expressions shared by the jobs. All are built-in Spark functions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

QTY = "decimal(18,6)"
SUM = "decimal(38,6)"
MONEY = "decimal(18,2)"


def qty(value: Column) -> Column:
    return value.cast(SUM)


def money(value: Column) -> Column:
    """Round half up to cents."""
    return F.round(value, 2).cast(MONEY)


def dec(literal: str, kind: str = QTY) -> Column:
    """An exact decimal literal."""
    return F.lit(literal).cast(kind)


def isin_ci(value: Column, allowed: Iterable[str]) -> Column:
    """IN under a collation that ignores case."""
    return F.lower(value).isin([text.lower() for text in allowed])


def at_least_zero(value: Column) -> Column:
    """The value when positive, else 0, also for NULL."""
    return F.when(value > 0, value).otherwise(F.lit(0).cast(SUM))


def floor_div(amount: Column, unit: Column) -> Column:
    """Whole units in a non-negative amount, exact on decimals; NULL for unit 0."""
    return F.call_function("div", amount, F.nullif(unit, F.lit(0)))


def ceil_div(amount: Column, unit: Column) -> Column:
    """Units needed to cover a non-negative amount, exact on decimals; NULL for unit 0."""
    whole = floor_div(amount, unit)
    rest = amount % F.nullif(unit, F.lit(0))
    return whole + F.when(rest > 0, 1).otherwise(0)


def ratio(amount: Column, unit: Column) -> Column:
    """Unrounded quotient; NULL for unit 0."""
    return amount.cast("double") / F.nullif(unit.cast("double"), F.lit(0.0))


def filled(value: Column) -> Column:
    """Neither NULL nor empty; never NULL itself."""
    return value.isNotNull() & F.coalesce(value != "", F.lit(False))
