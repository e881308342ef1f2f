"""Insert, update and delete as new snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def update_by_key(table: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace columns of matching rows by the update's values, also by a NULL.

    ``updates`` holds the key and the columns to set, one row per key.
    """
    changed = [name for name in updates.columns if name not in keys]
    right = updates.select(
        *[F.col(key).alias(f"_k_{key}") for key in keys],
        *[F.col(name).alias(f"_n_{name}") for name in changed],
        F.lit(True).alias("_hit"),
    )
    joined = table.join(right, [F.col(key) == F.col(f"_k_{key}") for key in keys], "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_n_{name}").cast(table.schema[name].dataType))
            .otherwise(F.col(name))
            .alias(name)
            if name in changed
            else F.col(name)
            for name in table.columns
        ]
    )


def delete_where(table: DataFrame, predicate: Column) -> DataFrame:
    """Drop rows for which the predicate is true; NULL keeps the row, as in SQL DELETE."""
    return table.filter(~F.coalesce(predicate, F.lit(False)))


def insert_new(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Append the rows whose key the table does not hold yet."""
    new = rows.join(table.select(*keys).distinct(), list(keys), "left_anti")
    return table.unionByName(new.select(*rows.columns), allowMissingColumns=True)
