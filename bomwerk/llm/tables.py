"""Intermediate tables in the shared folder, read back with their schema."""

from __future__ import annotations

from pyspark.sql import DataFrame

from bomwerk.session import run_folder


def stored(rows: DataFrame, purpose: str) -> DataFrame:
    """Write ``rows`` to the shared folder and read them from there.

    Cuts the lineage: what a lost executor held is read again, not computed again.
    """
    spark = rows.sparkSession
    folder = run_folder(spark, purpose)
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def kept(rows: DataFrame, *results: str) -> list[str]:
    """The columns that an operator hands on beside its ``results``.

    A column with the name of a result is replaced by it, whatever its case. Names that
    begin with an underscore are the operators' own; such columns are dropped.
    """
    taken = {name.lower() for name in results}
    return [name for name in rows.columns if name.lower() not in taken and not name.startswith("_")]


def read(spark, folder: str, name: str) -> DataFrame:
    """A table of the corpus."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
