"""Table sources: stored tables with fixed schemas, read lazily by name."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from bomwerk.sources.schemas import SCHEMAS


class StoredTables(Mapping[str, DataFrame]):
    """ERP tables stored as ``<root>/<table>`` in parquet, ORC, JSON or CSV."""

    def __init__(self, spark: SparkSession, root: str, source: str = "parquet", **options: str):
        self._spark = spark
        self._root = root.rstrip("/")
        self._source = source
        self._options = options

    def __getitem__(self, name: str) -> DataFrame:
        reader = self._spark.read.schema(SCHEMAS[name]).format(self._source).options(**self._options)
        return reader.load(f"{self._root}/{name}")

    def __iter__(self) -> Iterator[str]:
        return iter(SCHEMAS)

    def __len__(self) -> int:
        return len(SCHEMAS)


class CatalogTables(StoredTables):
    """ERP tables of a catalog database."""

    def __init__(self, spark: SparkSession, database: str):
        super().__init__(spark, database)

    def __getitem__(self, name: str) -> DataFrame:
        return self._spark.table(f"{self._root}.{name}")


class LocalTables(dict[str, DataFrame]):
    """Tables given as DataFrames; a table that was not given is empty."""

    def __init__(self, spark: SparkSession, given: Mapping[str, DataFrame] = {}):
        super().__init__(given)
        self._spark = spark

    def __missing__(self, name: str) -> DataFrame:
        return self._spark.createDataFrame([], SCHEMAS[name])
