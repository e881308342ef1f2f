"""Intermediate results that several jobs of one run read."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame

from bomwerk.session import drop_folder, run_folder


def stored(rows: DataFrame, purpose: str) -> DataFrame:
    """``rows`` written to a run folder and read from there; a ``scratch`` block drops it."""
    spark = rows.sparkSession
    folder = run_folder(spark, purpose)
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


class Run(Mapping[str, DataFrame]):
    """Tables whose named intermediates are computed once, stored, and dropped at the end.

    ``with Run(tables) as run:`` gives the jobs inside it the same rows of ``leads_linked``
    or the planning sheet without planning them again. Results must be written, or read,
    before the run ends.
    """

    def __init__(self, tables: Mapping[str, DataFrame]):
        self._tables, self._folder, self._stored = tables, None, {}

    def __getitem__(self, name: str) -> DataFrame:
        return self._tables[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._tables)

    def __len__(self) -> int:
        return len(self._tables)

    def has(self, name: str) -> bool:
        return getattr(self._tables, "has", lambda name: False)(name)

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The stored rows of ``name``, which ``build`` makes when it is first asked for."""
        if name not in self._stored:
            rows = build()
            spark = rows.sparkSession
            self._folder = self._folder or (spark, run_folder(spark, "run"))
            path = f"{self._folder[1]}/{len(self._stored)}"
            rows.write.parquet(path)
            self._stored[name] = spark.read.schema(rows.schema).parquet(path)
        return self._stored[name]

    def __enter__(self) -> Run:
        return self

    def __exit__(self, *error: object) -> None:
        if self._folder:
            drop_folder(*self._folder)
        self._folder, self._stored = None, {}


def once(tables: Mapping[str, DataFrame], name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` makes: stored and shared if ``tables`` are those of a run."""
    if not isinstance(tables, Run):
        return build()
    return tables.once(name, build)
