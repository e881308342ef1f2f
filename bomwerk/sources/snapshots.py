"""Versions of a set of tables: data is written first, one small commit record last.

``root/<table>/<folder>`` has data that is never changed, ``root/_commits`` one record for
each version with the folders that make up every table. A reader takes one version and
keeps it; what a run wrote before it failed is in no record. A record holds all tables, so
a header and its lines appear together. Commits carry the id of their run: a repeated run
finds its commit and adds nothing. One writer at a time commits to a root.

A table may be kept in buckets of a key. An update then rewrites the buckets that hold one
of its keys; the folders of the others go on into the new version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bomwerk.session import folder_exists
from bomwerk.sources.schemas import KEPT, SCHEMAS

TABLES = SCHEMAS | KEPT
COMMITS = "version LONG, run STRING, tables MAP<STRING, STRUCT<buckets: INT, key: STRING, parts: ARRAY<STRUCT<bucket: INT, folder: STRING>>>>"
WHOLE = -1  # bucket of a folder that has rows of all buckets


@dataclass(frozen=True)
class Layout:
    """Folders of a table, by bucket of ``key`` if it has ``buckets``."""

    buckets: int = 0
    key: str = ""
    parts: tuple[tuple[int, str], ...] = ()


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class SnapshotTables(Mapping[str, DataFrame]):
    """The ERP tables of one version below ``root``: the latest, or the one given.

    A table that the version does not have is taken from ``over``, else it is empty.
    """

    def __init__(self, spark: SparkSession, root: str, version: int | None = None, over: Mapping[str, DataFrame] = {}):
        self._spark, self.root, self._over = spark, root.rstrip("/"), over
        records = [] if self._new() else self._records(version)
        if version is not None and not records:
            raise KeyError(f"no version {version} in {root}")
        latest = max(records, key=lambda record: record.version) if records else None
        self.version = latest.version if latest else 0
        layouts = latest.tables if latest else {}
        self._layouts = {name: Layout(t.buckets, t.key, tuple((p.bucket, p.folder) for p in t.parts)) for name, t in layouts.items()}

    def _new(self) -> bool:
        return not folder_exists(self._spark, f"{self.root}/_commits")

    def _read(self) -> DataFrame:
        return self._spark.read.schema(COMMITS).json(f"{self.root}/_commits")

    def _records(self, version: int | None) -> list:
        found = self._read()
        if version is not None:
            return found.where(F.col("version") == version).collect()
        return found.agg(F.max_by(F.struct("*"), "version").alias("record")).where(F.col("record").isNotNull()).select("record.*").collect()

    def __getitem__(self, name: str) -> DataFrame:
        if not self.has(name) and name in self._over:
            return self._over[name]
        return self._rows(name, list(self.folders(name)))

    def has(self, name: str) -> bool:
        """Whether the version itself holds a table."""
        return name in self._layouts

    def _rows(self, name: str, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self._spark.createDataFrame([], TABLES[name])
        return self._spark.read.schema(TABLES[name]).parquet(*[f"{self.root}/{folder}" for folder in folders])

    def __iter__(self) -> Iterator[str]:
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)

    def folders(self, name: str) -> dict[str, int]:
        """The folders of a table with their bucket."""
        return {folder: bucket for bucket, folder in self._layouts.get(name, Layout()).parts}

    def latest(self) -> SnapshotTables:
        return SnapshotTables(self._spark, self.root, over=self._over)

    def done(self, run: str) -> bool:
        """Whether a run has committed."""
        return not self._new() and not self._read().where(F.col("run") == run).isEmpty()

    def change(self, run: str) -> Change:
        """Changes to several tables that are to be committed together."""
        return Change(self, run)


class Change:
    """Tables written on top of a version; nothing is visible before ``commit``."""

    def __init__(self, base: SnapshotTables, run: str):
        self._base, self.run = base, run
        self._layouts = dict(base._layouts)

    def added(self, name: str) -> DataFrame:
        """The rows that were written to a table last."""
        return self._base._rows(name, [self._layouts[name].parts[-1][1]])

    def _fresh(self, name: str) -> str:
        return f"{name}/{uuid.uuid4().hex}"

    def _write(self, name: str, rows: DataFrame) -> str:
        folder = self._fresh(name)
        shaped(rows, name).write.parquet(f"{self._base.root}/{folder}")
        return folder

    def replace(self, name: str, rows: DataFrame, key: str = "", buckets: int = 0) -> Change:
        """The table holds ``rows`` and nothing else, in ``buckets`` of ``key`` if given.

        Choose ``buckets`` so that the table has some hundred MB in each.
        """
        if not buckets:
            self._layouts[name] = Layout(parts=((WHOLE, self._write(name, rows)),))
            return self
        folder, where = self._fresh(name), bucket_of(key, buckets)
        # a large bucket becomes several files, a small one a single one
        placed = shaped(rows, name).withColumn("_bucket", where).hint("rebalance", F.col("_bucket"))
        placed.write.partitionBy("_bucket").parquet(f"{self._base.root}/{folder}")
        written = self._base._spark.read.schema(f"{TABLES[name]}, _bucket INT").parquet(f"{self._base.root}/{folder}")
        kept = written.select("_bucket").distinct().collect()  # at most a number for each bucket
        self._layouts[name] = Layout(buckets, key, tuple(sorted((row[0], f"{folder}/_bucket={row[0]}") for row in kept)))
        return self

    def append(self, name: str, rows: DataFrame) -> Change:
        """The table also holds ``rows``; what it held is not touched."""
        old = self._layouts.get(name, Layout())
        self._layouts[name] = Layout(old.buckets, old.key, (*old.parts, (WHOLE, self._write(name, rows))))
        return self

    def rewrite(self, name: str, keys: DataFrame, new: Callable[[DataFrame], DataFrame]) -> Change:
        """``new`` of the rows in buckets that hold one of ``keys``, a column named as the table's key.

        ``new`` must leave other keys' rows as they are and keep rows in their bucket.
        Appended rows that are in no bucket yet are put in theirs.
        """
        old = self._layouts.get(name, Layout())
        if not old.buckets:
            return self.replace(name, new(self._base._rows(name, [folder for _, folder in old.parts])))
        where = bucket_of(old.key, old.buckets)
        loose = [folder for bucket, folder in old.parts if bucket == WHOLE]
        touched = {row[0] for row in keys.select(where.alias("b")).distinct().collect()}  # at most a number for each bucket
        if loose:
            touched |= {row[0] for row in self._base._rows(name, loose).select(where.alias("b")).distinct().collect()}
        stays = tuple(part for part in old.parts if part[0] != WHOLE and part[0] not in touched)
        goes = [folder for bucket, folder in old.parts if bucket == WHOLE or bucket in touched]
        if not goes:
            return self
        self.replace(name, new(self._base._rows(name, goes)), old.key, old.buckets)
        self._layouts[name] = Layout(old.buckets, old.key, tuple(sorted((*stays, *self._layouts[name].parts))))
        return self

    def commit(self) -> SnapshotTables:
        """Make all changes the next version, unless the run has one already."""
        base = self._base
        if base.done(self.run):
            return base.latest()
        latest = base.latest()
        if latest.version != base.version:
            raise RuntimeError(f"version {latest.version} was committed after {base.version}, on which run {self.run} is based")
        tables = {name: (t.buckets, t.key, [tuple(part) for part in t.parts]) for name, t in self._layouts.items()}
        record = base._spark.createDataFrame([(base.version + 1, self.run, tables)], COMMITS)
        record.coalesce(1).write.mode("append").json(f"{base.root}/_commits")
        return base.latest()


def shaped(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the columns and types of a table; those they lack are NULL."""
    schema = rows.sparkSession.createDataFrame([], TABLES[name]).schema
    given = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def stored_tables(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], names: Sequence[str], run: str = "start") -> SnapshotTables:
    """``names`` of ``tables`` as the first version below ``root``, and the others over it."""
    change = SnapshotTables(spark, root, over=tables).change(run)
    for name in names:
        change.replace(name, tables[name])
    return change.commit()
