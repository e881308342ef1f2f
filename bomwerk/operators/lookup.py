"""Point lookups as joins: one row per key on the right side, then a join on the key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], last: bool = False) -> DataFrame:
    """Keep one row per key: the first (or last) by ``order``, NULLs lowest.

    An aggregate rather than a window, so each task keeps one row per key before
    the shuffle and a hot key costs no more than a cold one.
    """
    rest = [name for name in rows.columns if name not in keys]
    pick = F.max_by if last else F.min_by
    # a struct is not NULL even when its fields are, so no row is skipped
    chosen = pick(F.struct(*rest), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(chosen).select(*keys, "_row.*")


def join_on_key(rows: DataFrame, target: DataFrame, on: dict[str, str], how: str = "left") -> DataFrame:
    """Join many ``rows`` to a ``target`` keyed by the columns ``on`` maps to; its key columns are dropped.

    The hash of the key is a second, redundant key. An aggregated target is already
    partitioned by its key and would be joined without a shuffle of its own; adaptive
    execution then cannot split a hot key of ``rows``. With the hash both sides are
    shuffled for this join, and it can.
    """
    right = target.select(
        *[F.col(name).alias(f"_k{i}") for i, name in enumerate(on.values())],
        *[name for name in target.columns if name not in on.values()],
    )
    keys = [f"_k{i}" for i in range(len(on))]
    right = right.withColumn("_hash", F.xxhash64(*keys))
    condition = [F.col(left) == F.col(key) for left, key in zip(on, keys, strict=True)]
    condition.append(F.xxhash64(*on) == F.col("_hash"))
    return rows.join(right, condition, how).drop("_hash", *keys)


def lookup(
    rows: DataFrame, target: DataFrame, on: dict[str, str], columns: dict[str, str], how: str = "left"
) -> DataFrame:
    """Fetch columns from a target with one row per key.

    ``on`` maps a column of ``rows`` to a column of ``target``, ``columns`` maps the
    new name to the target's.
    """
    right = target.select(
        *[F.col(name).alias(f"_on{i}") for i, name in enumerate(on.values())],
        *[F.col(name).alias(new) for new, name in columns.items()],
    )
    return join_on_key(rows, right, {left: f"_on{i}" for i, left in enumerate(on)}, how)
