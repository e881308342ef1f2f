"""Key ranges cut at sampled splitters, with built-in functions only.

A range is found by binary search over the sorted splitters, a pure expression of the
key: a task that runs again on another executor puts every row where it was before.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLES_PER_RANGE = 32
MOST_RANGES = 2048  # bounds the sample that reaches the driver: 32 keys for each range


def count_ranges(rows: int, rows_per_range: int) -> int:
    """How many ranges to cut ``rows`` into."""
    return max(1, min(MOST_RANGES, -(-rows // rows_per_range)))


def uniform(*salt: Column) -> Column:
    """A fixed pseudo-random number in (0, 1) for each value of ``salt``."""
    return (F.shiftrightunsigned(F.xxhash64(*salt), 11).cast("double") + 0.5) / F.lit(float(2**53))


def sample(rows: DataFrame, key: Column, salt: Sequence[Column], weight: Column, total: float, size: int) -> list[Any]:
    """About ``size`` keys, each row drawn by its share of ``total``, sorted.

    Rows pass a threshold on their own hash, so no row is compared with another and
    every task sends only its share of the sample.
    """
    if total <= 0:
        return []
    drawn = rows.where(-F.log(uniform(*salt)) < weight * F.lit(size / total))
    return sorted(row[0] for row in drawn.select(key.alias("key")).collect())


def splitters(keys: Sequence[Any], ranges: int) -> list[Any]:
    """Quantile boundaries of a sorted sample; a frequent key can be several of them."""
    return [keys[len(keys) * i // ranges] for i in range(1, ranges)] if len(keys) >= ranges else list(keys)


def _search(key: Column, boundaries: Sequence[Any], literal: Callable[[Any], Column], reach: Callable[[Column, Column], Column]) -> Column:
    if not boundaries:
        return F.lit(0)
    sorted_keys = F.array(*[literal(value) for value in boundaries])
    steps = [1 << bit for bit in reversed(range(len(boundaries).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(step) for step in steps]),
        F.lit(0),
        lambda found, step: F.when(reach(F.get(sorted_keys, found + step - 1), key), found + step).otherwise(found),
    )


def below(key: Column, boundaries: Sequence[Any], literal: Callable[[Any], Column] = F.lit) -> Column:
    """How many sorted ``boundaries`` are lower than ``key``."""
    return _search(key, boundaries, literal, lambda boundary, value: boundary < value)


def upto(key: Column, boundaries: Sequence[Any], literal: Callable[[Any], Column] = F.lit) -> Column:
    """How many sorted ``boundaries`` are not above ``key``."""
    return _search(key, boundaries, literal, lambda boundary, value: boundary <= value)


def lookup(index: Column, values: Sequence[Any]) -> Column:
    """The value at a place of a short list."""
    return F.get(F.array(*[F.lit(value) for value in values]), index.cast("int"))
