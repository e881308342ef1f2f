"""Shards of near equal size by sampled splitters.

Records are ordered by the hash of their text and then by id, so copies of a text are
neighbours. Splitters drawn by size cut this order into ranges, overfull ranges are cut
again, and the exact sizes of the ranges place every record on one line of bytes, which
the shards divide. Records that fill an eighth of a shard or more, of which there are at
most eight a shard, are placed first, and the others fill what is left.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomwerk.llm import ranges
from bomwerk.llm.tables import kept, stored

OVERHEAD = 16  # bytes a record takes besides its text
BIG = 8  # a record above 1/8 of a shard is placed by itself
OVERFULL = 2  # times the mean range
ROUNDS = 4  # of cutting overfull ranges
ROWS_PER_RANGE = 4096
LEAST = -(2**63)


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text, none for a null, and the overhead."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def _key(text: Column, doc_id: Column) -> Column:
    return F.struct(F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash"), F.coalesce(doc_id.cast("long"), F.lit(LEAST)).alias("id"))


def _literal(key: Any) -> Column:
    return F.struct(F.lit(key[0]).cast("long").alias("hash"), F.lit(key[1]).cast("long").alias("id"))


def _fill(loads: Sequence[int], amount: int) -> list[float]:
    """What each shard still takes so that all end at one level, ``amount`` in total."""
    low, high = 0.0, float(max(loads) + amount)
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(max(0.0, level - load) for load in loads) < amount else (low, level)
    return [max(0.0, high - load) for load in loads]


def assign(docs: DataFrame, shards: int = 40) -> DataFrame:
    """``docs`` (doc_id, text) with size, shard and slot beside all other columns.

    Shards are numbered from 0 and slots in a shard from 0 without gaps. Shard sizes
    differ by at most one record of less than 1/8 of a shard, unless a single record
    exceeds a shard's share. A null text counts as empty. Null ids sort first; rows that
    repeat id and text are neighbours. An empty table stays empty. Columns named size,
    shard or slot are replaced.
    """
    columns = kept(docs, "size", "shard", "slot")
    rows = docs.select(*columns, record_size(F.col("text")).alias("size"), _key(F.col("text"), F.col("doc_id")).alias("_key"))
    slim = stored(rows.select("_key", "size"), "shard-keys")
    total, count = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()

    # records above total / (8 * shards): fewer than 8 * shards of them
    limit = total / (BIG * shards)
    big = sorted(((r[1], r[0][0], r[0][1]) for r in slim.where(F.col("size") > limit).select("_key", "size").collect()), reverse=True)
    loads, placed = [0] * shards, [[] for _ in range(shards)]
    for size, *key in big:
        at = min(range(shards), key=lambda shard: (loads[shard], shard))
        loads[at] += size
        placed[at].append(tuple(key))
    small = slim.where(F.col("size") <= limit)
    small_total, small_count = total - sum(size for size, *_ in big), count - len(big)

    cuts, totals = _cut(small, small_total, small_count)
    byte_starts, row_starts = [0], [0]
    for size, number in totals:
        byte_starts.append(byte_starts[-1] + size)
        row_starts.append(row_starts[-1] + number)
    room, edges = _fill(loads, small_total), []
    for width in room[:-1]:
        edges.append((edges[-1] if edges else 0.0) + width)

    def lined(records: DataFrame) -> DataFrame:
        """Records with their row on the line and the shard that has its middle."""
        order = Window.partitionBy("_range").orderBy("_key")
        upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        middle = ranges.lookup(F.col("_range"), byte_starts) + F.sum("size").over(upto) - F.col("size") / 2
        return (
            records.withColumn("_range", ranges.below(F.col("_key"), cuts, _literal).cast("int"))
            .withColumn("_row", ranges.lookup(F.col("_range"), row_starts) + F.row_number().over(order) - 1)
            .withColumn("shard", ranges.upto(middle, edges).cast("int"))
        )

    # one row a shard
    first = {shard: (row, number) for shard, row, number in lined(small).groupBy("shard").agg(F.min("_row"), F.count("*")).collect()}
    starts = [first.get(shard, (0, 0))[0] for shard in range(shards)]
    out = lined(rows.where(F.col("size") <= limit)).withColumn("slot", (F.col("_row") - ranges.lookup(F.col("shard"), starts)).cast("long"))
    out = out.select(*columns, "size", "shard", "slot")
    if big:
        out = out.unionByName(_place(rows.where(F.col("size") > limit), columns, placed, [first.get(shard, (0, 0))[1] for shard in range(shards)]))
    return out


def _cut(records: DataFrame, total: int, count: int) -> tuple[list[Any], list[tuple[int, int]]]:
    """Splitters, and size and rows of each range between them."""
    wanted = ranges.count_ranges(count, ROWS_PER_RANGE)
    key = F.col("_key")
    salt = [key["hash"], key["id"]]
    drawn = ranges.sample(records, key, salt, F.col("size"), total, wanted * ranges.SAMPLES_PER_RANGE)
    cuts = sorted({tuple(k) for k in ranges.splitters(drawn, wanted)})
    tried: set[tuple] = set()
    for turn in range(ROUNDS):
        placed = records.withColumn("_range", ranges.below(key, cuts, _literal))
        found = {r[0]: (r[1], r[2]) for r in placed.groupBy("_range").agg(F.sum("size"), F.count("*")).collect()}
        totals = [found.get(n, (0, 0)) for n in range(len(cuts) + 1)]
        mean = max(1, total / wanted), max(1, count / wanted)
        # a range of one key cannot be cut; one that was tried in vain is such a range
        over = [n for n, (size, number) in enumerate(totals) if number > ROWS_PER_RANGE and (size > OVERFULL * mean[0] or number > OVERFULL * mean[1])]
        over = [n for n in over if (tuple(cuts[n - 1 : n + 1]), n) not in tried]
        if not over or turn == ROUNDS - 1 or len(cuts) >= 4 * ranges.MOST_RANGES:
            return cuts, totals
        tried |= {(tuple(cuts[n - 1 : n + 1]), n) for n in over}
        inside = placed.where(F.col("_range").isin(over))
        drawn = ranges.sample(inside, key, [*salt, F.lit(turn)], F.lit(1.0), sum(totals[n][1] for n in over), len(over) * 4 * ranges.SAMPLES_PER_RANGE)
        cuts = sorted({*cuts, *(tuple(k) for k in drawn[:: ranges.SAMPLES_PER_RANGE])})
    raise AssertionError("unreachable")


def _place(records: DataFrame, columns: list[str], placed: list[list[tuple]], counts: list[int]) -> DataFrame:
    """The big records, fewer than eight a shard, in their shards behind the small ones."""
    # equal keys can be in several shards: the n-th of them takes the n-th place
    spots: dict[tuple, list[tuple[int, int]]] = {}
    for shard, keys in enumerate(placed):
        for n, key in enumerate(keys):
            spots.setdefault(key, []).append((shard, counts[shard] + n))
    at = F.element_at(
        F.map_from_entries(F.array(*[
            F.struct(
                F.lit(f"{key[0]}/{key[1]}").alias("key"),
                F.array(*[F.struct(F.lit(shard).alias("shard"), F.lit(slot).cast("long").alias("slot")) for shard, slot in where]).alias("where"),
            )
            for key, where in spots.items()
        ])),
        F.concat_ws("/", F.col("_key.hash").cast("string"), F.col("_key.id").cast("string")),
    )
    nth = F.row_number().over(Window.partitionBy("_key").orderBy("size"))
    return records.withColumn("_at", F.get(at, nth - 1)).select(*columns, "size", F.col("_at.shard").alias("shard"), F.col("_at.slot").alias("slot"))
