"""Which ranges of whole numbers contain a point, as a join on equal keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomwerk.operators.lookup import join_on_key

BITS = 31  # numbers from 0 below 2^31


def _pieces(low: Column, high: Column) -> Column:
    """The fewest aligned blocks (level, number), of 2^level numbers each, that make up ``low`` to ``high``."""
    kind = "struct<low:bigint,high:bigint,out:array<struct<level:int,number:bigint>>>"
    start = F.struct(low.cast("long").alias("low"), (high.cast("long") + 1).alias("high"), F.array().cast("array<struct<level:int,number:bigint>>").alias("out"))

    def step(state: Column, level: Column) -> Column:
        is_open = state["low"] < state["high"]
        left, right = is_open & (state["low"] % 2 == 1), is_open & (state["high"] % 2 == 1)
        block = lambda number: F.array(F.struct(level.cast("int").alias("level"), number.alias("number")))
        nothing = F.array().cast("array<struct<level:int,number:bigint>>")
        out = F.concat(state["out"], F.when(left, block(state["low"])).otherwise(nothing), F.when(right, block(state["high"] - 1)).otherwise(nothing))
        # a block that is an odd half of the next level's stays; the rest goes up
        return F.struct(F.shiftright(state["low"] + 1, 1).alias("low"), F.shiftright(state["high"], 1).alias("high"), out.alias("out")).cast(kind)

    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS)), start.cast(kind), step)["out"]


def contained(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str) -> DataFrame:
    """``ranges`` with every row of ``points`` whose ``point`` is from ``low`` to ``high``.

    A range is made of at most 60 aligned blocks, and a point lies in one block of each
    size, so both meet by equal keys, each pair once. Numbers are from 0 below 2^31;
    NULLs and ranges that end before they start contain nothing. Column names must differ.
    """
    blocks = ranges.withColumn("_piece", F.explode(_pieces(F.col(low), F.col(high))))
    blocks = blocks.withColumns({"_level": F.col("_piece.level"), "_number": F.col("_piece.number")}).drop("_piece")
    places = F.expr(f"transform(sequence(0, {BITS}), l -> named_struct('l', l, 'n', shiftright(CAST({point} AS BIGINT), l)))")
    at = points.where(F.col(point).isNotNull()).withColumn("_place", F.explode(places))
    at = at.withColumns({"_l": F.col("_place.l"), "_n": F.col("_place.n")}).drop("_place")
    return join_on_key(at, blocks, {"_l": "_level", "_n": "_number"}, "inner").drop("_l", "_n")
