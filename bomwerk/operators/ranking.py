"""Row numbers within a key, without putting a whole key into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bomwerk.session import run_folder


def numbered(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position", partitions: int | None = None
) -> DataFrame:
    """Number rows 1..n within ``keys`` by ``order``, which must be a total order.

    Rows are range-partitioned on (keys, order), so a hot key is spread over many
    partitions. Each (partition, key) slice is numbered locally and shifted by the
    size of the slices before it. The partition of a row must not change between the
    counting and the numbering, so the placement is written to a run folder first; a
    ``scratch`` block drops it. ``partitions`` sets their number, else Spark does; a large table wants
    some hundred MB in each.
    """
    spark = rows.sparkSession
    folder = run_folder(spark, "numbered")
    placed = rows.repartitionByRange(*([partitions] if partitions else []), *keys, *order).withColumn("_slice", F.spark_partition_id())
    placed.write.parquet(folder)
    placed = spark.read.schema(placed.schema).parquet(folder)
    # at most one row per (slice, key): a few rows per partition, not per input row
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        placed.groupBy("_slice", *keys)
        .agg(F.count("*").alias("_rows"))
        .select(
            F.col("_slice").alias("_in"),
            *[F.col(key).alias(f"_of_{key}") for key in keys],
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"),
        )
    )
    within = Window.partitionBy("_slice", *keys).orderBy(*order)
    ranked = placed.withColumn("_rank", F.row_number().over(within))
    matches = [F.col("_slice") == F.col("_in")]
    matches += [F.col(key).eqNullSafe(F.col(f"_of_{key}")) for key in keys]
    position = (F.col("_rank") + F.col("_shift")).alias(name)
    return ranked.join(shifts, matches).select(*rows.columns, position)
