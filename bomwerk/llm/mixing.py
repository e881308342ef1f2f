"""Mixing sources to target weights by Sainte-Laguë apportionment.

The words of the mix are dealt out in blocks of equal length. Every source is cut into
shards of bounded size; each shard gets a whole number of blocks by the method of the
highest quotients, target / (2n - 1) for its n-th block. A shard that gets more than it
holds repeats, and the last, partial turn takes its documents in a seeded order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomwerk.llm.tables import kept, stored

WEIGHTS = (5, 2, 1)  # by the rank of a source, repeating
REPEATS = 3  # a source's target is at most so many times its size
BLOCK = 128  # words
ROWS_PER_SHARD = 4096
MOST_SHARDS = 1024  # above one a source
SEED = 20240601


def words(text: Column) -> Column:
    """The number of runs without white space; none in a null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``sizes`` (source, source_size) with the target of each source.

    Runs over one row a source. Sources are capped in the order of cap / weight; the
    first one whose cap holds the common level ends the sequence.
    """
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    kind = F.pmod(F.row_number().over(ranked) - 1, F.lit(len(weights)))
    rows = sizes.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), kind))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = lambda name, all_of: F.sum(all_of).over(whole) - F.coalesce(F.sum(name).over(before), F.lit(0.0))
    rows = rows.withColumn("level", left("cap", F.col("source_size").cast("double")) / left("weight", F.col("weight")))
    holds = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    rows = rows.withColumn("level", F.first(holds, ignorenulls=True).over(whole))
    return rows.select("source", "source_size", F.least("cap", F.col("weight") * F.col("level")).alias("target"))


def quotas(shards: DataFrame, blocks: int) -> DataFrame:
    """``shards`` (source, shard, share) with ``blocks`` dealt out by Sainte-Laguë.

    Divisors somewhat above and below the mean share give each shard the blocks it has
    for certain and the ones it may have; of the latter, fewer than two a shard, the
    highest quotients win. Ties go to the lower source and shard.
    """
    total, count = shards.agg(F.coalesce(F.sum("share"), F.lit(0.0)), F.count("*")).first()
    if not total or not blocks:
        return shards.withColumn("blocks", F.lit(0).cast("long"))
    dealt = lambda seats: F.floor(F.col("share") * F.lit(seats / total) + 0.5)
    rows = shards.withColumn("sure", dealt(max(0.0, blocks - count / 2))).withColumn("most", dealt(blocks + count / 2) + 1)
    sure = rows.agg(F.sum("sure")).first()[0]
    quotients = rows.select("source", "shard", "share", F.explode(F.sequence(F.col("sure") + 1, F.col("most"))).alias("n"))
    order = Window.orderBy((F.col("share") / (2 * F.col("n") - 1)).desc(), F.col("source").asc_nulls_last(), "shard", "n")
    won = (
        quotients.withColumn("place", F.row_number().over(order)).where(F.col("place") <= blocks - sure)
        .groupBy(F.col("source").alias("_source"), F.col("shard").alias("_shard")).agg(F.count("*").alias("won"))
    )
    same = [F.col("source").eqNullSafe(F.col("_source")), F.col("shard") == F.col("_shard")]
    return (
        rows.join(won, same, "left")
        .select(*shards.columns, (F.col("sure") + F.coalesce("won", F.lit(0))).cast("long").alias("blocks"))
    )


def mix(docs: DataFrame, seed: int = SEED, weights=WEIGHTS, repeats: int = REPEATS, block: int = BLOCK) -> DataFrame:
    """``docs`` (doc_id, text, source) with size, source_size, target and taken beside all other columns.

    ``taken`` is the number of a document's words in the mix: its whole turns and, for
    the partial turn, what the seeded order leaves it; at most ``repeats`` times its
    size. A null text has no words, a null source is the last one; an empty table stays
    empty. Rows that repeat id and text are told apart by nothing and so are
    interchangeable. Columns with the names of the results are replaced.
    """
    columns = kept(docs, "size", "source_size", "target", "taken")
    rows = docs.select(*columns, words(F.col("text")).alias("size"),
                       F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("_order"))
    slim = stored(rows.select("source", "size", "_order"), "mix-sizes")
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    count = sources.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    # sources larger than a shard: at most MOST_SHARDS of them
    per_shard = max(ROWS_PER_SHARD, -(-count // MOST_SHARDS))
    large = {source: -(-number // per_shard) for source, _, number in sources.where(F.col("rows") > per_shard).collect()}
    parts = F.lit(1)
    for source, number in large.items():
        is_it = F.col("source").isNull() if source is None else F.col("source") == source
        parts = F.when(is_it, F.lit(number)).otherwise(parts)
    shard = F.pmod(F.xxhash64(F.lit("shard"), "_order"), parts.cast("long")).cast("int").alias("_shard")

    aims = targets(sources.select("source", "source_size"), weights, repeats)
    # the sources' rows once more on the right: one row a source, small beside the shards' input
    sums = slim.select("source", "size", shard).groupBy("source", "_shard").agg(F.sum("size").alias("shard_size"))
    same = [F.col("source").eqNullSafe(F.col("_source"))]
    shards = (
        sums.join(aims.withColumnRenamed("source", "_source"), same)
        .withColumn("share", F.when(F.col("source_size") > 0, F.col("target") * F.col("shard_size") / F.col("source_size")).otherwise(0.0))
        .select("source", F.col("_shard").alias("shard"), "share", "shard_size", "source_size", "target")
    )
    shards = stored(shards, "mix-shards")  # a row a shard
    total, number = shards.agg(F.coalesce(F.sum("shard_size"), F.lit(0)), F.count("*")).first()
    length = max(1, min(block, total // max(1, 8 * number)))
    dealt = stored(
        quotas(shards, round(total / length))
        .select(F.col("source").alias("_of"), F.col("shard").alias("_in"), "shard_size", "source_size", "target",
                F.least(F.col("blocks") * length, F.col("shard_size") * repeats).alias("quota")),
        "mix-quotas",
    )
    turns = F.when(F.col("shard_size") > 0, F.floor(F.col("quota") / F.col("shard_size"))).otherwise(0).cast("long")
    order = Window.partitionBy("source", "_shard").orderBy("_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.select(*columns, "size", "_order", shard).withColumn("_upto", F.sum("size").over(order))
    within = F.col("source").eqNullSafe(F.col("_of")) & (F.col("_shard") == F.col("_in"))
    rest = F.col("quota") - turns * F.col("shard_size") - (F.col("_upto") - F.col("size"))
    taken = turns * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.join(dealt, within).select(*columns, "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: each as often as the mix takes it, a part of a turn counting as one.

    All columns stay as they are. Documents without words are not in the mix.
    """
    rows = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("document"))
    taken = mix(rows, **options).where(F.col("taken") > 0)
    copies = F.ceil(F.col("taken") / F.col("size")).cast("long")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies))).select("document.*")
