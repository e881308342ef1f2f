"""How document filters interact in every order they could be applied in.

A document fails a set of filters, its mask. In an order, the filter that removes it is
the first one it fails: the minimum, over the filters of its mask, of their positions in
the order. As matrices: masks (0 where the filter fails, else infinite) combined with the
inverse permutations of the orders by minimum of sums give the step at which each order
removes each mask. What a step removes, and what its filter would have found had another
one not been faster, are sums over masks, weighted by how many documents have them.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomwerk.llm.tables import kept, stored
from bomwerk.operators.lookup import join_on_key

SPACES = r"[\x20\x09-\x0D]+"
MOST_FILTERS = 7  # 5,040 orders


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions A to D of a text, which is not null."""
    words = F.array_remove(F.split(text, SPACES), "")
    number = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": number < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * number.cast("long"),
        "C": 100 * capitals.cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, digest, ...) with ``repeat``: whether a lower id has the same digest.

    The lowest id of each digest is found by a minimum, and met on id and digest
    together, so a digest that a third of all rows share is no hot key. A row without an
    id neither repeats another nor is repeated.
    """
    first = docs.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("first")).withColumn("_first", F.lit(True))
    return join_on_key(docs, first, {"doc_id": "first", "digest": "digest"}).withColumn("repeat", F.col("doc_id").isNotNull() & F.col("_first").isNull()).drop("_first")


def masks(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, mask, documents, good, toxic): documents by the set of filters they fail.

    ``docs`` has doc_id, text and the column ``part``, ``labels`` doc_id, quality and
    toxic. A null text and a null part are empty. Bit n of a mask is the n-th of the
    filters A to E. Repeated labels of a document count once, a 1 before a 0.
    """
    text = F.coalesce("text", F.lit(""))
    failures = text_failures(text)
    bits = sum(F.when(failed, 1 << n).otherwise(0) for n, failed in enumerate(failures.values()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(part, F.lit("")).alias("part"), bits.alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = repeats(stored(rows, "audit-masks"))
    one = lambda name: F.max(F.when(F.col(name) == 1, 1).otherwise(0))
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    rows = join_on_key(rows, marked, {"doc_id": "_id"}).withColumn("mask", F.col("mask") + F.when(F.col("repeat"), 1 << len(failures)).otherwise(0))
    return rows.groupBy("part", "mask").agg(
        F.count("*").alias("documents"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")
    )


def audit(counts: DataFrame, filters: str, weights: Mapping[str, str]) -> DataFrame:
    """What every step of every order of ``filters`` does, per part.

    ``counts`` has part, mask and documents, once or more for each mask; ``filters`` are
    up to seven letters, the first for the lowest bit of a mask. One row for each part,
    order and step, zeros included: kept after the step, removed by it, redundant (failing its
    filter, but removed before), unique_fails (failing its filter only), shapley (removed
    by its filter in all orders together), and for each new name in ``weights`` the sum
    of that column over the removed. No counts give no rows.
    """
    if len(filters) > MOST_FILTERS or len(set(filters)) != len(filters):
        raise ValueError(f"up to {MOST_FILTERS} different filters")
    summed = counts.groupBy("part", "mask").agg(F.sum("documents").alias("documents"), *[F.sum(name).alias(name) for name in dict.fromkeys(weights.values())])
    orders = F.array(*[F.lit("".join(order)) for order in permutations(filters)])
    position = {letter: F.instr("filter_order", letter) for letter in filters}
    failing = {letter: F.col("mask").bitwiseAND(1 << n) != 0 for n, letter in enumerate(filters)}
    # the minimum of positions over the mask; a document that fails nothing outlasts all steps
    terms = [F.when(failing[letter], position[letter]).otherwise(len(filters) + 1) for letter in filters]
    rows = summed.withColumn("filter_order", F.explode(orders)).withColumn("_removal", F.least(*terms, F.lit(len(filters) + 1)))
    rows = rows.withColumn("step", F.explode(F.array(*[F.lit(n + 1) for n in range(len(filters))])))
    rows = rows.withColumn("filter", F.substr("filter_order", F.col("step"), F.lit(1)))
    bit = F.element_at(F.create_map(*[F.lit(x) for n, letter in enumerate(filters) for x in (letter, 1 << n)]), F.col("filter"))
    here, fails = F.col("_removal") == F.col("step"), F.col("mask").bitwiseAND(bit) != 0
    total = lambda which, name="documents": F.sum(F.when(which, F.col(name)).otherwise(0))
    rows = rows.groupBy("part", "filter_order", "step", "filter").agg(
        total(F.col("_removal") > F.col("step")).alias("kept"), total(here).alias("removed"),
        total(fails & (F.col("_removal") < F.col("step"))).alias("redundant"), total(F.col("mask") == bit).alias("unique_fails"),
        *[total(here, name).alias(new) for new, name in weights.items()],
    )
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def audited(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The audit of filters A to E over ``docs``, good and toxic documents apart.

    A: under 200 words. B: fewer than half of the words are distinct. C: over 3 % of the
    code points are A to Z. D: one of ``#$%&*|`` occurs. E: a lower id has the same text.
    """
    return audit(masks(docs, labels, part), "ABCDE", {"good_lost": "good", "toxic_lost": "toxic"})
