"""SpotSigs: chains of content words behind common words as document fingerprints.

Common words (anchors) are everywhere in running prose and rare in lists, menus and
numbers; the content words that follow one make a signature that is local and
characteristic. A fingerprint is the set of a text's signatures. Sets whose sizes differ
by more than the threshold allows cannot be similar, so they are compared only within
and between neighbouring ranges of sizes, and only where rare signatures meet.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomwerk.llm import ranges, rounds
from bomwerk.llm.tables import kept, stored
from bomwerk.operators.lookup import join_on_key

# Function words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from he in is it of on or that the this to was with "
    "das dem den der des die ein eine er es ist mit nicht sie und von zu "
    "au aux dans du elle et il la le les ne par pas pour que qui sur un une "
    "al como con de del el en lo los las no para por se si su y"
).split()
CHAIN = 2  # content words behind an anchor
STRETCH = 24  # words without an anchor among them, of which each is taken as one
SKIP = 8  # anchors a chain steps over between two content words
DOCS_PER_RANGE = 512
LEAST = -(2**63)
SIMILARITY = 0.8


def _pattern(words) -> str:
    """The words grouped by their first letter, so most words fail on one test."""
    groups: dict[str, list[str]] = {}
    for word in sorted(set(words)):
        groups.setdefault(word[0], []).append(word[1:])
    return "|".join(f"{first}(?:{'|'.join(sorted(rest, key=len, reverse=True))})" for first, rest in groups.items())


def signatures(text: Column, anchors=ANCHORS, chain: int = CHAIN) -> Column:
    """The sorted set of a text's signatures, each as a number below 2^32.

    The start of a text counts as an anchor too. Where ``STRETCH`` words or more follow
    each other without an anchor, and in a text that has none, every word is one, so
    texts in other languages, lists and tables are covered in whole. Chains that the end
    of the text cuts short do not count, unless the text has no other: then its words in
    a row are its signature. Null and empty texts, and those without a letter or digit,
    have none.
    """
    follow = "".join(rf"(?: \u0001[^ ]++){{0,{SKIP}}}+ \u0004?([^ \u0001\u0004]++)" for _ in range(chain))
    out = ":".join(f"${n + 1}" for n in range(chain + 1))
    bare = f"(?<![^ ])(?:[^ \u0001]++ ){{{STRETCH},}}+"

    # \u0001 marks an anchor, \u0004 a word that is one beside being content; the text's start is the anchor ^
    def every(part: Column) -> Column:
        return F.regexp_replace(part, "(?<![^ ])(?=[^ ])", "\u0004")

    def covered(marked: Column) -> Column:
        parts = F.split(F.regexp_replace(marked, bare, "\u0003$0\u0003"), "\u0003")
        stretched = F.array_join(F.transform(parts, lambda part, n: F.when(n % 2 == 1, every(part)).otherwise(part)), "")
        return F.when(F.instr(marked, "\u0001") == 0, every(marked)).when(marked.rlike(bare), stretched).otherwise(marked)

    def chains(words: Column) -> Column:
        marked = F.regexp_replace(F.concat(words, F.lit(" ")), f"(?<![^ ])(?=(?:{_pattern(anchors)}) )", "\u0001")
        cut = F.split(F.regexp_replace(F.concat(F.lit("\u0001^ "), _once(marked, covered)), rf"[\u0001\u0004]([^ ]++)(?={follow})", f"\u0002{out}\u0002"), "\u0002")
        whole = F.when(words != "", F.array(words)).otherwise(F.array().cast("array<string>"))
        return _once(F.filter(cut, lambda _, n: n % 2 == 1), lambda spots: F.when(F.size(spots) > 0, spots).otherwise(whole))

    words = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]++", " "))
    return F.array_sort(F.array_distinct(F.transform(_once(words, chains), lambda spot: F.shiftrightunsigned(F.xxhash64(spot), 32))))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def written(spots: Column) -> Column:
    """A set of signatures as text: eight hex digits each, in order."""
    return F.array_join(F.transform(spots, lambda spot: F.lower(F.lpad(F.hex(spot), 8, "0"))), "")


def jaccard(left: Column, right: Column, least: float = 0.0) -> Column:
    """Shared signatures by all of both sets, 0 where the sizes rule out ``least``; two empty sets are alike."""
    small, large = F.least(F.size(left), F.size(right)), F.greatest(F.size(left), F.size(right))
    shared = F.size(F.array_intersect(left, right))
    return (
        F.when(large == 0, 1.0)
        .when((small == 0) | (small < large * least), 0.0)
        .otherwise(shared / (F.size(left) + F.size(right) - shared))
    )


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, links) for every document with an id; the class is named by its lowest id.

    Documents belong together if a chain of fingerprints, each similar to the next, joins
    them; ``links`` counts the comparisons that linked the document's fingerprint. Sets
    are partitioned by size so that similar ones are in the same or in neighbouring
    partitions. In a set's rarest signatures, as many as a similar set cannot miss
    altogether, it meets the sets of both. Rows that repeat an id are one document; texts
    without a signature form one class.
    """
    prints = stored(
        docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), signatures(F.col("text")).alias("spots")), "spot-prints"
    )
    nodes = stored(prints.groupBy("spots").agg(F.min("doc_id").alias("node")).select("node", "spots"), "spot-nodes")
    spots = nodes.select("node", F.size("spots").alias("size"), F.explode("spots").alias("spot"))
    often = spots.groupBy("spot").agg(F.count("*").alias("often"))
    by_rarity = join_on_key(spots, often, {"spot": "spot"}, "inner").groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct("often", "spot"))).alias("spots"))
    # sizes are cut where a set stops being similar to the smallest one of its partition
    part = F.floor(F.log("size") / F.lit(-math.log(similarity))).cast("int")
    prefix = (F.col("size") - F.ceil(F.col("size") * similarity) + 1).cast("int")
    members = (
        by_rarity.select("node", part.alias("part"), F.explode(F.slice("spots", F.lit(1), prefix)).alias("s"))
        .select("node", "s.spot", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
        .select("node", F.xxhash64("spot", "part").alias("bucket"))
    )

    def judge(pairs: DataFrame) -> DataFrame:
        pairs = join_on_key(pairs, nodes, {"node": "node"}, "inner").withColumnRenamed("spots", "_left")
        pairs = join_on_key(pairs, nodes, {"hub": "node"}, "inner")
        near = jaccard(F.col("_left"), F.col("spots"))
        return pairs.select("node", "hub", near.alias("near")).withColumn("linked", F.col("near") >= similarity)

    found = stored(rounds.links(members, judge, 1 - similarity), "spot-links")
    roots = stored(rounds.components(found), "spot-roots")
    numbers = found.select(F.explode(F.array("node", "other")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    key = F.xxhash64("spots").alias("_key")
    named = join_on_key(join_on_key(nodes.select("node", key), roots, {"node": "node"}), numbers, {"node": "node"})
    named = named.select("_key", F.coalesce("root", "node").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return join_on_key(prints.select("doc_id", key), named, {"_key": "_key"}, "inner").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("links").alias("links"))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with ``next_<column>`` of the document before it by id; before the first stands the last.

    Documents are dealt into ranges of ids whose upper ends are ids of documents. The
    document at an end is the next one of the range above, and is sent there as well.
    Ids that repeat are ordered by their text's hash; a null id is the lowest.
    """
    rows = docs.select(*kept(docs, *[f"next_{c}" for c in columns])).withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)))
    count, highest = rows.agg(F.count("*"), F.max("_key")).first()
    wanted = ranges.count_ranges(count, DOCS_PER_RANGE)
    key = F.col("_key")
    drawn = ranges.sample(rows, key, [key], F.lit(1.0), count, wanted * ranges.SAMPLES_PER_RANGE)
    ends = [end for end in sorted(set(ranges.splitters(drawn, wanted))) if end != highest]
    own = ranges.below(key, ends)
    as_guest = F.when(ranges.upto(key, ends) > own, own + 1).when(key == F.lit(highest), 0)
    places = F.array_compact(F.array(F.struct(own.alias("range"), F.lit(0).alias("guest")), F.when(as_guest.isNotNull(), F.struct(as_guest.alias("range"), F.lit(1).alias("guest")))))
    rows = rows.withColumn("_place", F.explode(places)).withColumns({"_range": F.col("_place.range"), "_guest": F.col("_place.guest")}).drop("_place")
    order = Window.partitionBy("_range").orderBy("_guest", key.desc(), F.xxhash64("text"))
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return rows.where(F.col("_guest") == 0).drop("_key", "_range", "_guest")
