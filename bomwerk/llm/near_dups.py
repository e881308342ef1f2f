"""Near-duplicate texts by DartMinHash.

A text is a weighted set of five-word shingles. Each shingle throws darts, a Poisson
process fixed by the shingle's hash, at the region of its weight; a dart has a rank and
a coordinate. A text looks at ranks up to a limit that leaves it a few darts for each
coordinate, and the earliest dart of each coordinate is the signature. Two signatures
agree at a coordinate with the probability of the weighted Jaccard similarity. Where the
share of agreeing coordinates is near the threshold, the shingles themselves decide.

Texts with equal signatures are one node. Nodes meet in buckets of equal bands. First
all members of a bucket are compared with one hub, the node that meets most others. The
members that this leaves in different classes are compared in blocks: those outside the
largest class of the bucket with all others. A task compares two blocks of bounded size
and hands on the sure links that join classes and the nodes with links in doubt. Classes that are still apart then are compared by their shingles,
again in blocks, until a pair of them is joined or all its links are refused.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bomwerk.llm import batches, rounds
from bomwerk.llm.tables import stored
from bomwerk.operators.lookup import join_on_key

SHINGLE = 5  # words
SIMILARITY = 0.8
BANDS, ROWS = 32, 8
COORDINATES = BANDS * ROWS
DARTS = COORDINATES * (math.log(COORDINATES) + 3)  # expected; leaves about one text in 20 without one at some coordinate
DOUBT = 0.075  # so near the threshold, three standard errors, pairs are compared by their shingles
LOW, SURE = math.floor((SIMILARITY - DOUBT) * COORDINATES), math.ceil((SIMILARITY + DOUBT) * COORDINATES)
BLOCK, BLOCK_BYTES = 256, 8 << 20  # nodes and bytes of text
NEAREST = 3  # links in doubt to hubs that are tried for two classes; the blocks judge all others
COLUMNS = 1 << 13  # shingles of a block that are counted at once
SLICE_DARTS = 1 << 18  # that a task throws at once
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, weight) of all shingles: the weight is 1 + log2 of the count.

    A text of one to four words is one shingle; one without a letter or digit is its own
    characters.
    """
    import xxhash

    codes, words, starts = batches.split(batches.plain(texts, r"\p{L}\p{N}"))
    own = np.fromiter((xxhash.xxh64_intdigest(word) for word in words), np.uint64, len(words))
    hashes = own[codes] if len(codes) else np.zeros(0, np.uint64)
    lengths = np.diff(starts)
    long = lengths >= SHINGLE
    rolled = np.zeros(max(0, len(hashes) - SHINGLE + 1), np.uint64)
    for n in range(SHINGLE):
        rolled = _mix(rolled + _GOLDEN) ^ hashes[n : n + len(rolled)]
    # shingles that do not run over the end of their text
    of = np.repeat(np.arange(len(lengths)), lengths)[: len(rolled)]
    inside = np.arange(len(rolled)) + SHINGLE <= starts[of + 1] if len(rolled) else np.zeros(0, bool)
    text, value = [of[inside]], [_mix(rolled[inside])]
    for n in np.flatnonzero(~long):
        if lengths[n]:
            key = " ".join(words[c] for c in codes[starts[n] : starts[n + 1]])
        else:
            key = "\u0000" + (texts[int(n)].as_py() or "")
        text.append(np.array([n]))
        value.append(np.array([xxhash.xxh64_intdigest(key)], np.uint64))
    text, value = np.concatenate(text).astype(np.int64), np.concatenate(value)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    first = np.ones(len(text), bool)
    first[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(text)))
    return text[at], value[at], 1.0 + np.log2(counts)


def signatures(text: np.ndarray, value: np.ndarray, weight: np.ndarray, number: int) -> np.ndarray:
    """``COORDINATES`` 16-bit prints for each of ``number`` texts, of which none is without a shingle."""
    total = np.bincount(text, weight, number)
    # the weight axis is cut at 0, 1, 2, 4, 8 ...; a strip below the weight throws darts at its own pace
    parts = []
    low, high, strip = 0.0, 1.0, 0
    left = np.arange(len(text))
    while len(left):
        parts.append((left, np.full(len(left), low), np.full(len(left), high - low), np.full(len(left), strip, np.uint64)))
        low, high, strip = high, high * 2, strip + 1
        left = left[weight[left] > low]
    index, floor, width, strips = (np.concatenate([part[n] for part in parts]) for n in range(4))
    element = _mix(value[index] + strips * _GOLDEN)
    best = np.full((number, COORDINATES), np.iinfo(np.uint64).max, np.uint64)
    flat = best.reshape(-1)
    limit, todo = DARTS / total, np.ones(number, bool)
    while todo.any():
        live = np.flatnonzero(todo[text[index]])
        rank, turn, many = np.zeros(len(live)), 0, 1
        while len(live):
            steps = np.arange(turn, turn + many, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            seed = _mix(element[live][:, None] ^ (steps * _GOLDEN)[None, :])
            wait = -np.log(((seed >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / width[live][:, None]
            ranks = rank[:, None] + np.cumsum(wait, axis=1)
            most = limit[text[index[live]]][:, None]
            second = _mix(seed + _GOLDEN)
            height = floor[live][:, None] + width[live][:, None] * ((second >> np.uint64(40)).astype(np.float64) / 2.0**24)
            hit = (ranks <= most) & (height < weight[index[live]][:, None])
            row, _ = np.nonzero(hit)
            third = second[hit]
            place = text[index[live[row]]] * COORDINATES + (third & np.uint64(0xFFFFFF)) % np.uint64(COORDINATES)
            dart = (ranks[hit].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (_mix(third) >> np.uint64(32))
            np.minimum.at(flat, place.astype(np.int64), dart)
            on = ranks[:, -1] <= most[:, 0]
            live, rank = live[on], ranks[on, -1]
            turn += many
            many = min(2 * many, 64, max(1, SLICE_DARTS // max(1, len(live))))
        # a text that misses a coordinate looks at twice the ranks, which adds darts and changes none
        todo = (best == np.iinfo(np.uint64).max).any(axis=1)
        limit = np.where(todo, limit * 2, limit)
    return (best & np.uint64(0xFFFF)).astype("<u2")


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, signature, bytes) of all documents with an id; a null text counts as empty."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part in batches.slices(batch):
                for low in range(0, part.num_rows, 512):
                    some = part.slice(low, 512)
                    prints = signatures(*shingles(some.column("text")), some.num_rows)
                    bodies = [p.tobytes() for p in prints]
                    lengths = pc.binary_length(some.column("text")).cast(pa.int64())
                    yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(bodies, pa.binary()), lengths], names=["doc_id", "signature", "bytes"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, signature binary, bytes long")


@F.pandas_udf(T.IntegerType())
def agreeing(left: pd.Series, right: pd.Series) -> pd.Series:
    """At how many coordinates two signatures agree."""
    a = np.frombuffer(b"".join(left), "<u2").reshape(len(left), -1)
    b = np.frombuffer(b"".join(right), "<u2").reshape(len(right), -1)
    return pd.Series((a == b).sum(axis=1).astype(np.int32))


def exact(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """``pairs`` (node, other) with the weighted Jaccard similarity of their texts as ``exact``."""
    ids = pairs.select(F.explode(F.array("node", "other")).alias("id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = stored(texts.join(ids, "id", "left_semi"), "near-texts")
    both = join_on_key(pairs.select("node", "other"), texts.withColumnRenamed("text", "left"), {"node": "id"}, "inner")
    both = join_on_key(both, texts.withColumnRenamed("text", "right"), {"other": "id"}, "inner")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part in batches.slices(batch, "left", "right"):
                found = weighted_jaccard(part.column("left"), part.column("right"))
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("other"), pa.array(found, pa.float64())], names=["node", "other", "exact"])

    # a repeated id gives a pair more than one similarity
    return both.mapInArrow(run, "node long, other long, exact double").groupBy("node", "other").agg(F.max("exact").alias("exact"))


def weighted_jaccard(left: pa.Array, right: pa.Array) -> np.ndarray:
    """The similarity of each pair of texts: the sum of the lower weights by that of the higher."""
    sides = [shingles(left), shingles(right)]
    text, value, weight = (np.concatenate([side[n] for side in sides]) for n in range(3))
    order = np.lexsort((value, text))
    text, value, weight = text[order], value[order], weight[order]
    same = (text[1:] == text[:-1]) & (value[1:] == value[:-1])
    shared = np.bincount(text[1:][same], np.minimum(weight[1:], weight[:-1])[same], len(left))
    return shared / (np.bincount(text, weight, len(left)) - shared)


def roots(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, root) of the similar ``nodes`` (node, signature, bytes): the root is the lowest of its class.

    Every node that shares a bucket with one it resembles is linked to it or, by other
    links, to its class; nodes without a link may be left out. ``docs`` (doc_id, text)
    has the texts of the nodes.
    """
    bands = F.array(*[F.xxhash64(F.lit(n), F.substring("signature", 1 + 2 * ROWS * n, 2 * ROWS)) for n in range(BANDS)])
    members = nodes.select("node", "bytes", F.posexplode(bands).alias("band", "bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    members = stored(join_on_key(members, sizes, {"bucket": "bucket"}, "inner").select("bucket", "band", "node", "bytes", "size"), "near-members")
    # the middle of a group of near-copies shares a bucket with more of them than its fringe
    degrees = members.groupBy("node").agg(F.sum("size").alias("degree"))
    rank = F.struct("degree", F.xxhash64("node").alias("draw"), "node")
    hubs = join_on_key(members, degrees, {"node": "node"}, "inner").groupBy("bucket").agg(F.max(rank).alias("hub")).select("bucket", F.col("hub.node").alias("hub"))
    pairs = join_on_key(members, hubs, {"bucket": "bucket"}, "inner").where(F.col("node") != F.col("hub")).select("node", F.col("hub").alias("other")).distinct()
    prints = nodes.select("node", "signature")
    pairs = join_on_key(pairs, prints, {"node": "node"}, "inner").withColumnRenamed("signature", "_left")
    pairs = join_on_key(pairs, prints, {"other": "node"}, "inner").select("node", "other", agreeing("_left", "signature").alias("near"))
    starred = _starred(pairs.where(F.col("near") >= LOW), docs)

    # buckets whose members are in one class by now are done; in others, the largest class
    # is compared with the rest, and the rest with itself
    members = join_on_key(members.drop("size"), starred, {"node": "node"}).withColumn("root", F.coalesce("root", "node"))
    shares = members.groupBy("bucket", "root").agg(F.count("*").alias("_n"), F.sum("bytes").alias("_bytes"))
    largest = F.struct("_n", "root")
    mixed = shares.groupBy("bucket").agg(
        F.max_by("root", largest).alias("_main"), F.max_by("_n", largest).alias("_main_n"), F.max_by("_bytes", largest).alias("_main_bytes"),
        F.sum("_n").alias("_n"), F.sum("_bytes").alias("_bytes"), F.count("*").alias("_classes"),
    )
    blocks = lambda n, size: F.least(n, F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)))
    mixed = mixed.where(F.col("_classes") > 1).select(
        "bucket", "_main", blocks(F.col("_main_n"), F.col("_main_bytes")).cast("int").alias("_mains"),
        blocks(F.col("_n") - F.col("_main_n"), F.col("_bytes") - F.col("_main_bytes")).cast("int").alias("_rests"),
    )
    members = join_on_key(members, mixed, {"bucket": "bucket"}, "inner")
    is_main = F.col("root") == F.col("_main")
    place = lambda count: F.pmod(F.xxhash64("node"), F.col(count).cast("long")).cast("int")
    own = F.when(is_main, F.col("_rests") + place("_mains")).otherwise(place("_rests"))
    upto = F.when(is_main, F.col("_rests")).otherwise(F.col("_rests") + F.col("_mains"))
    members = members.withColumn("block", own).select("bucket", "band", "node", "root", "block", F.explode(F.sequence(F.lit(0), upto - 1)).alias("_with"))
    members = members.select("bucket", F.least("block", "_with").alias("a"), F.greatest("block", "_with").alias("b"), "band", "node", "root", "block")
    members = join_on_key(members, prints, {"node": "node"}, "inner")
    members = members.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")
    compared = stored(members.mapInArrow(_by_groups(_compare), "bucket long, a int, b int, band int, block int, node long, root long, other long"), "near-compared")
    sure = compared.where(F.col("other").isNotNull()).select(F.col("root").alias("node"), "other")
    doubt = compared.where(F.col("other").isNull()).drop("other")
    many, in_doubt = compared.agg(F.count("*"), F.count_if(F.col("other").isNull())).first()
    if in_doubt:
        sure = sure.unionByName(_judged(doubt, sure, prints, docs))
    return rounds.joined(starred, sure) if many else starred


def _starred(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, root) of ``edges`` (node, other, near) to hubs: of the sure ones, and of the
    nearest in doubt between classes of those whose shingles are similar.
    """
    edges = stored(edges, "near-edges")
    found = rounds.components(edges.where(F.col("near") >= SURE).select("node", "other"))
    doubt = edges.where(F.col("near") < SURE)
    if doubt.isEmpty():
        return found
    for side in ("node", "other"):
        doubt = join_on_key(doubt, found.withColumnRenamed("root", f"_{side}"), {side: "node"}).withColumn(f"_{side}", F.coalesce(f"_{side}", side))
    between = Window.partitionBy("_low", "_high").orderBy(F.col("near").desc(), "node", "other")
    doubt = doubt.where(F.col("_node") != F.col("_other")).withColumn("_low", F.least("_node", "_other")).withColumn("_high", F.greatest("_node", "_other"))
    doubt = stored(doubt.withColumn("_place", F.row_number().over(between)).where(F.col("_place") <= NEAREST).select("node", "other", "_low", "_high"), "near-doubt")
    judged = exact(doubt, docs).where(F.col("exact") >= SIMILARITY)
    similar = join_on_key(doubt, judged, {"node": "node", "other": "other"}, "inner").select(F.col("_low").alias("node"), F.col("_high").alias("other"))
    return stored(rounds.joined(found, similar), "near-roots")


def _judged(doubt: DataFrame, sure: DataFrame, prints: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (node, other) by shingles between the classes after ``sure`` links that each two blocks of ``doubt`` have."""
    found = rounds.components(sure)
    doubt = join_on_key(doubt, found.withColumnRenamed("root", "_root"), {"root": "node"}).withColumn("root", F.coalesce("_root", "root")).drop("_root")
    apart = doubt.groupBy("bucket", "a", "b").agg(F.min("root").alias("_low"), F.max("root").alias("_high"))
    apart = apart.where(F.col("_low") != F.col("_high")).select("bucket", "a", "b")
    doubt = stored(join_on_key(doubt, apart, {"bucket": "bucket", "a": "a", "b": "b"}, "inner"), "near-doubt")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.join(doubt.select(F.col("node").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id", "text"])
    rows = join_on_key(join_on_key(doubt, prints, {"node": "node"}, "inner"), stored(texts, "near-texts"), {"node": "id"}, "inner")
    rows = rows.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")
    return stored(rows.mapInArrow(_by_groups(_judge), "node long, other long").distinct(), "near-judged")


def _by_groups(work: Callable[[pa.RecordBatch, list[int], list[int]], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` on the groups (bucket, a, b) of rows, which follow each other."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in parts:
            batch = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(name).to_numpy() for name in ("bucket", "a", "b")])
            starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()]
            yield work(batch, starts, starts[1:])
            rest = batch.slice(starts[-1])  # the last group may go on in the next batch
        if rest is not None and rest.num_rows:
            yield work(rest, [0], [rest.num_rows])

    return run


def _edges(batch: pa.RecordBatch, low: int, high: int, roots: np.ndarray, prints: np.ndarray) -> list[tuple[int, int, int]]:
    """(near, row, row) between the classes of a group, each in the first band alone in which its nodes agree."""
    band, apart = batch.column("band")[low].as_py(), batch.column("a")[low].as_py() != batch.column("b")[low].as_py()
    blocks = batch.column("block").to_numpy()
    edges = []
    for n in range(low, high - 1):
        same = prints[n + 1 : high] == prints[n]
        near = same.sum(axis=1)
        fits = (near >= LOW) & (roots[n + 1 : high] != roots[n])
        if apart:  # two blocks: each is compared with itself elsewhere
            fits &= blocks[n + 1 : high] != blocks[n]
        at = np.flatnonzero(fits)
        at = at[same[at].reshape(len(at), BANDS, ROWS).all(axis=2).argmax(axis=1) == band] if len(at) else at
        edges += [(int(near[m]), n, n + 1 + int(m)) for m in at]
    return edges


def _prints(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u2").reshape(batch.num_rows, -1)


def _compare(batch: pa.RecordBatch, starts: list[int], ends: list[int]) -> pa.RecordBatch:
    """Of each group the sure links that join classes, from ``root`` to ``other``, and without ``other`` the nodes with links in doubt between those still apart."""
    roots, prints = batch.column("root").to_numpy(), _prints(batch)
    rows: list[int] = []
    others: list[int | None] = []
    for low, high in zip(starts, ends, strict=False):
        edges, classes = _edges(batch, low, high, roots, prints), _Classes(roots)
        for _, a, b in sorted((edge for edge in edges if edge[0] >= SURE), reverse=True):
            if classes.join(a, b):
                rows.append(a)
                others.append(int(roots[b]))
        open_ = {n for near, a, b in edges if near < SURE and classes.of(a) != classes.of(b) for n in (a, b)}
        rows += sorted(open_)
        others += [None] * len(open_)
    names = ["bucket", "a", "b", "band", "block", "node", "root"]
    columns = [batch.column(name).take(pa.array(rows, pa.int64())) for name in names]
    return pa.RecordBatch.from_arrays([*columns, pa.array(others, pa.int64())], names=[*names, "other"])


def _shared(text: np.ndarray, value: np.ndarray, weight: np.ndarray, number: int) -> np.ndarray:
    """The shared weight, the sum of the lower ones, of each two of ``number`` texts.

    A minimum of weights is the sum of the steps between weights that both reach, so each
    step is a product of matrices of zeros and ones, over the shingles of two texts or more.
    """
    shared, below = np.zeros((number, number)), 0.0
    for level in np.unique(weight):
        reach = weight >= level
        rows, (_, codes, counts) = text[reach], np.unique(value[reach], return_inverse=True, return_counts=True)
        common = counts[codes] > 1
        rows, codes = rows[common], (np.cumsum(counts > 1) - 1)[codes[common]]
        for low in range(0, int(codes.max()) + 1 if len(codes) else 0, COLUMNS):
            some = (codes >= low) & (codes < low + COLUMNS)
            has = np.zeros((number, COLUMNS), np.float32)
            has[rows[some], codes[some] - low] = 1
            shared += (level - below) * (has @ has.T)
        below = level
    return shared


def _judge(batch: pa.RecordBatch, starts: list[int], ends: list[int]) -> pa.RecordBatch:
    """Of each group the links between roots of classes whose shingles are similar, as many as join them."""
    roots, prints = batch.column("root").to_numpy(), _prints(batch)
    found: list[tuple[int, int]] = []
    for low, high in zip(starts, ends, strict=False):
        edges, classes = _edges(batch, low, high, roots, prints), _Classes(roots)
        if not edges:
            continue
        text, value, weight = shingles(batch.column("text").slice(low, high - low))
        total = np.bincount(text, weight, high - low)  # no text is without a shingle
        shared = _shared(text, value, weight, high - low)
        left, right = np.array([edge[1:] for edge in edges]).T - low
        both = shared[left, right]
        for n in np.flatnonzero(both / (total[left] + total[right] - both) >= SIMILARITY):
            _, a, b = edges[n]
            if classes.join(a, b):
                found.append((int(roots[a]), int(roots[b])))
    return pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], pa.int64()) for n in range(2)], names=["node", "other"])


class _Classes:
    """The classes of rows, named by their roots, as links join them."""

    def __init__(self, roots: np.ndarray):
        self.roots, self.top = roots, {}

    def of(self, row: int) -> int:
        root = int(self.roots[row])
        while (up := self.top.get(root, root)) != root:
            self.top[root] = self.top.get(up, up)
            root = up
        return root

    def join(self, a: int, b: int) -> bool:
        """Whether the classes of two rows were apart."""
        left, right = self.of(a), self.of(b)
        if left != right:
            self.top[left] = right
        return left != right


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) for every document with an id; the class is named by its lowest id.

    Documents belong together if a chain of texts, each similar to the next, joins them.
    Rows that repeat an id are one document; rows without an id belong to no class.
    Texts without a letter or digit, null and empty ones too, are alike only if equal.
    """
    prints = stored(signed(docs.select("doc_id", "text")), "near-prints")
    nodes = stored(prints.groupBy("signature").agg(F.min("doc_id").alias("node"), F.max("bytes").alias("bytes")).select("node", "signature", "bytes"), "near-nodes")
    named = nodes.select("node", F.xxhash64("signature").alias("_a"), F.xxhash64(F.lit(1), "signature").alias("_b"))
    named = join_on_key(named, roots(nodes, docs), {"node": "node"}, "left").select("_a", "_b", F.coalesce("root", "node").alias("class_id"))
    hashed = prints.select("doc_id", F.xxhash64("signature").alias("_a"), F.xxhash64(F.lit(1), "signature").alias("_b"))
    classed = join_on_key(hashed, named, {"_a": "_a", "_b": "_b"}, "inner").select("doc_id", "class_id")
    found = stored(classed.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("class_id").alias("_last")), "near-classes")
    # an id on rows with different texts joins their classes
    several = found.where(F.col("class_id") != F.col("_last")).select("doc_id", F.col("class_id").alias("node"))
    if several.isEmpty():
        return found.drop("_last")
    merged = rounds.components(join_on_key(classed, several, {"doc_id": "doc_id"}, "inner").select("node", F.col("class_id").alias("other")))
    return join_on_key(found.drop("_last"), merged, {"class_id": "node"}).select("doc_id", F.coalesce("root", "class_id").alias("class_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class: the one that names it. Rows without an id stay."""
    named = stored(classes(docs).where(F.col("doc_id") == F.col("class_id")).select("doc_id"), "near-kept")
    one = docs.join(named, "doc_id", "left_semi").select(*docs.columns)
    repeated = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where(F.col("count") > 1)
    if not repeated.isEmpty():
        one = one.dropDuplicates(["doc_id"])
    return one.unionByName(docs.where(F.col("doc_id").isNull()))
