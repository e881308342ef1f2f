"""The trie of shared beginnings of conversations, measured along its Euler tour.

A conversation is a path of turns from the root; conversations with equal first turns
share nodes. Each node has an arc that enters it and one that leaves it. The arcs in
depth-first order are the Euler tour, a linked list: an enter arc is followed by that of
the first child or by the leave arc, a leave arc by the enter arc of the next sibling or
by the parent's leave arc. The list is ranked in blocks: tasks join the arcs that follow
each other within a block to segments, the list of segments shrinks in rounds in which
random segments swallow their successors, and the short rest is walked. What a subtree
holds is the difference of the prefix sums at its two arcs.

A node is named by its lowest member and its depth. Turns and conversations are dealt
into ranges of (conversation, turn), so neither a conversation of very many turns nor a
beginning that very many share is gathered in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bomwerk.llm.tables import stored
from bomwerk.operators.lookup import join_on_key

WORDS = r"[^\x20\x09-\x0D]+"
GROUP, HEADS = 20, 4  # conversations of a group begin like its first one, each with up to HEADS - 1 of its turns
BLOCK = 1 << 18  # nodes whose arcs a task joins at once
SHORT = 1 << 17  # segments that one task ranks
CHUNK = 1 << 20  # characters of a list of ids
NOTHING = hashlib.sha256(b"").hexdigest()
_GOLDEN, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all of them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ranged(rows: DataFrame, *order: str) -> DataFrame:
    """Rows in ranges of ``order``, each a sorted partition; equal conversations may be in several."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


# --- conversations ---


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, one, two, words) of each turn: its place from 1, two hashes of role and text, its words.

    Turns come in the order of ``turn``, null first; turns that share a number in that
    of their hashes. A null role or text is empty, rows without a conv_id are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = stored(
        conversations.where(F.col("conv_id").isNotNull()).select(
            F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(F.lit(1), role, text).alias("one"),
            F.xxhash64(F.lit(2), role, text).alias("two"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"),
        ),
        "trie-turns",
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, last, count = TaskContext.get().partitionId(), None, 0
        for batch in parts:
            if not batch.num_rows:
                continue
            conv = _numbers(batch, "conv_id")
            place = _places(conv) + np.where(conv == last, count, 0) if last is not None else _places(conv)
            last, count = int(conv[-1]), int(place[-1])
            names = ["conv_id", "one", "two", "words"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(name) for name in names], pa.array(place, pa.int64()), pa.array(np.full(len(conv), piece), pa.int64())],
                names=[*names, "position", "piece"],
            )

    placed = stored(_ranged(rows, "conv_id", "turn", "one", "two").mapInArrow(run, "conv_id long, one long, two long, words long, position long, piece long"), "trie-placed")
    # a conversation that began in earlier pieces is shifted by its turns there
    seams = placed.groupBy("piece").agg(
        F.min(F.struct("conv_id", (-F.col("position")).alias("n"))).alias("low"), F.max(F.struct("conv_id", F.col("position").alias("n"))).alias("high")
    )
    shifts, before = [], None
    for row in sorted(seams.collect()):  # a row for each partition
        shift = before[1] if before and before[0] == row.low.conv_id else 0
        if shift:
            shifts.append((row.piece, row.low.conv_id, shift))
        before = row.high.conv_id, row.high.n + (shift if row.high.conv_id == row.low.conv_id else 0)
    if shifts:
        table = F.broadcast(placed.sparkSession.createDataFrame(shifts, "piece long, conv_id long, shift long"))
        placed = placed.join(table, ["piece", "conv_id"], "left").withColumn("position", F.col("position") + F.coalesce("shift", F.lit(0)))
    return placed.select("conv_id", "position", "one", "two", "words")


def _places(keys: np.ndarray) -> np.ndarray:
    """1, 2, 3 ... within each run of equal keys."""
    starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    return np.arange(len(keys)) - np.repeat(starts, np.diff(np.append(starts, len(keys)))) + 1


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id, length) as they are rebuilt, and their turns (conv_id, depth, one, two, words, ends).

    Conversation c has the first h turns of conversation c - c % 20, h being the CRC-32
    of its id as text modulo 4, or all if there are fewer, then its own after its first h.
    The remainder of a negative id is negative, as in SQL.
    """
    head = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(HEADS)).cast("int")
    own = turns.groupBy("conv_id").agg(F.max("position").alias("own")).select("conv_id", "own", head.alias("head"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    opening = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("position") < HEADS))
    opening = opening.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("position", "one", "two", "words"))).alias("opening"))
    opened = join_on_key(own, opening, {"base": "conv_id"})
    taken = F.when(F.col("opening").isNull(), F.array().cast(opening.schema["opening"].dataType)).otherwise(F.slice("opening", F.lit(1), F.col("head")))
    opened = opened.withColumn("opening", taken).withColumn("taken", F.size("opening"))
    opened = stored(opened.withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("head"), F.lit(0))), "trie-conversations")
    first = opened.select("conv_id", "length", F.explode("opening").alias("turn")).select(
        "conv_id", F.col("turn.position").alias("depth"), "turn.one", "turn.two", "turn.words", "length"
    )
    rest = join_on_key(turns, opened.select("conv_id", "head", "taken", "length"), {"conv_id": "conv_id"}, "inner").where(F.col("position") > F.col("head"))
    rest = rest.select("conv_id", (F.col("position") - F.col("head") + F.col("taken")).alias("depth"), "one", "two", "words", "length")
    rows = first.unionByName(rest).withColumn("ends", F.col("depth") == F.col("length")).drop("length")
    return opened.select("conv_id", "length"), rows


def prefixes(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, depth, one, two, words, ends) with prints of the path to each turn and to the one before it.

    The print of a path is two sums, modulo 2^64, of hashes of its turns and their depths.
    A sum runs on over the pieces of a long conversation.
    """
    schema = "piece long, conv_id long, depth long, words long, ends boolean, high long, low long, up_high long, up_low long"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, last, carry = TaskContext.get().partitionId(), None, (np.uint64(0), np.uint64(0))
        for batch in parts:
            if not batch.num_rows:
                continue
            conv, depth = _numbers(batch, "conv_id"), _numbers(batch, "depth").astype(np.uint64)
            starts = np.flatnonzero(np.diff(conv, prepend=conv[0] - 1))
            runs, sums, ups = np.diff(np.append(starts, len(conv))), [], []
            for n, (name, salt) in enumerate((("one", _GOLDEN), ("two", _SECOND))):
                own = _mix(_numbers(batch, name).view(np.uint64) ^ _mix(depth * salt + salt))
                total = np.cumsum(own)
                base = total[starts] - own[starts]
                if last is not None and conv[0] == last:
                    base[:1] -= carry[n]
                total = total - np.repeat(base, runs)
                sums.append(total)
                ups.append(total - own)
            last, carry = int(conv[-1]), (sums[0][-1], sums[1][-1])
            columns = [np.full(len(conv), piece), *[value.view(np.int64) for value in (*sums, *ups)]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), *[batch.column(name) for name in ("conv_id", "depth", "words", "ends")], *[pa.array(c, pa.int64()) for c in columns[1:]]],
                names=["piece", "conv_id", "depth", "words", "ends", "high", "low", "up_high", "up_low"],
            )

    placed = stored(_ranged(stored(rows, "trie-rebuilt"), "conv_id", "depth").mapInArrow(run, schema), "trie-prefixes")
    seams = placed.groupBy("piece").agg(
        F.min(F.struct("conv_id", (-F.col("depth")).alias("n"), "high", "low")).alias("start"), F.max(F.struct("conv_id", "depth", "high", "low")).alias("end")
    )
    shifts: dict[int, tuple[int, int, int]] = {}
    before, wrap = None, (1 << 64) - 1
    for row in sorted(seams.collect()):  # a row for each partition
        shift = before[1:] if before and before[0] == row.start.conv_id else (0, 0)
        if any(shift):
            shifts[row.piece] = row.start.conv_id, *shift
        own = shift if row.end.conv_id == row.start.conv_id else (0, 0)
        before = row.end.conv_id, row.end.high + own[0] & wrap, row.end.low + own[1] & wrap
    if not shifts:
        return placed

    def moved(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            piece, conv = _numbers(batch, "piece"), _numbers(batch, "conv_id")
            add = np.zeros((2, len(conv)), np.uint64)
            for n in set(piece.tolist()) & shifts.keys():
                add[:, (piece == n) & (conv == shifts[n][0])] = np.array(shifts[n][1:], np.uint64)[:, None]
            new = {name: (_numbers(batch, name).view(np.uint64) + add[n % 2]).view(np.int64) for n, name in enumerate(("high", "low", "up_high", "up_low"))}
            yield pa.RecordBatch.from_arrays([pa.array(new[name], pa.int64()) if name in new else batch.column(name) for name in batch.schema.names], names=batch.schema.names)

    return placed.mapInArrow(moved, schema)


# --- nodes ---


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, high, low, digest): of each path the SHA-256 of the ids (conv_id) that end there, ascending, comma-joined.

    Ranges of (path, id) are joined to texts of bounded size; only the few paths whose ids
    lie in several of them are hashed text after text, as SHA-256 needs them in order.
    """
    schema = "depth long, high long, low long, first long, ids string, digest string"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # path, first id, texts; the path of the partition's start may have begun before it
        state = {"whole": False, "size": 0}

        def row(path, first, texts, whole):
            text = ",".join(texts)
            return (*path, first, None, hashlib.sha256(text.encode()).hexdigest()) if whole else (*path, first, text, None)

        path = first = None
        texts: list[str] = []
        for batch in parts:
            keys = [batch.column(name).to_pylist() for name in ("depth", "high", "low", "conv_id")]
            out = []
            for *now, conv in zip(*keys, strict=True):
                now = tuple(now)
                if now != path:
                    if path is not None:
                        out.append(row(path, first, texts, state["whole"]))
                        state["whole"] = True
                    path, first, texts, state["size"] = now, conv, [], 0
                elif state["size"] > CHUNK:
                    out.append(row(path, first, texts, False))
                    state["whole"] = False
                    first, texts, state["size"] = conv, [], 0
                text = str(conv)
                texts.append(text)
                state["size"] += len(text) + 1
            if out:
                yield _rows(out, schema)
        if path is not None:
            yield _rows([row(path, first, texts, False)], schema)

    def chain(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = digest = None
        for batch in parts:
            out = []
            for depth, high, low, text in zip(*[batch.column(name).to_pylist() for name in ("depth", "high", "low", "ids")], strict=True):
                if (depth, high, low) != path:
                    if path is not None:
                        out.append((*path, digest.hexdigest()))
                    path, digest = (depth, high, low), hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            if out:
                yield _rows(out, found)
        if path is not None:
            yield _rows([(*path, digest.hexdigest())], found)

    found = "depth long, high long, low long, digest string"
    keys = ["depth", "high", "low"]
    written = stored(_ranged(ends.select(*keys, "conv_id"), *keys, "conv_id").mapInArrow(run, schema), "trie-ends")
    parts = written.where(F.col("digest").isNull()).select(*keys, "first", "ids").repartition(*keys).sortWithinPartitions(*keys, "first")
    return written.where(F.col("digest").isNotNull()).select(*keys, "digest").unionByName(parts.mapInArrow(chain, found))


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [field.split() for field in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(column, kinds[kind]) for column, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], names=[name for name, _ in fields])


def nodes(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, first_child, saved, ends_sha256."""
    lengths, rows = rebuilt(numbered(conversations))
    paths = prefixes(rows)
    made = paths.groupBy("depth", "high", "low").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"), F.min("up_high").alias("up_high"), F.min("up_low").alias("up_low")
    )
    zero = F.lit(0).cast("long")
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where(F.col("n_convs") > 0)
    root = root.select(zero.alias("depth"), zero.alias("high"), zero.alias("low"), "conv_id", "n_convs", zero.alias("words"), zero.alias("up_high"), zero.alias("up_low"))
    made = stored(made.unionByName(root), "trie-paths")
    ends = paths.where("ends").select("depth", "high", "low", "conv_id")
    turnless = lengths.where(F.col("length") == 0).select(zero.alias("depth"), zero.alias("high"), zero.alias("low"), "conv_id")
    digests = end_digests(stored(ends.unionByName(turnless), "trie-ending"))
    names = made.select((F.col("depth") + 1).alias("depth"), F.col("high").alias("up_high"), F.col("low").alias("up_low"), F.col("conv_id").alias("parent_conv_id"))
    key = ["depth", "up_high", "up_low"]
    named = join_on_key(made, names, {name: name for name in key})
    named = join_on_key(named, digests, {name: name for name in ("depth", "high", "low")})
    named = stored(
        named.select(
            "conv_id", "depth", "parent_conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
            F.coalesce("digest", F.lit(NOTHING)).alias("ends_sha256"),
        ),
        "trie-nodes",
    )
    children = named.where(F.col("depth") > 0).groupBy(F.col("parent_conv_id").alias("_of"), (F.col("depth") - 1).alias("_at"))
    children = children.agg(F.count("*").alias("n_children"), F.min("conv_id").alias("first_child"))
    return join_on_key(named, children, {"conv_id": "_of", "depth": "_at"}).withColumn("n_children", F.coalesce("n_children", F.lit(0)))


# --- the tour ---

# Arcs are named (conversation, at): at is twice the depth, and one more for a leave arc.
_SUMS = ("steps", "leaves", "saved")
_NODE = "parent_conv_id long, n_convs long, n_children long, ends_sha256 string"
_ENDS = [f"{side}_{name}" for side in ("enter", "leave") for name in ("conv", "at", *_SUMS)]
_BLOCKS = f"kind int, block long, conv_id long, depth long, {_NODE}, " + ", ".join(f"{name} long" for name in _ENDS)
_OF_NODE, _OF_SEGMENT, _OF_START = 0, 1, 2


def _block(table: pa.Table, block: int) -> list[pa.RecordBatch]:
    """The arcs of some nodes, in the order of parents and children, joined to segments.

    Rows for the nodes name the segment of each of their arcs by its first arc and have
    the sums before them in it. Rows for segments have its first arc and its sums as
    ``enter``, and the arc that follows it as ``leave``; for the segment that ends with
    the block's last node the node's parent is there, as its next sibling is not known.
    One more row has the block's first node.
    """
    n = table.num_rows
    col = lambda name: table.column(name).to_numpy()
    conv, depth, children = col("conv_id"), col("depth"), col("n_children")
    parent = table.column("parent_conv_id").fill_null(0).to_numpy()
    child = table.column("first_child").fill_null(0).to_numpy()
    convs, code = np.unique(conv, return_inverse=True)
    levels = int(depth.max()) + 2
    key = code * levels + depth
    order = np.argsort(key, kind="stable")
    key = key[order]

    def find(conv_of: np.ndarray, depth_of: np.ndarray) -> np.ndarray:
        """The place of each node in the block, or -1."""
        at = np.minimum(np.searchsorted(convs, conv_of), len(convs) - 1)
        wanted = np.where((convs[at] == conv_of) & (depth_of >= 0) & (depth_of < levels), at * levels + depth_of, -1)
        place = np.minimum(np.searchsorted(key, wanted), n - 1)
        return np.where(key[place] == wanted, order[place], -1)

    rows = np.arange(n)
    after = np.empty(2 * n, np.int64)  # arc 2r enters node r, 2r + 1 leaves it
    to_conv, to_at = np.empty(2 * n, np.int64), np.empty(2 * n, np.int64)
    down = find(child, depth + 1)
    after[::2] = np.where(children == 0, 2 * rows + 1, np.where(down >= 0, 2 * down, -1))
    to_conv[::2], to_at[::2] = child, 2 * (depth + 1)
    sibling = np.zeros(n, bool)
    sibling[:-1] = (parent[1:] == parent[:-1]) & (depth[1:] == depth[:-1]) & (depth[1:] > 0)
    up = find(parent, depth - 1)
    after[1::2] = np.where(sibling, 2 * (rows + 1), np.where((up >= 0) & (depth > 0), 2 * up + 1, -1))
    after[2 * n - 1] = -1
    to_conv[1::2], to_at[1::2] = parent, 2 * (depth - 1) + 1  # the root has no parent: below 0
    weight = np.zeros((len(_SUMS), 2 * n), np.int64)
    weight[0] = 1
    weight[1, ::2] = children == 0
    weight[2, ::2] = col("saved")

    # sums before each arc of its segment, by doubling the step back
    back = np.arange(2 * n)
    inner = np.flatnonzero(after >= 0)
    back[after[inner]] = inner
    sums = np.where(back != np.arange(2 * n), weight[:, back], 0)
    while (back[back] != back).any():
        sums = sums + sums[:, back]
        back = back[back]
    head_conv, head_at = conv[back // 2], 2 * depth[back // 2] + back % 2
    tails = np.flatnonzero(after < 0)

    ints = lambda values: pa.array(values, pa.int64())
    kind = lambda which, size: pa.array(np.full(size, which, np.int32))
    owned = [table.column(name).combine_chunks() for name in ("parent_conv_id", "n_convs", "n_children", "ends_sha256")]
    owned = [column.chunk(0) if isinstance(column, pa.ChunkedArray) else column for column in owned]
    none = lambda size: [pa.nulls(size, pa.int64())] * 3 + [pa.nulls(size, pa.string())]
    sides = [[ints(head_conv[s::2]), ints(head_at[s::2]), *[ints(row[s::2]) for row in sums]] for s in (0, 1)]
    names = [field.split()[0] for field in _BLOCKS.split(", ")]
    out = [pa.RecordBatch.from_arrays([kind(_OF_NODE, n), ints(np.full(n, block)), ints(conv), ints(depth), *owned, *sides[0], *sides[1]], names=names)]
    many = len(tails)
    open_ = pa.array(np.where(tails == 2 * n - 1, block, 0), pa.int64(), mask=tails != 2 * n - 1)
    segments = [ints(head_conv[tails]), ints(head_at[tails]), *[ints(row) for row in (sums + weight)[:, tails]], ints(to_conv[tails]), ints(to_at[tails]), *[pa.nulls(many, pa.int64())] * 3]
    out.append(pa.RecordBatch.from_arrays([kind(_OF_SEGMENT, many), open_, *[pa.nulls(many, pa.int64())] * 2, *none(many), *segments], names=names))
    start = [ints([int(parent[0])]), *[pa.nulls(1, pa.int64())] * 9]
    out.append(pa.RecordBatch.from_arrays([kind(_OF_START, 1), ints([block]), ints(conv[:1]), ints(depth[:1]), *none(1), *start], names=names))
    return out


def tour(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes with the place of their arcs in segments of the Euler tour, and the segments.

    ``tree`` has a row per node as ``nodes`` makes them.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 24, [], 0
        for batch in parts:
            while batch.num_rows:
                part = batch.slice(0, BLOCK - size)
                batch = batch.slice(part.num_rows)
                held.append(part)
                size += part.num_rows
                if size == BLOCK:
                    yield from _block(pa.Table.from_batches(held), block)
                    block, held, size = block + 1, [], 0
        if size:
            yield from _block(pa.Table.from_batches(held), block)

    made = stored(_ranged(tree, "parent_conv_id", "depth", "conv_id").mapInArrow(run, _BLOCKS), "trie-blocks")
    # the next sibling of a block's last node, if it has one, is the first node of the block after it
    follows = Window.orderBy("block")  # a row for each block
    starts = made.where(F.col("kind") == _OF_START).select(F.col("block").alias("_start"), F.col("conv_id").alias("_conv"), F.col("depth").alias("_depth"), F.col("enter_conv").alias("_parent"))
    starts = starts.withColumnRenamed("_start", "block").select("block", *[F.lead(name).over(follows).alias(name) for name in ("_conv", "_depth", "_parent")])
    segments = made.where(F.col("kind") == _OF_SEGMENT).select("block", *[F.col(f"enter_{name}").alias(name) for name in ("conv", "at", *_SUMS)], F.col("leave_conv").alias("next_conv"), F.col("leave_at").alias("next_at"))
    segments = segments.join(F.broadcast(starts), "block", "left")
    # siblings have one parent at one depth
    sibling = F.coalesce((F.col("_parent") == F.col("next_conv")) & (2 * (F.col("_depth") - 1) + 1 == F.col("next_at")) & (F.col("_depth") > 0), F.lit(False))
    conv, at = F.when(sibling, F.col("_conv")).otherwise(F.col("next_conv")), F.when(sibling, 2 * F.col("_depth")).otherwise(F.col("next_at"))
    segments = segments.select("conv", "at", *_SUMS, F.when(at >= 0, conv).alias("next_conv"), F.when(at >= 0, at).alias("next_at"))
    return made.where(F.col("kind") == _OF_NODE).drop("kind", "block"), stored(segments, "trie-segments")


def ranked(segments: DataFrame, short: int = SHORT) -> DataFrame:
    """(conv, at, and the sums before it) of each segment (conv, at, sums, next_conv, next_at) of a list.

    While there are more than ``short`` of them, every segment that draws 1 swallows its
    successor if that one drew 0, a quarter of all; the swallowed are placed again in
    the opposite order.
    """
    swallowed: list[DataFrame] = []
    turn = 0
    while segments.count() > short:
        coin = lambda conv, at, turn=turn: F.pmod(F.xxhash64(F.lit(turn), conv, at), F.lit(2))
        lefts = segments.where(coin("conv", "at") == 1)
        rights = segments.where(coin("conv", "at") == 0)
        taken = rights.select("conv", "at", *[F.col(name).alias(f"_{name}") for name in (*_SUMS, "next_conv", "next_at")], F.lit(True).alias("_hit"))
        joined = stored(join_on_key(lefts, taken, {"next_conv": "conv", "next_at": "at"}), "trie-joined")
        gone = joined.where("_hit").select("next_conv", "next_at", "conv", "at", *_SUMS)
        swallowed.append(gone.select(F.col("next_conv").alias("conv"), F.col("next_at").alias("at"), F.col("conv").alias("of_conv"), F.col("at").alias("of_at"), *_SUMS))
        grown = joined.select(
            "conv", "at", *[(F.col(name) + F.coalesce(f"_{name}", F.lit(0))).alias(name) for name in _SUMS],
            *[F.when(F.col("_hit"), F.col(f"_{name}")).otherwise(F.col(name)).alias(name) for name in ("next_conv", "next_at")],
        )
        met = gone.select(F.col("next_conv").alias("conv"), F.col("next_at").alias("at"), F.lit(True).alias("_gone"))
        left_over = join_on_key(rights, met, {"conv": "conv", "at": "at"}).where(F.col("_gone").isNull()).drop("_gone")
        segments = stored(grown.unionByName(left_over), "trie-segments")
        turn += 1
    names = ["conv", "at", *_SUMS]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(parts)) if (parts := list(parts)) else None
        if rows is None or not rows.num_rows:
            return
        place = {arc: n for n, arc in enumerate(zip(rows["conv"].to_pylist(), rows["at"].to_pylist(), strict=True))}
        after = list(zip(rows["next_conv"].to_pylist(), rows["next_at"].to_pylist(), strict=True))
        weights = [rows[name].to_pylist() for name in _SUMS]
        (now,) = place.keys() - set(after)  # the one that follows none: the root's enter arc
        sums, out = [0] * len(_SUMS), {name: [] for name in names}
        while now in place:
            n = place[now]
            for name, value in zip(names, (*now, *sums), strict=True):
                out[name].append(value)
            sums = [total + weight[n] for total, weight in zip(sums, weights, strict=True)]
            now = after[n]
        yield pa.RecordBatch.from_arrays([pa.array(out[name], pa.int64()) for name in names], names=names)

    # no more than ``short`` rows
    found = stored(segments.coalesce(1).mapInArrow(run, ", ".join(f"{name} long" for name in names)), "trie-ranks")
    for gone in reversed(swallowed):
        before = found.select(F.col("conv").alias("_c"), F.col("at").alias("_a"), *[F.col(name).alias(f"_{name}") for name in _SUMS])
        placed = join_on_key(gone, before, {"of_conv": "_c", "of_at": "_a"}, "inner")
        found = stored(found.unionByName(placed.select("conv", "at", *[(F.col(name) + F.col(f"_{name}")).alias(name) for name in _SUMS])), "trie-ranks")
    return found


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of the rebuilt ``conversations`` (conv_id, turn, role, text).

    conv_id (its lowest member) and depth name it; parent_conv_id (null for the root),
    n_convs (members), n_children, n_leaves (childless nodes in its subtree, itself
    included), saved_tokens (words that its subtree need not repeat: for each node those
    of its last turn, for all members but one), ends_sha256 (of the ids that end there),
    and the places of its enter and leave arcs in the Euler tour, from 0. Other columns
    are ignored. Repeated rows are turns of their own. No conversation, no node.
    """
    places, segments = tour(stored(nodes(conversations), "trie-tree"))
    ranks = ranked(segments)
    rows = places
    for side in ("enter", "leave"):
        here = ranks.select(F.col("conv").alias("_c"), F.col("at").alias("_a"), *[F.col(name).alias(f"_{side}_{name}") for name in _SUMS])
        rows = join_on_key(rows, here, {f"{side}_conv": "_c", f"{side}_at": "_a"}, "inner")
    at = {(side, name): F.col(f"{side}_{name}") + F.col(f"_{side}_{name}") for side in ("enter", "leave") for name in _SUMS}
    return rows.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (at["leave", "leaves"] - at["enter", "leaves"]).alias("n_leaves"),
        (at["leave", "saved"] - at["enter", "saved"]).alias("saved_tokens"), "ends_sha256", at["enter", "steps"].alias("enter"), at["leave", "steps"].alias("leave"),
    )
