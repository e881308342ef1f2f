"""Benchmark decontamination by template windows.

Numbers, names and units become typed placeholders, so a question whose figures or names
were exchanged keeps its template. Windows of canonical tokens are joined by hash with
those of the benchmark, and the slots behind the placeholders must be exchanged
consistently: the same value of the item always for the same value of the document.
Windows are found by their literal words too, those of mostly placeholders only so.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bomwerk.llm import batches
from bomwerk.llm.tables import stored
from bomwerk.operators.lookup import join_on_key

WIDTH = 8  # tokens of a window; an item with fewer has one window of its length
LEAST_TOKENS = 3  # items with fewer have no window; they are compared as whole texts
LEAST_WORDS = 0.5  # share of a window's tokens that are no placeholder; with less, only its literal words count
COVERAGE = 0.5  # share of an item's windows that makes a document contaminated
SLICE = 1 << 20  # bytes of text that are canonical tokens at a time
BITS = 24  # of the filter of window hashes that every task gets: 2 MB whatever the benchmark's size
# Units that count as such behind a number.
UNITS = frozenset(
    "kg g mg t lb lbs oz km m cm mm mi mile miles ft feet inch inches l ml s sec second seconds min minute minutes h "
    "hour hours day days week weeks month months year years usd eur dollar dollars euro euros cent cents percent % $ € £".split()
)
WORD, NUMBER, UNIT, NAME = range(4)
ENDS = frozenset(".!?:")  # of a sentence
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_PARTS = re.compile(r"[$€£%]|\d[\d.,]*|[^\W\d_]+")
_FIGURE = re.compile(r"^[^\w$€£]*[$€£]?[+-]?\d")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _parts(word: str) -> list[tuple[int, str]]:
    """(kind, value) of what a word consists of: one for most words, none for mere marks."""
    if not word.isalpha() and _FIGURE.match(word):
        found = []
        for part in _PARTS.findall(word):
            if part[0].isdigit():
                found.append((NUMBER, part.rstrip(".,")))
            elif not part.isalpha() or part.lower() in UNITS:
                found.append((UNIT, part.lower()))
            else:
                found.append((WORD, part.lower()))
        return found
    core = word if word.isalnum() else "".join(filter(str.isalnum, word))
    if not core:
        return []
    if len(core) > 1 and core[0].isupper() and core[1:].islower():
        return [(NAME, core.lower())]  # unless a sentence starts with it
    core = core.lower()
    return [(UNIT if core in UNITS else WORD, core)]  # a unit only behind a number


class Tokens:
    """The canonical tokens of some texts as flat arrays."""

    def __init__(self, texts: pa.Array):
        import xxhash

        import pyarrow.compute as pc

        codes, words, starts = batches.split(pc.fill_null(texts.cast(pa.string()), ""))
        parts = [_parts(word) for word in words]
        ends = np.array([not word[-1].isalnum() and word.rstrip("\"')]»”")[-1:] in ENDS for word in words], bool)
        number = np.array([len(p) for p in parts], np.int64)
        offset = np.concatenate([[0], np.cumsum(number)])
        kinds = np.array([kind for p in parts for kind, _ in p], np.int64)
        self.values = [value for p in parts for _, value in p]
        hashes = np.fromiter((xxhash.xxh64_intdigest(value) for value in self.values), np.uint64, len(self.values))

        # a capital in the middle of a sentence makes a name
        opens = np.ones(len(codes), bool)
        if len(codes):
            opens[1:] = ends[codes[:-1]]
            opens[starts[:-1][starts[:-1] < len(codes)]] = True
        many = number[codes] if len(codes) else np.zeros(0, np.int64)
        upto = np.concatenate([[0], np.cumsum(many)])
        word_of = np.repeat(np.arange(len(codes)), many)
        self.place = (offset[codes[word_of]] + np.arange(len(word_of)) - upto[word_of]).astype(np.int64) if len(word_of) else np.zeros(0, np.int64)
        self.starts = upto[starts]
        kind = kinds[self.place] if len(self.place) else np.zeros(0, np.int64)
        kind = np.where((kind == NAME) & opens[word_of], WORD, kind) if len(kind) else kind
        before = np.concatenate([[WORD], kind[:-1]]) if len(kind) else kind
        after = np.concatenate([kind[1:], [WORD]]) if len(kind) else kind
        sign = np.array([value in "$€£%" for value in self.values], bool)[self.place] if len(kind) else kind
        self.kind = np.where((kind == UNIT) & (before != NUMBER) & ~((after == NUMBER) & sign), WORD, kind) if len(kind) else kind
        own = hashes[self.place] if len(kind) else np.zeros(0, np.uint64)
        self.own = own
        self.hash = np.where(self.kind == WORD, own, _mix(self.kind.astype(np.uint64) * _GOLDEN)) if len(kind) else own

    def slots(self, low: int, high: int) -> list[str | None]:
        """Type and value of each placeholder, None for words."""
        return [None if k == WORD else f"{k}:{self.values[p]}" for k, p in zip(self.kind[low:high].tolist(), self.place[low:high].tolist(), strict=True)]

    def windows(self, width: int, literal: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Where windows start, and their hashes: of templates with enough words, or of the ``literal`` words.

        A template without placeholders has the hash of its literal words.
        """
        last = len(self.hash) - width + 1
        if last <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        text = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))[:last]
        worded = np.concatenate([[0], np.cumsum(self.kind == WORD)])
        words = worded[width : width + last] - worded[:last]
        fits = np.arange(last) + width <= self.starts[text + 1]
        at = np.flatnonzero(fits & (words < width if literal else words >= LEAST_WORDS * width))
        source, rolled = self.own if literal else self.hash, np.full(len(at), width, np.uint64)
        for n in range(width):
            rolled = _mix(rolled + _GOLDEN) ^ source[at + n]
        return at, _mix(rolled)


ITEM = "item_id long, width int, places array<int>, windows array<long>, literal array<boolean>, worded array<int>, wanted int, slots array<string>"
HELD = T.StructType([T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("exchanged", T.BooleanType())])
RUN = "doc_id long, run long, width int, windows array<long>, slots array<string>"


def templates(benchmark: DataFrame) -> DataFrame:
    """The windows and slots of every item of ``benchmark`` (item_id, text) that has a window."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part in batches.slices(batch, size=SLICE):
                tokens, rows = Tokens(part.column("text")), []
                for n, item in enumerate(part.column("item_id").to_pylist()):
                    low, high = int(tokens.starts[n]), int(tokens.starts[n + 1])
                    width = min(WIDTH, high - low)
                    if width < LEAST_TOKENS:
                        continue
                    slots, places, windows, literal = tokens.slots(low, high), [], [], []
                    for plain in (False, True):
                        at, hashes = tokens.windows(width, plain)
                        mine = (at >= low) & (at < high)
                        places += (at[mine] - low).tolist()
                        windows += hashes[mine].view(np.int64).tolist()
                        # a template without placeholders is literal
                        literal += [plain or not any(slots[place : place + width]) for place in (at[mine] - low).tolist()]
                        if not plain:
                            worded = list(places)
                    rows.append((item, width, places, windows, literal, worded, high - low - width + 1, slots))
                kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.int32(), pa.list_(pa.string())]
                yield _batch(rows, kinds, ["item_id", "width", "places", "windows", "literal", "worded", "wanted", "slots"])

    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    return rows.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, ITEM).where(F.size("windows") > 0)


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row[n] for row in rows], kind) for n, kind in enumerate(types)], names=names)


def _runs(docs: DataFrame, widths: list[int], mask: np.ndarray) -> DataFrame:
    """Stretches of consecutive windows that the filter lets pass, with a hash of their tokens and slots."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in parts:
            for part in batches.slices(batch, size=SLICE):
                tokens, ids, rows = Tokens(part.column("text")), part.column("doc_id").to_pylist(), []
                for width, literal in ((width, literal) for width in widths for literal in (False, True)):
                    at, hashes = tokens.windows(width, literal)
                    bit = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
                    hit = (mask[bit >> 3] >> (bit & 7)) & 1 == 1
                    at, hashes = at[hit], hashes[hit]
                    if not len(at):
                        continue
                    text = np.searchsorted(tokens.starts, at, "right") - 1
                    breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(text) != 0)) + 1
                    for low, high in zip([0, *breaks.tolist()], [*breaks.tolist(), len(at)], strict=True):
                        first, last = int(at[low]), int(at[high - 1]) + width
                        slots = [] if literal else tokens.slots(first, last)
                        key = xxhash.xxh64(hashes[low:high].tobytes())
                        key.update("\u0000".join(slot or "" for slot in slots))
                        rows.append((ids[int(text[low])], key.intdigest() - (1 << 63), width, hashes[low:high].view(np.int64).tolist(), slots))
                yield _batch(rows, [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string())], ["doc_id", "run", "width", "windows", "slots"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, RUN)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, coverage, reparameterised) for every benchmark item that a document contains.

    ``coverage`` is the share of the item's windows found literally or with consistent
    slots; or that of its windows with enough words, if higher, since the others are not
    found with values exchanged. ``reparameterised`` tells that some value was exchanged.
    An item of fewer than three tokens is contained in documents that consist of its
    words. Documents and items without an id, null texts and items without a word give no
    row; rows that repeat an id are one document or item.
    """
    items = stored(templates(benchmark), "leak-items")
    widths = [row[0] for row in items.select("width").distinct().collect()]  # at most WIDTH of them
    runs = stored(_runs(docs, sorted(widths), _filter(items)), "leak-runs")
    # a passage that very many documents share is one run: it is compared once
    distinct = stored(runs.groupBy("run", "width").agg(F.first("windows").alias("windows"), F.first("slots").alias("theirs")), "leak-distinct")
    offered = items.select("item_id", "width", F.explode(F.arrays_zip("windows", "places", "literal")).alias("w"))
    offered = offered.select("item_id", "width", F.col("w.windows").alias("hash"), F.col("w.places").alias("place"), F.col("w.literal").alias("literal"))
    asked = distinct.select("run", "width", F.posexplode("windows").alias("at", "hash"))
    # a window that many items or runs have is split between tasks
    met = join_on_key(asked, offered, {"hash": "hash", "width": "width"}, "inner").groupBy("run", "width", "item_id", (F.col("at") - F.col("place")).alias("shift"))
    met = met.agg(F.collect_set(F.when(~F.col("literal"), F.col("place"))).alias("places"), F.collect_set(F.when(F.col("literal"), F.col("place"))).alias("same"))  # at most an item's windows
    ours = items.select("item_id", "width", "wanted", "worded", F.col("slots").alias("ours"))
    met = join_on_key(met, distinct.select("run", "width", "theirs"), {"run": "run", "width": "width"}, "inner").withColumn("_width", F.col("width"))
    met = join_on_key(met, ours, {"item_id": "item_id", "_width": "width"}, "inner").drop("_width")
    pairs = _slot_pairs(F.col("places"), F.col("width"), F.col("shift"))
    held = _held(F.col("places"), F.col("same"), F.col("width"), F.col("pairs"))
    met = met.withColumn("pairs", pairs).withColumn("held", held).where(F.size("held.places") > 0)
    met = stored(met.select("run", "item_id", "held.places", "wanted", "worded", "held.exchanged"), "leak-met")
    per_run = met.groupBy("run").agg(F.collect_list(F.struct("item_id", "places", "wanted", "worded", "exchanged")).alias("items"))  # items that one run holds
    back = join_on_key(runs.select("doc_id", "run"), per_run, {"run": "run"}, "inner").select("doc_id", F.inline("items"))
    found = back.groupBy("doc_id", "item_id").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.max("wanted").alias("wanted"), F.max("worded").alias("worded"), F.bool_or("exchanged").alias("reparameterised")
    )
    worded = F.size(F.array_intersect("places", "worded")) / F.greatest(F.size("worded"), F.lit(1))
    share = F.greatest(F.size("places") / F.col("wanted"), worded)
    found = found.select("doc_id", "item_id", F.least(share, F.lit(1.0)).alias("coverage"), "reparameterised").where(F.col("coverage") >= coverage)
    short = _short(benchmark, items)
    return found if short.isEmpty() else found.unionByName(_equal(docs, short))


def _words(text: str) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}$€£%]+", " "))


def _short(benchmark: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, words) of items that have words but no window."""
    rows = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), _words("text").alias("words"))
    return rows.where(F.col("words") != "").join(items.select("item_id"), "item_id", "left_anti").distinct()


def _equal(docs: DataFrame, short: DataFrame) -> DataFrame:
    """Documents that consist of the words of a short item."""
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), _words("text").alias("words"))
    met = join_on_key(rows, short, {"words": "words"}, "inner").select("doc_id", "item_id").distinct()
    return met.select("doc_id", "item_id", F.lit(1.0).alias("coverage"), F.lit(False).alias("reparameterised"))


def _filter(items: DataFrame) -> np.ndarray:
    """The window hashes reduced to the places of a filter of fixed size; Spark packs them into words of 64 places."""
    place = items.select(F.explode("windows").alias("w")).select(F.shiftrightunsigned("w", 64 - BITS).alias("place"))
    word = F.bit_or(F.expr("shiftleft(CAST(1 AS BIGINT), CAST(place % 64 AS INT))")).alias("bits")
    packed = place.groupBy(F.floor(F.col("place") / 64).alias("word")).agg(word).toArrow()  # at most 2^BITS / 64 rows
    mask = np.zeros(1 << (BITS - 6), np.int64)
    mask[packed["word"].to_numpy()] = packed["bits"].to_numpy()
    return mask.view(np.uint8)


def _slot_pairs(places: Column, width: Column, shift: Column) -> Column:
    """The item's and the document's value of each placeholder in the windows that met."""
    tokens = F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p, p + width - 1))))
    pairs = F.transform(tokens, lambda t: F.struct(t.alias("at"), F.get("ours", t).alias("ours"), F.get("theirs", t + shift).alias("theirs")))
    return F.filter(pairs, lambda p: p["ours"].isNotNull())


@F.pandas_udf(HELD)
def _held(places: pd.Series, same: pd.Series, width: pd.Series, pairs: pd.Series) -> pd.DataFrame:
    """The windows that hold, and whether one has a value exchanged: the ``same`` ones, and those of ``places`` with consistent slots."""
    rows = []
    for mine, plain, wide, found in zip(places, same, width, pairs, strict=True):
        slots = {p["at"]: (p["ours"], p["theirs"]) for p in found}
        keep = _consistent([int(p) for p in mine], int(wide), slots)
        exchanged = any(slots[t][0] != slots[t][1] for p in keep for t in range(p, p + int(wide)) if t in slots)
        rows.append((sorted({*keep, *(int(p) for p in plain)}), exchanged))
    return pd.DataFrame(rows, columns=["places", "exchanged"])


def _consistent(places: list[int], width: int, slots: dict[int, tuple[str, str]]) -> list[int]:
    """The ``places`` whose slots are all unchanged, or all exchanged as they mostly are.

    Each value of the item stands for the value of the document that takes most of its
    places; of a tie for itself if that is one of them, or else for none.
    """
    counts: dict[str, Counter] = defaultdict(Counter)
    for ours, theirs in slots.values():
        counts[ours][theirs] += 1
    stands = {}
    for ours, found in counts.items():
        most = max(found.values())
        best = [theirs for theirs, count in found.items() if count == most]
        stands[ours] = best[0] if len(best) == 1 else ours
    keep = []
    for place in places:
        inside = [slots[t] for t in range(place, place + width) if t in slots]
        if all(ours == theirs for ours, theirs in inside) or all(stands[ours] == theirs for ours, theirs in inside):
            keep.append(place)
    return keep


def decontaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the contaminated ones; rows without an id stay."""
    found = stored(contaminated(docs.select("doc_id", "text"), benchmark, coverage).select("doc_id").distinct(), "leak-ids")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
