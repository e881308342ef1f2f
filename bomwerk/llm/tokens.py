"""Token counts of whole texts with a public tokenizer.

White space is a boundary where the tokenizer's file shows it: its normalisation never joins
what white space separates, its pattern never matches across it and drops it, so the tokens
on its two sides do not depend on each other. With any other file, texts are encoded whole. A huge text is encoded in overlapping chunks with offsets; two
neighbours are spliced at a boundary in their overlap from which both have the same
tokens, and an overlap without one is widened. Shorter texts are encoded word by word:
the distinct words of a batch are chunks of one text, cut at the same boundaries.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomwerk.llm import batches
from bomwerk.llm.tables import kept

CHUNK = 16_384  # characters; a longer text is encoded in chunks
OVERLAP = 256  # characters, doubled where alignment fails
REMEMBERED = 400_000  # words whose counts a task keeps
SPACE = frozenset(" \t\n\r\v\f")
# What a tokenizer's file may have for white space to be a boundary: normalisers that change
# characters one by one, pre-tokenizers that drop white space, and patterns without any in them.
NORMALIZERS = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents", "BertNormalizer"}
DROPPING = {"Whitespace", "WhitespaceSplit", "BertPreTokenizer"}
PATTERNS = {r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}


def separates(file: dict) -> bool:
    """Whether white space separates tokens, by the content of a ``tokenizers`` file."""

    def parts(step: dict | None, names: str) -> list[dict]:
        return [] if step is None else step[names] if step["type"] == "Sequence" else [step]

    def harmless(step: dict) -> bool:
        spaces = step["type"] == "Replace" and step["pattern"] == {"Regex": r"\s+"} and step["content"] == " "
        return spaces or step["type"] in NORMALIZERS

    def drops(step: dict) -> bool:
        if step["type"] != "Split":
            return step["type"] in DROPPING
        return step["behavior"] == "Removed" and step["invert"] and step["pattern"].get("Regex") in PATTERNS

    first = parts(file.get("pre_tokenizer"), "pretokenizers")[:1]
    whole = all(not set(token["content"]) & SPACE and not token["lstrip"] and not token["rstrip"] for token in file["added_tokens"])
    return whole and bool(first) and drops(first[0]) and all(harmless(step) for step in parts(file.get("normalizer"), "normalizers"))


class Counter:
    """Counts tokens with the ``tokenizers`` file at ``path``."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.separable = separates(json.loads(self.tokenizer.to_str()))
        self.chunk, self.overlap = chunk, overlap
        self.known: dict[str, int] = {}

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and start offsets of each text's tokens."""
        out = []
        for code in self.tokenizer.encode_batch(texts, add_special_tokens=False):
            starts = np.fromiter((start for start, _ in code.offsets), np.int64, len(code))
            out.append((np.array(code.ids, np.int64), starts))
        return out

    def long(self, text: str) -> int:
        """Tokens of a text by chunks that overlap."""
        edges = list(range(0, len(text), self.chunk))
        if len(edges) > 1 and len(text) - edges[-1] <= self.overlap:
            edges.pop()
        chunks = [(low, min(len(text), low + self.chunk + self.overlap)) for low in edges]
        chunks[-1] = (chunks[-1][0], len(text))
        total, low = 0, 0
        (start, end), ahead = chunks[0], chunks[1:]
        left = self._at(text, start, end)
        while ahead:
            right_start, right_end = ahead[0]
            right = self._at(text, right_start, right_end)
            wide = self.overlap
            cut = self._boundary(text, left, right, right_start, end)
            while cut is None and end < right_end:
                wide *= 2
                end = min(right_end, right_start + wide)
                left = self._at(text, start, end)
                cut = self._boundary(text, left, right, right_start, end)
            if cut is None:  # no boundary in the whole chunk: left now covers it
                ahead.pop(0)
                continue
            total += int(((left[1] >= low) & (left[1] < cut)).sum())
            low, start, end, left = cut, right_start, right_end, right
            ahead.pop(0)
        return total + int((left[1] >= low).sum())

    def _at(self, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        ids, starts = self.encode([text[start:end]])[0]
        return ids, starts + start

    @staticmethod
    def _boundary(text: str, left, right, start: int, end: int) -> int | None:
        """A place behind white space in the overlap from which both sides have the same tokens.

        They must agree up to the last white space of the overlap, on a word or more:
        what the end of ``left`` cuts off comes after it.
        """
        inner = [n for n in range(start + 1, end) if text[n - 1] in SPACE and text[n] not in SPACE]
        last = next((n for n in range(end - 1, start, -1) if text[n] in SPACE), None)
        for cut in inner:
            if last is None or cut >= last:
                return None
            ours = (left[1] >= cut) & (left[1] < last)
            theirs = (right[1] >= cut) & (right[1] < last)
            if ours.any() and np.array_equal(left[0][ours], right[0][theirs]) and np.array_equal(left[1][ours], right[1][theirs]):
                return cut
        return None

    def words(self, words: list[str]) -> np.ndarray:
        """Tokens of each word; new words are encoded in chunks of many, cut by offsets."""
        new = [word for word in words if word not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = words
        group: list[list[str]] = []
        size = self.chunk
        for word in new:
            if size >= self.chunk:
                group.append([])
                size = 0
            group[-1].append(word)
            size += len(word) + 1
        for some, (_, starts) in zip(group, self.encode([" ".join(some) for some in group]), strict=True):
            ends = np.cumsum([len(word) + 1 for word in some])
            counts = np.diff(np.searchsorted(starts, ends, "left"), prepend=0)
            self.known.update(zip(some, counts.tolist(), strict=True))
        return np.array([self.known[word] for word in words], np.int64)

    def batch(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.separable:
            return np.array([len(ids) for ids, _ in self.encode(texts.to_pylist())], np.int64)
        huge = pc.greater(pc.utf8_length(texts), self.chunk).to_numpy(zero_copy_only=False)
        codes, words, starts = batches.split(pc.if_else(pa.array(huge), "", texts))
        upto = np.concatenate([[0], np.cumsum(self.words(words)[codes] if len(codes) else codes)])
        counts = upto[starts[1:]] - upto[starts[:-1]]
        for n in np.flatnonzero(huge):
            counts[n] = self.long(texts[int(n)].as_py())
        return counts


def count(docs: DataFrame, path: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit beside all other columns.

    ``path`` is the tokenizer's file, at the same place on every executor. No begin, end
    or added special token counts; special strings inside a text are handled as the
    library does by default; nothing is truncated. A null or empty text has no token.
    Columns with the names of the results are replaced.
    """
    columns = kept(docs, "n_bytes", "n_tokens", "over_limit")
    rows = docs.select(*columns)
    schema = rows.withColumn("n_tokens", F.lit(0).cast("long")).schema

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = Counter(path)
        for batch in parts:
            for part in batches.slices(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counter.batch(part.column(text)), pa.int64())], names=[*columns, "n_tokens"])

    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    return rows.mapInArrow(run, schema).select(*columns, size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
