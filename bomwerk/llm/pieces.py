"""Encoding and decoding with merge-type SentencePiece vocabularies.

A text starts as a row of characters. An agenda holds the adjacent pairs whose joined
string is a piece, the best score first and the leftmost of equal ones; each step joins
the first pair that is still there and adds its new neighbours. Characters without a
piece become their bytes.

Where no piece of the vocabulary has a space mark behind another character, no pair is
ever joined across the start of a run of space marks, nor with an ASCII character that
no piece has; the segments between them are encoded one by one, and equal segments once.
A vocabulary with such a piece is encoded text by text. Every new segment of an Arrow batch is encoded and decoded by the
library as well; a text with a segment that differs is left to the library.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bomwerk.llm import batches
from bomwerk.llm.tables import kept

SPACE = "▁"  # the mark of a space
MARK = SPACE.encode()
REMEMBERED, REMEMBERED_BYTES = 400_000, 32 << 20  # segments that a task keeps, and their text
SIDE_BY_SIDE = 64  # characters of a segment whose agenda is worked off beside others
NUMBERS = 1 << 24  # more than characters and pieces of a vocabulary
LAST = 1 << 62


class Vocabulary:
    """Pieces, scores and bytes of the model file at ``path``."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        lib, size = self.library, self.library.get_piece_size()
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes: list[bytes] = [b""] * size
        self.of_byte: dict[int, int] = {}
        for n in range(size):
            piece = lib.id_to_piece(n)
            if lib.is_byte(n):
                value = int(piece[3:5], 16)
                self.of_byte[value], self.bytes[n] = n, bytes([value])
            elif lib.is_unused(n):
                raise ValueError(f"unused piece {piece!r}: not a plain merge vocabulary")
            elif not lib.is_control(n) and not lib.is_unknown(n):
                self.scores[piece], self.ids[piece] = lib.get_score(n), n
                self.bytes[n] = piece.replace(SPACE, " ").encode()
        if len(self.of_byte) not in (0, 256):
            raise ValueError("some bytes have no piece")
        self.unknown = lib.unk_id()
        self.names = [str(n) for n in range(size)]
        self.splits = all(SPACE not in piece.lstrip(SPACE) for piece in self.ids)
        self.prefixed = lib.normalize("a").startswith(SPACE)
        self._pairs()
        self.lone = np.zeros(256, bool)  # ASCII characters that no piece has
        self.lone[:128] = self.number_of[:128] < 0
        self.fence = "\n" if self.lone[ord("\n")] else ""
        if not self.fence:
            self.lone[:] = False
        self.fenced = lib.encode(self.fence)
        if lib.encode("ab ba") != self.encode(lib.normalize("ab ba")):
            raise ValueError(f"{path} is not a merge-type vocabulary")

    def encode(self, symbols: str) -> list[int]:
        """Ids of a normalised text or segment, by the agenda."""
        scores = self.scores
        parts: list[str] = list(symbols)
        count = len(parts)
        before, after = list(range(-1, count - 1)), list(range(1, count + 1))
        agenda: list[tuple[float, int, int, str]] = []
        for n in range(count - 1):
            joined = parts[n] + parts[n + 1]
            if joined in scores:
                agenda.append((-scores[joined], n, n + 1, joined))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, joined = heapq.heappop(agenda)
            # a part that has gone or grown since is no longer the one this pair meant
            if not parts[left] or after[left] != right or parts[left] + parts[right] != joined:
                continue
            parts[left], parts[right] = joined, ""
            follow, lead = after[right], before[left]
            after[left] = follow
            if follow < count:
                before[follow] = left
                wider = joined + parts[follow]
                if wider in scores:
                    heapq.heappush(agenda, (-scores[wider], left, follow, wider))
            if lead >= 0:
                wider = parts[lead] + joined
                if wider in scores:
                    heapq.heappush(agenda, (-scores[wider], lead, left, wider))
        ids: list[int] = []
        for part in parts:
            if part:
                own = self.ids.get(part)
                if own is not None:
                    ids.append(own)
                elif self.of_byte:
                    ids += [self.of_byte[value] for value in part.encode()]
                elif not ids or ids[-1] != self.unknown:  # unknown characters in a row are one id
                    ids.append(self.unknown)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        """The text of a segment's ids, with its leading space."""
        return b"".join([self.bytes[n] for n in ids])

    def _pairs(self) -> None:
        """Numbers for characters and pieces, and what each pair of them that makes a piece is joined to."""
        chars = sorted({char for piece in self.ids for char in piece})
        number = {name: n for n, name in enumerate(dict.fromkeys([*chars, *self.ids]))}
        rank = {score: n for n, score in enumerate(sorted(set(self.scores.values()), reverse=True))}
        found = []
        for piece, score in self.scores.items():
            for cut in range(1, len(piece)):
                left, right = number.get(piece[:cut]), number.get(piece[cut:])
                if left is not None and right is not None:
                    found.append((left * len(number) + right, rank[score] * SIDE_BY_SIDE * NUMBERS + number[piece]))
        self.keys, self.turns = (np.array(column, np.int64) for column in zip(*sorted(found), strict=True))
        self.number_of = np.full(0x110000, -1, np.int32)
        for char in chars:
            self.number_of[ord(char)] = number[char]
        self.size = len(number)
        self.id_of = np.array([self.ids.get(name, -1) for name in number], np.int64)

    def _turn(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """When each pair is joined, by score, then by place, and to which number; ``LAST`` if it makes no piece."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.turns[at] + place * NUMBERS, LAST)

    def encode_all(self, segments: list[str]) -> list[list[int]]:
        """Ids of many segments: the agendas of short ones are worked off side by side.

        In each turn every segment joins the first pair of its agenda. A segment without
        a pair left is done and leaves the arrays.
        """
        out: list[list[int] | None] = [None] * len(segments)
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        live = np.flatnonzero((sizes > 1) & (sizes <= SIDE_BY_SIDE))
        codes = np.frombuffer("".join([segments[n] for n in live.tolist()]).encode("utf-32-le"), np.uint32)
        part, lengths = self.number_of[codes], sizes[live]
        first = np.cumsum(lengths) - lengths
        place = np.arange(len(part)) - np.repeat(first, lengths)  # the leftmost of equal scores goes first
        turn = np.full(len(part), LAST, np.int64)  # of each part with the next one
        if len(part):
            turn[:-1] = self._turn(part[:-1], part[1:], place[:-1])
            turn[first + lengths - 1] = LAST
        done_part, done_live, done_lengths = [], [], []
        while len(live):
            best = np.minimum.reduceat(turn, first)
            open_ = best < LAST
            if not open_.all():
                stays = np.repeat(open_, lengths)
                done_part.append(part[~stays])
                done_live.append(live[~open_])
                done_lengths.append(lengths[~open_])
                part, turn, place = part[stays], turn[stays], place[stays]
                live, best, lengths = live[open_], best[open_], lengths[open_]
                if not len(live):
                    break
                first = np.cumsum(lengths) - lengths
            left = np.flatnonzero(turn == np.repeat(best, lengths))
            part[left] = best % NUMBERS
            keep = np.ones(len(part), bool)
            keep[left + 1] = False
            part, turn, place = part[keep], turn[keep], place[keep]
            lengths = lengths - 1
            at = left - np.arange(len(left))  # where it stands when the right parts are gone
            ends = np.cumsum(lengths) - 1
            first = ends + 1 - lengths
            turn[ends] = LAST
            for near in (at[at < ends], at[at > first] - 1):
                turn[near] = self._turn(part[near], part[near + 1], place[near])
        if done_live:
            part, live, lengths = np.concatenate(done_part), np.concatenate(done_live), np.concatenate(done_lengths)
            ids = np.where(part >= 0, self.id_of[part], -1)
            ends = np.cumsum(lengths)
            whole = np.minimum.reduceat(ids, ends - lengths) >= 0
            flat = ids.tolist()
            for n, low, high, plain in zip(live.tolist(), (ends - lengths).tolist(), ends.tolist(), whole.tolist(), strict=True):
                if plain:
                    out[n] = flat[low:high]
        # long segments, and those with a character that has no piece
        return [self.encode(segment) if ids is None else ids for segment, ids in zip(segments, out, strict=True)]


class Coder:
    """Encodes and decodes batches of texts; remembers segments."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self._forget()

    def _forget(self) -> None:
        """Segments by number: how many ids, ids as text, decoded bytes, and whether the library disagrees."""
        self.known: dict[str, int] = {}
        self.counts: list[int] = []
        self.written: list[str] = []
        self.bodies: list[bytes] = []
        self.differs: list[bool] = []

    def segments(self, texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Code of each segment, the distinct segments, and where each text's segments start."""
        data = b"".join(texts_ := [text.encode() for text in self.vocabulary.library.normalize(texts.to_pylist())])
        edges = np.concatenate([[0], np.cumsum([len(text) for text in texts_])]).astype(np.int64)
        cut = np.zeros(len(data) + 1, bool)
        cut[edges] = True
        if self.vocabulary.splits and len(data) >= len(MARK):
            flat = np.frombuffer(data, np.uint8)
            mark = np.zeros(len(data) + len(MARK), bool)
            mark[len(MARK) : len(data) + 1] = (flat[:-2] == MARK[0]) & (flat[1:-1] == MARK[1]) & (flat[2:] == MARK[2])
            cut[: len(data)] |= mark[len(MARK) :] & ~mark[: len(data)]
            lone = self.vocabulary.lone[flat]
            cut[: len(data)] |= lone
            cut[1:] |= lone
        offsets = np.flatnonzero(cut)
        if len(offsets) < 2:
            return np.zeros(0, np.int64), [], np.zeros(len(edges), np.int64)
        parts = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
        coded = parts.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.searchsorted(offsets, edges)

    def learn(self, segments: list[str]) -> np.ndarray:
        """The number of each segment; those that are new are encoded and decoded."""
        known = self.known
        numbers = np.fromiter([known.get(segment, -1) for segment in segments], np.int64, len(segments))
        at = np.flatnonzero(numbers < 0)
        if len(known) + len(at) > REMEMBERED and known:
            self._forget()
            return self.learn(segments)
        if len(at):
            new = [segments[n] for n in at.tolist()]
            numbers[at] = np.arange(len(self.counts), len(self.counts) + len(new))
            self.known.update(zip(new, numbers[at].tolist(), strict=True))
            self._learn(new)
        return numbers

    def _learn(self, new: list[str]) -> None:
        words, names = self.vocabulary, self.vocabulary.names
        # the library puts the first space mark before a text by itself; before other segments goes a lone character
        inner = [words.prefixed and text[0] != SPACE for text in new]
        plain = [words.fence + text if fenced else text[words.prefixed :] for text, fenced in zip(new, inner, strict=True)]
        checks = words.library.encode(plain, num_threads=1)
        coded = words.encode_all(new)
        bodies = [words.decode(ids) for ids in coded]
        # a text of these segments is decoded at once; only if it differs, each by itself
        back = words.library.decode([n for ids in coded for n in ids]).encode()
        whole = b"".join(bodies)
        alike = whole[words.prefixed and whole[:1] == b" " :] == back
        cut = len(words.fenced)
        differs = [ids != (check[cut:] if fenced else check) and bare != "" for ids, check, fenced, bare in zip(coded, checks, inner, plain, strict=True)]
        if not alike:
            differs = [wrong or words.library.decode(ids).encode() != body[words.prefixed and body[:1] == b" " :] for wrong, ids, body in zip(differs, coded, bodies, strict=True)]
        self.counts += map(len, coded)
        self.written += [",".join([names[n] for n in ids]) for ids in coded]
        self.bodies += bodies
        self.differs += differs

    def batch(self, texts: pa.Array) -> Iterator[tuple[int, str, bytes, bool]]:
        """For each text the number of ids, ids as text, decoded bytes, and whether the library had to do it."""
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.string()), "")
        codes, distinct, starts = self.segments(texts)
        numbers = self.learn(distinct)
        own = numbers[codes]
        wrong = np.fromiter([self.differs[n] for n in numbers.tolist()], bool, len(numbers))[codes]
        counts = np.fromiter([self.counts[n] for n in numbers.tolist()], np.int64, len(numbers))[codes]
        upto, written, bodies = np.concatenate([[0], np.cumsum(counts)]), self.written, self.bodies
        for n, (low, high) in enumerate(zip(starts.tolist(), starts[1:].tolist(), strict=False)):
            if wrong[low:high].any():
                ids = self.vocabulary.library.encode(texts[n].as_py())
                yield len(ids), ",".join(map(str, ids)), self.vocabulary.library.decode(ids).encode(), True
                continue
            at = own[low:high].tolist()
            body = b"".join([bodies[c] for c in at])
            yield int(upto[high] - upto[low]), ",".join([written[c] for c in at]), body[self.vocabulary.prefixed and body[:1] == b" " :], False
        if sum(map(len, self.bodies)) > REMEMBERED_BYTES:
            self._forget()


def encode(docs: DataFrame, path: str, text: str = "text", texts: bool = False) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256, decoded_sha256 and by_library beside all other columns.

    Whole texts, without begin and end ids and without sampling. ``path`` is the model
    file, at the same place on every executor. The digests are those of the decimal ids
    joined by commas and of the decoded text; ``texts`` adds both themselves as ``ids``
    and ``decoded``. ``by_library`` marks texts in which a segment differed from the
    library's. A null text counts as empty: no ids. Columns with the names of the
    results are replaced.
    """
    results = ["n_tokens", "ids_sha256", "decoded_sha256", "by_library", *(["ids", "decoded"] if texts else [])]
    columns = kept(docs, *results)
    rows = docs.select(*columns)
    kinds = ["long", "string", "string", "boolean", "string", "string"]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema], *[f"{name} {kind}" for name, kind in zip(results, kinds, strict=False)]])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path)
        for batch in parts:
            for part in batches.slices(batch, text):
                numbers, prints, backs, left, ids, bodies = [], [], [], [], [], []
                for count, written, body, by_library in coder.batch(part.column(text)):
                    numbers.append(count)
                    prints.append(hashlib.sha256(written.encode()).hexdigest())
                    backs.append(hashlib.sha256(body).hexdigest())
                    left.append(by_library)
                    if texts:
                        ids.append(written)
                        bodies.append(body.decode(errors="replace"))
                made = [pa.array(numbers, pa.int64()), pa.array(prints, pa.string()), pa.array(backs, pa.string()), pa.array(left, pa.bool_())]
                made += [pa.array(ids, pa.string()), pa.array(bodies, pa.string())] if texts else []
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*columns, *results])

    return rows.mapInArrow(run, schema)
