"""Piece encoding, the filter audit and the trie of conversations against plain versions of them."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from itertools import permutations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from bomwerk.llm import filter_audit, pieces, prefix_trie

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SAMPLES = "/root/testdata/sf0.01"
ODD_TEXTS = [
    "", " ", "  ", "a", "\n", "\n\n a", "a\x00b\t\tc", "▁▁x ▁", "😀 é́ ﬁ 　日本語テスト", " lead", "trail  ", "<s> </s><0x41><unk>", "x" * 5000,
    "ab" * 40 + " " + "é" * 100, "▁", "a▁b", " " * 50 + "a", "ç" * 64, "\r\n x", "a" * 64 + " " + "b" * 65, "word " * 60_000, "ab" * 100_000, None,
]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- pieces ---


def _by_library(texts):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=MODEL)
    out = []
    for text in texts:
        ids = library.encode(text or "")
        out.append((len(ids), ",".join(map(str, ids)), library.decode(ids)))
    return out


def test_pieces_equal_the_library(spark):
    docs = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string").withColumn("IDS", F.lit("x")).withColumn("n_tokens", F.lit("x"))
    found = pieces.encode(docs.repartition(3), MODEL, texts=True)
    assert found.schema["n_tokens"].dataType.simpleString() == "bigint" and [c.lower() for c in found.columns].count("ids") == 1
    got = {r.doc_id: r for r in found.collect()}
    for n, (count, ids, text) in enumerate(_by_library(ODD_TEXTS)):
        row = got[n]
        assert (row.n_tokens, row.ids, row.decoded, row.by_library) == (count, ids, text, False), ODD_TEXTS[n]
        assert (row.ids_sha256, row.decoded_sha256) == (_sha(ids), _sha(text))
    assert pieces.encode(docs.limit(0), MODEL).collect() == []


def test_pieces_of_all_documents(spark):
    docs = spark.read.parquet(f"{SAMPLES}/documents.parquet").select("doc_id", "text")
    texts = docs.collect()
    want = {row.doc_id: (_sha(ids), _sha(text)) for row, (_, ids, text) in zip(texts, _by_library([row.text for row in texts]), strict=True)}
    got = {r.doc_id: (r.ids_sha256, r.decoded_sha256) for r in pieces.encode(docs, MODEL).collect()}
    assert got == want


def test_agendas_side_by_side_and_alone():
    words = pieces.Vocabulary(MODEL)
    rng = random.Random(3)
    segments = ["▁" + "".join(rng.choice("aeinrst▁é😀\n") for _ in range(rng.randrange(0, 63))) for _ in range(500)]
    assert words.encode_all(segments) == [words.encode(segment) for segment in segments]
    assert words.encode_all([]) == [] and words.encode("") == []


def test_a_wrong_segment_goes_to_the_library(monkeypatch):
    coder = pieces.Coder(MODEL)
    own = coder.vocabulary.encode_all
    monkeypatch.setattr(coder.vocabulary, "encode_all", lambda segments: [[5] if s == "▁fox" else ids for s, ids in zip(segments, own(segments), strict=True)])
    import pyarrow as pa

    texts = ["a fox ran", "a dog ran"]
    got = list(coder.batch(pa.array(texts)))
    assert [row[3] for row in got] == [True, False]
    assert [(row[0], row[1], row[2].decode()) for row in got] == _by_library(texts)


def test_few_segments_are_remembered(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(pieces, "REMEMBERED", 10)
    coder = pieces.Coder(MODEL)
    for text in ("a b c d e f", "g h i j k l m", "a b c", "n " * 30 + "o p q r s t u v w x y z"):
        assert [(row[0], row[1], row[2].decode()) for row in coder.batch(pa.array([text]))] == _by_library([text])
    assert len(coder.known) == len(coder.counts)


def test_tokens_of_files_without_a_boundary(spark):
    from tokenizers import Tokenizer

    from bomwerk.llm import tokens

    texts = [text or "" for text in ODD_TEXTS] + ["two  words\n\nand <|endoftext|> more"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for name, separable in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        path = public_tokenizers.path(name)
        assert tokens.Counter(path).separable is separable
        library = Tokenizer.from_file(path)
        want = {n: len(library.encode(text, add_special_tokens=False)) for n, text in enumerate(texts)}
        assert {r.doc_id: r.n_tokens for r in tokens.count(docs, path).collect()} == want


# --- filter audit ---


def plain_audit(docs, labels):
    """Every order applied document by document."""
    good = {d for d, quality, _ in labels if quality == 1}
    toxic = {d for d, _, t in labels if t == 1}
    rows = []
    for doc_id, text, lang in docs:
        text = text or ""
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in docs),
        }
        rows.append((doc_id, lang or "", fails))
    out = {}
    for part in {lang for _, lang, _ in rows}:
        own = [(doc_id, fails) for doc_id, lang, fails in rows if lang == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(own)
            for step, letter in enumerate(order, 1):
                gone = [(d, f) for d, f in left if f[letter]]
                before = [(d, f) for d, f in own if f[letter] and any(f[x] for x in order[: step - 1])]
                left = [(d, f) for d, f in left if not f[letter]]
                only = sum(f[letter] and sum(f.values()) == 1 for _, f in own)
                shapley[letter] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(before), only, sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), letter]
        for key, value in out.items():
            if key[0] == part:
                value[6] = shapley[value[6]]
    return out


def _audit(rows):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows.collect()}


def test_audit_equals_every_order_applied(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["tale", "Fox", "DOG", "50%", "river", "über"]) + str(rng.randrange(400)) for _ in range(n)) for n in (5, 199, 200, 350, 350)]
    texts += ["same " * 210, None, "", "\x0b\x85  x", "A", "😀" * 40 + "A", "x " * 40_000, "a\x0bb\x0cc"]
    docs = [(n, rng.choice(texts), rng.choice(["en", "de", None, ""])) for n in range(80)]
    docs += [(None, texts[0], "en"), (3, texts[1], "en"), (3, texts[1], "en"), (-5, texts[7], "de")]
    labels = [(n, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for n in range(0, 90, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("part", F.lit(7)).repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    best = {}
    for doc_id, quality, toxic in labels:
        old = best.get(doc_id, (0, 0))
        best[doc_id] = max(old[0], quality or 0), max(old[1], toxic or 0)
    want = plain_audit(docs, [(d, *marked) for d, marked in best.items() if d is not None])
    assert _audit(filter_audit.audited(frame, marks)) == want
    assert filter_audit.audited(frame.limit(0), marks).collect() == []
    assert {k: v[:4] for k, v in _audit(filter_audit.audited(frame, marks.limit(0))).items()} == {k: v[:4] for k, v in want.items()}


def test_audit_of_other_filters(spark):
    counts = spark.createDataFrame([("p", 0b11, 4), ("p", 0b01, 1), ("p", 0b11, 1), ("p", 0, 2)], "part string, mask int, documents long")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filter_audit.audit(counts, "XY", {}).collect()}
    assert got == {("XY", 1): (2, 6, 0, 1, 7), ("XY", 2): (2, 0, 5, 0, 5), ("YX", 1): (3, 5, 0, 0, 5), ("YX", 2): (2, 1, 5, 1, 7)}
    with pytest.raises(ValueError):
        filter_audit.audit(counts, "ABCDEFGH", {})


def test_repeats_of_one_text_share_no_key(spark):
    docs = spark.createDataFrame([(n, b"hot") for n in range(500)] + [(7, b"cold")], "doc_id long, digest binary")
    plan = filter_audit.repeats(docs)
    assert plan.where("repeat").count() == 499
    # the join is on id and digest together
    assert "doc_id" in next(line for line in plan._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line)


# --- trie ---


def plain_trie(rows):
    """The trie by dictionaries of paths."""
    convs = {}
    key = lambda r: (r[1] is not None, r[1] or 0)
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=key):
        convs.setdefault(conv, []).append((role or "", text or ""))
    paths = {}
    for conv, own in convs.items():
        h = zlib.crc32(str(conv).encode()) % 4
        base = conv - int(math.fmod(conv, 20))  # the remainder of a negative id is negative, as in SQL
        paths[conv] = convs.get(base, [])[:h] + own[h:]
    members, ending = {}, {}
    for conv, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(conv)
        ending.setdefault(tuple(path), []).append(conv)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    out = {}
    for path in sorted(members, key=len, reverse=True):
        own = (len(members[path]) - 1) * len([w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in path[-1][1]).split(" ") if w]) if path else 0
        below = children.get(path, [])
        leaves, saved = sum(out[c][3] for c in below) if below else 1, own + sum(out[c][4] for c in below)
        out[path] = (min(members[path[:-1]]) if path else None, len(members[path]), len(below), leaves, saved, _sha(",".join(map(str, sorted(ending.get(path, []))))))
    return {(min(members[path]), len(path)): value for path, value in out.items()}


def _trie(spark, rows, parts=5):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("x")).repartition(parts)
    found = prefix_trie.trie(frame).collect()
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found}
    assert len(got) == len(found)
    # the tour meets each arc once, and children within their parents
    assert sorted(place for r in found for place in (r.enter, r.leave)) == list(range(2 * len(found)))
    spans = {(r.conv_id, r.depth): (r.enter, r.leave) for r in found}
    for r in found:
        if r.depth:
            assert spans[r.parent_conv_id, r.depth - 1][0] < r.enter < r.leave < spans[r.parent_conv_id, r.depth - 1][1]
    return got


def conversations(seed, count, deep=()):
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(3 * count), count):
        for turn in range(deep[conv % len(deep)] if deep else rng.randrange(1, 7)):
            rows.append((conv, turn, rng.choice(["user", "assistant", None]), rng.choice(["hi there", "so  it\x0bis", "", None, "well " * 3, f"own {rng.randrange(4)}"])))
    return rows


ODD_CONVERSATIONS = [(None, 0, "user", "lost"), (-7, 1, "user", "x"), (-20, 0, "user", "y"), (40, None, "user", "first"), (40, 3, "a", "b"), (41, None, None, None), (41, 2, "a", "b c"), (100, 5, "r", "t"), (100, 6, "r", "t"), (10**12, 0, "user", "z")]


def test_trie_equals_dictionaries_of_paths(spark):
    rows = conversations(1, 150) + ODD_CONVERSATIONS
    rows = [r for n, r in enumerate(rows) if not any(r[:2] == s[:2] for s in rows[:n])]
    want = plain_trie(rows)
    assert _trie(spark, rows) == want
    assert any(ends == prefix_trie.NOTHING for *_, ends in want.values()) and (min(r[0] for r in rows if r[0] is not None), 0) in want
    assert _trie(spark, ODD_CONVERSATIONS[:1]) == {}
    assert _trie(spark, []) == {}
    assert _trie(spark, [(5, 0, "user", "alone")]) == plain_trie([(5, 0, "user", "alone")])


def test_trie_in_small_blocks_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 7)
    monkeypatch.setattr(prefix_trie, "CHUNK", 12)
    shrink = prefix_trie.ranked
    monkeypatch.setattr(prefix_trie, "ranked", lambda segments: shrink(segments, short=20))
    rows = conversations(2, 60)
    assert _trie(spark, rows) == plain_trie(rows)


def test_one_conversation_and_one_opening_with_most_rows(spark):
    # conversation 20 runs over all partitions, and all others begin alike
    rows = [(20, n, "user", f"turn {n % 3}") for n in range(900)]
    rows += [(conv, n, "user", f"turn {n % 3}") for conv in range(21, 400) for n in range(1 + conv % 2)]
    assert _trie(spark, rows, 8) == plain_trie(rows)


def test_repeated_turn_numbers_are_turns_of_their_own(spark):
    rows = [(20, 0, "user", "a"), (20, 0, "user", "a"), (20, 0, "user", "b")]
    got = _trie(spark, rows)
    assert sorted(depth for _, depth in got) == [0, 1, 2, 3]
    assert _trie(spark, rows[::-1], 1) == got
