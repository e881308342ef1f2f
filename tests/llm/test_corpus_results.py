"""Every operator against a plain version of it over whole tables."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from bomwerk.llm import decontaminate, mixing, near_dups, pii, queries, ranges, sharding, spotsigs, tokens, toxicity

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def result(spark):
    known = {}

    def result(name):
        if name not in known:
            known[name] = queries.QUERIES[name](spark, FOLDER).toPandas()
        return known[name]

    return result


def classes(sims, ids, least):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), sim in sims.items():
        if sim >= least:
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_all_are_registered():
    assert {re.match("op[0-9]+", name)[0] for name in entry.queries() if re.match("op[0-9]+_", name)} >= {f"op{n}" for n in range(1, 11)}
    assert "pipeline" in entry.queries()


def test_ranges(spark):
    keys = [1, 4, 4, 4, 9]
    rows = spark.createDataFrame([(k,) for k in (0, 1, 2, 4, 5, 9, 10, None)], "k long")
    found = rows.select("k", ranges.below(F.col("k"), keys).alias("b"), ranges.upto(F.col("k"), keys).alias("u")).collect()
    for row in found:
        if row.k is not None:
            assert (row.b, row.u) == (sum(k < row.k for k in keys), sum(k <= row.k for k in keys))


def test_op1(result, docs):
    found = result("op1_spotsigs").set_index("doc_id")
    texts = dict(zip(docs.doc_id, docs.text.fillna(""), strict=True))
    order = sorted(texts, reverse=True)
    assert sorted(found.index) == sorted(texts)
    prints = {}
    for i, n in zip(order, [*order[1:], order[0]], strict=True):
        text, cut = texts[i], len(texts[i]) // 3
        edited = text[: len(text) - cut] + texts[n][:cut]
        row = found.loc[i]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        sets = [{f[k : k + 8] for k in range(0, len(f), 8)} for f in (row.fingerprint, row.edited_fingerprint, found.loc[n].fingerprint)]
        for other, near in ((sets[1], row.near_edited), (sets[2], row.near_next)):
            assert near == pytest.approx(len(sets[0] & other) / len(sets[0] | other) if sets[0] | other else 1.0)
        assert prints.setdefault(text, row.fingerprint) == row.fingerprint
    assert (found.near_edited > found.near_next).mean() > 0.9


def test_spot_signatures(spark):
    def plain(text):
        words = re.findall(r"[^\W_]+", text.lower())
        content = [(n, w) for n, w in enumerate(words) if w not in spotsigs.ANCHORS]
        begins = {n for n, w in enumerate(words) if w in spotsigs.ANCHORS}
        stops = [-1, *sorted(begins), len(words)]
        for low, high in zip(stops, stops[1:], strict=False):
            if high - low > spotsigs.STRETCH or len(stops) == 2:
                begins |= set(range(low + 1, high))
        chains = set()
        for n, word in [(-1, "^"), *((n, words[n]) for n in begins if n < len(words))]:
            chain = [w for m, w in content if m > n][:2]
            if len(chain) == 2:
                chains.add(f"{word}:{chain[0]}:{chain[1]}")
        return chains or ({" ".join(words)} if words else set())

    texts = ["The cat sat on a mat, and the dog slept.", "of the of the", "red", "", "Cats of the in a to barn", "x the y"]
    texts += ["один два три четыре", "один два три пять", "menu soup bread", "menu soup", " ".join(f"row{n}" for n in range(60))]
    texts += ["the list " + " ".join(f"part{n}" for n in range(count)) + " of it and more" for count in (22, 23, 24, 50)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    hashed = {t: {spark.range(1).select(F.shiftrightunsigned(F.xxhash64(F.lit(c)), 32)).first()[0] for c in plain(t)} for t in texts}
    for row in rows.select("text", spotsigs.signatures(F.col("text")).alias("s")).collect():
        assert set(row.s) == hashed[row.text], row.text


def test_texts_without_anchors_differ_in_their_fingerprints(spark):
    texts = [f"один два три слово{n}" for n in range(20)] + [f"menu soup item{n}" for n in range(20)]
    texts += ["the start " + " ".join(f"cell{n if n != edit else 'x'}" for n in range(40)) for edit in range(40)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert rows.select(spotsigs.written(spotsigs.signatures(F.col("text")))).distinct().count() == len(texts)


def test_spotsig_classes(spark, docs):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sets = {r.doc_id: set(r.s) for r in rows.select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).collect()}
    sims = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    found = {r.doc_id: r.class_id for r in spotsigs.classes(rows).collect()}
    assert found == classes(sims, sorted(sets), spotsigs.SIMILARITY)


def test_shared_weights_of_a_block():
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["a", "b", "c", "d e", "f g h"], size=n)) for n in (5, 40, 41, 90, 200, 3)] + ["a b c d e f", "", "?"]
    text, value, weight = near_dups.shingles(pa.array(texts))
    found = near_dups._shared(text, value, weight, len(texts))
    sets = [dict(zip(value[text == n].tolist(), weight[text == n].tolist(), strict=True)) for n in range(len(texts))]
    for i, left in enumerate(sets):
        for j, right in enumerate(sets):
            assert i == j or found[i, j] == pytest.approx(sum(min(w, right[v]) for v, w in left.items() if v in right))


def test_op2(result, docs):
    found = result("op2_sharding").merge(docs, on="doc_id")
    assert len(found) == len(docs) and set(found.law) == {"bytes"} and found.grown_shard.isna().all()
    size = found.text.map(lambda t: len((t or "").encode()) + 16)
    assert (found["size"] == size).all()
    assert (found.text_crc32 == found.text.map(lambda t: zlib.crc32((t or "").encode()))).all()
    for _, slots in found.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))
    loads = found.groupby("shard")["size"].sum().reindex(range(40), fill_value=0)
    # no more apart than records that fill less than an eighth of a shard, but for shards that one record overfills
    fair = size.sum() / 40
    alone = found[found["size"] > fair].shard
    rest = loads[~loads.index.isin(alone)]
    assert rest.max() - rest.min() <= 2 * fair / 8


def test_overfull_ranges_are_cut(spark):
    copies = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same").otherwise(F.col("id").cast("string")).alias("text"))
    found = sharding.assign(copies, 7).groupBy("shard").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots")).collect()
    assert len(found) == 7 and max(r["size"] for r in found) - min(r["size"] for r in found) <= 48
    assert all(r["last"] + 1 == r["n"] == r["slots"] for r in found)


def test_op3(result, docs):
    found = result("op3_pii").set_index("doc_id")
    for i, text in zip(docs.doc_id, docs.text.fillna(""), strict=True):
        spans = base_spans(text)
        row = found.loc[i]
        assert row.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [spans.count(f"{kind}:") for kind in ("email", "ip", "card", "phone")]


def base_spans(text):
    def luhn(digits):
        total = 0
        for n, c in enumerate(reversed(digits)):
            value = int(c) * (1 + n % 2)
            total += value - 9 * (value > 9)
        return total % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    found = [(m.start(), n, f"{kind}:{m.start()}:{m.end()}") for n, (kind, pattern, ok) in enumerate(kinds) for m in re.finditer(pattern, text) if ok(m.group())]
    return ",".join(span for *_, span in sorted(found))


ODD_SPANS = [
    "a@b.co.uk@c.de, x.y@z.com_q@r.org 😀 m@n.o", "1.2.3.4.5.6.7.8 and 256.1.1.1 01.002.0003.255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111",
    "+1 (564) 555-4526.. +12 34 +1-2-3-4-5-6-7-8-9", "@@a@b@c.d@e.f.", "a%b+c@d-e.f-g.h 9" + " 9" * 15, "+" * 50 + "1 23456789", "x" * 20_000 + "@y.z",
    "1.2.3.4" * 30, "00000000000000000000.1.1.1 é1.1.1.1é", "a@b.c " * 1500, "",
]


def test_odd_spans(spark):
    rows = spark.createDataFrame(list(enumerate(ODD_SPANS)), "doc_id long, text string")
    base = pii.written(F.filter("found", lambda span: span["kind"] < 4))
    for row in pii.find(rows).select("doc_id", base.alias("spans")).collect():
        assert row.spans == base_spans(ODD_SPANS[row.doc_id]), ODD_SPANS[row.doc_id][:60]


def test_validated_kinds(spark):
    texts = ["iban DE89 3704 0044 0532 0130 00.", "DE89370400440532013001", "social security number 123-45-6789", "part 123-45-6789", "ssn 000-45-6789"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [(pii.KINDS[s.kind].name, s.value) for s in r.found if s.kind > 3] for r in pii.find(rows).collect()}
    assert found == {0: [("iban", "DE89 3704 0044 0532 0130 00")], 1: [], 2: [("ssn", "123-45-6789")], 3: [], 4: []}


def test_op4(result, docs):
    items = pd.read_parquet(f"{FOLDER}/benchmark.parquet")
    want = {(int(i), int(n)) for i, text in zip(docs.doc_id, docs.text, strict=True) for n, item in zip(items.item_id, items.text, strict=True) if item in (text or "")}
    assert want <= set(zip(result("op4_decontaminate").doc_id, result("op4_decontaminate").item_id, strict=True))
    assert set(result("op4_decontaminate").doc_id) == {i for i, _ in want}


def test_exchanged_values(spark):
    item = "If Alice buys 12 apples for $3 and gives 12 apples to Bob, how many kg of apples does Alice have after 5 days of work?"
    texts = [
        f"Some words. {item} More words.",
        "we ask: If Carol buys 47 apples for $9 and gives 47 apples to Dave, how many kg of apples does Carol have after 8 weeks of work? yes",
        # the same value of the item cannot be two of the document
        "If Carol buys 47 apples for $9 and gives 50 apples to Dave, how many kg of apples does Erin have after 8 weeks of work?",
        "If Alice buys a pear, nothing else of the question is here, not even the apples of Bob.",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontaminate.contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.reparameterised) for r in found) == [(0, 7, False), (1, 7, True)]


def test_op5(result, docs):
    found = result("op5_langid").merge(docs, on="doc_id")
    assert len(found) == len(docs) and found.score.between(0, 1).all()
    assert (found.held_out == found.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    assert set(found.lang_pred) <= set(docs.lang) | {"und"}
    held = found[found.held_out]
    assert (held.lang_pred == held.lang).mean() >= 0.95 and not held[held.n_chars > 100].rejected.any()


def test_op6(spark, result, docs):
    found = result("op6_toxicity").set_index("doc_id")
    assert len(found) == len(docs) and found.score.between(0, 1).all()
    assert (found.predicted == (found.score >= 0.5)).all()
    # enough labelled documents to learn from
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").withColumn("test", F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    model = toxicity.train(rows, labels.where("NOT test"))
    scored = toxicity.score(rows.join(labels.where("test"), "doc_id"), model).select("toxic", "score").toPandas()
    assert (scored.score >= 0.5)[scored.toxic == 1].mean() >= 0.7
    assert (scored.score >= 0.5)[scored.toxic == 0].mean() <= 0.03


def test_segments():
    rng = np.random.default_rng(1)
    for _ in range(200):
        length = int(rng.integers(1, 40))
        scores = np.where(rng.random(length) < 0.5, rng.integers(-3, 5, length), 0).astype(float)
        drift = -0.5
        whole = np.where(scores == 0, drift, scores)
        places = np.flatnonzero(scores)
        found = toxicity.segments(scores[places], places, length, drift)
        assert [(s, e) for s, e, _ in sorted(found)] == maximal(whole, 0, length)
        for start, end, score in found:
            assert score == pytest.approx(whole[start:end].sum())


def maximal(scores, low, high):
    """By definition: the best segment, the shortest one on ties, then those on its two sides."""
    best = max(((scores[a:b].sum(), a - b, -a) for a in range(low, high) for b in range(a + 1, high + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    start = -best[2]
    end = start - best[1]
    return [*maximal(scores, low, start), (start, end), *maximal(scores, end, high)]


def test_op7(result, docs):
    text, value, weight = near_dups.shingles(pa.array(docs.text.fillna("").tolist()))
    total = np.bincount(text, weight, len(docs))
    where = collections.defaultdict(list)
    for t, v, w in zip(text.tolist(), value.tolist(), weight.tolist(), strict=True):
        where[v].append((t, w))
    shared = collections.Counter()
    for found in where.values():
        for n, (a, w) in enumerate(found):
            for b, x in found[:n]:
                shared[(b, a)] += min(w, x)
    ids = docs.doc_id.tolist()
    sims = {(ids[a], ids[b]): s / (total[a] + total[b] - s) for (a, b), s in shared.items()}
    found = dict(zip(result("op7_near_dups").doc_id, result("op7_near_dups").class_id, strict=True))
    assert found == classes(sims, sorted(ids), near_dups.SIMILARITY)


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    for _ in range(10):
        n = int(rng.integers(1, 400))
        value = rng.integers(0, 2**63, n).astype(np.uint64)
        a, b = rng.uniform(0.1, 9, n), rng.uniform(0.1, 9, n)
        prints = near_dups.signatures(np.repeat([0, 1], n), np.tile(value, 2), np.concatenate([a, b]), 2)
        assert abs((prints[0] == prints[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.13


def test_large_group_of_near_copies(spark):
    """A chain of edits: neighbours are similar, its ends are not; a third of all rows are exact copies."""
    words = [f"w{n}" for n in range(200)]
    texts = []
    for n in range(60):
        texts.append(" ".join(words))
        words[3 * n] = f"new{n}"
    other = [" ".join(f"o{n}x{k}" for k in range(60)) for n in range(20)]
    rows = [(n, t) for n, t in enumerate(texts + other)] + [(1000 + n, texts[0]) for n in range(60)]
    found = {r.doc_id: r.class_id for r in near_dups.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {found[n] for n in [*range(60), *range(1000, 1060)]} == {0}
    assert all(found[n] == n for n in range(60, 80))


def test_op8(result, docs):
    found = result("op8_mixing")
    size = docs.set_index("doc_id").text.map(lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or "")))
    assert (found.set_index("doc_id")["size"].sort_index() == size.sort_index()).all()
    sizes = docs.assign(size=docs.doc_id.map(size)).groupby("source", dropna=False)["size"].sum()
    want = targets(dict(sizes))
    for source, rows in found.groupby("source", dropna=False):
        assert (rows.target - want[source]).abs().max() < 1e-6 * max(1, want[source])
        assert abs(rows.taken.sum() - want[source]) <= 2 * mixing.BLOCK
    assert (found.taken <= 3 * found["size"]).all()


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None or s != s, s))
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(order)}
    target, pool, free = dict.fromkeys(order, 0.0), float(sum(sizes.values())), set(order)
    while pool > 1e-9 and free:
        whole = sum(weight[s] for s in free)
        share = {s: pool * weight[s] / whole for s in free}
        pool = 0.0
        for s in list(free):
            target[s] += share[s]
            if target[s] >= 3 * sizes[s]:
                pool += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                free.discard(s)
    return target


def test_sainte_lague(spark):
    rng = np.random.default_rng(5)
    for _ in range(4):
        shares = rng.uniform(0, 50, 12).round(3) ** 2
        seats = int(rng.integers(30, 400))
        rows = spark.createDataFrame([(f"s{n:02}", 0, float(x)) for n, x in enumerate(shares)], "source string, shard int, share double")
        found = {r.source: r.blocks for r in mixing.quotas(rows, seats).collect()}
        won = collections.Counter()
        for _ in range(seats):
            won[max(range(12), key=lambda n: (shares[n] / (2 * won[n] + 1), -n))] += 1
        assert found == {f"s{n:02}": won[n] for n in range(12)}


def test_op9(spark, result):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS FROM '{FOLDER}/pages.parquet'")
    want = connection.execute(queries.ORACLE_SQL["op9_url_filter"]).df()
    columns = sorted(want.columns)
    rows = lambda f: sorted(map(repr, f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False, name=None)))
    assert rows(result("op9_url_filter")) == rows(want)


def test_op10(result, docs):
    found = result("op10_tokens").merge(docs, on="doc_id")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = found.text.fillna("").tolist()
    assert found.n_tokens.tolist() == [len(code) for code in library.encode_batch(texts, add_special_tokens=False)]
    assert found.n_bytes.tolist() == [len(text.encode()) for text in texts]
    assert (found.over_limit == (found.n_tokens > 2048)).all()


def test_chunks_are_spliced():
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = np.random.default_rng(2)
    marks = ["it's", "don't", "<|endoftext|>", "😀", "e\u0301", "naïve", "12345", "!!!", "\u00a0", "A" * 90, "ÉCOLE", "\x1c", "日本語", "word", "<|endof", "text|>"]
    for space in (" ", "\n", "\u2003", ""):
        text = space.join(marks[n] for n in rng.integers(0, len(marks), 3000))
        for chunk, overlap in ((500, 16), (997, 64), (4000, 256)):
            counter = tokens.Counter(path, chunk, overlap)
            want = len(library.encode(text, add_special_tokens=False))
            assert counter.long(text) == want
            assert counter.batch(pa.array([text, None, "", text[:100]])).tolist()[:3] == [want, 0, 0]
            assert int(counter.words(text.split(" ")).sum()) == want if space == " " else True


def test_pipeline(spark, docs, tmp_path):
    found = corpus_pipeline.run(spark, FOLDER).toPandas()
    parts = {name: stage for name, stage in corpus_pipeline.STAGES}
    assert list(parts) == ["language", "near_duplicates", "benchmark_leaks", "source_mix", "shards"]
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet")
    spoken = parts["language"](spark, rows, FOLDER).toPandas()
    assert set(spoken[spoken.n_chars > 100].doc_id) == set(docs[docs.n_chars > 100].doc_id)
    items = pd.read_parquet(f"{FOLDER}/benchmark.parquet").text.tolist()
    assert not found.text.map(lambda t: any(item in t for item in items)).any()
    assert not found.drop_duplicates("doc_id").text.duplicated().any()
    assert found.groupby("doc_id").size().max() <= 3
    merged = found.merge(docs, on="doc_id", suffixes=("", "_raw"))
    assert (merged.text == merged.text_raw).all() and len(merged) == len(found)
    for _, slots in found.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))
