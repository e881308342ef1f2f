"""Trained operators and the mix against plain versions of them."""

from __future__ import annotations

import heapq
import math
import random
from collections import defaultdict

import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from bomwerk.llm import batches, langid, mixing, pii, toxicity

SAMPLES = "/root/testdata/sf0.01"


# --- language ---


def plain_language(body, dictionaries):
    """Sizes of a text behind each dictionary, piece by piece."""
    raw = body.encode()
    if not raw:
        return "und", 0.0, True
    count = -(-len(raw) // langid.PIECE)
    parts = [raw[len(raw) * n // count : len(raw) * (n + 1) // count] for n in range(count)]

    def size(lang, part):
        held = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=langid.LEVEL)
        return len(zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=held, write_content_size=False).compress(part))

    sizes = sorted((sum(size(lang, part) for part in parts), lang) for lang in dictionaries)
    if sizes[0][0] == sizes[1][0]:
        carrier = b" ".join(dictionaries[lang][: langid.CARRIER_BYTES] for lang in sorted(dictionaries))
        sizes = sorted((sum(size(lang, carrier + b" " + part + b" ") - size(lang, carrier) for part in parts), lang) for lang in dictionaries)
    margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
    return sizes[0][1], 1 - math.exp(-langid.STEEP * margin), margin < langid.MIN_MARGIN


def test_language_equals_plain_compression(spark):
    docs = spark.read.parquet(f"{SAMPLES}/documents.parquet").select("doc_id", "text", "lang")
    dictionaries = langid.train(docs.where(~langid.held_out(F.col("doc_id"), 3, 1)))
    rows = docs.where("doc_id % 3 = 0").collect()
    extra = [(10**6, rows[0].text * 40, "xx"), (10**6 + 1, "ok", None), (10**6 + 2, "12 ..", None), (10**6 + 3, None, None)]
    some = spark.createDataFrame([tuple(r) for r in rows] + extra, "doc_id long, text string, lang string").repartition(3)
    for row in langid.classify(some, dictionaries).collect():
        body = batches.plain(pa.array([row.text]))[0].as_py()
        lang, score, rejected = plain_language(body, dictionaries)
        assert (row.lang_pred, row.rejected) == (lang, rejected) and row.score == pytest.approx(score), row.doc_id


def test_a_language_of_long_documents_only_is_learnt(spark):
    rng = random.Random(3)
    dutch, greek = "de het een van en niet dat voor met zijn naar huis boom".split(), "και το να είναι για με που από στο σπίτι δέντρο".split()
    text = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(n, text(dutch, 40), "nl") for n in range(50)] + [(100 + n, text(greek, 6000), "el") for n in range(5)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model) == {"nl", "el"} and all(len(held) <= langid.DICTIONARY_BYTES for held in model.values())
    asked = spark.createDataFrame([(1, text(greek, 30)), (2, text(dutch, 30)), (3, text(greek, 9000))], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.classify(asked, model).collect()} == {1: "el", 2: "nl", 3: "el"}


# --- toxicity ---


def _labelled(spark, count=600):
    rng = random.Random(11)
    mild, rude = [f"mild{n}" for n in range(60)], [f"rude{n}" for n in range(12)]
    docs, labels = [], []
    for n in range(count):
        toxic = n % 5 == 0
        words = [rng.choice(mild) for _ in range(60)]
        if toxic:
            words[20:28] = [rng.choice(rude) for _ in range(8)]
        docs.append((n, " ".join(words)))
        labels.append((n, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), docs, labels


def test_log_odds_equal_plain_counts(spark):
    docs, labels, rows, marks = _labelled(spark)
    model = toxicity.train(docs.repartition(3), labels)
    back = F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(toxicity.CALIBRATION)) == 0
    counted = {r.doc_id for r in docs.where(~back).collect()}
    toxic = {d for d, t in marks if t}
    total, bad = defaultdict(int), defaultdict(int)
    for doc_id, text in rows:
        if doc_id in counted:
            words = set("".join(c if c.isalpha() else " " for c in text.lower()).split())
            tokens = words | {"^" + w[:n] for n in toxicity.BEGINNINGS for w in words if len(w) > n}
            for token in tokens:
                total[token] += 1
                bad[token] += doc_id in toxic
    share = 1 - 1 / toxicity.CALIBRATION
    n1, n0 = len(toxic) * share, (len(rows) - len(toxic)) * share
    weight = toxicity.PRIOR * (n1 + n0)
    strong = {}
    for token, count in total.items():
        prior = toxicity.PRIOR * count
        y1, y0 = bad[token] + prior, count - bad[token] + prior
        odds = math.log(y1 / max(n1 + weight - y1, 0.5)) - math.log(y0 / max(n0 + weight - y0, 0.5))
        strong[token] = odds, odds / math.sqrt(1 / y1 + 1 / y0), count
    fits = []
    for caution in toxicity.CAUTION:
        want = {t: odds * (1 - caution / abs(z)) for t, (odds, z, count) in strong.items() if count > 1 and abs(z) >= caution}
        fits.append(set(want) == set(model.scores) and all(model.scores[t] == pytest.approx(w) for t, w in want.items()))
    assert any(fits) and model.scores["rude"] > 0


def test_more_evidence_scores_higher(spark):
    model = toxicity.Model({"rude": 3.0}, -0.05, (0.4, -1.0))
    texts = [(n, " ".join(["mild"] * 40 + ["rude"] * n)) for n in range(12)]
    found = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    ranked = [found[n] for n in range(1, 12)]
    assert ranked == sorted(set(ranked)) and found[0] < 0.5 < found[11] <= 1


def test_training_on_odd_labels(spark):
    docs, labels, *_ = _labelled(spark, 60)
    asked = spark.createDataFrame([(1, "rude0 rude1 rude2"), (2, None), (3, "")], "doc_id long, text string")

    def scores(d, m):
        return [r.score for r in toxicity.score(asked, toxicity.train(d, m)).orderBy("doc_id").collect()]

    assert all(0 <= s < 0.5 for s in scores(docs, labels.limit(0)))
    assert all(0 <= s <= 1 for s in scores(docs.limit(0), labels))
    assert all(s > 0.5 for s in scores(docs, labels.withColumn("toxic", F.lit(1))))
    assert all(s < 0.5 for s in scores(docs, labels.withColumn("toxic", F.lit(None).cast("int"))))
    # repeated and null labels of a document change nothing
    again = labels.unionByName(labels).unionByName(labels.withColumn("toxic", F.lit(None).cast("int")))
    assert scores(docs, again) == scores(docs, labels)


# --- mix ---


def test_each_document_of_the_mix(spark):
    """Sainte-Laguë by a heap, and the turns of each source's documents."""
    rng = random.Random(8)
    docs = [(n, " ".join(["w"] * rng.randrange(1, 400)), rng.choice("aaab") if n % 7 else None) for n in range(400)]
    found = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)).collect()
    sizes, targets = defaultdict(int), {}
    for row in found:
        assert row.size == len(row.text.split())
        sizes[row.source] += row.size
        targets[row.source] = row.target
    total, number = sum(sizes.values()), len(sizes)
    length = max(1, min(mixing.BLOCK, total // max(1, 8 * number)))
    heap = [(-targets[s], n, 1, s) for n, s in enumerate(sorted(targets, key=lambda s: (s is None, s or "")))]
    heapq.heapify(heap)
    blocks = defaultdict(int)
    for _ in range(round(total / length)):
        _, n, turn, source = heapq.heappop(heap)
        blocks[source] += 1
        heapq.heappush(heap, (-targets[source] / (2 * turn + 1), n, turn + 1, source))
    for source, size in sizes.items():
        rows = [r for r in found if r.source == source]
        quota = min(blocks[source] * length, mixing.REPEATS * size)
        assert sum(r.taken for r in rows) == quota
        turns = quota // size
        # whole turns for all, one more for some, and one document that the quota cuts
        assert all(turns * r.size <= r.taken <= (turns + 1) * r.size for r in rows)
        assert sum(r.taken % r.size != 0 for r in rows) <= 1


# --- personal data ---


def test_every_kind_of_personal_data_is_found(spark):
    rng = random.Random(2)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        body = "4" + number(14)
        odd = sum(sum(divmod(2 * int(c), 10)) if n % 2 == 0 else int(c) for n, c in enumerate(body))
        return body + str(-odd % 10)

    def iban():
        account = number(18)
        check = 98 - int(account + "131400") % 97
        return f"DE{check:02}{account}"

    made = {
        "email": lambda: f"user{number(3)}@mail{number(2)}.example.org", "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        "card": card, "phone": lambda: f"+49 {number(3)} {number(7)}", "iban": iban,
    }
    kinds = [kind.name for kind in pii.KINDS]
    rows = [(n, f"Some words before, {kind} {make()} and after it.", kind) for n, (kind, make) in enumerate((k, m) for k, m in made.items() if k in kinds for _ in range(40))]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string, planted string")).collect()
    caught = defaultdict(list)
    for row in found:
        caught[row.planted].append(any(kinds[span["kind"]] == row.planted for span in row.found))
    assert {"email", "ip", "card", "phone"} <= set(caught)
    assert all(sum(hits) / len(hits) >= 0.95 for hits in caught.values()), {k: sum(v) for k, v in caught.items()}
