"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns in every operator."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bomwerk.llm import decontaminate, langid, mixing, near_dups, pii, sharding, spotsigs, tokens, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the quick brown fox jumps over a lazy dog and then it runs to the old barn by the river"
LONG = " ".join(f"word{n} of the tale" for n in range(30_000))
ROWS = [
    (1, PROSE, "en", "a", 1),
    (2, None, "en", "a", 1),
    (3, "", None, None, None),
    (4, PROSE, "en", "b", 1),
    (4, PROSE, "en", "b", 1),
    (5, LONG, "en", "b", 1),
    (6, "x" * 300_000, "en", None, 1),
    (7, "### 😀 ***", "en", "c", 1),
    (8, "Der Hund läuft über die Straße und die Katze schläft auf dem Sofa, weil es heute regnet.", "de", "c", 1),
    (9, "ok", "en", "c", 1),
    (None, PROSE + " again", "en", "a", 1),
]
ODD = {"size": "7", "SCORE": "x", "shard": "s", "class_id": "k", "found": "f", "taken": "t", "n_tokens": "n", "_key": "u", "next_text": "v"}


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    return rows.withColumns({name: F.lit(value) for name, value in ODD.items()}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, PROSE), (2, None), (3, ""), (None, PROSE), (4, "no")], "item_id long, text string")


def _model():
    return toxicity.Model({"fox": 6.0, "river": -2.0}, -0.05, (1.0, 0.0))


OPERATORS = {
    "spotsigs_next": lambda d, i: spotsigs.with_next(d.withColumn("spots", spotsigs.signatures(F.col("text"))), ["text", "spots"]),
    "sharding": lambda d, i: sharding.assign(d, 5),
    "pii": lambda d, i: pii.find(d),
    "langid": lambda d, i: langid.classify(d, langid.train(d.select("doc_id", "text", "lang"))),
    "toxicity": lambda d, i: toxicity.score(d, _model()),
    "mixing": lambda d, i: mixing.mix(d),
    "tokens": lambda d, i: tokens.count(d, public_tokenizers.path("word_bpe_49k.json")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_keeps_every_row(docs, empty, items, name):
    found = OPERATORS[name](docs, items)
    assert len(set(map(str.lower, found.columns))) == len(found.columns)
    assert sorted(str(r.doc_id) for r in found.collect()) == sorted(str(r[0]) for r in ROWS)
    assert OPERATORS[name](empty, items).collect() == []


def test_clashing_columns_stay_unless_replaced(docs):
    row = pii.find(docs).where("doc_id = 9").first()
    assert (row["size"], row["SCORE"], row["found"]) == ("7", "x", [])
    assert langid.classify(docs, {"en": b"the of"}).where("doc_id = 9").select("score").first()[0] >= 0


def test_empty_texts_have_defined_results(docs):
    found = {r.doc_id: r for r in langid.classify(docs, langid.train(docs)).collect()}
    assert [(found[n].lang_pred, found[n].score, found[n].rejected) for n in (2, 3, 7)] == [("und", 0.0, True)] * 3
    assert (found[8].lang_pred, found[1].lang_pred) == ("de", "en")
    scored = {r.doc_id: r for r in toxicity.score(docs, _model()).collect()}
    assert scored[2].score == scored[3].score and scored[2].passages == []
    counted = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokens.count(docs, public_tokenizers.path("word_bpe_49k.json")).collect()}
    assert counted[2] == counted[3] == (0, 0)


def test_near_duplicates_of_odd_texts(docs, empty):
    found = {r.doc_id: r.class_id for r in near_dups.classes(docs).collect()}
    # equal texts, null and empty ones too, are one class; a repeated id is one document; no id is no document
    assert found == {1: 1, 2: 2, 3: 2, 4: 1, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9}
    kept = near_dups.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 5, 6, 7, 8, 9, None]))
    assert near_dups.classes(empty).collect() == []
    spots = {r.doc_id: r.class_id for r in spotsigs.classes(docs).collect()}
    assert spots == {1: 1, 2: 2, 3: 2, 4: 1, 5: 5, 6: 6, 7: 2, 8: 8, 9: 9}


def test_leaks_in_odd_texts(docs, empty, items):
    found = decontaminate.contaminated(docs, items)
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(1, 1), (4, 1)]
    kept = decontaminate.decontaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [2, 3, 5, 6, 7, 8, 9, None]))
    assert decontaminate.contaminated(empty, items).collect() == []
    assert decontaminate.contaminated(docs, items.where("false")).collect() == []


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, None, "x"), (1, None, "x"), (2, "", "x"), (3, "no scheme.com/", "x"), (4, "http://A.Com/" + "a/" * 50_000, "x"), (None, "x://com/", "x"), (5, "x://", "x")],
        "page_id long, url string, host string",
    )
    rules = spark.createDataFrame([("com", "/", "block"), ("com", "/", "allow"), ("a.com", "/a/", "allow"), ("a.com", "/a/a/", "block")], "host string, path string, verdict string")
    found = [(r.page_id, r.host, r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()]
    assert sorted(found, key=str) == sorted([
        (1, "", None, "allow"), (1, "", None, "allow"), (2, "", None, "allow"), (3, "", None, "allow"),
        (4, "a.com", "a.com/a/a/", "block"), (None, "com", "com/", "block"), (5, "", None, "allow"),
    ], key=str)
    assert {r.verdict for r in url_filter.judge(pages, rules.where("false"), default="block").collect()} == {"block"}
    assert url_filter.judge(pages.where("false"), rules).collect() == []


def test_pipeline_on_odd_and_empty_tables(spark, docs, empty, items, tmp_path):
    for name, rows in (("odd", docs.select(*[f.name for f in empty.schema])), ("none", empty)):
        folder = f"{tmp_path}/{name}"
        rows.write.parquet(f"{folder}/documents.parquet")
        items.write.parquet(f"{folder}/benchmark.parquet")
        found = corpus_pipeline.run(spark, folder)
        assert found.columns == [*empty.columns, "size", "shard", "slot"]
        left = {r.doc_id for r in found.collect()}
        assert left <= {5, 6, 8, 9, None} and (name == "none") == (not left)
