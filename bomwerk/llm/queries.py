"""The corpus operators as queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from bomwerk.llm import decontaminate, filter_audit, langid, mixing, near_dups, pieces, pii, prefix_trie, sharding, spotsigs, tokens, toxicity, url_filter
from bomwerk.llm.tables import read
from bomwerk.session import tune

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
URL_RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)


def op1_spotsigs(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    docs = read(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = spotsigs.with_next(docs.withColumn("spots", spotsigs.signatures(F.col("text"))), ["text", "spots"])
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substr("next_text", F.lit(1), cut))
    rows = rows.select("doc_id", "n_chars", "spots", "next_spots", edited.alias("edited"))
    rows = rows.withColumn("edited_spots", spotsigs.signatures(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        spotsigs.written(F.col("spots")).alias("fingerprint"), spotsigs.written(F.col("edited_spots")).alias("edited_fingerprint"),
        spotsigs.jaccard(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        spotsigs.jaccard(F.col("spots"), F.col("next_spots")).alias("near_next"),
    )


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    docs = read(spark, folder, "documents").select("doc_id", "text", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    return sharding.assign(docs, shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in all documents."""
    rows = pii.find(read(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("found", lambda span: span["kind"] < 4)
    number = lambda kind: F.size(F.filter("found", lambda span: span["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id", *[number(n).alias(f"n_{kind.name}") for n, kind in enumerate(pii.KINDS[:4])],
        F.sha2(pii.written(base), 256).alias("base_sha256"), pii.written(F.col("found")).alias("spans"),
        F.array_join(F.transform("found", lambda span: F.format_number(span["score"], 2)), ",").alias("scores"),
    )


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """The benchmark items that documents contain."""
    return decontaminate.contaminated(read(spark, folder, "documents").select("doc_id", "text"), read(spark, folder, "benchmark"))


def op5_langid(spark: SparkSession, folder: str) -> DataFrame:
    """The language of all documents, learnt from two thirds of them."""
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang", langid.held_out(F.col("doc_id"), 3, 1).alias("held_out"))
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.classify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity of all documents, learnt from the labels of four fifths of them."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    labels = read(spark, folder, "labels").select("doc_id", "toxic").where(~langid.held_out(F.col("doc_id"), 5, 0))
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs.withColumn("held_out", langid.held_out(F.col("doc_id"), 5, 0)), model)
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def op7_near_dups(spark: SparkSession, folder: str) -> DataFrame:
    """The class of near-duplicates of every document."""
    return near_dups.classes(read(spark, folder, "documents").select("doc_id", "text"))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents mixed by source."""
    docs = read(spark, folder, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on every page's url."""
    values = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS rules(host, path, verdict)")
    return url_filter.judge(read(spark, folder, "pages").select("page_id", "url"), rules)


def op10_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of all documents."""
    import public_tokenizers

    docs = read(spark, folder, "documents").select("doc_id", "text")
    return tokens.count(docs, public_tokenizers.path(TOKENIZER)).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op11_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents and the texts that they decode to."""
    import public_tokenizers

    docs = read(spark, folder, "documents").select("doc_id", "text")
    return pieces.encode(docs, public_tokenizers.path(PIECES)).drop("text")


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What five filters remove from all documents in every order, by language."""
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang")
    return filter_audit.audited(docs, read(spark, folder, "labels")).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The trie of shared beginnings of all conversations."""
    return prefix_trie.trie(read(spark, folder, "conversations")).drop("enter", "leave")


URL_FILTER_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT row_number() OVER () AS row, page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path
  FROM parts
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
    ('net', '/es/', 'block'), ('net', '/fr/', 'block')
)
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(verdict, 'allow') AS verdict
FROM hosts LEFT JOIN rules
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
QUALIFY row_number() OVER (PARTITION BY row ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) = 1
"""

FILTER_AUDIT_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body FROM documents
), measured AS (
  SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words,
    min(doc_id) OVER (PARTITION BY body) AS first FROM texts
), failing AS (
  SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
    100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body) AS c,
    regexp_matches(body, '[#$%&*|]') AS d, coalesce(first < doc_id, false) AS e
  FROM measured
), marked AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), counts AS (
  SELECT part, a, b, c, d, e, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM failing LEFT JOIN marked USING (doc_id) GROUP BY ALL
), letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')), orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order
  FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), removals AS (
  SELECT counts.*, filter_order, least(
    CASE WHEN a THEN strpos(filter_order, 'A') ELSE 6 END, CASE WHEN b THEN strpos(filter_order, 'B') ELSE 6 END,
    CASE WHEN c THEN strpos(filter_order, 'C') ELSE 6 END, CASE WHEN d THEN strpos(filter_order, 'D') ELSE 6 END,
    CASE WHEN e THEN strpos(filter_order, 'E') ELSE 6 END) AS removal
  FROM counts, orders
), steps AS (
  SELECT *, substr(filter_order, step, 1) AS letter,
    CASE substr(filter_order, step, 1) WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS fails,
    a::INT + b::INT + c::INT + d::INT + e::INT AS n_fails
  FROM removals, range(1, 6) AS s(step)
), summed AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (removal > step), 0) AS kept, coalesce(sum(n) FILTER (removal = step), 0) AS removed,
    coalesce(sum(n) FILTER (fails AND removal < step), 0) AS redundant,
    coalesce(sum(n) FILTER (fails AND n_fails = 1), 0) AS unique_fails,
    coalesce(sum(good) FILTER (removal = step), 0) AS good_lost, coalesce(sum(toxic) FILTER (removal = step), 0) AS toxic_lost
  FROM steps GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM summed
"""

PREFIX_TRIE_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT n, 0 AS k, n AS c FROM range(256) AS r(n)
  UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc_table AS (
  SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), crcs AS (
  SELECT DISTINCT conv_id, conv_id::VARCHAR AS s, 0 AS k, 4294967295 AS c FROM turns
  UNION ALL
  SELECT conv_id, s, k + 1, xor(c >> 8, t[((xor(c, ascii(substr(s, k + 1, 1))) & 255) + 1)]) FROM crcs, crc_table WHERE k < length(s)
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(c, 4294967295) % 4 AS h, own
  FROM crcs JOIN (SELECT conv_id, max(pos) AS own FROM turns GROUP BY conv_id) USING (conv_id) WHERE k = length(s)
), rebuilt AS (
  SELECT c.conv_id, t.pos AS depth, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, t.pos - c.h + least(c.h, coalesce(b.own, 0)), t.role, t.text
  FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h LEFT JOIN convs b ON b.conv_id = c.base
), paths AS (
  SELECT conv_id, depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    string_agg(md5(md5(role) || md5(text)), '') OVER (PARTITION BY conv_id ORDER BY depth) AS path,
    depth = max(depth) OVER (PARTITION BY conv_id) AS ending
  FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM rebuilt) FROM convs
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ending), '')) AS ends_sha256
  FROM paths GROUP BY path, depth
), children AS (
  SELECT substr(path, 1, 32 * (depth - 1)) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), subtrees AS (
  SELECT substr(path, 1, 32 * d) AS path, count(*) FILTER (n_children IS NULL) AS n_leaves, sum(saved) AS saved_tokens
  FROM nodes LEFT JOIN children USING (path), range(0, depth + 1) AS r(d) GROUP BY 1
)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
  n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN subtrees USING (path) LEFT JOIN children USING (path)
  LEFT JOIN nodes u ON n.depth > 0 AND u.path = substr(n.path, 1, 32 * (n.depth - 1))
"""

_QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    op1_spotsigs, op2_sharding, op3_pii, op4_decontaminate, op5_langid, op6_toxicity, op7_near_dups, op8_mixing, op9_url_filter, op10_tokens,
    op11_pieces, op12_filter_audit, op13_prefix_trie,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: (lambda spark, folder, query=query: query(tune(spark), folder)) for query in _QUERIES
} | {"pipeline": corpus_pipeline.run}
ORACLE_SQL = {"op9_url_filter": URL_FILTER_SQL, "op12_filter_audit": FILTER_AUDIT_SQL, "op13_prefix_trie": PREFIX_TRIE_SQL}
