"""Registered queries of this subpackage, with checking SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from papersieve.llm import (
    ann,
    compression,
    conversations,
    huffman,
    langid,
    packing,
    periodic,
    quality,
    sharding,
    simhash,
    suffix,
    warc,
    wfst,
)
from papersieve.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# File names of the public tokenizers that the queries use.
TOKENIZER = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document, lengths in words."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    documents = table(spark, sf_dir, "documents")
    return langid.predict(documents, langid.fit(documents))


@query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document."""
    documents = table(spark, sf_dir, "documents")
    return sharding.place(documents.select("doc_id"), "doc_id")


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    return quality.assess(table(spark, sf_dir, "documents"))


ORACLES["op5_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
win AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i:i + 4]) AS c
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)),
rep AS (
  SELECT rid, count(DISTINCT i + k) AS n
  FROM (SELECT rid, i FROM win WHERE c > 1), range(0, 5) AS r(k) GROUP BY rid),
f AS (
  SELECT d.doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines,
         coalesce(rep.n, 0) AS n_repeat_words,
         len(regexp_extract_all(t, '[A-Z]')) AS caps, len(regexp_extract_all(t, '[A-Za-z]')) AS letters,
         len(regexp_extract_all(t, '!')) AS excl
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d) d
  LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * caps > 50 * letters
            OR 100 * n_dup_lines > 50 * n_lines OR 100 * excl > 30 * n_words
            OR word_chars NOT BETWEEN 2 * n_words AND 30 * n_words) AS kept
FROM b
"""


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.digest(table(spark, sf_dir, "documents"))


@query
def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document's ids, read back from Huffman-coded files."""
    import public_tokenizers

    with open(public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
        model_json = f.read()
    return huffman.round_trip(table(spark, sf_dir, "documents"), model_json)


@query
def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"))


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every page's capture, read back from the archives."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


ORACLES["op6_warc"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_page FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_page <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_page <> page_id THEN first_page END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


@query
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the digest of what they decode to."""
    import public_tokenizers

    with open(public_tokenizers.path(PIECE_MODEL), "rb") as f:
        model = f.read()
    return wfst.encode(table(spark, sf_dir, "documents"), model)


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated passages."""
    return suffix.digest(table(spark, sf_dir, "documents"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document with planted repetitions, and the text without them."""
    return periodic.digest(table(spark, sf_dir, "documents"))


@query
def op12_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by compressed sizes."""
    documents = table(spark, sf_dir, "documents")
    return compression.score(documents, compression.fit(documents, table(spark, sf_dir, "labels")))


@query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of rebuilt conversations."""
    return conversations.digest(table(spark, sf_dir, "conversations"))


# DuckDB has no crc32: the remainder by four comes from one step of the bitwise division
# per bit, over the decimal digits of the id.
ORACLES["op13_conversation_trie"] = """
WITH RECURSIVE ids AS (
  SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT c, CAST(4294967295 AS BIGINT) AS r, 0 AS step, CAST(c AS VARCHAR) AS s FROM ids
  UNION ALL
  SELECT c,
         CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END,
         step + 1, s
  FROM (SELECT c, step, s, CASE WHEN step % 8 = 0 THEN xor(r, ascii(s[step // 8 + 1])) ELSE r END AS x
        FROM crc WHERE step < 8 * length(s))),
h AS (SELECT c, xor(r, CAST(4294967295 AS BIGINT)) % 4 AS h FROM crc WHERE step = 8 * length(s)),
t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS k
  FROM conversations WHERE conv_id IS NOT NULL),
parts AS (
  SELECT h.c, 0 AS part, t.k, t.role, t.text FROM h JOIN t ON t.c = h.c - h.c % 20 AND t.k < h.h
  UNION ALL
  SELECT h.c, 1, t.k, t.role, t.text FROM h JOIN t ON t.c = h.c AND t.k >= h.h),
placed AS (
  SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY part, k) AS d FROM parts),
prefixes AS (
  SELECT c, d, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words,
         list({'role': role, 'text': text}) OVER (PARTITION BY c ORDER BY d) AS p
  FROM placed
  UNION ALL
  SELECT c, 0, 0, CAST([] AS STRUCT("role" VARCHAR, "text" VARCHAR)[]) FROM h),
lengths AS (SELECT c, max(d) AS n FROM prefixes GROUP BY c),
nodes AS (
  SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = n), '') AS ends
  FROM prefixes JOIN lengths USING (c) GROUP BY d, p),
numbered AS (SELECT *, row_number() OVER () AS id FROM nodes),
linked AS (
  SELECT v.*, u.id AS parent, u.conv_id AS parent_conv_id
  FROM numbered v LEFT JOIN numbered u ON v.d = u.d + 1 AND v.p[1:v.d - 1] = u.p),
kids AS (SELECT parent AS id, count(*) AS n FROM linked WHERE parent IS NOT NULL GROUP BY 1),
up AS (
  SELECT id AS node, id AS anc FROM linked
  UNION ALL
  SELECT up.node, l.parent FROM up JOIN linked l ON l.id = up.anc WHERE l.parent IS NOT NULL),
sums AS (
  SELECT anc AS id, sum((l.n_convs - 1) * l.words) AS saved, count(*) FILTER (WHERE kids.id IS NULL) AS leaves
  FROM up JOIN linked l ON l.id = up.node LEFT JOIN kids ON kids.id = l.id GROUP BY anc)
SELECT conv_id, CAST(d AS BIGINT) AS depth, parent_conv_id, n_convs, coalesce(kids.n, 0) AS n_children,
       leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM linked JOIN sums USING (id) LEFT JOIN kids USING (id)
"""
