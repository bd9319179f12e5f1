"""The queries of this subpackage, ``(spark, table folder) -> DataFrame``, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from heatlens.llm import (
    ego_join, exact_dedup, hard_negatives, language, lexicon_bpe, license_scan, near_dedup, packing, pii, prefix_trie,
    token_files, toxicity, url_filter,
)
from heatlens.llm.common import read_table
from heatlens.staging import small_table, staging_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op6_odd_sketch(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, folder, "documents"))


# Fixed rules of the URL query: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query
def op1_ego_join(spark: SparkSession, folder: str) -> DataFrame:
    return ego_join.near_vectors(read_table(spark, folder, "embeddings"), cosine=0.95)


@query
def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.duplicate_report(read_table(spark, folder, "documents"))


ORACLE["op2_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def _remainder(name: str, modulus: int):
    """crc32 of the id as text, modulo; null where the id is."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % modulus


@query
def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    held = F.coalesce(_remainder("doc_id", 4) == 2, F.lit(False))
    model = language.train(docs.filter(~held & F.col("lang").isNotNull()).select("doc_id", "text", "lang"))
    return language.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query
def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_spans(read_table(spark, folder, "documents"), "doc_id")
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(count, pii.BASE_KINDS)
    return found.select(
        "doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans")
    )


@query
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    held = F.coalesce(_remainder("doc_id", 5) == 0, F.lit(False))
    labels = read_table(spark, folder, "labels").filter(~held)
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = small_table(spark, URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(read_table(spark, folder, "pages"), rules)


ORACLE["op7_url_filter"] = f"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id,
         lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)) AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), rules(h, p, verdict) AS (VALUES {", ".join(map(str, URL_RULES))}),
fits AS (
  SELECT r, h || rules.p AS rule, verdict,
         row_number() OVER (PARTITION BY r ORDER BY length(h || rules.p) DESC, length(h) DESC) AS n
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, rules.p)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM p LEFT JOIN (SELECT * FROM fits WHERE n = 1) f ON p.r = f.r
"""


@query
def op8_lexicon_bpe(spark: SparkSession, folder: str) -> DataFrame:
    encoded = lexicon_bpe.encode(read_table(spark, folder, "documents"), WORD_BPE)
    return encoded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = staging_path(spark, "token-files")
    token_files.write_token_files(read_table(spark, folder, "documents"), path, BYTE_BPE, end_id=2)
    return token_files.read_token_files(spark, path).select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


@query
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(read_table(spark, folder, "documents"), BYTE_BPE, end_id=1, capacity=2048)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op11_diagonal_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = license_scan.scan(read_table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])

    def labels(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"), "score",
    )


@query
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_nodes(read_table(spark, folder, "conversations"))


# A turn's number is its rank; a node's path is the list of the numbers. crc32 by its table, from the polynomial.
ORACLE["op12_prefix_trie"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS print
  FROM conversations WHERE conv_id IS NOT NULL
), numbered AS (
  SELECT conv_id, dense_rank() OVER (ORDER BY role, text) AS id, length(text) AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, print) AS place
  FROM t
), own AS (
  SELECT conv_id, list(id ORDER BY place) AS ids, list(chars ORDER BY place) AS chars FROM numbered GROUP BY conv_id
), bits AS (
  SELECT list(v ORDER BY i) AS v FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))) AS v FROM range(256) r(i))
), kept AS (
  SELECT conv_id, ids, chars,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(str_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                         lambda x, y: xor(v[(xor(x, y) & 255) + 1], x >> 8)), 4294967295::BIGINT) % 6 AS h
  FROM own, bits
), rebuilt AS (
  SELECT k.conv_id, coalesce(a.ids[1:h], []) || k.ids[h + 1:] AS ids, coalesce(a.chars[1:h], []) || k.chars[h + 1:] AS chars
  FROM kept k LEFT JOIN own a ON a.conv_id = k.conv_id - k.conv_id % 100
), nodes AS (
  SELECT ids[1:d] AS path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars[d]) AS chars,
         string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(ids) = d) AS ends
  FROM rebuilt, unnest(range(len(ids) + 1)) r(d) GROUP BY 1, 2
), counted AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children
  FROM nodes n LEFT JOIN (SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1) c ON c.path = n.path
), totals AS (
  SELECT path[1:d] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
         sum((n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE chars END) AS saved_tokens
  FROM counted, unnest(range(depth + 1)) r(d) GROUP BY 1
)
SELECT c.conv_id, c.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children,
       n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(c.ends, '')) AS ends_sha256
FROM counted c JOIN totals USING (path) LEFT JOIN nodes p ON c.depth > 0 AND p.path = c.path[1:c.depth - 1]
"""


@query
def op13_residue_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read_table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)


ORACLE["op13_residue_negatives"] = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER w AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT same
  AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 3
"""
