"""The queries opN_<name>: each operator with production parameters over its whole table.

A query only names the table and turns the operator's outputs into the digest columns it returns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.llm import (
    alignment,
    decontaminate,
    language,
    licenses,
    manifest,
    mixing,
    sentence_pieces,
    simhash,
    substrings,
    token_counts,
    topk,
    toxicity,
    urls,
)
from notemill.llm.tables import load
from notemill.llm.toxicity import held_out

TOKEN_LIMIT = 512

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL["op1_mix_sources"] = mixing.MIX_SQL


@query
def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(load(spark, sf_dir, "embeddings"))


SQL["op2_top_k"] = topk.TOP_K_SQL


@query
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.dedup_substrings(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source, language, and 64 documents a folder.

    Every eighth document is the licence file of its folder, every 64th that of its language and every
    512th that of its source.
    """
    up = lambda n: F.col("doc_id") % n == 0
    folder = (
        F.when(up(512), F.col("source"))
        .when(up(64), F.concat_ws("/", "source", "lang"))
        .otherwise(F.concat_ws("/", F.col("source"), F.col("lang"), F.expr("doc_id DIV 64")))
    )
    name = F.when(up(8), F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = load(spark, sf_dir, "documents").select("doc_id", "text", F.concat(folder, F.lit("/"), name).alias("path"))
    return licenses.scan_licenses(files)


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


@query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs)
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score"
    )


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    counts = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.contamination(docs, load(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["stop"] - s["start"]))
    return marked.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@query
def op11_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    aligned = alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    side = lambda g, name: F.array_join(g[name].cast("array<string>"), ",")
    written = F.array_join(F.transform("groups", lambda g: F.concat(side(g, "a"), F.lit("|"), side(g, "b"))), ";")
    return aligned.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
        F.when(F.col("n_a") > 0, F.sha2(written, 256)).otherwise(F.lit("")).alias("groups_sha256"),
    )


@query
def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = sentence_pieces.decode(sentence_pieces.encode(docs, model), model)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = manifest.manifest(load(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("proof")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


SQL["op13_merkle_manifest"] = manifest.MANIFEST_SQL

SQL["op4_substring_dedup"] = r"""
WITH words AS (
  SELECT row_number() OVER () AS doc, doc_id, COALESCE(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
windows AS (
  SELECT doc, doc_id, pos, array_to_string(w[pos:pos + 12], ' ') AS body
  FROM words, unnest(range(1, len(w) - 11)) AS r(pos) WHERE len(w) >= 13),
firsts AS (SELECT body, min(doc_id) AS least FROM windows GROUP BY body),
hits AS (
  SELECT DISTINCT doc, pos + k AS pos
  FROM windows JOIN firsts USING (body), unnest(range(0, 13)) AS o(k)
  WHERE least < doc_id OR (doc_id IS NULL AND least IS NOT NULL)),
per_doc AS (SELECT doc, list(pos) AS gone FROM hits GROUP BY doc)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(COALESCE(gone, [])) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(COALESCE(gone, []), i)), ' ')) AS kept_sha256
FROM words LEFT JOIN per_doc USING (doc)
"""

SQL["op10_decontaminate"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, doc_id, COALESCE(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
phrases AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[pos:pos + least(10, len(w)) - 1], ' ') AS body
  FROM items, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS r(pos) WHERE len(w) > 0),
hits AS (
  SELECT doc, pos, p.size, p.item_id
  FROM docs, (SELECT DISTINCT size FROM phrases) s, unnest(range(1, len(w) - s.size + 2)) AS r(pos)
  JOIN phrases p ON p.size = s.size AND p.body = array_to_string(w[pos:pos + s.size - 1], ' ')),
counts AS (
  SELECT doc, count(DISTINCT pos + k) AS n_hit
  FROM hits, unnest(range(0, size)) AS o(k) GROUP BY doc),
found AS (
  SELECT doc, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM hits GROUP BY doc)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(COALESCE(n_items, 0) AS BIGINT) AS n_items, sha256(COALESCE(ids, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN counts USING (doc) LEFT JOIN found USING (doc)
"""
