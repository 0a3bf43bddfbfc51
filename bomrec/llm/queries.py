"""One query for each operator, over its whole table, and its SQL check where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomrec.llm import (
    alignment, decontaminate, exact_dedup, jaccard, language, mixing, quality, secrets, sharding, simhash, token_counts, variants, warc,
)
from bomrec.llm.common import document_table, kept, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(key: str, check: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if check is not None:
            CHECKS[key] = check
        return fn

    return register


@query("op1_code_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = document_table(spark, sf_dir)
    learned = docs.where(~language.held_out(F.col("doc_id"))).select("text", "lang")
    told = language.identify(docs.select("doc_id", "text"), learned)
    return told.select(
        "doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous"
    )


@query("op2_ngram_jaccard_join")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = jaccard.ngram_jaccard_join(document_table(spark, sf_dir))
    return rows.select("doc_id", "n_shingles", "component_id", "n_links")


@query("op3_interleaved_shards")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = document_table(spark, sf_dir)
    text = F.col("text").cast("binary")
    thin = docs.select(
        "doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("").cast("binary"))).alias("text_crc32"),
    )
    placed = sharding.interleaved_shards(thin, shards=24, text_col="text_crc32")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query(
    "op4_exact_dedup",
    r"""
    WITH d AS (
      SELECT doc_id, length(coalesce(text, '')) AS n_chars,
             sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
      FROM documents),
    w AS (
      SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size
      FROM d)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(document_table(spark, sf_dir))


@query("op5_token_rollups")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: all documents come in, those labelled toxic go, and those labelled of low
    quality are counted anew with runs of white space as one space. The last batch is delivered twice."""
    version = F.lit("byte_bpe_50k").alias("tokenizer")
    docs = document_table(spark, sf_dir)
    labels = document_table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    counted = token_counts.count_tokens(docs.select("doc_id", "source", "lang", "text"), "text", "tokens")
    squeezed = F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")
    again = token_counts.count_tokens(counted.withColumn("text", F.when(squeezed != F.col("text"), squeezed)), "text", "again")
    new = F.when(F.col("text").isNull(), F.col("tokens")).otherwise(F.col("again"))
    counted = kept(again.select("doc_id", "source", "lang", "tokens", new.alias("squeezed_tokens"), version))
    toxic = counted.join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    poor = counted.join(labels.where("quality = 0 AND NOT toxic <=> 1").select("doc_id"), "doc_id", "left_semi")
    revised = poor.withColumnsRenamed({"tokens": "old_tokens", "squeezed_tokens": "tokens"})
    rollup = token_counts.Rollup(spark, f"{shared_dir(spark)}/bomrec-rollup-{uuid.uuid4().hex}")
    rollup.apply("insert-all", token_counts.inserted(counted))
    rollup.apply("delete-toxic", token_counts.deleted(toxic))
    for _ in range(2):
        rollup.apply("recount-poor", token_counts.revised(revised))
    return rollup.totals()


@query(
    "op6_warc_round_trip",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
    w AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
    SELECT page_id, octet_length(encode(payload)) AS payload_bytes,
           array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
             ((('0x' || substr(h, CAST((5 * i) // 4 + 1 AS INT), 2))::INT >> CAST(3 - (5 * i) % 4 AS INT)) & 31) + 1 AS INT), 1)), '')
             AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to
    FROM w
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(document_table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    records = warc.read_archives(archives, with_payload=False)
    key = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(.*)>$", 1), F.lit("")).cast("long")
    return records.select(
        key("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", key("refers_to").alias("refers_to")
    )


@query(
    "op7_winnowed_decontamination",
    r"""
    WITH dw AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    bw AS (
      SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    bp AS (
      SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0),
    b AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM bp),
    dp AS (
      SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
      FROM dw, (SELECT DISTINCT k FROM b) ks WHERE len(w) >= k),
    d AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM dp),
    hits AS (SELECT d.doc_id, d.i, d.k, b.item_id FROM d JOIN b ON b.k = d.k AND b.win = d.win),
    pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hits),
    n AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
    its AS (
      SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN its USING (doc_id)
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(document_table(spark, sf_dir), document_table(spark, sf_dir, "benchmark"))


@query("op8_automaton_secret_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(document_table(spark, sf_dir))
    return found.select(
        "doc_id", *[F.col("n")[k].alias(f"n_{k}") for k in ("assign", "access", "hex")], "base_sha256",
        F.col("spans_text").alias("spans"),
    )


@query("op9_random_index_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = document_table(spark, sf_dir)
    labels = document_table(spark, sf_dir, "labels").where(~quality.held_out(F.col("doc_id"))).select("doc_id", "quality")
    scored = quality.score_quality(docs.select("doc_id", "text"), labels)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op10_entropy_mix")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = document_table(spark, sf_dir)
    sized = kept(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("n_words")))
    mixed = mixing.entropy_mix(sized, size_col="n_words")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


@query("op11_bk_tree_simhash")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(document_table(spark, sf_dir))


@query("op12_tokenizer_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = alignment.align(document_table(spark, sf_dir))
    return rows


@query("op13_spelling_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(document_table(spark, sf_dir))
