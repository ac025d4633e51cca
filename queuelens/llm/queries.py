"""Registered queries of the training-data operators and their DuckDB SQL (None: SQL cannot express the method)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (htmltext, langid, licences, merkle, mixing, neighbours, packing, perplexity, simhash, tokenfile,
               urlfilter, warc, whitening)
from .common import read_table


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors.where("vec_id % 20 = 0"), vectors, k=20).withColumnRenamed("id", "vec_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicate_classes(docs, shingle=4, budget=4).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def tokenizer_path() -> str:
    """The byte-level vocabulary file of the public tokenizers package (installed on every node)."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    files = tokenfile.read_tokens(spark, tokenfile.write_tokens(docs, tokenizer_path(), end_id=2))
    return tokenfile.starts(tokenfile.checksums(files), files).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmltext.extract(pages, htmltext.fit(), keep=False).select(
        "row.page_id", "row.url", "text", F.length("text").cast("bigint").alias("n_chars"))


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
             ("org", "/fr/", "allow")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = """
WITH rules AS (
  SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
                        ('org', '/fr/', 'allow')) r(rule_host, rule_path, rule_verdict)
), rest AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM rest
), parsed AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts
), fits AS (
  SELECT page_id, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS place
  FROM parsed JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM parsed LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (page_id)
"""


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    tables = langid.fit(docs, ~held_out())
    return langid.identify(docs, tables, keep=False).select(
        F.col("row.doc_id").alias("doc_id"), held_out("row.doc_id").alias("held_out"), "lang_pred", "score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces, assignment = packing.packed(docs, tokenizer_path(), end_id=1, length=2048)
    return packing.checksums(pieces).join(assignment, "piece_id").select(
        F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.by_document(docs, licences.Classifier.fit(docs)).withColumnRenamed("id", "doc_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return mixing.replicated(docs).select(
        "row.doc_id", "row.source", "copy", "shuffle_key", F.md5(F.col("row.text").cast("binary")).alias("text_md5"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return perplexity.judged(docs, keep=False).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "lang", "perplexity")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.read(spark, warc.write(pages)).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    return merkle.audited(docs).select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"),
                                       "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whiten(vectors, most=16).withColumnRenamed("id", "vec_id")


QUERIES = {
    "op1_neighbours": (op1_neighbours, None),
    "op2_simhash": (op2_simhash, None),
    "op3_token_files": (op3_token_files, None),
    "op4_main_text": (op4_main_text, None),
    "op5_url_filter": (op5_url_filter, OP5_SQL),
    "op6_language": (op6_language, None),
    "op7_packing": (op7_packing, None),
    "op8_licences": (op8_licences, None),
    "op9_mixing": (op9_mixing, mixing.SQL),
    "op10_quality": (op10_quality, None),
    "op11_warc": (op11_warc, warc.SQL),
    "op12_manifest": (op12_manifest, merkle.SQL),
    "op13_whitening": (op13_whitening, None),
}
