"""The registered query of each operator: production parameters over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import byte_bpe, embedding_dedup, fill_middle, html_text, license_scan, mixing, personal_data, quality_model, quality_rules, simhash, source_audit, token_files, url_filter
from threadloom.llm.common import load, shared_dir
from threadloom.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]
WORD_VOCAB = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
BYTE_VOCAB = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Digests of each document's ids and of the bytes decoded from them."""
    ids = byte_bpe.encode(docs, BYTE_VOCAB, public_tokenizers.PATTERN)
    both = byte_bpe.decode(ids, BYTE_VOCAB, public_tokenizers.PATTERN)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(load(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(load(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.main_text(load(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


#: Host, path and verdict; a rule holds for its host and all subdomains.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(load(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write(load(spark, sf_dir, "documents"), path, WORD_VOCAB, END_ID)
    return token_files.checksums(token_files.read(spark, path, WORD_VOCAB))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    vectors, network = quality_model.train(docs, load(spark, sf_dir, "labels"))
    found = quality_model.scores(docs, vectors, network)
    return found.select("doc_id", quality_model.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(load(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(load(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(load(spark, sf_dir, "embeddings"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(load(spark, sf_dir, "documents"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find(load(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(personal_data.listed(base).cast("binary"), 256).alias("base_sha256"), personal_data.listed(F.col("spans")).alias("spans"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle.transformed(load(spark, sf_dir, "documents"))
    digests = [F.sha2(c.cast("binary"), 256) for c in (F.col("output"), fill_middle.restored(F.col("form"), F.col("output")))]
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digests[0].alias("output_sha256"), digests[1].alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_license_scan": op2_license_scan,
    "op3_html_text": op3_html_text,
    "op4_url_filter": op4_url_filter,
    "op5_token_files": op5_token_files,
    "op6_quality_model": op6_quality_model,
    "op7_simhash": op7_simhash,
    "op8_mixing": op8_mixing,
    "op9_quality_rules": op9_quality_rules,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_source_audit": op11_source_audit,
    "op12_personal_data": op12_personal_data,
    "op13_fill_middle": op13_fill_middle,
}
