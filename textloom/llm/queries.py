"""The subpackage's queries: each applies an operator, with its production parameters, to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_at_exit, shared_dir, spread
from .decontamination import decontaminate
from .distinct_words import encode_decode
from .html_text import extract_pages
from .licenses import scan_licenses
from .merkle import merkle_manifest, proof_digest
from .near_duplicates import near_duplicates
from .oracle import ORACLE_SQL
from .pii import scan_pii
from .quality_classifier import score_quality, train
from .quality_rules import quality_rules
from .secrets import scan_secrets
from .sstable import read_token_shards, write_token_shards
from .tokenizing import token_counts
from .whitening import whiten


__all__ = ["ORACLE_SQL", "QUERIES"]


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file; callers of the operators pass any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table; one of fewer pieces than there are cores is dealt over them, a larger one isn't shuffled."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/token-shards-{uuid.uuid4().hex}"
    delete_at_exit(spark, folder)
    write_token_shards(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), folder)
    return read_token_shards(spark, folder)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents")).drop("redacted")


def op6_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_pii(table(spark, sf_dir, "documents")).drop("redacted")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels")))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle_manifest(docs, found={"text": tampered})
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_html_extraction, op3_token_counts, op4_token_shards, op5_secret_scan,
        op6_pii_scan, op7_near_duplicates, op8_bpe_round_trip, op9_quality_rules, op10_quality_classifier,
        op11_embedding_whitening, op12_merkle_manifest, op13_license_scan,
    )
}
