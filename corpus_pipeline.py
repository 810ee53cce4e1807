"""From raw documents to token ids: quality rules, near-duplicates, decontamination, secrets, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame; all but the last return the
columns of ``documents``. Verdicts are on rows, so a rejected row never takes others with it that share its identifier; rows that are equal in all columns
have one verdict, and the near-duplicate stage keeps one of them.

A null or empty text is rejected by the first stage, which asks for 50 words; handed to a later one, it is near to no other, holds no benchmark window and no secret, and encodes to no ids. Rows with a null identifier or source
are rows like any other. Every stage gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import materialize
from textloom.llm.decontamination import decontaminate
from textloom.llm.distinct_words import encode_decode
from textloom.llm.near_duplicates import near_duplicates
from textloom.llm.quality_rules import quality_rules
from textloom.llm.queries import tokenizer_path
from textloom.llm.secrets import scan_secrets

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, an identifier of the whole row: ordered by ``doc_id`` with null last, then by a digest of all columns."""
    parts = [p for c in COLUMNS for p in (F.col(c).isNull(), F.col(c))]
    return docs.select(*COLUMNS, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(*parts).alias("h"), F.hash(*parts).alias("g")).alias("_row"))


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` less the rows in ``rejected``; Spark broadcasts those only if they are below its size limit."""
    gone = rejected.select(F.col("_row").alias("_gone")).distinct()
    return docs.join(gone, docs["_row"] == gone["_gone"], "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that are frequent on their host."""
    out = quality_rules(docs, cleaned=True, keep=("lang", "source")).where("kept")
    return out.select("doc_id", F.col("cleaned").alias("text"), "lang", "source", F.length("cleaned").cast("long").alias("n_chars"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the least identifier."""
    docs = _with_rows(docs)
    return _without(docs, near_duplicates(docs, id_col="_row").where(~F.col("kept"))).dropDuplicates(["_row"]).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    docs = _with_rows(docs)
    return _without(docs, decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_row").where("contaminated")).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by the kind of secret."""
    out = scan_secrets(docs, keep=("lang", "source"))
    return out.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of decoded texts."""
    return encode_decode(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", deduplicate),
    ("decontamination", decontaminated),
    ("secret_scan", redact_secrets),
    ("bpe_round_trip", encode),
]

#: SQL expresses neither signatures nor tokenizers; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
