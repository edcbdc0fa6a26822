"""A corpus pipeline: quality rules, line dedup, near-duplicates, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage as a
Parquet table in the shared checkpoint folder and hands the reread table to the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import line_dedup, near_dedup, packing, quality_rules, secret_scan
from causeway.llm.common import prepare, store, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL has no tokenizer, decoding worklist or sketches; a brute-force version is in the tests.
ORACLE_SQL = None


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents; n_chars counts the text as it now is."""
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return docs.withColumn("n_chars", length).select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts go."""
    prepare(spark)
    return quality_rules.quality_rules(docs).filter("quality.kept").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; one that had nothing else goes."""
    left = line_dedup.dedup_lines(docs)
    return _documents(left.filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest id, of each group of near-duplicates (5 words, 0.8)."""
    found = near_dedup.near_duplicates(docs)
    return near_dedup.with_classes(docs, found, once=True).filter("kept").select(*COLUMNS)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found in any decoded layer replaced by a mark."""
    prepare(spark)
    return _documents(secret_scan.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens, with their ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", keep_good), ("line_dedup", drop_lines), ("near_dedup", drop_copies),
    ("secret_scan", hide_secrets), ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir))
    return docs
