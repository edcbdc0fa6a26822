"""The registered queries of this subpackage; ``queries()`` and ``oracle_sql()`` like the others'."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_bpe, chat_format, embedding_dedup, lexical_search, line_dedup, near_dedup, oracles, packing,
    personal_data, quality_rules, secret_scan, spelling, substring_dedup, toxicity,
)
from .common import table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    tricky = spark.createDataFrame(
        [(-7, 0, "user", text), (-7, 1, "assistant", text)],
        "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.format_chats(turns.unionByName(tricky)))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(
        table(spark, sf_dir, "documents"), plan=near_dedup.Sketch(shingle=2))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *[f"quality.{n}" for n in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept")])


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")


def _counts(spans: str, kinds: tuple[str, ...], kind_of: Callable[[Column], Column]) -> list[Column]:
    """Number of spans of every kind. A lambda of two parameters would get the position as second."""
    def of_kind(n: int) -> Column:
        return F.size(F.filter(spans, lambda s: kind_of(s) == n)).cast("long")

    return [of_kind(n).alias(f"n_{kind}") for n, kind in enumerate(kinds)]


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = _counts("secrets.base", secret_scan.KINDS, lambda kind: kind)
    return found.select("doc_id", *counts, F.sha2("secrets.base_text", 256).alias("base_sha256"),
                        F.col("secrets.spans_text").alias("spans"),
                        F.col("secrets.refused").alias("refused"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_embeddings(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_model(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return toxicity.score_toxicity(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal_data.spans(personal_data.extract(docs))
    counts = _counts("base", personal_data.KINDS, lambda s: s["kind"])
    return found.select("doc_id", *counts, F.sha2(personal_data.span_text("base"), 256).alias("base_sha256"),
                        personal_data.span_text("spans").alias("spans"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build_index(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lexical_search.search(index, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.group_variants(spelling.count_words(docs, noise=31))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_chat_formatting, op2_substring_dedup, op3_packing, op4_near_dedup,
        op5_quality_rules, op6_byte_bpe, op7_line_dedup, op8_secret_scan,
        op9_embedding_dedup, op10_toxicity, op11_personal_data,
        op12_lexical_search, op13_spelling_variants)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(oracles.TEXTS)
