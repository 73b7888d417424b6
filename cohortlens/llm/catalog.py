"""Queries of the training-data operators and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import filter_audit
from .byte_bpe import digests, encode_and_decode
from .chat_format import format_and_read
from .common import read_table
from .decontaminate import find_contamination
from .html_extract import extract_pages
from .jaccard_join import jaccard_join
from .mixing import mix_sources
from .quality_classifier import classify_quality
from .quality_rules import quality_rules
from .secret_scan import secret_scan
from .token_records import encode_and_read
from .toxicity import classify_toxicity
from .whitening import whiten


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read_table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7, whose texts hold the template's
    own control strings."""
    text = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)],
                                  "conv_id long, turn long, role string, text string")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return format_and_read(turns.unionByName(extra))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))


def word_tokenizer() -> str:
    """The public vocabulary file that the token queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_read(read_table(spark, sf_dir, "documents"), word_tokenizer())


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(read_table(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten(read_table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", rows.deviation.cast("long"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return digests(encode_and_decode(read_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``corpus_pipeline`` one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_jaccard_join, op2_chat_format, op3_quality_classifier, op4_decontaminate, op5_toxicity, op6_quality_rules,
        op7_html_extract, op8_token_records, op9_secret_scan, op10_mix_sources,
        op11_whitening, op12_filter_audit, op13_byte_bpe, pipeline)}


def oracle_sql() -> dict[str, str]:
    """The filter audit alone is within reach of one SQL statement over whole
    tables.  ``tests/llm`` says what holds each of the others: brute force,
    an exact round trip or held-out accuracy."""
    return {"op12_filter_audit": filter_audit.ORACLE_SQL}
