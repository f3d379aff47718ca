"""Queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, line_dedup, ngram_join, quality_rules, source_mix, suffix_dedup, token_store, toxicity, url_filter
from .common import table


def vocabulary(name: str) -> str:
    """Where the public tokenizers' files are on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.evaluate(url_filter.captures_of(pages), url_filter.list_of(pages))


def learnable(ident: str = "doc_id") -> Column:
    """Rows that the toxicity query may learn from; the rest is held out."""
    return F.crc32(F.col(ident).cast("string").cast("binary")) % 3 != 1


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(learnable()))
    rows = toxicity.score(docs, model, into="t")
    held_out, said = F.coalesce(~learnable(), F.lit(False)), F.col("t.score")
    return rows.select("doc_id", held_out.alias("held_out"), said.alias("score"), (said >= 0.7).cast("int").alias("predicted"), F.col("t.threshold").alias("lang_threshold"), F.col("t.toxic").cast("int").alias("lang_predicted"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.quality(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *quality_rules.BASE, "base_failed", "kept")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern, said = vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat_format.read_back(chat_format.format_chats(turns, path, pattern), path, pattern)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op6_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup(table(spark, sf_dir, "documents"), words=line_dedup.PASSAGE)
    return rows.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_store(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_classes(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filter, op2_toxicity, op3_suffix_dedup, op4_quality_rules, op5_chat_format, op6_line_dedup, op6_passage_dedup, op7_token_store, op8_decontaminate, op9_source_mix, op10_ngram_join)}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": url_filter.DUCKDB_SQL, "op4_quality_rules": quality_rules.duckdb_sql(), "op6_line_dedup": line_dedup.DUCKDB_SQL, "op6_passage_dedup": line_dedup.PASSAGE_SQL}
