"""Transcripts, forms and timed items out of plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colloquy.schema import ENDING_PUNCT, MOR_PUNCT, PUNCT, REGULAR

#: A word or one punctuation mark.
TOKEN = r"[\p{L}\p{N}']+|[.,!?]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, line_no, tier, text``: a conversation is a transcript, a turn an utterance, a role a tier."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("line_no"), F.col("role").alias("tier"), "text")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


def token_type(text: Column) -> Column:
    return F.when(text.isin(ENDING_PUNCT + MOR_PUNCT), PUNCT).otherwise(REGULAR)


def forms(lines: DataFrame) -> DataFrame:
    """``doc_id, line_no, tier, form_no, text, type``: one row per token, numbered from 0."""
    return lines.select("doc_id", "line_no", "tier", F.posexplode(tokens(F.col("text"))).alias("form_no", "text")).withColumns({"form_no": F.col("form_no").cast("bigint"), "type": token_type(F.col("text"))})


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, item_no, tier, start_ms, end_ms``: events as timed items of one document per user; times in whole
    milliseconds since 2024, independent of the session's time zone."""
    ms = "datediff(CAST(ts AS date), DATE'2024-01-01') * 86400000L + hour(ts) * 3600000L + minute(ts) * 60000L + CAST(extract(SECOND FROM ts) * 1000 AS bigint)"
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("item_no"), F.col("event_type").alias("tier"), F.expr(ms).alias("start_ms"), "value")
    return e.select("doc_id", "item_no", "tier", "start_ms", (F.col("start_ms") + F.floor(F.col("value") * 60000)).cast("bigint").alias("end_ms"))
