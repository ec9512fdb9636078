"""The queries of this package, by name, and their SQL for DuckDB where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.quality import judge

    return judge(read(spark, sf_dir, "documents"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.chat import format_chats, loss_text, parse_chats

    rows = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long"), "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(said).alias("text"))
    done = format_chats(rows.unionByName(extra)).select("conv_id", "formatted", "valid", "first_bad_turn", loss_text(F.col("segments")).alias("loss"), parse_chats(F.col("formatted")).alias("turns"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        F.col("first_bad_turn").cast("long").alias("first_bad_turn"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.lines import line_report

    return line_report(spark, read(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from granary.llm.tokens import token_counts

    return token_counts(spark, read(spark, sf_dir, "documents"), path("byte_bpe_50k.json"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from granary.llm.pieces import encode_documents

    return encode_documents(spark, read(spark, sf_dir, "documents"), path("piece_bpe_32k.model"), digests=True)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.warc import round_trip

    return round_trip(spark, read(spark, sf_dir, "pages"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.html import extract

    return extract(spark, read(spark, sf_dir, "pages"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.neardup import near_duplicates

    return near_duplicates(spark, read(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.passages import repeated_passages

    return repeated_passages(spark, read(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.decontaminate import find_leaks

    return find_leaks(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_line_dedup": op2_line_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_html_extraction": op4_html_extraction,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_warc": op10_warc,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from granary.llm import oracles

    return dict(oracles.SQL)
