"""A corpus pipeline: documents in, token ids of clean and distinct documents out.

Each stage is written as Parquet to the shared folder and reread as the next one's documents. Stages keep columns of any
name but take doc_id and text. Null and empty texts go with the first stage; an empty table stays empty; repeated rows, ties and
very long texts are treated as each operator says: no stage drops a text for its length or reads a part of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import Scratch, broadcast_if_small, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that the rule table rejects, null and empty texts among them."""
    from granary.llm.quality import keep_good

    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes recurring lines out of the texts and leaves out documents that had nothing else; n_chars follows the text."""
    from granary.llm.lines import clean_lines

    out = clean_lines(spark, docs, leave_out_emptied=True)
    changed = F.col("__lines.dropped") > 0
    columns = [F.when(changed, F.length("text").cast(dict(docs.dtypes)[c])).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near duplicates, and documents without an id."""
    from granary.llm.neardup import SMALL, near_duplicates

    gone = Scratch(spark).table(near_duplicates(spark, docs).where("NOT kept").select("doc_id").distinct(), "gone")
    return docs.join(broadcast_if_small(gone, SMALL), "doc_id", "left_anti").select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold an item of the benchmark."""
    from granary.llm.decontaminate import drop_leaks

    return drop_leaks(spark, docs, read(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the token ids of each document."""
    from public_tokenizers import path

    from granary.llm.pieces import encode_documents

    return encode_documents(spark, docs, path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

#: SQL cannot express the stages from line_dedup on; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = read(spark, sf_dir, "documents"), Scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        last = scratch.table(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
        docs = last
    return docs
