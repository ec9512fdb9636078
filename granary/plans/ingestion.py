"""From pages to search chunks.

The strategy says how pages become paragraphs: "advanced" works on lines with positions, anything else on the page's
own paragraphs. Both give (document_id, page, position, text) over the whole document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import textnorm
from granary.functions.scalars import chunk_date
from granary.operators import neighbours, paragraphs


def paragraphs_of_lines(lines: DataFrame, language: str, header_patterns: list[str] = (), header_prefixes: list[str] = (), typos: list[tuple[str, str]] = (), qa_prefixes: list[str] = ()) -> DataFrame:
    """lines: document_id, page_num, line_num, text, x_start, x_end and the page's prose margins."""
    text = textnorm.normalize(F.col("text"), language, list(typos))
    clean = lines.withColumn("text", textnorm.strip_headers(text, list(header_prefixes)))
    tagged = paragraphs.classify_lines(clean, language, list(header_patterns), list(qa_prefixes))
    typed = paragraphs.document_paragraphs(paragraphs.page_paragraphs(tagged), language)
    return typed.select("document_id", "page", "position", "type", "text")


def paragraphs_of_texts(texts: DataFrame, language: str, header_patterns: list[str] = (), header_prefixes: list[str] = (), typos: list[tuple[str, str]] = ()) -> DataFrame:
    """texts: document_id, page_num, position, text; headers and footers go, sentences run on, questions get their answers."""
    code = "gu" if language == "gu" else "hi"
    text = textnorm.strip_headers(textnorm.normalize(F.col("text"), code, list(typos)), list(header_prefixes))
    clean = texts.withColumn("text", text).where(~textnorm.is_running_head(F.col("text"), F.col("position"), list(header_patterns))).where("text <> ''")
    prefixes = textnorm.STOP_PREFIXES[code] + textnorm.ANSWER_PREFIXES[code]
    runs = neighbours.merge_sentences(clean, "document_id", ["page_num", "position"], "text", "page_num", prefixes, textnorm.PUNCTUATION_ENDS[code])
    rows = runs.select("document_id", F.col("page_num").alias("page"), F.col("island").cast("int").alias("position"), "text")
    return paragraphs.dialogue_blocks(rows, code)


def generate(pages: DataFrame, language: str, strategy: str = "advanced", **settings) -> DataFrame:
    if strategy == "advanced":
        return paragraphs_of_lines(pages, language, **settings)
    return paragraphs_of_texts(pages, language, **settings)


def chunks(paras: DataFrame, files: DataFrame, pages: DataFrame, embed=None) -> DataFrame:
    """Search chunks. files: document_id, original_filename, language, metadata; pages: document_id, page, pravachan_no, date."""
    placed = neighbours.ordinals(paras.where(F.trim("text") != ""), "document_id", ["page", "position"], "para_ord")
    joined = placed.join(files, "document_id").join(pages, ["document_id", "page"], "left")
    second = F.col("language") == "gu"
    out = joined.select(
        F.concat_ws("_", "document_id", F.concat(F.lit("p"), F.col("page")), F.concat(F.lit("para"), F.col("para_ord"))).alias("chunk_id"),
        "document_id", "original_filename", F.col("page").alias("page_number"), F.col("para_ord").cast("string").alias("paragraph_id"), "para_ord", "language", "metadata",
        F.when(~second, F.col("text")).alias("text_content_hindi"), F.when(second, F.col("text")).alias("text_content_gujarati"),
        F.col("pravachan_no").alias("pravachan_number"), chunk_date(F.col("date")).alias("date"), F.current_timestamp().alias("timestamp_indexed"), F.col("text").alias("__text"),
    )
    if embed is not None:
        out = out.withColumn("vector_embedding", embed("__text"))
    return out.drop("__text")
