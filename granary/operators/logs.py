"""Query-log parsing and analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.scalars import is_private_ip

FIELDS = ("timestamp", "client_ip", "query", "search_type", "exact_match", "categories", "language", "enable_reranking", "page_size", "page_number", "latency_ms", "total_results")


#: The columns of an exported log, in order.
EXPORT = (
    "timestamp", "date", "hour", "day_of_week", "client_ip", "country", "country_code", "region", "city", "latitude", "longitude",
    "query", "search_type", "exact_match", "categories", "language", "enable_reranking", "page_size", "page_number", "latency_ms", "total_results", "has_results",
)


def write_csv(records: DataFrame, path: str) -> None:
    """Records with their time parts as CSV with a header, in the fixed columns; those that records lack are empty."""
    rows = with_time_parts(records)
    rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in EXPORT]).write.mode("overwrite").option("header", True).csv(path)


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """Typed records of the log lines; lines with too few fields, a bad time or a bad number are left out."""
    f = F.split(F.col(column), ",")
    at = lambda k: F.trim(F.get(f, F.lit(k)))
    flag = lambda k: F.lower(at(k)) == "true"
    out = lines.where(F.size(f) >= len(FIELDS)).select(
        F.try_to_timestamp(at(0), F.lit("yyyy-MM-dd HH:mm:ss")).alias("timestamp"), at(1).alias("client_ip"), at(2).alias("query"), at(3).alias("search_type"),
        flag(4).alias("exact_match"), at(5).alias("categories"), at(6).alias("language"), flag(7).alias("enable_reranking"),
        at(8).try_cast("int").alias("page_size"), at(9).try_cast("int").alias("page_number"), at(10).try_cast("double").alias("latency_ms"), at(11).try_cast("int").alias("total_results"),
    )
    return out.dropna(subset=["timestamp", "page_size", "page_number", "latency_ms", "total_results"])


def with_time_parts(records: DataFrame) -> DataFrame:
    t = F.col("timestamp")
    return records.withColumns({"hour": F.hour(t), "day_of_week": F.date_format(t, "EEEE"), "date": F.to_date(t), "has_results": F.col("total_results") > 0})


def summary(records: DataFrame) -> DataFrame:
    """One row of totals over all records."""
    share = lambda c: F.round(100 * F.count_if(c) / F.count("*"), 4)
    lexical, vector, none = F.col("search_type") == "lexical", F.col("search_type") == "vector", F.col("total_results") == 0
    return records.agg(
        F.count("*").alias("total"), F.count_if(lexical).alias("lexical"), F.count_if(vector).alias("vector"), F.count_if(none).alias("zero_results"),
        share(lexical).alias("lexical_pct"), share(vector).alias("vector_pct"), share(none).alias("zero_pct"),
        F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"), F.round(F.avg("total_results"), 6).alias("avg_results"),
        F.count_distinct("client_ip").alias("unique_ips"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"),
    )


def located(records: DataFrame, places: DataFrame) -> DataFrame:
    """Adds the place of each address from a dimension table; own addresses are Local, unknown ones Unknown."""
    joined = records.join(places, "client_ip", "left")
    return joined.withColumn("country", F.when(is_private_ip(F.col("client_ip")), "Local").otherwise(F.coalesce("country", F.lit("Unknown"))))


def log_texts(lines: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """What a log says was stripped, or else matched, if its length lies between the bounds."""
    text = F.coalesce(*[F.nullif(F.regexp_extract(column, p, 1), F.lit("")) for p in ("Stripped: '(.*)'", "matched: '(.*)'")])
    return lines.select(text.alias("text")).where(F.length("text").between(low, high))


def small(text: Column, min_words: int, min_chars: int) -> Column:
    """Under either bound."""
    return (F.size(F.array_remove(F.split(text, r"\s+"), "")) < min_words) | (F.length(text) < min_chars)
