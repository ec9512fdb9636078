"""Facets, book fields and catalogue figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def facets(rows: DataFrame, group: list[str], values: dict[str, Column]) -> DataFrame:
    """(group..., key, values): each key's distinct non-blank values as a sorted list of strings. Values may be scalars or arrays."""
    types = dict(rows.select(*[v.alias(k) for k, v in values.items()]).dtypes)
    as_list = lambda k, v: v.cast("array<string>") if types[k].startswith("array") else F.array(v.cast("string"))
    entries = F.array(*[F.struct(F.lit(k).alias("key"), as_list(k, v).alias("list")) for k, v in values.items()])
    long = rows.select(*group, F.explode(entries).alias("e")).select(*group, "e.key", F.explode("e.list").alias("value"))
    return long.where(F.trim("value") != "").groupBy(*group, "key").agg(F.array_sort(F.collect_set("value")).alias("values"))


def facets_of_map(rows: DataFrame, group: list[str], metadata: str) -> DataFrame:
    """The same for every key of a map column."""
    long = rows.select(*group, F.explode(metadata).alias("key", "value"))
    return long.where(F.trim("value") != "").groupBy(*group, "key").agg(F.array_sort(F.collect_set("value")).alias("values"))


def date_ranges(rows: DataFrame, group: list[str], value: str, start: str, end: str) -> DataFrame:
    """(group..., ranges): per value its distinct (start, end) in order, where all three are there."""
    whole = rows.where(F.col(value).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull())
    each = whole.groupBy(*group, value).agg(F.array_sort(F.collect_set(F.struct(F.col(start).alias("start_date"), F.col(end).alias("end_date")))).alias("list"))
    return each.groupBy(*group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "list")))).alias("ranges"))


def composite_key(key: Column, language: Column) -> Column:
    return F.concat_ws("_", key, language)


def field_of_key(key: Column) -> Column:
    """What stands before the last underscore."""
    return F.regexp_extract(key, "^(.*)_[^_]*$", 1)


def pivot_facets(rows: DataFrame) -> DataFrame:
    """(content_type, language, fields map) from (content_type, key, language, values)."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "values"))))
    return rows.groupBy("content_type", "language").agg(entries.alias("fields"))


def merge_facets(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, values) of two content types as one: full outer by key, lists united, deduplicated and sorted."""
    both = left.select("key", F.col("values").alias("l")).join(right.select("key", F.col("values").alias("r")), "key", "full_outer")
    none = F.array().cast("array<string>")
    return both.select("key", F.array_sort(F.array_union(F.coalesce("l", none), F.coalesce("r", none))).alias("values"))


def years(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Every year that a range touches, once."""
    return rows.select(F.explode(F.sequence(F.year(start), F.year(end))).alias("year")).distinct()


def histogram(rows: DataFrame, length: Column, bounds: list[int]) -> DataFrame:
    """(bucket, n, share in percent): bounds are inclusive; the last bucket is open."""
    bucket = F.lit(len(bounds))
    for k in reversed(range(len(bounds))):
        bucket = F.when(length <= bounds[k], F.lit(k)).otherwise(bucket)
    counts = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total), F.lit(True)).select("bucket", "n", F.round(100 * F.col("n") / F.col("total"), 4).alias("percent"))


def status_rank(status: Column) -> Column:
    return F.when(status == "searchable", 1).when(status == "in_progress", 2).when(status == "planned", 3).otherwise(99)


def catalogue(rows: DataFrame) -> DataFrame:
    """Per language: series, searchable items, and counts by status; rows have language, status, count."""
    n = lambda s: F.count_if(F.col("status") == s)
    return rows.groupBy("language").agg(
        F.count("*").alias("series"),
        F.coalesce(F.sum(F.when(F.col("status") == "searchable", F.col("count"))), F.lit(0)).cast("long").alias("searchable_items"),
        n("searchable").alias("searchable"), n("in_progress").alias("in_progress"), n("planned").alias("planned"),
    )
