"""Settings inherited along folders, and page ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Settings that add up from the base to the leaf; all others are overlaid.
LISTS = ("header_prefix", "header_regex", "page_list", "typo_list", "question_prefix", "answer_prefix")
SCALARS = ("psm", "chunk_strategy", "ignore_bookmarks")


def ancestors(path: Column) -> Column:
    """The folders of a path from the base "" on."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1
    return F.transform(F.sequence(F.lit(0), n), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def overlaid(base: Column, leaf: Column) -> Column:
    """base with leaf's keys set to leaf's values."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(leaf, k)), leaf)


def merged_config(files: DataFrame, folder_configs: DataFrame, file_configs: DataFrame) -> DataFrame:
    """(path, config): the maps of a file's folders overlaid from the base to the leaf, and its own last.

    files: path; folder_configs: dir, config map; file_configs: path, config map.
    """
    above = files.select("path", F.posexplode(ancestors(F.col("path"))).alias("depth", "dir"))
    found = above.join(folder_configs, "dir").select("path", "depth", "config")
    own = files.join(file_configs, "path").select("path", F.lit(2**31 - 1).alias("depth"), "config")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("depth", F.map_entries("config").alias("e")))), lambda c: F.map_from_entries(c["e"]))
    none = F.create_map().cast("map<string,string>")
    folded = found.unionByName(own).groupBy("path").agg(F.aggregate(ordered, none, overlaid).alias("config"))
    return files.join(folded, "path", "left").select("path", F.coalesce("config", none).alias("config"))


def scan_settings(files: DataFrame, folder_settings: DataFrame, file_settings: DataFrame) -> DataFrame:
    """(path, settings...): lists add up along the folders, scalars and crop are the deepest one given.

    folder_settings: dir, columns of LISTS (arrays), SCALARS, crop_top, crop_bottom. file_settings: dir, path, the
    same lists, file_url, start_page, end_page; only the section in the deepest folder that has settings counts, it
    adds to all lists but the typos, and start and end count only if both are there.
    """
    above = files.select("path", F.posexplode(ancestors(F.col("path"))).alias("depth", "dir"))
    found = above.join(folder_settings, "dir")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(dict(folder_settings.dtypes)[c]))
    lists = [F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("depth", empty(c).alias("v")))), lambda s: s["v"])).alias(c) for c in LISTS]
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("depth"))).alias(c) for c in (*SCALARS, "crop_top", "crop_bottom")]
    merged = found.groupBy("path").agg(F.max_by("dir", "depth").alias("dir"), *lists, *last)
    section = file_settings.select("dir", "path", *[F.col(c).alias(f"own_{c}") for c in LISTS if c != "typo_list"], "file_url", "start_page", "end_page")
    both = merged.join(section, ["dir", "path"], "left")
    added = lambda c: F.col(c) if c == "typo_list" else F.concat(F.col(c), F.coalesce(F.col(f"own_{c}"), F.array().cast(dict(folder_settings.dtypes)[c])))
    whole = (F.coalesce("start_page", F.lit(0)) > 0) & (F.coalesce("end_page", F.lit(0)) > 0)
    return both.select("path", *[added(c).alias(c) for c in LISTS], *SCALARS, "crop_top", "crop_bottom", "file_url", F.when(whole, F.col("start_page")).alias("start_page"), F.when(whole, F.col("end_page")).alias("end_page"))


def page_set(ranges: Column) -> Column:
    """Ranges (start, end) as a sorted list of pages without repeats."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(ranges, lambda r: F.sequence(r["start"], r["end"])))))


def missing_pages(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """(document_id, page_num) that are asked for and not there."""
    return wanted.join(present, ["document_id", "page_num"], "left_anti")


def inherit(rows: DataFrame, key: str, levels: list[str]) -> Column:
    """The value of the deepest level that has one."""
    return F.coalesce(*[F.col(c) for c in reversed(levels)])


def latest(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(order))).where("__n = 1").drop("__n")
