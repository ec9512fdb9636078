"""Crawl state: change detection, upserts and deletes by key, without a merge command.

Each operator returns the table's new content. Write it to a new version folder and switch, or overwrite the
partitions that it touches.
"""

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new's rows, and old's whose key new does not have. new has a key once."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def update_keeping(old: DataFrame, new: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """upsert, but the kept columns stay as they were where new has null."""
    before = old.select(key, *[F.col(c).alias(f"__{c}") for c in kept])
    filled = new.join(before, key, "left").select(*[F.coalesce(c, f"__{c}").alias(c) if c in kept else F.col(c) for c in new.columns])
    return upsert(old, filled, key)


def delete(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key), key, "left_anti")


def reindex(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys that new has are replaced by new's."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def vanished(state: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """State rows whose file is gone."""
    return state.join(files.select(path), path, "left_anti")


def changes(files: DataFrame, state: DataFrame, key: str, checks: list[str]) -> DataFrame:
    """files with `change`: new, changed or same, by the checksums."""
    before = state.select(key, F.lit(True).alias("__known"), *[F.col(c).alias(f"__{c}") for c in checks])
    same = F.lit(True)
    for c in checks:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    joined = files.join(before, key, "left")
    change = F.when(F.col("__known").isNull(), "new").when(same, "same").otherwise("changed")
    return joined.select(*files.columns, change.alias("change"))


def metadata_update(chunks: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """chunks with a document's new metadata; texts and vectors stay."""
    fields = [c for c in metadata.columns if c != key]
    joined = chunks.join(metadata.select(key, F.struct(*fields).alias("__new")), key, "left")
    return joined.select(*[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in chunks.columns])


def without_ignored(files: DataFrame, path: str = "path") -> DataFrame:
    """Files that lie under no folder with an _ignore file and have no hidden part."""
    dirs = files.where(F.col(path).rlike(r"(^|/)_ignore$")).select(F.regexp_replace(path, "_ignore$", "").alias("__dir"))
    above = F.transform(F.sequence(F.lit(1), F.size(F.split(path, "/"))), lambda k: F.when(k == 1, F.lit("")).otherwise(F.concat(F.array_join(F.slice(F.split(path, "/"), F.lit(1), k - 1), "/"), F.lit("/"))))
    seen = files.where(~F.col(path).rlike(r"(^|/)\.")).where(~F.col(path).rlike(r"(^|/)_ignore$"))
    exploded = seen.select(path, F.explode(above).alias("__dir")).join(dirs.distinct(), "__dir", "left_semi").select(path).distinct()
    return seen.join(exploded, path, "left_anti")


def compare(base: DataFrame, other: DataFrame, key: str, content: str) -> DataFrame:
    """(key, verdict): matching, different or missing, for the base's rows."""
    right = other.select(key, F.col(content).alias("__o"), F.lit(True).alias("__is"))
    verdict = F.when(F.col("__is").isNull(), "missing").when(F.col(content).eqNullSafe(F.col("__o")), "matching").otherwise("different")
    return base.join(right, key, "left").select(key, verdict.alias("verdict"))


def line_differences(before, after):
    """How many different lines a diff of two texts adds or takes away."""

    def changed(p: str | None, q: str | None) -> int:
        lines = difflib.unified_diff((p or "").split("\n"), (q or "").split("\n"), lineterm="", n=0)
        return len({x for x in lines if x[:1] in "+-" and x[:3] not in ("+++", "---")})

    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([changed(p, q) for p, q in zip(a, b, strict=True)], dtype="int32")

    return run(before, after)
