"""Readers and writers: page texts, page JSON, markdown, logs, snapshots."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATOR = "\n----\n"

PAGE = (
    "page_num int, metadata struct<avg_left_margin:double,avg_right_margin:double,prose_left_margin:double,prose_right_margin:double>,"
    "lines array<struct<line_num:int,text:string,x_start:int,x_end:int>>"
)


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, length) of all files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select("path", "length")


def pdf_files(files: DataFrame) -> DataFrame:
    return files.where(F.endswith(F.lower("path"), F.lit(".pdf")))


def page_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("path").rlike(r"(^|/)page_\d{4}\.(txt|json)$")).select("path").distinct().orderBy("path")


def page_number(path: Column) -> Column:
    return F.regexp_extract(path, r"page_(\d+)\.[^/]*$", 1).try_cast("int")


def page_paragraphs(pages: DataFrame, value: str) -> DataFrame:
    """One row (position, text) per paragraph of a page's text that is not blank, in place of the text."""
    others = [c for c in pages.columns if c != value]
    parts = pages.select(*others, F.posexplode(F.split(value, SEPARATOR)).alias("position", "text"))
    return parts.where(F.trim("text") != "").withColumn("text", F.trim("text"))


def read_page_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(document_id, page_num, position, text) of the paragraphs in <folder>/<document>/page_NNNN.txt."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "page_*.txt").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return page_paragraphs(rows.select(F.element_at(F.split("path", "/"), -2).alias("document_id"), page_number(F.col("path")).alias("page_num"), "value"), "value")


def read_page_json(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of <folder>/<document>/page_NNNN.json; an unreadable page is empty with zero margins."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "page_*.json").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", PAGE).alias("p"))
    zero = lambda c: F.coalesce(F.col(f"p.metadata.{c}"), F.lit(0.0)).alias(c)
    none = F.array().cast("array<struct<line_num:int,text:string,x_start:int,x_end:int>>")
    margins = [zero(c) for c in ("avg_left_margin", "avg_right_margin", "prose_left_margin", "prose_right_margin")]
    return raw.select(F.element_at(F.split("path", "/"), -2).alias("document_id"), page_number(F.col("path")).alias("page_num"), *margins, F.coalesce("p.lines", none).alias("lines"))


def page_lines(pages: DataFrame) -> DataFrame:
    return pages.select("document_id", "page_num", "prose_left_margin", "prose_right_margin", F.inline("lines"))


def page_texts(paragraphs: DataFrame) -> DataFrame:
    """(document_id, page_num, file, value): the text of each page file, paragraphs by position."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda p: p["text"]), SEPARATOR)
    return paragraphs.groupBy("document_id", "page_num").agg(text.alias("value")).withColumn("file", F.format_string("page_%04d.txt", "page_num"))


def write_pages(paragraphs: DataFrame, path: str) -> None:
    page_texts(paragraphs).write.mode("overwrite").partitionBy("document_id").json(path)


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("markdown"))


def complete_documents(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Documents all of whose wanted pages are there."""
    lacking = wanted.join(present, ["document_id", "page_num"], "left_anti").select("document_id").distinct()
    return wanted.select("document_id").distinct().join(lacking, "document_id", "left_anti")


def write_snapshot(tables: dict[str, DataFrame], path: str, name: str) -> None:
    for table, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}/{table}")


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def list_snapshots(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []


def restore_snapshot(spark: SparkSession, path: str, name: str | None = None) -> dict[str, DataFrame]:
    """The tables of a snapshot, by default of the last one by name."""
    found = list_snapshots(spark, path)
    if not found:
        raise ValueError(f"no snapshot in {path}")
    fs, at = _fs(spark, f"{path}/{name or found[-1]}")
    return {t: spark.read.parquet(f"{path}/{name or found[-1]}/{t}") for t in sorted(s.getPath().getName() for s in fs.listStatus(at))}


def restore_into(spark: SparkSession, path: str, target: str, name: str | None = None) -> dict[str, DataFrame]:
    """Puts a snapshot's tables below target; what is there under their names goes first."""
    restored = {}
    for table, df in restore_snapshot(spark, path, name).items():
        fs, at = _fs(spark, f"{target}/{table}")
        fs.delete(at, True)
        df.write.parquet(f"{target}/{table}")
        restored[table] = spark.read.parquet(f"{target}/{table}")
    return restored


def ensure_table(spark: SparkSession, name: str, schema: str, path: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet LOCATION '{path}'")


def drop_tables(spark: SparkSession, names: list[str]) -> dict[str, str]:
    """Drops tables, going on after one that cannot be dropped; what went wrong, by name."""
    failed = {}
    for name in names:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        except PySparkException as error:
            failed[name] = str(error)
    return failed


def substitute_env(text: str, env: dict[str, str]) -> str:
    """{NAME} in a settings text becomes the variable's value; unknown names stay."""
    import re

    return re.sub(r"\{([A-Z_][A-Z0-9_]*)\}", lambda m: env.get(m[1], m[0]), text)
