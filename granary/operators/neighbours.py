"""Window operators: forward fill, ordinals, context, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def forward_fill(rows: DataFrame, key: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the last value that is not null up to each row. A struct moves as one."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def fill_pages(bookmarks: DataFrame, books: DataFrame) -> DataFrame:
    """For each page of a book: the number and date of its last dated bookmark at or before it.

    bookmarks: document_id, pos, page, pravachan_no, date; books: document_id, total_pages. A bookmark before page 1
    counts for page 1; number and date move together, so a null number comes with a date.
    """
    marks = bookmarks.where(F.col("date").isNotNull()).select("document_id", F.greatest("page", F.lit(1)).alias("page"), F.struct("pravachan_no", "date").alias("mark"), "pos")
    last = marks.groupBy("document_id", "page").agg(F.max_by("mark", F.struct("pos")).alias("mark"))
    spine = books.select("document_id", F.explode(F.sequence(F.lit(1), F.col("total_pages"))).alias("page"))
    filled = forward_fill(spine.join(last, ["document_id", "page"], "left"), "document_id", ["page"], F.col("mark"), "mark")
    return filled.select("document_id", "page", "mark.pravachan_no", "mark.date")


def ordinals(rows: DataFrame, key: str, order: list[str], name: str = "ordinal") -> DataFrame:
    """0-based place of each row in its document."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1)


def context(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Adds previous_ and next_ of the columns, inside one document."""
    w = W.partitionBy(key).orderBy(*order)
    both = {f"{side}_{c}": f(c).over(w) for side, f in (("previous", F.lag), ("next", F.lead)) for c in columns}
    return rows.withColumns(both)


def islands(rows: DataFrame, key: str, order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Numbers the runs of each document; starts may use lag() over the window that `over` gives."""
    return rows.withColumn("__s", F.coalesce(starts, F.lit(True)).cast("int")).withColumn(name, F.sum("__s").over(over(key, order))).drop("__s")


def over(key: str, order: list[str]):
    return W.partitionBy(key).orderBy(*order)


def merge_runs(rows: DataFrame, key: str, order: list[str], kind: str, kinds: list[str], text: str, page: str) -> DataFrame:
    """Adjacent rows of the same kind become one row where the kind is listed: texts joined by line ends, page of the first."""
    w = over(key, order)
    marked = rows.withColumn("__prev", F.lag(kind).over(w))
    runs = islands(marked, key, order, ~(F.col("__prev").eqNullSafe(F.col(kind)) & F.col(kind).isin(kinds)))
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__t"), F.col(page).alias("__p"))))
    grouped = runs.groupBy(key, "island").agg(ordered.alias("__r"), F.first(kind).alias(kind))
    return grouped.select(key, "island", kind, F.array_join(F.transform("__r", lambda r: r["__t"]), "\n").alias(text), F.col("__r")[0]["__p"].alias(page))


def merge_sentences(rows: DataFrame, key: str, order: list[str], text: str, page: str, prefixes: list[str], endings: list[str]) -> DataFrame:
    """Rows run together until one ends with an ending; one that starts with a prefix opens a new run. Joined by a space."""
    w = over(key, order)
    opens = F.lit(False)
    for p in prefixes:
        opens = opens | F.startswith(F.col(text), F.lit(p))
    ends = F.lit(False)
    for e in endings:
        ends = ends | F.endswith(F.col("__prev"), F.lit(e))
    marked = rows.withColumn("__prev", F.lag(text).over(w))
    runs = islands(marked, key, order, F.col("__prev").isNull() | opens | ends)
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__t"), F.col(page).alias("__p"))))
    grouped = runs.groupBy(key, "island").agg(ordered.alias("__r"))
    return grouped.select(key, "island", F.array_join(F.transform("__r", lambda r: r["__t"]), " ").alias(text), F.col("__r")[0]["__p"].alias(page))


def evict_oldest(entries: DataFrame, size: str, used: str, needed: int, era: Column) -> DataFrame:
    """The entries to drop, longest unused first, until enough is freed.

    era: a coarse step of `used` that never falls as it grows, such as a day. Sums of eras tell what lies before each,
    so that only the entries of one era are put in order together.
    """
    rows = entries.withColumn("__era", era)
    sums = rows.groupBy("__era").agg(F.sum(size).alias("__sum"))
    earlier = F.coalesce(F.sum("__sum").over(W.orderBy("__era").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per era
    reached = sums.select("__era", earlier.alias("__earlier")).where(F.col("__earlier") < needed)
    within = F.sum(size).over(W.partitionBy("__era").orderBy(used).rowsBetween(W.unboundedPreceding, 0)) - F.col(size)
    return rows.join(reached, "__era").withColumn("__before", F.col("__earlier") + within).where(F.col("__before") < needed).select(*entries.columns)


def sequence_starts(rows: DataFrame, key: str, order: list[str], width: Column, name: str = "seq_num") -> DataFrame:
    """A shared numbering in which each row takes up `width` numbers, from 1."""
    w = over(key, order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("__w", width).withColumn(name, F.coalesce(F.sum("__w").over(w), F.lit(0)) + 1).drop("__w")
