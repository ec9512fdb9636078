"""Incremental ingestion, and windows over the query log.

The library's model is incremental batch: a run takes what is new, as told by keys and checksums, and stops. With
Structured Streaming that is a file source with the available-now trigger; the checkpoint folder keeps what was done
and takes the place of a process lock. Windows over events are an extension.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def new_files(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def ingest(stream: DataFrame, keys: list[str], write: Callable[[DataFrame, int], None], checkpoint: str, watermark: tuple[str, str] | None = None):
    """Runs over all that is new, each (document, checksum) once, and ends."""
    if watermark:
        stream = stream.withWatermark(*watermark)
    query = stream.dropDuplicates(keys).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def counts_by_window(events: DataFrame, time: str, every: str, slide: str | None = None, by: tuple[str, ...] = (), late: str | None = None) -> DataFrame:
    """(start, by..., n, total): tumbling or sliding windows, for streams with a watermark."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if late else events
    w = F.window(time, every, slide) if slide else F.window(time, every)
    return rows.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, time: str, user: str, gap: str) -> DataFrame:
    """(user, start, end, n): runs of a user's events with no gap as long as `gap`."""
    return events.groupBy(user, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def last_turns(turns: DataFrame, key: str, order: Column, n: int = 3) -> DataFrame:
    """The last n turns of each conversation."""
    from pyspark.sql import Window as W

    return turns.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(order.desc()))).where(F.col("__n") <= n).drop("__n")


class CachedView:
    """A table that is computed again after a time to live, or when it is invalidated."""

    def __init__(self, build: Callable[[], DataFrame], ttl_seconds: float = 1800.0, clock: Callable[[], float] | None = None):
        import time

        self.build, self.ttl, self.clock = build, ttl_seconds, clock or time.monotonic
        self.df, self.at = None, 0.0

    def get(self) -> DataFrame:
        if self.df is None or self.clock() - self.at >= self.ttl:
            self.invalidate()
            self.df, self.at = self.build().persist(), self.clock()
        return self.df

    def invalidate(self) -> None:
        if self.df is not None:
            self.df.unpersist()
        self.df = None
