"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as white space between words: space, tab, \n, \v, \f, \r.
SPACE_CLASS = r"[ \x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row, however often body uses it, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The maximal runs of non-space characters, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        at = context._jsc.sc().getCheckpointDir()
        if at.isDefined():
            return at.get()
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="granary-")
        context.setCheckpointDir(found)
        return context._jsc.sc().getCheckpointDir().get()
    return found


class Scratch:
    """Tables written to the shared folder, so that lost executors cost no more than the step at hand.

    table() writes and rereads; drop() removes what no later step reads. Tables that a returned
    DataFrame still reads stay in the checkpoint folder and go with it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark).rstrip('/')}/granary-{uuid.uuid4().hex}", {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(f"{name}-{len(self.paths)}")
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[name] = path
        return out

    def bucketed(self, df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
        """table() in buckets of a column, so that a later grouping by it needs no shuffle of these rows."""
        path, entry = self.path(f"{name}-{len(self.paths)}"), f"granary_{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, column).saveAsTable(entry, format="parquet")
        out = self.spark.table(entry)
        out.schema  # noqa: B018  resolved now: the catalog need not keep the name
        self.spark.sql(f"DROP TABLE {entry}")
        self.paths[name] = path
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)

def give_back() -> None:
    """Returns what a Python worker has freed to the system, so that workers kept for later tasks are small."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def is_small(df: DataFrame, rows: int) -> bool:
    """True if df has at most so many rows of 64 bytes; longer ones count for more. Reads no more than needed to tell."""
    long = {"string": F.octet_length, "binary": F.octet_length}
    sizes = [F.coalesce(long[t](c), F.lit(0)) for c, t in df.dtypes if t in long] + [8 * F.greatest(F.size(c), F.lit(0)) for c, t in df.dtypes if t.startswith("array")]
    weight = F.sum(sum((F.floor(s / 64) for s in sizes), F.lit(1)).cast("long"))
    return (df.limit(rows + 1).agg(weight).first()[0] or 0) <= rows


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if it is_small; otherwise as it is, for a shuffle join."""
    return F.broadcast(df) if is_small(df, rows) else df
