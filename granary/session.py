"""Session settings the library expects."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

#: Settings that change results; performance settings stay with the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def build_session(app: str = "granary", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; conf has further ones, with dots written as __."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    at = context._jsc.sc().getCheckpointDir()
    if not at.isDefined():
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="granary-"))
        at = context._jsc.sc().getCheckpointDir()
    return at.get().rstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str):
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
