"""Sources and sessions of streams; the operators are in late_windows, streaks and upserts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of the same cluster whose streams keep state in RocksDB; the caller's settings stay."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return own


def read_event_stream(
    spark: SparkSession, path: str, schema, *, glob: str | None = None, files_per_batch: int | None = None,
) -> DataFrame:
    """A file stream with an event-time column of type TIMESTAMP.

    ``path`` is a file or a folder of part files. Without ``files_per_batch``
    all files present are one batch, so the watermark moves only after the
    whole backlog is read and no part of it counts as late.
    """
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if not re.search(r"[*?\[{]", path):
        path = f"{path[:-1]}[{path[-1]}]"  # as a pattern, a file and a folder are read alike
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
