"""A stream's upserts as a merge-on-read table: batches on top of a compacted base.

    table/batches/group=G/batch_id=N   rows of batch N, one per key
    table/base/through=N               one row per key of all batches up to N
    table/pointers/N                   empty file: base N is complete

A batch is folded by itself, so nothing is kept in a state store between
batches. Every ``every`` batches the base is written anew. A reader takes the
newest base and at most ``every`` batches after it, however many there were.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seriesloom.files import Files
from seriesloom.operators.clean import clean_rows, dedupe_observations, fold_duplicates, latest_by

EVERY = 8


def compacted_through(spark: SparkSession, table: str) -> int:
    """The last batch in the newest complete base, -1 without one."""
    return max(Files(spark, table).numbers("pointers"), default=-1)


def _live(spark: SparkSession, table: str, *, upto: int | None = None) -> DataFrame:
    """Rows of the newest base and of the batches after it, with their batch_id."""
    files, through = Files(spark, table), compacted_through(spark, table)
    paths = [f"{table}/base/through={through}"] if through >= 0 else []
    for group in files.names("batches"):
        for name in files.names(f"batches/{group}"):
            number = int(name.rsplit("=", 1)[-1])
            if through < number and (upto is None or number <= upto):
                paths.append(f"{table}/batches/{group}/{name}")
    return spark.read.parquet(*paths)


def read_upserted(
    spark: SparkSession, table: str, *, key: Sequence[str] = ("series_id", "obs_date"), order: Sequence[str] = (),
) -> DataFrame:
    """The current row of every key: the one of the greatest ``order``, then of the latest batch."""
    return latest_by(_live(spark, table), key, [*order, "_batch"]).drop("_batch")


def compact(
    spark: SparkSession, table: str, *, through: int, key: Sequence[str], order: Sequence[str] = (), keep: int = 2,
) -> None:
    """Write the base of all batches up to ``through``, then point at it.

    Until the pointer exists readers use the base before it, so a job that
    fails halfway leaves the table as it was. The last ``keep`` bases stay for
    readers under way; older ones and the batches they hold are removed.
    """
    files = Files(spark, table)
    latest_by(_live(spark, table, upto=through), key, [*order, "_batch"]).write.mode("overwrite").parquet(
        f"{table}/base/through={through}"
    )
    files.create(f"pointers/{through}")
    points = files.numbers("pointers")
    old, oldest = points[:-keep], points[-keep:][0]
    for point in old:
        files.remove(f"pointers/{point}")
        files.remove(f"base/through={point}")
    for group in files.names("batches") if old else []:
        numbers = files.numbers(f"batches/{group}")
        if numbers and max(numbers) <= oldest:
            files.remove(f"batches/{group}")


def stream_upsert(
    stream: DataFrame, table: str, checkpoint: str, *, key: Sequence[str] = ("series_id", "obs_date"),
    value: str = "value", order: Sequence[str] = (), every: int = EVERY,
) -> StreamingQuery:
    """Override by key: the row of the greatest ``order`` wins, without ``order`` the one of the later batch.

    Two rows of one key (and order) with different values in a batch fail it.
    Rows without a value are skipped. A batch that runs again replaces its own
    folder; once a base holds it, it changes nothing.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id <= compacted_through(spark, table):
            return
        if order:
            once = clean_rows(fold_duplicates(batch, [*key, *order], [value], skip_null=value, strict=True))
            folded = latest_by(once, key, order)
        else:
            folded = clean_rows(dedupe_observations(batch, key=key, value=value, strict=True))
        folded.withColumn("_batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(
            f"{table}/batches/group={batch_id // every}/batch_id={batch_id}"
        )
        if (batch_id + 1) % every == 0:
            compact(spark, table, through=batch_id, key=key, order=order)

    return (
        stream.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
