"""Event-time windows that list late rows instead of dropping them.

A window's rows are spread over ``parts`` groups by a hash of their id, so one
busy key is not one state. Each group keeps its sums and the ids it has seen,
emits its sums when the watermark passes the window's end, and remembers the
ids for a while longer. A row that arrives after the close goes to the late
rows, one by one. Sums of closed groups and late rows together do not depend on
how the files were cut into batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

UNITS = 1_000_000  # sums are kept in whole millionths
RESULT = "kind string, units bigint, valued bigint, events bigint, event_id string, ts timestamp"


def _key_schema(events: DataFrame, key: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {events.schema[k].dataType.simpleString()}" for k in key)


def windows_and_late_rows(
    events: DataFrame, *, key: Sequence[str], event_id: str, value: str = "value", time: str = "ts",
    window: str = "24 hours", slide: str | None = None, lateness: str = "1 day",
    remember: int = 7 * 86_400, parts: int = 4,
) -> DataFrame:
    """Rows of three kinds: ``closed`` sums, ``late`` rows, and ``untimed`` rows, which have no time.

    An id counts once per window. Repeats are recognised until ``remember``
    seconds after the window has closed. A null value counts as an event without
    a value; an event without an id is never a repeat.

    The processor reads times from a plain number, because Spark removes rows
    behind the watermark wherever it finds the watermarked column itself.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    names = [*key, "window_start", "window_end", *[c.split()[0] for c in RESULT.split(", ")]]
    n_key = len(key)

    class Parts(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.sums = handle.getValueState("sums", "units bigint, valued bigint, events bigint, closed boolean")
            self.ids = handle.getListState("ids", "ids string")  # an entry per chunk of rows, its ids as a JSON list

        def handleInputRows(self, key, rows, timerValues) -> Iterator:
            start, end = key[n_key], key[n_key + 1]
            if start is None:
                for data in rows:
                    yield self.listed(key, data, "untimed")
                return
            state = self.sums.get()
            known = state is not None
            units, valued, events, closed = state if known else (0, 0, 0, False)
            now = timerValues.getCurrentWatermarkInMs()
            late = now >= end // 1000  # the sums may still wait for their timer, which runs after the rows
            seen = {i for r in self.ids.get() for i in json.loads(r[0])} if known else set()
            for data in rows:
                data = data.sort_values(["event_id", "at", "units"]).reset_index(drop=True)
                repeat = data["event_id"].notna() & (data["event_id"].duplicated() | data["event_id"].isin(seen))
                data = data[~repeat]
                if not len(data):
                    continue
                ids = data["event_id"].dropna().tolist()
                seen.update(ids)
                if ids:
                    self.ids.appendList([(json.dumps(ids),)])
                if late:
                    yield self.listed(key, data, "late")
                else:
                    units += int(data["units"].sum())
                    valued += int(data["valued"].sum())
                    events += len(data)
            if not known:
                closed = late  # nothing was on time, so there is nothing to emit
                self.handle.registerTimer(now + remember * 1000 if late else end // 1000)
            self.sums.update((units, valued, events, closed))

        def listed(self, key, data, kind):
            import pandas as pd

            out = pd.DataFrame({k: [key[i]] * len(data) for i, k in enumerate(names[:n_key])})
            for i, k in ((n_key, "window_start"), (n_key + 1, "window_end")):
                out[k] = pd.to_datetime([key[i]] * len(data), unit="us", utc=True)
            out["kind"], out["units"], out["valued"] = kind, data["units"].to_numpy(), data["valued"].to_numpy()
            out["events"], out["event_id"] = 1, data["event_id"].to_numpy()
            out["ts"] = pd.to_datetime(data["at"].to_numpy(), unit="us", utc=True)
            return out

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
            import pandas as pd

            units, valued, events, closed = self.sums.get()
            if closed:
                self.sums.clear()
                self.ids.clear()
                yield pd.DataFrame(columns=names)
                return
            self.sums.update((units, valued, events, True))
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + remember * 1000)
            span = [pd.Timestamp(key[n_key + i], unit="us", tz="UTC") for i in (0, 1)]
            yield pd.DataFrame([(*key[:n_key], *span, "closed", units, valued, events, None, pd.NaT)], columns=names)

        def close(self) -> None:
            pass

    at = F.unix_micros(time)
    span = F.window(time, window, slide) if slide else F.window(time, window)
    marked = events.withWatermark(time, lateness)
    timed = marked.where(F.col(time).isNotNull()).withColumn("_span", span)
    rows = timed.select(
        *key, F.unix_micros("_span.start").alias("_from"), F.unix_micros("_span.end").alias("_to"),
        F.pmod(F.xxhash64(event_id), F.lit(parts)).alias("_part"), F.col(event_id).cast("string").alias("event_id"),
        at.alias("at"),
        F.coalesce((F.col(value).cast("decimal(28,6)") * UNITS).cast("bigint"), F.lit(0).cast("bigint")).alias("units"),
        F.col(value).isNotNull().cast("bigint").alias("valued"),
    )
    schema = f"{_key_schema(events, key)}, window_start timestamp, window_end timestamp, {RESULT}"
    return rows.groupBy(*key, "_from", "_to", "_part").transformWithStateInPandas(
        statefulProcessor=Parts(), outputStructType=schema, outputMode="Append", timeMode="EventTime",
    )


def run_windows(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Run over the files present. Each kind of row gets a folder of its own, in a folder per batch that a rerun replaces."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{table}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def _written(spark: SparkSession, table: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("basePath", table).parquet(table)


def late_rows(spark: SparkSession, table: str, stream: DataFrame) -> DataFrame:
    """Every row that came after its window had closed, with the batch that brought it."""
    found = _written(spark, table, StructType([*stream.schema.fields, StructField("batch_id", LongType())])).where("kind = 'late'")
    return found.drop("kind", "events", "valued").withColumn("value", F.col("units") / UNITS).drop("units")


def read_windows(spark: SparkSession, table: str, stream: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Totals of the closed windows, late rows included, and how many events were late."""
    found = _written(spark, table, stream.schema).where("kind IN ('closed', 'late')")
    return found.groupBy(*key, "window_start", "window_end").agg(
        F.when(F.sum("valued") > 0, F.sum("units").cast("decimal(38,0)") / F.lit(UNITS)).cast("double").alias("total"),
        F.sum("events").alias("events"),
        F.sum(F.when(F.col("kind") == "late", F.col("events")).otherwise(0)).alias("late_events"),
    )
