"""Streaming queries: each replays the events as a file stream and returns the
table it wrote under the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import query, table
from seriesloom.session import new_table_path
from seriesloom.streaming import late_windows, streaks, streams, upserts


def event_stream(spark, sf, **options):
    schema = table(spark, sf, "events").schema
    return streams.read_event_stream(spark, f"{sf}/events.parquet", schema, **options)


@query("stream_daily_window", """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS d, CAST(SUM(CAST(value AS DECIMAL(28,6))) AS DOUBLE) AS total, count(*) AS events FROM events GROUP BY 1, 2)
  SELECT event_type, CAST(d AS VARCHAR) || ' 00:00:00' AS window_start, total, events FROM d
  WHERE CAST(d AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT MAX(ts) - INTERVAL 1 DAY FROM events)""")
def stream_daily_window(spark, sf):
    """Closed daily windows over deduplicated events; open ones are not emitted."""
    base = new_table_path(spark, "daily-window")
    stream = late_windows.windows_and_late_rows(
        event_stream(streams.stream_session(spark), sf), key=["event_type"], event_id="event_id"
    )
    late_windows.run_windows(stream, f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return late_windows.read_windows(spark, f"{base}/table", stream, key=["event_type"]).select(
        "event_type", "window_start", "total", "events"
    )


REPLAYED = """r AS (SELECT *, event_id % 3 AS batch FROM events),
  k AS (SELECT event_type, CAST(ts AS DATE) AS d, batch, value, event_id, ts,
    (SELECT MAX(ts) FROM r p WHERE p.batch < r.batch) - INTERVAL 1 DAY AS mark FROM r)"""


def replay_by_thirds(spark, sf):
    """The events as three batches, each over the whole time, so most of the later two come late."""
    base = new_table_path(spark, "replay")
    events = table(spark, sf, "events")
    for batch in range(3):
        # Files are taken in the order of their times, one a batch.
        events.where(F.col("event_id") % 3 == batch).coalesce(1).write.mode("append").parquet(f"{base}/in")
    own = streams.stream_session(spark)
    stream = late_windows.windows_and_late_rows(
        streams.read_event_stream(own, f"{base}/in", events.schema, files_per_batch=1), key=["event_type"], event_id="event_id"
    )
    late_windows.run_windows(stream, f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return base, stream


@query("stream_late_rows", f"""WITH {REPLAYED}
  SELECT event_type, CAST(event_id AS VARCHAR) AS event_id, CAST(d AS VARCHAR) || ' 00:00:00' AS window_start, value, batch
  FROM k WHERE CAST(d AS TIMESTAMP) + INTERVAL 1 DAY <= mark""")
def stream_late_rows(spark, sf):
    """Every event that came after its day had closed."""
    base, stream = replay_by_thirds(spark, sf)
    return late_windows.late_rows(spark, f"{base}/table", stream).select(
        "event_type", "event_id", "window_start", "value", F.col("batch_id").alias("batch")
    )


@query("stream_corrected_windows", f"""WITH {REPLAYED}
  SELECT event_type, CAST(d AS VARCHAR) || ' 00:00:00' AS window_start, CAST(SUM(CAST(value AS DECIMAL(28,6))) AS DOUBLE) AS total, count(*) AS events,
    CAST(count(*) FILTER (WHERE CAST(d AS TIMESTAMP) + INTERVAL 1 DAY <= mark) AS BIGINT) AS late_events
  FROM k WHERE CAST(d AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT MAX(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2""")
def stream_corrected_windows(spark, sf):
    """Totals with late events, equal to those of one batch."""
    base, stream = replay_by_thirds(spark, sf)
    return late_windows.read_windows(spark, f"{base}/table", stream, key=["event_type"]).drop("window_end")


@query("stream_upsert", """WITH d AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS d, MAX(event_id) AS e FROM events GROUP BY 1, 2)
  SELECT series_id, CAST(d AS VARCHAR) AS obs_date, value FROM d JOIN events ON event_id = e""")
def stream_upsert(spark, sf):
    """The last event of each type and day, upserted by key in the order of the event ids."""
    base = new_table_path(spark, "upsert")
    rows = event_stream(spark, sf).select(
        F.col("event_type").alias("series_id"), F.to_date("ts").alias("obs_date"), "event_id", "value"
    )
    upserts.stream_upsert(rows, f"{base}/table", f"{base}/checkpoint", order=["event_id"]).awaitTermination()
    return upserts.read_upserted(spark, f"{base}/table", order=["event_id"]).drop("event_id")


@query("stream_upsert_compacted", """WITH d AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS d, MAX(event_id) AS e FROM events GROUP BY 1, 2)
  SELECT series_id, CAST(d AS VARCHAR) AS obs_date, value FROM d JOIN events ON event_id = e""")
def stream_upsert_compacted(spark, sf):
    """The same from ten batches, the newest events first, with a new base after every fourth."""
    base = new_table_path(spark, "upsert-batches")
    events = table(spark, sf, "events").select(
        F.col("event_type").alias("series_id"), F.to_date("ts").alias("obs_date"), "event_id", "value"
    )
    events.repartitionByRange(10, F.desc("event_id")).write.parquet(f"{base}/in")
    rows = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    upserts.stream_upsert(rows, f"{base}/table", f"{base}/checkpoint", order=["event_id"], every=4).awaitTermination()
    return upserts.read_upserted(spark, f"{base}/table", order=["event_id"]).drop("event_id")


STREAK_SQL = """WITH d AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS d, SUM(CAST(value AS DECIMAL(28,6))) AS amt FROM events GROUP BY 1, 2),
  k AS (SELECT *, isodow(d) >= 6 AS skipped, amt - 1000 > 0 AS pos FROM d),
  g AS (SELECT *, count(*) FILTER (WHERE NOT skipped AND NOT pos) OVER (PARTITION BY series_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS grp FROM k)
  SELECT series_id, CAST(d AS VARCHAR) AS obs_date, skipped, count(*) FILTER (WHERE NOT skipped AND pos) OVER (PARTITION BY series_id, grp ORDER BY d ROWS UNBOUNDED PRECEDING) AS streak FROM g"""


def streak_of_files(spark, sf, order, files):
    """Daily rows written in the given order, one file a batch, and replayed."""
    base = new_table_path(spark, "streak")
    daily = table(spark, sf, "events").groupBy(
        F.col("event_type").alias("series_id"), F.to_date("ts").alias("obs_date")
    ).agg((F.sum(F.col("value").cast("decimal(28,6)")).cast("double") - 1000).alias("amount"))
    dealt = daily.withColumn("skipped", F.weekday("obs_date") >= 5)
    (dealt.repartitionByRange(files, order) if files > 1 else dealt).write.parquet(f"{base}/daily")
    own = streams.stream_session(spark)
    reader = own.readStream.schema(dealt.schema)
    rows = (reader.option("maxFilesPerTrigger", 1) if files > 1 else reader).parquet(f"{base}/daily")
    streaks.run_streaks(streaks.stream_streak(rows), f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return streaks.read_streaks(spark, f"{base}/table").select("series_id", "obs_date", "skipped", "streak")


@query("stream_streak", STREAK_SQL)
def stream_streak(spark, sf):
    """The streak per type and day, all days in one batch."""
    return streak_of_files(spark, sf, None, 1)


@query("stream_streak_shuffled", STREAK_SQL)
def stream_streak_shuffled(spark, sf):
    """The same from five batches of days in hash order: most days come late."""
    return streak_of_files(spark, sf, F.xxhash64("series_id", "obs_date"), 5)
