"""Streams: equal results under any batching, late rows listed, reruns without effect."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from seriesloom.session import new_table_path
from seriesloom.streaming import late_windows, streaks, streams, upserts

# --- windows ---------------------------------------------------------------

EVENTS = "event_id long, k string, t string, value double"


def _events(spark, data):
    return spark.createDataFrame(data, EVENTS).select("event_id", "k", F.to_timestamp("t").alias("ts"), "value")


def _windows(spark, batches, **options):
    """The stream over one file per batch, and the folder it wrote."""
    base = new_table_path(spark, "win")
    for i, data in enumerate(batches):
        _events(spark, data).coalesce(1).write.parquet(f"{base}/in/{i}")
        os.utime(next(f.path for f in os.scandir(f"{base}/in/{i}") if f.name.endswith(".parquet")), (1e9 + i, 1e9 + i))
    schema = "event_id long, k string, ts timestamp, value double"
    source = streams.stream_session(spark).readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")
    stream = late_windows.windows_and_late_rows(source, key=["k"], event_id="event_id", **options)
    late_windows.run_windows(stream, f"{base}/out", f"{base}/cp").awaitTermination()
    return stream, f"{base}/out"


def _totals(spark, stream, out):
    found = late_windows.read_windows(spark, out, stream, key=["k"]).collect()
    return {(r["k"], r["window_start"]): (r["total"], r["events"]) for r in found}


def test_windows_equal_under_any_batching(spark):
    rng = random.Random(8)
    data = []
    for i in range(300):
        t = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(8 * 1440))
        data.append((i, rng.choice("ab"), t.isoformat(" "), None if i % 40 == 0 else i / 8))
    last = [(999, "a", "2024-01-30 00:00:00", 1.0)]
    one = _totals(spark, *_windows(spark, [data + data[:50] + last]))
    shuffled = data + data[:50]
    rng.shuffle(shuffled)
    stream, out = _windows(spark, [shuffled[0::3], shuffled[1::3], shuffled[2::3], last])
    assert _totals(spark, stream, out) == one and len(one) == 16
    late = rows(late_windows.late_rows(spark, out, stream))
    assert len(late) > 100 and len({r["event_id"] for r in late}) == len(late)
    by_hand = {}
    for i, k, t, v in {d[0]: d for d in data}.values():
        day = dt.datetime.fromisoformat(t).replace(hour=0, minute=0)
        total, n = by_hand.get((k, day), (0, 0))
        by_hand[k, day] = (total + (v or 0), n + 1)
    assert {(k, s.replace(tzinfo=None)): v for (k, s), v in one.items()} == by_hand


def test_a_late_repeat_is_not_counted_again(spark):
    first = [(1, "a", "2024-01-01 10:00:00", 5.0), (2, "a", "2024-01-09 00:00:00", 1.0)]
    then = [(1, "a", "2024-01-01 10:00:00", 5.0), (3, "a", "2024-01-01 11:00:00", 2.0), (None, "a", "2024-01-01 12:00:00", 4.0)]
    stream, out = _windows(spark, [first, then, [(9, "a", "2024-01-20 00:00:00", 1.0)]], parts=1)
    got = {s.day: v for (_, s), v in _totals(spark, stream, out).items()}
    assert got == {1: (11.0, 3), 9: (1.0, 1)}
    assert sorted((r["event_id"] or "", r["value"]) for r in rows(late_windows.late_rows(spark, out, stream))) == [("", 4.0), ("3", 2.0)]


def test_sliding_windows_and_null_values(spark):
    data = [(1, "a", "2024-01-02 12:00:00", None), (2, "a", "2024-01-20 00:00:00", 3.0)]
    stream, out = _windows(spark, [data], window="2 days", slide="1 day")
    got = {(s.month, s.day): v for (_, s), v in _totals(spark, stream, out).items()}
    assert got == {(1, 1): (None, 1), (1, 2): (None, 1)}


# --- streaks ---------------------------------------------------------------

DAYS = "series_id string, obs_date date, amount double, skipped boolean"


def _streaks(spark, batches):
    base = new_table_path(spark, "streak")
    for i, data in enumerate(batches):
        spark.createDataFrame(data, DAYS).coalesce(1).write.parquet(f"{base}/in/{i}")
        os.utime(next(f.path for f in os.scandir(f"{base}/in/{i}") if f.name.endswith(".parquet")), (1e9 + i, 1e9 + i))
    source = streams.stream_session(spark).readStream.schema(DAYS).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")
    streaks.run_streaks(streaks.stream_streak(source), f"{base}/out", f"{base}/cp").awaitTermination()
    return f"{base}/out"


def _by_hand(data):
    want, series = {}, {}
    for s, day, amount, skipped in sorted(data, key=lambda r: r[:2]):
        k = series.get(s, 0)
        k = k if skipped else k + 1 if (amount or 0) > 0 else 0
        series[s] = want[s, day] = k
    return want


def test_shuffled_days_equal_sorted_days(spark):
    rng = random.Random(3)
    data = [
        (s, dt.date(1969, 10, 1) + dt.timedelta(days=d), rng.choice([1.0, 2.0, 3.0, 0.0, None]) if s == "x" else 1.0, rng.random() < 0.2)
        for s in "xy" for d in range(250) if rng.random() < 0.8
    ]
    shuffled = data[:]
    rng.shuffle(shuffled)
    out = _streaks(spark, [shuffled[i::5] for i in range(5)])
    got = {(r["series_id"], r["obs_date"]): r["streak"] for r in streaks.read_streaks(spark, out).collect()}
    assert got == _by_hand(data)


def test_a_late_day_changes_days_up_to_the_next_reset_only(spark):
    def day(n):
        return dt.date(2024, 1, n)

    first = [("a", day(n), 0.0 if n == 6 else 1.0, False) for n in (1, 2, 4, 5, 6, 7)]
    out = _streaks(spark, [first, [("a", day(3), 0.0, False), ("a", day(2), 9.0, False)], [("a", day(6), 1.0, False), ("a", None, 1.0, False)]])
    found = streaks.streak_changes(spark, out).where("batch_id > 0")
    changes = [(r["batch_id"], r["obs_date"] and r["obs_date"].day, r["streak"], r["change"]) for r in found.collect()]
    assert sorted(changes, key=str) == sorted(
        [(1, 3, 0, "late"), (1, 4, 1, "shifted"), (1, 5, 2, "shifted"), (2, 6, 3, "revised"), (2, 7, 4, "shifted"), (2, None, None, "unplaced")],
        key=str,
    )


@pytest.mark.parametrize("seed", range(3))
def test_effects_combine_in_any_grouping(seed):
    rng = random.Random(seed)
    parts = [(rng.random() < 0.4, rng.randrange(5)) for _ in range(9)]
    left = parts[0]
    for p in parts[1:]:
        left = streaks.combine(left, p)
    right = parts[-1]
    for p in reversed(parts[:-1]):
        right = streaks.combine(p, right)
    assert left == right
    adds, resets = rng.getrandbits(32), rng.getrandbits(32) & rng.getrandbits(32)
    streak = 5
    for bit in range(32):
        streak = 0 if resets >> bit & 1 else streak + (adds >> bit & 1)
    assert streaks.combine((False, 5), streaks.effect(adds & ~resets, resets))[1] == streak


# --- upserts ---------------------------------------------------------------

SCHEMA = "series_id string, obs_date date, value double"


def _land(spark, folder, name, data):
    df = spark.createDataFrame(data, "series_id string, d string, value double").select(
        "series_id", F.to_date("d").alias("obs_date"), "value")
    df.coalesce(1).write.parquet(f"{folder}/{name}")


def _upsert(spark, base, **options):
    stream = spark.readStream.schema(SCHEMA).parquet(f"{base}/in/*")
    upserts.stream_upsert(stream, f"{base}/table", f"{base}/checkpoint", **options).awaitTermination()


def test_a_later_batch_overrides(spark):
    base = new_table_path(spark, "up")
    _land(spark, f"{base}/in", "1", [("a", "2024-01-01", 1.0), ("a", "2024-01-02", 2.0), ("a", "2024-01-02", 2.0)])
    _upsert(spark, base)
    _land(spark, f"{base}/in", "2", [("a", "2024-01-02", 5.0), ("b", "2024-01-01", None)])
    _upsert(spark, base)
    got = rows(upserts.read_upserted(spark, f"{base}/table"), "obs_date")
    assert [(r["series_id"], r["value"]) for r in got] == [("a", 1.0), ("a", 5.0)]


def test_a_conflict_in_one_batch_fails_it(spark):
    base = new_table_path(spark, "upc")
    _land(spark, f"{base}/in", "1", [("a", "2024-01-01", 1.0), ("a", "2024-01-01", 2.0)])
    with pytest.raises(Exception, match="conflicting rows"):
        _upsert(spark, base)


def test_reads_do_not_grow_with_batches_and_reruns_change_nothing(spark):
    base = new_table_path(spark, "upn")
    counts = []
    for n in range(9):
        _land(spark, f"{base}/in", str(n), [("a", f"2024-01-{n % 4 + 1:02d}", float(n)), ("b", "2024-01-01", float(-n))])
        _upsert(spark, base, every=3)
        counts.append(len(upserts._live(spark, f"{base}/table").inputFiles()))
    assert max(counts) <= 6 and upserts.compacted_through(spark, f"{base}/table") == 8
    got = {(r["series_id"], r["obs_date"].day): r["value"] for r in upserts.read_upserted(spark, f"{base}/table").collect()}
    assert got == {("a", 1): 8.0, ("a", 2): 5.0, ("a", 3): 6.0, ("a", 4): 7.0, ("b", 1): -8.0}
    kept = upserts.Files(spark, f"{base}/table")
    assert kept.numbers("base") == [5, 8] and kept.names("batches") == ["group=2"]
    # All batches once more, from a stream that has forgotten them: the base holds them already.
    again = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")
    upserts.stream_upsert(again, f"{base}/table", f"{base}/other-checkpoint", every=3).awaitTermination()
    assert {(r["series_id"], r["obs_date"].day): r["value"] for r in upserts.read_upserted(spark, f"{base}/table").collect()} == got


def test_an_unfinished_base_is_not_read(spark):
    base = new_table_path(spark, "upf")
    _land(spark, f"{base}/in", "1", [("a", "2024-01-01", 1.0)])
    _upsert(spark, base)
    spark.createDataFrame([("z", dt.date(2024, 1, 1), 9.0, 0)], f"{SCHEMA}, _batch long").write.parquet(f"{base}/table/base/through=0")
    assert [r["series_id"] for r in upserts.read_upserted(spark, f"{base}/table").collect()] == ["a"]


def test_order_beats_arrival(spark):
    base = new_table_path(spark, "upo")
    schema = f"{SCHEMA}, seq int"
    for n, data in enumerate(([("a", dt.date(2024, 1, 1), 7.0, 9)], [("a", dt.date(2024, 1, 1), 1.0, 2), ("a", dt.date(2024, 1, 1), 1.5, 3)])):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{base}/in/{n}")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in/*")
        upserts.stream_upsert(stream, f"{base}/table", f"{base}/checkpoint", order=["seq"]).awaitTermination()
    got = upserts.read_upserted(spark, f"{base}/table", order=["seq"]).collect()
    assert [(r["value"], r["seq"]) for r in got] == [(7.0, 9)]


def test_seen_ids_are_stored_by_chunk(spark):
    """One state entry holds the ids of many rows, whatever characters they have, and repeats are found in it."""
    import json

    from seriesloom.streaming import late_windows

    entries = []

    class Ids:
        def get(self):
            return iter(entries)

        def appendList(self, rows):
            entries.extend(rows)

    class Sums:
        state = None

        def get(self):
            return self.state

        def update(self, value):
            self.state = value

    class Handle:
        def getValueState(self, *_):
            return sums

        def getListState(self, *_):
            return Ids()

        def registerTimer(self, *_):
            pass

    class Times:
        def getCurrentWatermarkInMs(self):
            return 0

    import pandas as pd

    found = {}
    sums = Sums()
    events = spark.createDataFrame([("k", 'a"\n,', 1.0)], "key string, event_id string, value double").withColumn(
        "ts", F.lit("2024-01-01 10:00:00").cast("timestamp"))
    grouped = type(events.groupBy("key"))
    kept, grouped.transformWithStateInPandas = grouped.transformWithStateInPandas, (
        lambda self, **kw: found.update(kw) or events)
    try:
        late_windows.windows_and_late_rows(events, key=["key"], event_id="event_id")
    finally:
        grouped.transformWithStateInPandas = kept
    processor = found["statefulProcessor"]
    processor.init(Handle())
    chunk = pd.DataFrame({"event_id": ['a"\n,', "b", 'a"\n,', None], "at": [1, 2, 3, 4], "units": [1, 2, 4, 8], "valued": [1, 1, 1, 1]})
    for _ in range(2):
        list(processor.handleInputRows(("k", 0, 10**12, 0), iter([chunk]), Times()))
    assert [json.loads(e[0]) for e in entries] == [['a"\n,', "b"]]
    assert sums.state == (1 + 2 + 8 + 8, 4, 4, False)
