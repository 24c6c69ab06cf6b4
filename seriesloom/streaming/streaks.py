"""Streaks that stay right when days arrive out of order.

A series is kept as blocks of 32 days. A block is three bit masks: days known,
days that add to the streak, days that set it back. What a run of days does to
a streak is one of two things: set it to a number (it holds a reset) or add a
number to it. Such effects combine by `combine`, which is associative, so a
block's effect comes from its masks, and the streak before a block from the
effects of the blocks before it, back to the last reset.

A day that arrives late changes the streak of later days only as far as the
next reset. Exactly those days are emitted again.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seriesloom.operators.clean import latest_by

BLOCK = 32
STREAK_SCHEMA = "series_id string, obs_date date, skipped boolean, streak bigint, change string"
UNTOUCHED = (False, 0)


def combine(first: tuple[bool, int], then: tuple[bool, int]) -> tuple[bool, int]:
    """Effect of two runs of days, one after the other: (holds a reset, days added since it, or in all)."""
    return then if then[0] else (first[0], first[1] + then[1])


def effect(adds: int, resets: int) -> tuple[bool, int]:
    """Effect of the days of one block's masks."""
    if not resets:
        return (False, adds.bit_count())
    return (True, (adds >> resets.bit_length()).bit_count())


def stream_streak(daily: DataFrame) -> DataFrame:
    """Streaks of daily rows (series_id, obs_date, amount, skipped), in any order of arrival.

    A skipped day leaves the streak alone, a day without a positive amount (null
    included) sets it back to zero. ``change`` says why a row is emitted: a
    ``new`` day after all known ones, a ``late`` day before some known one, a
    ``revised`` day whose kind differs from what was known, and days ``shifted``
    because an earlier one came or changed. Repeats of a day change nothing; two
    kinds of one day in one batch count as the one that resets, then adds. Rows
    without series or day are emitted as ``unplaced``. Days before 1970 are
    blocks with negative numbers.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Streak(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.blocks = handle.getMapState("blocks", "block bigint", "known bigint, adds bigint, resets bigint")
            self.ends = handle.getValueState("ends", "first bigint, last bigint, day bigint")

        def handleInputRows(self, key, rows, timerValues) -> Iterator:
            import pandas as pd

            columns = ["series_id", "obs_date", "skipped", "streak", "change"]
            data = pd.concat(list(rows))
            if key[0] is None or data["day"].isna().any():
                lost = data if key[0] is None else data[data["day"].isna()]
                out = pd.DataFrame({"series_id": [key[0]] * len(lost), "obs_date": pd.to_datetime(lost["day"], unit="D").dt.date})
                out["skipped"], out["streak"], out["change"] = lost["kind"].to_numpy() == 0, None, "unplaced"
                yield out
                data = data.drop(lost.index) if key[0] is not None else data.iloc[:0]
            kinds = data.groupby("day")["kind"].max()
            if not len(kinds):
                return
            self.read, self.changed = {}, set()
            self.span = self.ends.get()
            last_day = self.span[2] if self.span else None
            changes = {}
            for day, kind in ((int(d), int(k)) for d, k in kinds.items()):
                block, bit = divmod(day, BLOCK)
                known, adds, resets = self.block(block)
                before = None if not known >> bit & 1 else 2 if resets >> bit & 1 else adds >> bit & 1
                if before == kind:
                    continue
                keep = ~(1 << bit)
                self.read[block] = (known | 1 << bit, adds & keep | (kind == 1) << bit, resets & keep | (kind == 2) << bit)
                self.changed.add(block)
                changes[day] = "revised" if before is not None else "late" if last_day is not None and day < last_day else "new"
                self.span = (
                    (min(self.span[0], block), max(self.span[1], block), max(self.span[2], day)) if self.span else (block, block, day)
                )
            if not changes:
                return
            out = [(key[0], day, *row) for day, row in sorted(self.emitted(changes).items())]
            for block in self.changed:
                self.blocks.updateValue((block,), self.read[block])
            self.ends.update(self.span)
            frame = pd.DataFrame(out, columns=columns)
            frame["obs_date"] = pd.to_datetime(frame["obs_date"], unit="D").dt.date
            yield frame

        def block(self, number: int) -> tuple[int, int, int]:
            if number not in self.read:
                found = self.blocks.getValue((number,)) if self.span and self.span[0] <= number <= self.span[1] else None
                self.read[number] = tuple(found) if found else (0, 0, 0)
            return self.read[number]

        def before(self, number: int) -> int:
            """The streak before a block: effects of earlier blocks, back to the last reset."""
            total = UNTOUCHED
            while number > self.span[0] and not total[0]:
                number -= 1
                _, adds, resets = self.block(number)
                total = combine(effect(adds, resets), total)
            return total[1]

        def emitted(self, changes: dict[int, str]) -> dict[int, tuple]:
            """Rows of the changed days, and of those after each up to the next reset."""
            rows: dict[int, tuple] = {}
            for start in sorted(changes):
                if start in rows and rows[start][2] != "shifted":
                    continue
                block = start // BLOCK
                streak = self.before(block)
                while block <= self.span[1]:
                    known, adds, resets = self.block(block)
                    for bit in range(BLOCK):
                        day = block * BLOCK + bit
                        if not known >> bit & 1:
                            continue
                        reset, add = resets >> bit & 1, adds >> bit & 1
                        streak = 0 if reset else streak + add
                        if day < start:
                            continue
                        if reset and day > start and day not in changes:
                            break
                        rows[day] = (not reset and not add, streak, changes.get(day, "shifted"))
                    else:
                        block += 1
                        continue
                    break
            return rows

        def close(self) -> None:
            pass

    kind = F.when(F.col("skipped"), 0).when(F.col("amount") > 0, 1).otherwise(2)
    rows = daily.select("series_id", F.unix_date("obs_date").alias("day"), kind.alias("kind"))
    return rows.groupBy("series_id").transformWithStateInPandas(
        statefulProcessor=Streak(), outputStructType=STREAK_SCHEMA, outputMode="Update", timeMode="None",
    )


def run_streaks(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Run over the files present; every batch writes its changes to a folder of its own, which a rerun replaces."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def streak_changes(spark: SparkSession, table: str) -> DataFrame:
    """Every emitted row with its batch: the history of corrections."""
    return spark.read.schema(f"{STREAK_SCHEMA}, batch_id bigint").parquet(table)


def read_streaks(spark: SparkSession, table: str) -> DataFrame:
    """The streak of every day as it is known now."""
    placed = streak_changes(spark, table).where("change <> 'unplaced'")
    return latest_by(placed, ["series_id", "obs_date"], ["batch_id"]).drop("batch_id", "change")
