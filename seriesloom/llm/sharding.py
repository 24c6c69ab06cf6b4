"""Sharding by fixed virtual slots.

A record's slot is a hash of its id and never changes.  Bytes are summed per
slot, and a table says which shard owns which slot.  That table has versions:
the first deals the slots out evenly, and each edit (`rebalance`, `grow`)
writes a new version that moves some slots and leaves the others where they
are.  Only tables of one row per slot pass through the driver.

Shards have near equal bytes (law ``bytes``).  A rebalancing lets each shard
keep its largest slots as long as they fit its share, releases the rest, and
gives the released slots, largest first, to the shard with the fewest bytes.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.tables import save, shuffle_partitions
from seriesloom.session import new_table_path

SLOTS = 4096
SHARDS = 16
LAW = "bytes"


class SlotMap(NamedTuple):
    """One version of the table: ``shards[slot]`` owns the slot."""

    version: int
    n_shards: int
    shards: tuple[int, ...]


def slot_of(record_id: Column, text: Column, slots: int = SLOTS) -> Column:
    """The slot of a record: a hash of its id; of its text where it has no id, so that such records spread."""
    name = F.coalesce(F.concat(F.lit("i"), record_id.cast("string")), F.concat(F.lit("t"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("bigint") % slots


def size_of(text: Column) -> Column:
    """Bytes a record counts for: its text in UTF-8 and one more; a null text has none."""
    return F.coalesce(F.octet_length(text).cast("bigint"), F.lit(0).cast("bigint")) + 1


def slot_sizes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> list[int]:
    """Bytes of every slot, 0 for an empty one; at most one row per slot reaches the driver."""
    text = F.col(text_col)
    found = (
        docs.select(slot_of(F.col(id_col), text, slots).alias("v"), size_of(text).alias("b"))
        .groupBy("v").agg(F.sum("b").alias("b")).collect()
    )
    sizes = [0] * slots
    for r in found:
        sizes[r["v"]] = r["b"]
    return sizes


def first_map(n_shards: int = SHARDS, slots: int = SLOTS) -> SlotMap:
    """Version 1: the slots dealt out evenly, without any knowledge of their bytes."""
    return SlotMap(1, n_shards, tuple(v % n_shards for v in range(slots)))


def loads(current: SlotMap, sizes: Sequence[int]) -> list[int]:
    """Bytes of every shard."""
    total = [0] * current.n_shards
    for shard, size in zip(current.shards, sizes, strict=True):
        total[shard] += size
    return total


def rebalance(current: SlotMap, sizes: Sequence[int]) -> SlotMap:
    """The next version, with near equal bytes; empty slots and what fits a shard's share stay where they are.

    Ties: the lower slot counts as larger, the lower shard as emptier.  A shard
    always keeps its largest slot, so a slot larger than a share doesn't wander.
    """
    share = sum(sizes) / current.n_shards
    owner, kept, free, count = list(current.shards), [0] * current.n_shards, [], [0] * current.n_shards
    full = [False] * current.n_shards
    for slot in sorted((v for v, b in enumerate(sizes) if b), key=lambda v: (-sizes[v], v)):
        shard = owner[slot]
        full[shard] = full[shard] or (count[shard] > 0 and kept[shard] + sizes[slot] > share)
        if full[shard]:
            free.append(slot)
        else:
            kept[shard] += sizes[slot]
            count[shard] += 1
    heap = [(b, s) for s, b in enumerate(kept)]
    heapq.heapify(heap)
    for slot in free:
        b, shard = heap[0]
        owner[slot] = shard
        heapq.heapreplace(heap, (b + sizes[slot], shard))
    return SlotMap(current.version + 1, current.n_shards, tuple(owner))


def grow(current: SlotMap, sizes: Sequence[int]) -> SlotMap:
    """The next version with one more shard, which takes slots from the fullest shards; no other slot moves."""
    new, share = current.n_shards, sum(sizes) / (current.n_shards + 1)
    owner, held = list(current.shards), loads(current, sizes)
    stock: list[list[int]] = [[] for _ in range(new)]
    for slot in sorted((v for v, b in enumerate(sizes) if b), key=lambda v: (sizes[v], -v)):
        stock[owner[slot]].append(slot)
    heap, got = [(-b, s) for s, b in enumerate(held)], 0
    heapq.heapify(heap)
    while heap:
        b, shard = heapq.heappop(heap)
        while stock[shard] and got + sizes[stock[shard][-1]] > share:
            stock[shard].pop()
        if not stock[shard] or -b <= share:
            continue
        slot = stock[shard].pop()
        owner[slot] = new
        got += sizes[slot]
        heapq.heappush(heap, (b + sizes[slot], shard))
    return SlotMap(current.version + 1, new + 1, tuple(owner))


def store_map(spark: SparkSession, folder: str, current: SlotMap) -> None:
    """Write a version to its own folder; a version that exists is never replaced, so two editors can't both win."""
    rows = spark.createDataFrame(
        [(v, s, current.n_shards) for v, s in enumerate(current.shards)], "slot bigint, shard int, n_shards int"
    )
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{folder}/version-{current.version:09d}")


def load_map(spark: SparkSession, folder: str, version: int) -> SlotMap:
    rows = spark.read.parquet(f"{folder}/version-{version:09d}").orderBy("slot").collect()
    return SlotMap(version, rows[0]["n_shards"], tuple(r["shard"] for r in rows))


def write_shards(
    docs: DataFrame, current: SlotMap, folder: str, *, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Write every record to the folder of its shard and return the files' rows: ``shard``, ``slot``, ``place`` and ``record``.

    ``record`` is a struct of the input's columns, so none can clash.  Within a
    shard records are in order of slot, id and a hash of the text; ``place`` counts them from
    0 without gaps.  Null ids are placed by their text, null and empty texts by
    their id; repeated rows are neighbours; an empty table gives no row.

    Rows are dealt by ranges of that order, so neither a large shard nor a slot
    of many records becomes one task; the places come from the numbers of rows
    per range, of which the driver sees one each.
    """
    spark = docs.sparkSession
    slots = len(current.shards)
    # Written, so that its size is known and the join need not shuffle the records.
    table = save(spark.createDataFrame([(v, s) for v, s in enumerate(current.shards)], "slot bigint, shard int"), "slot-map")
    rows = docs.select(
        slot_of(F.col(id_col), F.col(text_col), slots).alias("slot"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record")
    ).join(table, "slot")
    # Ranges are found from a sample of these keys, which reaches the driver: no text may be among them.
    order = ["shard", "slot", F.col("record")[id_col].asc_nulls_first(), F.xxhash64(F.col("record")[text_col])]
    dealt = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order, F.col("record")[text_col])
    path = f"{folder}/records-{current.version:09d}"
    numbered = dealt.withColumn("n", F.monotonically_increasing_id())
    numbered.write.partitionBy("shard").parquet(path)
    return read_shards(spark, path, numbered.schema)


def read_shards(spark: SparkSession, path: str, schema) -> DataFrame:
    """The records of written shards, each with its place.

    ``n`` holds the range a row was written from and its number in that range.
    Ranges ascend over all shards, so a place is the rows of the ranges before,
    plus that number, less the rows of the shards before.
    """
    files = spark.read.schema(schema).parquet(path).withColumn("part", F.shiftright("n", 33))
    found = files.groupBy("part", "shard").count().collect()
    before, starts, at = {}, {}, 0
    for r in sorted(found, key=lambda r: (r["part"], r["shard"])):
        before.setdefault(r["part"], at)
        starts.setdefault(r["shard"], at)
        at += r["count"]
    firsts = save(
        spark.createDataFrame(
            [(r["part"], r["shard"], before[r["part"]] - starts[r["shard"]]) for r in found], "part bigint, shard int, first bigint"
        ),
        "shard-firsts",
    )
    row = F.col("n").bitwiseAND(F.lit((1 << 33) - 1))
    return files.join(firsts, ["part", "shard"]).select("shard", "slot", (F.col("first") + row).alias("place"), "record")


def shard_documents(
    docs: DataFrame, *, n_shards: int = SHARDS, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text",
    folder: str | None = None,
) -> DataFrame:
    """Shard a table from nothing: version 1 is dealt evenly, version 2 rebalanced by the bytes found, and written.

    Returns the rows of `write_shards`; both versions stay in ``folder``.
    """
    spark = docs.sparkSession
    folder = folder or new_table_path(spark, "shards")
    start = first_map(n_shards, slots)
    store_map(spark, folder, start)
    current = rebalance(start, slot_sizes(docs, id_col=id_col, text_col=text_col, slots=slots))
    store_map(spark, folder, current)
    return write_shards(docs, load_map(spark, folder, current.version), folder, id_col=id_col, text_col=text_col)
