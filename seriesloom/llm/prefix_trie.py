"""Prefix trie of conversations, screened by a count-min sketch.

A node is a distinct sequence of first turns.  Its key is a digest of that
sequence which can be carried on: D(0) = 0, D(d) = D(d-1) * BASE + digest of
turn d, modulo the prime 2^127 - 1.  Runs of turns can therefore be digested in
parallel and put together afterwards, so a conversation of any length spreads
over many tasks.

All keys are counted in a count-min sketch.  A key that the sketch estimates at
one occurs once: its node has one member, and everything about it is known in
the row itself, so it is emitted on the spot.  Only keys with a higher estimate
shuffle, and are grouped exactly.  The sketch has a fixed largest size; beyond
it more single nodes shuffle, and the result is the same.

Sums over a subtree need no walk.  Let ``r`` be the first depth at which a
conversation is the smallest member of its node; it is so at all greater depths
too.  Then each conversation counts for exactly the nodes from depth r on, and
in a node at depth d it adds: a child if it is longer than d and r <= d + 1; a
leaf if its last node is childless and it is that node's smallest member; and
as text that it shares with smaller members, the turns from d to r - 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.tables import open_fs, save, shuffle_partitions
from seriesloom.session import new_table_path

PRIME = (1 << 127) - 1
BASE = 0x5DEECE66D1A2B3C4D5E6F708192A3B4D  # any large number
MASK = (1 << 64) - 1
SKETCH_ROWS = 3
WIDEST = 1 << 26  # cells a row; two bits each make 50 MB in all
SEGMENT = 1 << 16  # cells
END_BLOCK = 4096  # ids listed in one row
NO_ENDS = hashlib.sha256(b"").hexdigest()

# --- numbers and digests along runs ------------------------------------------


def _halves(values: list[int]) -> tuple[pa.Array, pa.Array]:
    """A number below 2^127 as two signed 64-bit columns."""
    a = np.array([v >> 64 for v in values], np.uint64).view(np.int64)
    return pa.array(a), pa.array(np.array([v & MASK for v in values], np.uint64).view(np.int64))


def _whole(high: pa.Array, low: pa.Array) -> list[int]:
    a, b = (x.to_numpy(zero_copy_only=False).view(np.uint64).tolist() for x in (high, low))
    return [(x << 64) | y for x, y in zip(a, b)]


RUN = "place bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, before bigint, last boolean"


def _fold(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    """Over sorted rows (key, digest, chars, ...): each row's place in its run within this task, digests, characters before it.

    ``last`` is false while the next row continues the run; a run's last row in
    the task has null where the task ends.
    """
    key, state = None, (0, 0, 0)
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").to_pylist()
        digests, chars = batch.column("digest").to_pylist(), batch.column("chars").to_pylist()
        place, now, prior, before = [], [], [], []
        n, d, c = state
        for k, m, size in zip(keys, digests, chars):
            if k != key:
                key, n, d, c = k, 0, 0, 0
            place.append(n)
            prior.append(d)
            before.append(c)
            d = (d * BASE + int.from_bytes(m, "big")) % PRIME
            now.append(d)
            n, c = n + 1, c + size
        state = (n, d, c)
        if held is not None:
            yield held(keys[0])
        ends = [a != b for a, b in zip(keys, keys[1:])]
        columns = [batch.column(x) for x in keep]
        numbers = [pa.array(place, pa.int64()), *_halves(now), *_halves(prior), pa.array(before, pa.int64())]

        def held(following, columns=columns, numbers=numbers, ends=ends, final=keys[-1]):
            after = [None if following is None else following != final]
            return pa.RecordBatch.from_arrays(
                [*columns, *numbers, pa.array(ends + after, pa.bool_())],
                names=keep + ["place", "k1", "k2", "p1", "p2", "before", "last"],
            )

    if held is not None:
        yield held(None)


def runs(rows: DataFrame, order: list, keep: str) -> DataFrame:
    """Rows (key, digest, chars, ...) with their place in their key's run and the digests of the run up to them.

    ``keep`` is the schema of the columns to return, ``key`` and ``chars`` (bigint) among
    them; RUN is added.  Rows are dealt by ranges of (key, order), so a run can
    span many tasks; a sample of these columns reaches the driver, so they must
    be short.  What came before a task's first run is added afterwards,
    from one row per task.  The result is a written table.
    """
    names = [c.split()[0] for c in keep.split(", ")]
    n = shuffle_partitions(rows.sparkSession)
    dealt = rows.repartitionByRange(n, "key", *order).sortWithinPartitions("key", *order)
    parts = dealt.withColumn("part", F.spark_partition_id())
    columns = names + ["part"]
    found = save(
        parts.select(*columns, "digest").mapInArrow(lambda it: _fold(it, columns), f"{keep}, part int, {RUN}"), "runs"
    )
    total = F.struct("key", "place", "k1", "k2", (F.col("before") + F.col("chars")).alias("chars"))
    ends = found.groupBy("part").agg(F.min("key").alias("first"), F.max(total).alias("end")).collect()
    carry, before = {}, None
    for r in sorted(ends, key=lambda r: r["part"]):
        e = r["end"]
        n, d, c = e["place"] + 1, ((e["k1"] & MASK) << 64) | (e["k2"] & MASK), e["chars"]
        if before is not None:
            carry[before[0]]["continued"] = before[1][0] == r["first"]
        carried = before[1][1] if before is not None and before[1][0] == r["first"] else (0, 0, 0)
        carry[r["part"]] = {"first": r["first"], "state": carried, "end": e["key"], "continued": False}
        if e["key"] == r["first"]:
            n, d, c = carried[0] + n, (carried[1] * pow(BASE, n, PRIME) + d) % PRIME, carried[2] + c
        before = (r["part"], (e["key"], (n, d, c)))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, part = batch.column("key").to_pylist(), batch.column("part").to_pylist()
            place, before = batch.column("place").to_pylist(), batch.column("before").to_pylist()
            now = _whole(batch.column("k1"), batch.column("k2"))
            prior = _whole(batch.column("p1"), batch.column("p2"))
            last = batch.column("last").to_pylist()
            for i, (k, p) in enumerate(zip(keys, part)):
                c = carry[p]
                if last[i] is None:
                    last[i] = not c["continued"]
                if k == c["first"] and c["state"][0]:
                    n, d, size = c["state"]
                    power = pow(BASE, place[i], PRIME)
                    prior[i] = (prior[i] + d * power) % PRIME
                    now[i] = (now[i] + d * power * BASE) % PRIME
                    place[i] += n
                    before[i] += size
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(x) for x in names], pa.array(place, pa.int64()), *_halves(now), *_halves(prior),
                    pa.array(before, pa.int64()), pa.array(last, pa.bool_()),
                ],
                names=names + ["place", "k1", "k2", "p1", "p2", "before", "last"],
            )

    return found.mapInArrow(join, f"{keep}, {RUN}")


def turn_digest(role: Column, text: Column) -> Column:
    """128 bits of role and text; the role's length keeps the two apart."""
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


# --- count-min sketch ---------------------------------------------------------


def _cells(high: np.ndarray, low: np.ndarray, row: int, width: int) -> np.ndarray:
    mixed = high.view(np.uint64) + np.uint64(2 * row + 1) * low.view(np.uint64)
    return ((mixed ^ (mixed >> np.uint64(32))) & np.uint64(width - 1)).astype(np.int64)


def _count(width: int):
    """Arrow batches of keys to the segments of this task's sketch that hold anything: bits of 1 or more, bits of 2 or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, more = (np.zeros((SKETCH_ROWS, width // 8), np.uint8) for _ in range(2))
        for batch in batches:
            high, low = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for row in range(SKETCH_ROWS):
                cell, times = np.unique(_cells(high, low, row, width), return_counts=True)
                at, bit = cell >> 3, np.left_shift(1, cell & 7).astype(np.uint8)
                again = (times > 1) | (some[row][at] & bit > 0)
                np.bitwise_or.at(more[row], at[again], bit[again])
                np.bitwise_or.at(some[row], at, bit)
        step = min(width, SEGMENT) // 8
        for row in range(SKETCH_ROWS):
            for at in range(0, width // 8, step):
                if some[row][at : at + step].any():
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row], pa.int32()), pa.array([at], pa.int64()),
                            pa.array([some[row][at : at + step].tobytes()], pa.binary()),
                            pa.array([more[row][at : at + step].tobytes()], pa.binary()),
                        ],
                        names=["line", "start", "some", "more"],
                    )

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted segments to one per place: 2 or more in all is 2 in one, or 1 in two."""
    def out(key, some, more):
        arrays = [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64())]
        return pa.RecordBatch.from_arrays(
            arrays + [pa.array([x.tobytes()], pa.binary()) for x in (some, more)], names=["line", "start", "some", "more"]
        )

    key = None
    for batch in batches:
        for r in batch.to_pylist():
            a, b = np.frombuffer(r["some"], np.uint8), np.frombuffer(r["more"], np.uint8)
            if (r["line"], r["start"]) != key:
                if key is not None:
                    yield out(key, some, more)
                key, some, more = (r["line"], r["start"]), a, b
            else:
                some, more = some | a, more | b | (some & a)
    if key is not None:
        yield out(key, some, more)


def sketch(keys: DataFrame, width: int) -> str:
    """Count the rows (k1, k2) in a sketch of ``width`` cells a line, and return the path of its table.

    Each task counts its own rows; segments are put together by their place.
    """
    n = shuffle_partitions(keys.sparkSession)
    schema = "line int, start bigint, some binary, more binary"
    parts = keys.select("k1", "k2").coalesce(n).mapInArrow(_count(width), schema)
    merged = parts.repartition(n, "line", "start").sortWithinPartitions("line", "start").mapInArrow(_merge, schema)
    path = new_table_path(keys.sparkSession, "prefix-sketch")
    merged.write.parquet(path)
    return path


_LOADED: dict[str, np.ndarray] = {}


def _more_than_one(path: str, width: int) -> np.ndarray:
    """Bits of cells counted 2 or more, read from the shared folder once per worker."""
    if path not in _LOADED:
        _LOADED.clear()
        bits = np.zeros((SKETCH_ROWS, width // 8), np.uint8)
        files, root = open_fs(path)
        for info in files.get_file_info(pafs.FileSelector(root)):
            if info.path.endswith(".parquet"):
                for r in pq.read_table(info.path, filesystem=files, columns=["line", "start", "more"]).to_pylist():
                    more = np.frombuffer(r["more"], np.uint8)
                    bits[r["line"], r["start"] : r["start"] + len(more)] = more
        _LOADED[path] = bits
    return _LOADED[path]


def _screen(path: str, width: int, pairs: list[tuple[str, str]], names: list[str]):
    """Add for each pair of key columns whether the sketch proves the key single."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _more_than_one(path, width)
        for batch in batches:
            flags = []
            for a, b in pairs:
                high, low = (batch.column(x).to_numpy(zero_copy_only=False) for x in (a, b))
                single = np.zeros(batch.num_rows, bool)
                for row in range(SKETCH_ROWS):
                    cell = _cells(high, low, row, width)
                    single |= (bits[row][cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 0
                flags.append(pa.array(single))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *flags], names=batch.schema.names + names
            )

    return run


# --- the trie -----------------------------------------------------------------


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (d, k1, k2, block, ids) to one SHA-256 per key, fed block by block."""
    key, digest = None, None
    rows: list[tuple] = []

    def flush():
        out = pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)] + [pa.array([r[3] for r in rows], pa.string())],
            names=["d", "k1", "k2", "ends_sha256"],
        )
        rows.clear()
        return out

    for batch in batches:
        for d, a, b, ids in zip(*(batch.column(x).to_pylist() for x in ("d", "k1", "k2", "ids"))):
            if (d, a, b) != key:
                if key is not None:
                    rows.append((*key, digest.hexdigest()))
                key, digest = (d, a, b), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if len(rows) > 10_000:
            yield flush()
    if key is not None:
        rows.append((*key, digest.hexdigest()))
    yield flush()


def ended(rows: DataFrame) -> DataFrame:
    """Rows (d, k1, k2, c) of conversations that end at a node: per node the digest of their ids, ascending.

    Ids are listed by blocks of `END_BLOCK` consecutive numbers, so a node where
    very many end is read as few, short rows, one after another.
    """
    n = shuffle_partitions(rows.sparkSession)
    lists = rows.groupBy("d", "k1", "k2", F.floor(F.col("c") / END_BLOCK).alias("block")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda x: x.cast("string")), ",").alias("ids")
    )
    return (
        lists.repartition(n, "d", "k1", "k2").sortWithinPartitions("d", "k1", "k2", "block")
        .mapInArrow(_ends, "d bigint, k1 bigint, k2 bigint, ends_sha256 string")
    )


def prefixes(turns: DataFrame, *, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """A row per conversation and depth from 1: c, d, key, parent's key, characters of the turn and before it, whether it is the last."""
    role, text = (F.coalesce(F.col(x), F.lit("")) for x in (role_col, text_col))
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("key"), F.col(turn_col).alias("turn"), turn_digest(role, text).alias("digest"),
        F.char_length(text).cast("bigint").alias("chars"),
    )
    return runs(rows, [F.col("turn").asc_nulls_first(), "digest"], "key bigint, chars bigint").select(
        F.col("key").alias("c"), (F.col("place") + 1).alias("d"), "k1", "k2", "p1", "p2", "chars", "before", "last"
    )


def prefix_trie(
    turns: DataFrame, conversations: DataFrame | None = None, *, conv_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text", widest: int = WIDEST,
) -> DataFrame:
    """Rows (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one per node.

    Turns are ordered by ``turn_col``, null first; equal numbers by `turn_digest`.  A
    null role or text is empty.  Turns without a conversation's id belong to
    none.  ``conversations`` may name (in ``conv_col``) more conversations,
    which have no turns and end at the root; its nulls and repeats count for
    nothing.  Without any conversation there is no root and no row.  Other
    columns aren't read.  ``saved_tokens`` counts code points.
    """
    found = save(prefixes(turns, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col), "prefixes")
    roots = found.where("d = 1").select("c", F.lit(False).alias("last"))
    if conversations is not None:
        ids = conversations.select(F.col(conv_col).cast("bigint").alias("c")).where("c IS NOT NULL").distinct()
        roots = roots.union(ids.join(roots, "c", "left_anti").select("c", F.lit(True).alias("last")))

    width = 1 << max(12, min(widest.bit_length() - 1, (2 * found.count()).bit_length()))
    path = sketch(found, width)
    schema = "c bigint, d bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, chars bigint, before bigint, last boolean"
    screen = _screen(path, width, [("k1", "k2"), ("p1", "p2")], ["single", "single_parent"])
    screened = save(found.mapInArrow(screen, f"{schema}, single boolean, single_parent boolean"), "screened")

    # A prefix that occurs once is its own node, and the smallest member of it.  The root is no prefix of the sketch.
    single = screened.where("single").withColumn("known_parent", F.col("single_parent") & (F.col("d") > 1))
    zero = F.lit(0).cast("bigint")
    shared = save(
        screened.where("NOT single").drop("single", "single_parent").unionByName(
            roots.select(
                "c", zero.alias("d"), zero.alias("k1"), zero.alias("k2"), zero.alias("p1"), zero.alias("p2"),
                zero.alias("chars"), zero.alias("before"), "last",
            )
        ),
        "shared-prefixes",
    )
    key = ["d", "k1", "k2"]
    nodes = save(
        shared.groupBy(*key).agg(
            F.min("c").alias("c"), F.count(F.lit(1)).alias("n_convs"), F.min("last").alias("leaf"),
            F.max("before").alias("before"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
        ),
        "shared-nodes",
    )
    # Per conversation: the first depth at which it is its node's smallest member, the characters before that depth
    # (all of them, if there is none), and whether it stands for a leaf.
    never = F.lit(2**62)
    firsts = (
        nodes.select("c", F.col("d").alias("r"), F.col("before").alias("until"), "leaf")
        .unionByName(single.where("NOT known_parent").select("c", F.col("d").alias("r"), F.col("before").alias("until"), F.lit(False).alias("leaf")))
        .unionByName(screened.where("last").select("c", never.alias("r"), (F.col("before") + F.col("chars")).alias("until"), F.col("single").alias("leaf")))
        .groupBy("c").agg(F.min("r").alias("r"), F.min_by("until", "r").alias("until"), F.max("leaf").alias("stands"))
    )
    sums = (
        shared.join(firsts.withColumnRenamed("c", "who"), F.col("c") == F.col("who"), "left").groupBy(*key).agg(
            F.sum((~F.col("last") & (F.coalesce("r", never) <= F.col("d") + 1)).cast("bigint")).alias("n_children"),
            F.sum(F.coalesce("stands", F.lit(False)).cast("bigint")).alias("n_leaves"),
            F.sum(F.greatest(F.coalesce("until", zero) - F.col("before"), zero)).alias("saved_tokens"),
        )
    )
    whole = (
        nodes.join(sums, key).join(ended(shared.where("last").select(*key, "c")), key, "left")
        .select(
            F.col("c").alias("conv_id"), F.col("d").alias("depth"), "p1", "p2", "n_convs", "n_children", "n_leaves",
            "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
        )
    )
    alone = single.select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), "p1", "p2", F.lit(1).cast("bigint").alias("n_convs"),
        F.when(F.col("last"), 0).otherwise(1).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"),
        zero.alias("saved_tokens"),
        F.when(F.col("last"), F.sha2(F.col("c").cast("string"), 256)).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
        "known_parent",
    )
    above = nodes.select(
        (F.col("d") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("c").alias("parent_conv_id")
    )
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    top = nodes.where("d = 0").select("c").first()  # the parent of every first turn: no join on one key
    first = F.lit(top["c"] if top else None).cast("bigint")
    asking = whole.unionByName(alone.where("NOT known_parent").drop("known_parent"))
    # A parent that isn't shared was proved single, while the sketch took its child for more: both are of one conversation.
    parent = F.coalesce("parent_conv_id", "conv_id").alias("parent_conv_id")
    return (
        asking.where("depth > 1").join(above, ["depth", "p1", "p2"], "left").select(*[parent if c == "parent_conv_id" else c for c in columns])
        .unionByName(asking.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, first)).select(*columns))
        .unionByName(alone.where("known_parent").withColumn("parent_conv_id", F.col("conv_id")).select(*columns))
    )


def with_host_turns(conversations: DataFrame, *, hosts: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt from the first turns of their host, and all their ids.

    The host of c is c - c % ``hosts``; the first h turns of c, h = crc32(c) %
    ``most``, give way to the host's first h, all it has if fewer.  Rows are
    (conv_id, turn, role, text), turns renumbered from 0.
    """
    role, text = (F.coalesce(F.col(x), F.lit("")).alias(x) for x in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("key"), F.col("turn").alias("turn"), role, text
    ).withColumn("digest", turn_digest(F.col("role"), F.col("text"))).withColumn("chars", F.lit(0).cast("bigint"))
    numbered = save(
        runs(rows, [F.col("turn").asc_nulls_first(), "digest"], "key bigint, chars bigint, role string, text string")
        .select(F.col("key").alias("c"), "place", "role", "text"),
        "numbered-turns",
    )
    h = F.crc32(F.col("c").cast("string").cast("binary")) % most
    ids = numbered.where("place = 0").select("c", h.alias("h"), (F.col("c") - F.col("c") % hosts).alias("host"))
    given = numbered.where((F.col("place") < most - 1) & (F.col("c") % hosts == 0)).select(
        F.col("c").alias("host"), "place", "role", "text"
    )
    lengths = given.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    lead = ids.join(given, "host").where("place < h").select(F.col("c").alias("conv_id"), F.col("place").alias("turn"), "role", "text")
    bases = ids.join(lengths, "host", "left").select("c", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("led"))
    own = numbered.join(bases, "c").where("place >= h").select(
        F.col("c").alias("conv_id"), (F.col("led") + F.col("place") - F.col("h")).alias("turn"), "role", "text"
    )
    return lead.unionByName(own), ids.select(F.col("c").alias("conv_id"))
