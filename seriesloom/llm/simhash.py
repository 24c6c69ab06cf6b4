"""SimHash near-duplicates found through Golay codes.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits.  If two
fingerprints differ in at most four bits, then either some segment is equal, or
every segment has an error and, as 4 = 1 + 1 + 2 at most, two of them have
exactly one.  So two kinds of keys find every pair:

* the value of each segment (no error there);
* for two segments, codeword indices of the perfect binary Golay code (23, 12):
  every 23-bit word lies within three bits of exactly one codeword.  The words
  within one bit of a segment decode to one index or to six (each word three
  bits off its codeword has six).  Two segments one bit apart hold each other's
  own index among their nearby ones, so (own index, nearby index) of one side
  meets (nearby index, own index) of the other.

Rows of equal key are compared and only pairs within four bits become links.
Within a key a spanning forest of the links is kept, which loses no
connection; keys with many fingerprints are cut into blocks and every two
blocks are compared in a task of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesloom.llm.components import components
from seriesloom.llm.tables import save, shuffle_partitions
from seriesloom.llm.text import raw_texts, shingle_hashes, words

SEGMENTS = ((0, 22), (22, 21), (43, 21))  # lowest bit, width
PAIRS = ((0, 1), (0, 2), (1, 2))
GENERATOR = 0xC75  # of the (23, 12) Golay code: x^11+x^10+x^6+x^5+x^4+x^2+1
BLOCK = 4096  # fingerprints of one key that are compared in one task
SHORT = 24  # runs up to this length are compared in one vector operation


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parity of the upper 12 bits; error pattern and its weight for each syndrome."""
    def remainder(value: int) -> int:
        for bit in range(22, 10, -1):
            if value >> bit & 1:
                value ^= GENERATOR << (bit - 11)
        return value

    parity = np.array([remainder(m << 11) for m in range(4096)], np.uint32)
    error = np.zeros(2048, np.uint32)
    single = [1 << i for i in range(23)]
    for a in range(23):
        for b in range(a, 23):
            for c in range(b, 23):
                pattern = single[a] | single[b] | single[c]
                error[remainder(pattern)] = pattern
    error[0] = 0
    return parity, error, np.bitwise_count(error)


def golay_index(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest codeword of each 23-bit word, and the distance to it."""
    parity, error, weight = _golay()
    syndrome = parity[values >> 11] ^ (values & np.uint32(0x7FF))
    return (values ^ error[syndrome]) >> 11, weight[syndrome]


def nearby_indices(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices that the words within one bit decode to, as (row, index) without repeats."""
    flips = np.concatenate([[0], 1 << np.arange(23)]).astype(np.uint32)
    found, _ = golay_index(values[:, None] ^ flips[None, :])
    found.sort(axis=1)
    first = np.ones(found.shape, bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    rows, columns = np.nonzero(first)
    return rows, found[rows, columns]


def keys_of(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each fingerprint, as (row, key)."""
    parts = [((fingerprints >> np.uint64(lo)) & np.uint64((1 << w) - 1)).astype(np.uint32) for lo, w in SEGMENTS]
    own = [golay_index(p)[0] for p in parts]
    near = [nearby_indices(p) for p in parts]
    everyone = np.arange(len(fingerprints))
    rows = [everyone] * 3
    keys = [p.astype(np.int64) | (i << 56) for i, p in enumerate(parts)]
    for tag, (i, j) in enumerate(PAIRS, start=3):
        (ri, ni), (rj, nj) = near[i], near[j]
        left = own[i][rj].astype(np.int64) << 12 | nj
        right = ni.astype(np.int64) << 12 | own[j][ri]
        other = ni != own[i][ri]  # (own, own) is in the left part already
        rows += [rj, ri[other]]
        keys += [left | tag << 56, right[other] | tag << 56]
    return np.concatenate(rows), np.concatenate(keys)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit, lowest first."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 240):  # so few rows add up in a byte
        part = np.ascontiguousarray(hashes[at : at + 240].astype("<u8")).view(np.uint8).reshape(-1, 8)
        ones += np.add.reduce(np.unpackbits(part, axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return ones


def simhash(hashes: np.ndarray) -> int:
    """Bit set where over half the hashes have it; no hash: 0."""
    if not len(hashes):
        return 0
    bits = np.packbits(bit_counts(hashes) * 2 > len(hashes), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """Rows (id, fp): the 64-bit SimHash over all word shingles of each whole text.

    Null or wordless texts have fingerprint 0.  Every input row gives a row.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [simhash(shingle_hashes(words(t), shingle)) for t in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(got, np.uint64).view(np.int64))], ["id", "fp"]
            )

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id bigint, fp bigint"
    )


def forest(values: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect whatever links within ``bits`` connect: one less than members per component."""
    a, b, left = [], [], np.arange(len(values))
    while left.size > 1:
        stack, left = [left[0]], left[1:]
        while stack and left.size:
            u = stack.pop()
            close = np.bitwise_count(values[left] ^ values[u]) <= bits
            if close.any():
                hit = left[close]
                left = left[~close]
                a.append(np.full(hit.size, values[u]))
                b.append(values[hit])
                stack.extend(hit.tolist())
    return a, b


def _links_of_runs(bits: int):
    """Over rows sorted by (key, part): links of each run of equal (key, part)."""
    def links(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
        """key: (n, 2); both sorted by key."""
        cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        start = np.concatenate([[0], cut])
        size = np.diff(np.concatenate([start, [len(fp)]]))
        out_a, out_b = [], []
        small = np.repeat((size > 1) & (size <= SHORT), size)
        end = np.repeat(start + size, size)
        place = np.flatnonzero(small)
        for step in range(1, int(size[(size <= SHORT)].max(initial=1))):
            place = place[place + step < end[place]]
            if not place.size:
                break
            close = np.bitwise_count(fp[place] ^ fp[place + step]) <= bits
            out_a.append(fp[place[close]])
            out_b.append(fp[place[close] + step])
        for r in np.flatnonzero(size > SHORT):
            a, b = forest(np.unique(fp[start[r] : start[r] + size[r]]), bits)
            out_a += a
            out_b += b
        if not out_a:
            return np.empty((0, 2), np.int64)
        pairs = np.stack([np.concatenate(out_a), np.concatenate(out_b)], axis=1).view(np.int64)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        pairs.sort(axis=1)
        return np.unique(pairs, axis=0)

    def batch_of(pairs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.empty((0, 2), np.int64), np.empty(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            more = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            key = np.concatenate([key, more])
            fp = np.concatenate([fp, batch.column(2).to_numpy().view(np.uint64)])
            last = np.flatnonzero((key != key[-1]).any(axis=1))
            whole = last[-1] + 1 if last.size else 0  # the last run may go on
            if whole:
                yield batch_of(links(key[:whole], fp[:whole]))
                key, fp = key[whole:], fp[whole:]
        if len(fp):
            yield batch_of(links(key, fp))

    return run


def links(distinct: DataFrame, *, bits: int = 4, block: int = BLOCK) -> DataFrame:
    """Rows (u, v): links between distinct fingerprints (column fp) that connect all pairs within ``bits``.

    ``bits`` is at most 4.  Keys with more than ``block`` fingerprints are cut
    into blocks of about that size by hash; each two blocks form a part.
    """
    if not 0 <= bits <= 4:
        raise ValueError("the segments find differences of at most 4 bits")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                fp = batch.column(0).slice(at, 20_000).to_numpy().view(np.uint64)
                rows, keys = keys_of(fp)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows].view(np.int64))], ["key", "fp"])

    keys = distinct.select("fp").mapInArrow(emit, "key bigint, fp bigint")
    crowded = save(
        keys.groupBy("key").count().where(F.col("count") > block)
        .select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks")),
        "crowded",
    )
    parts = shuffle_partitions(distinct.sparkSession)
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # A block and another form part low * blocks + high, whichever of the two asks.
    every = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda b: F.least(b, own) * F.col("blocks") + F.greatest(b, own),
    )
    rows = keys.join(crowded, "key", "left").select(
        "key", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(every)).alias("part"), "fp"
    ).withColumn("part", F.col("part").cast("bigint"))
    return rows.repartition(parts, "key", "part").sortWithinPartitions("key", "part").mapInArrow(
        _links_of_runs(bits), "u bigint, v bigint"
    )


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = 4
) -> DataFrame:
    """Rows (id, fp, component_id): component_id is the smallest id reachable over links within ``bits`` bits.

    One row per input row.  Equal texts, repeated rows and wordless texts share
    a fingerprint and so a component.  Null ids stay in the result and never
    name a component unless all its ids are null (then null).  An empty table
    gives an empty one.
    """
    rows = save(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "simhash")
    distinct = save(rows.groupBy("fp").agg(F.min("id").alias("low")), "distinct")
    comp = components(links(distinct, bits=bits)).select(
        F.col("node").alias("fp"), F.col("component").alias("c")
    )
    named = distinct.join(comp, "fp", "left").select("fp", "low", F.coalesce("c", "fp").alias("c"))
    lowest = named.groupBy("c").agg(F.min("low").alias("component_id"))
    of = save(named.join(lowest, "c").select("fp", "component_id"), "of")
    return rows.join(of, "fp").select("id", "fp", "component_id")


# --- near copies by resemblance ---------------------------------------------

RESEMBLANCE = 0.8  # common distinct shingles over all distinct shingles of the two
BANDS, ROWS = 32, 5  # a pair of resemblance s meets in no band with probability (1 - s^5)^32: 3.0e-6 at 0.8
PHASES = (1, 2, 6, 24)  # SimHash neighbourhood, then bands, asked one after another, so that later ones hardly repeat links
AGREE = 96  # of the 160 minima, at least; a pair of resemblance 0.8 has fewer with probability 2e-9
RUN_ROWS, RUN_BYTES = 1024, 16_000_000  # of one key, compared in one task
_MULTIPLIERS = np.random.default_rng(20).integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def minima(hashes: np.ndarray) -> np.ndarray:
    """Smallest product of any hash with each multiplier: two sets agree in each with the probability of their resemblance."""
    best = np.full(len(_MULTIPLIERS), np.uint64(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 512):  # stays in the cache
            np.minimum(best, (_MULTIPLIERS[:, None] * hashes[None, at : at + 512]).min(axis=1), out=best)
    return best


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Exact, of two sorted arrays of distinct hashes; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    total = len(a) + len(b) - both
    return both / total if total else 1.0


def signatures(docs: DataFrame, *, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Rows (id, th, node, size, sig, keys, fp): hash of the text, 128-bit hash of its shingle set, bytes of the text,
    a byte of each minimum, a key of each band, and the SimHash.  No word: no keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, sigs, keys, fps = [], [], [], [], []
            for raw in raw_texts(batch.column(1)):
                every = shingle_hashes(words(raw), shingle)
                fps.append(simhash(every))
                hashes = np.unique(every)
                nodes.append(xxhash.xxh3_128_digest(hashes.astype("<u8").tobytes()))
                sizes.append(len(raw))
                best = minima(hashes)
                sigs.append((best & np.uint64(0xFF)).astype(np.uint8).tobytes())
                bands = best.astype("<u8").reshape(BANDS, ROWS)
                keys.append([xxhash.xxh64_intdigest(b.tobytes(), k) - (1 << 63) for k, b in enumerate(bands)] if len(hashes) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(np.array(fps, np.uint64).view(np.int64))],
                ["id", "th", "node", "size", "sig", "keys", "fp"],
            )

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select("id", "text", F.xxhash64("text").alias("th")).mapInArrow(
        run, "id bigint, th bigint, node binary, size bigint, sig binary, keys array<bigint>, fp bigint"
    )


def linked(labels: np.ndarray, sigs: np.ndarray, texts: list[bytes], shingle: int, least: float) -> list[tuple[int, int]]:
    """Pairs of labels that connect all rows of resemblance ``least`` or more; equal labels are connected before."""
    sets: dict[int, np.ndarray] = {}

    def set_of(k: int) -> np.ndarray:
        if k not in sets:
            sets[k] = np.unique(shingle_hashes(words(texts[k]), shingle))
        return sets[k]

    out, left = [], np.arange(len(labels))
    while left.size > 1:
        stack, left = [int(left[0])], left[1:]
        while stack and left.size:
            u = stack.pop()
            close = labels[left] == labels[u]
            maybe = ~close & (np.count_nonzero(sigs[left] == sigs[u], axis=1) >= AGREE)
            new = set()
            for k in np.flatnonzero(maybe).tolist():
                v = int(left[k])
                if labels[v] in new:
                    close[k] = True  # comes with another of its label
                elif resemblance(set_of(u), set_of(v)) >= least:
                    close[k] = True
                    new.add(labels[v])
                    out.append((int(labels[u]), int(labels[v])))
            stack.extend(left[close].tolist())
            left = left[~close]
    return out


def near_links(nodes: DataFrame, texts: DataFrame, *, shingle: int, least: float) -> DataFrame:
    """Rows (u, v): labels of nodes (node, label, size, sig, keys) that share a key and have the resemblance.

    Each is compared with the other on all shingles of both texts (node, text).
    Only keys that two labels share are looked at.  Per key a spanning forest of
    the links is kept; crowded keys are cut into blocks as in ``links``.
    """
    rows = nodes.select("node", "label", "size", F.explode("keys").alias("key"))
    shared = save(
        rows.groupBy("key").agg(
            F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"), F.sum("size").alias("bytes")
        ).where("lo < hi").select(
            "key", F.ceil(F.greatest(F.col("n") / RUN_ROWS, F.col("bytes") / RUN_BYTES)).cast("int").alias("blocks")
        ), "shared-keys",
    )
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    every = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.least(k, own).cast("bigint") * F.col("blocks") + F.greatest(k, own),
    )
    # A row per node with the places it is asked at, so a text is joined once.
    asked = rows.join(shared, "key").select("node", F.struct("key", every.alias("parts")).alias("place"))
    asked = asked.groupBy("node").agg(F.collect_list("place").alias("places"))  # at most one for each band
    found = asked.join(nodes.select("node", "label", "sig"), "node").join(texts, "node")
    found = found.select("label", "sig", "text", F.explode("places").alias("place")).select(
        F.col("place.key").alias("key"), F.explode("place.parts").alias("part"), "label", "sig", "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, labels, sigs, raws = None, [], [], []

        def links_of() -> pa.RecordBatch:
            table = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), -1)
            pairs = linked(np.array(labels, np.int64), table, raws, shingle, least)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in range(2)], ["u", "v"])

        for batch in batches:
            for key, part, label, sig, raw in zip(*(batch.column(k).to_pylist() for k in range(4)), raw_texts(batch.column(4))):
                if group is not None and group != (key, part):
                    yield links_of()
                    labels, sigs, raws = [], [], []
                group = (key, part)
                labels.append(label)
                sigs.append(sig)
                raws.append(raw)
        if raws:
            yield links_of()

    return found.repartition(shuffle_partitions(nodes.sparkSession), "key", "part").sortWithinPartitions("key", "part").mapInArrow(
        run, "u bigint, v bigint"
    )


def _joined(nodes: DataFrame, comp: DataFrame) -> DataFrame:
    """The nodes with their label replaced by the smallest it reaches."""
    comp = save(comp, "groups").select(F.col("node").alias("label"), F.col("component").alias("low"))
    return nodes.join(comp, "label", "left").select("node", "size", "sig", "keys", F.coalesce("low", "label").alias("label"))


def with_neighbourhood(nodes: DataFrame, *, bits: int = 4) -> DataFrame:
    """The nodes with one more key before the others: that of all fingerprints reached over links within ``bits`` bits."""
    distinct = save(nodes.where(F.size("keys") > 0).select("fp").distinct(), "distinct")
    near = save(components(links(distinct, bits=bits)), "neighbourhoods").select(F.col("node").alias("fp"), "component")
    return nodes.join(near, "fp", "left").select(
        "node", "dedup_null", "dedup_id", "dedup_th", "size", "sig",
        F.when(F.size("keys") > 0, F.concat(F.array(F.xxhash64(F.coalesce("component", "fp"))), "keys")).otherwise(F.col("keys")).alias("keys"),
    )


def keep_one(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = RESEMBLANCE,
) -> DataFrame:
    """The documents, all columns, one of each group of near copies.

    Two documents are linked when their sets of shingles have the resemblance
    ``least`` or more, computed from all shingles of both.  Candidates are first
    the texts whose SimHashes are connected within four bits, found through the
    Golay codes as in ``near_duplicates``.  As four bits find only some pairs of
    0.8, texts that agree in all minima of some band are candidates too: a pair
    of resemblance 0.8 is missed with a probability of at most 3.0e-6, one above
    with less; ``least`` below 0.8 is refused, as that is not so there.  A group
    is what links connect.
    Of a group the smallest id stays, of equal ids the text with the smallest
    hash, of equal rows one; null ids stay only where a group has no other.
    Wordless documents are one group.  Columns may have any names.
    """
    if least < RESEMBLANCE:
        raise ValueError("the bands are made for a resemblance of 0.8 or more")
    own = save(signatures(docs, id_col=id_col, text_col=text_col, shingle=shingle), "signatures")
    ident = F.col(id_col).cast("bigint")
    # The row travels as one column, so no column of its can meet a name used here.
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("dedup_row"), ident.isNull().alias("dedup_null"),
        F.coalesce(ident, F.lit(0)).alias("dedup_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("dedup_th"),
    )
    first = F.struct(
        F.col("id").isNull().alias("dedup_null"), F.coalesce("id", F.lit(0)).alias("dedup_id"), F.col("th").alias("dedup_th"),
        "size", "sig", "keys", "fp",
    )
    nodes = save(own.groupBy("node").agg(F.min(first).alias("first")).select("node", "first.*"), "nodes")
    nodes = save(with_neighbourhood(nodes), "nodes-with-neighbourhood")
    # Only nodes that share a key with another go on, each with one of its texts.
    keys = nodes.select("node", F.explode("keys").alias("key"))
    several = keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    some = save(nodes.join(keys.join(several, "key").select("node").distinct(), "node"), "candidates")
    place = ["dedup_null", "dedup_id", "dedup_th"]
    texts = save(
        rows.select(*place, F.col("dedup_row")[text_col].alias("text")).join(some.select("node", *place), place)
        .groupBy("node").agg(F.any_value("text").alias("text")), "candidate-texts",
    )
    some = some.select("node", "size", "sig", "keys", F.xxhash64("node").alias("label"))
    start = 0
    for width in PHASES:
        asked = some.withColumn("keys", F.slice("keys", start + 1, width))
        some = save(_joined(some, components(near_links(asked, texts, shingle=shingle, least=least))), "nodes")
        start += width
    named = own.select("id", "th", "node").join(some.select("node", "label"), "node", "left").select(
        "id", "th", F.coalesce("label", F.xxhash64("node")).alias("label")
    )
    best = (
        named.groupBy("label")
        .agg(F.min(F.struct(F.col("id").isNull().alias("dedup_null"), F.coalesce("id", F.lit(0)).alias("dedup_id"), F.col("th").alias("dedup_th"))).alias("best"))
        .select("best.*")
    )
    kept = save(best, "kept")
    same = Window.partitionBy(*place).orderBy("dedup_th")
    return (
        rows.join(kept, place).withColumn("dedup_n", F.row_number().over(same))
        .where("dedup_n = 1").select("dedup_row.*")
    )
