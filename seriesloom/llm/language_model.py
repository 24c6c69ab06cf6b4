"""Language-model scores by deleted interpolation of n-gram estimates.

The probability of a word after another mixes the maximum-likelihood bigram
estimate, the maximum-likelihood unigram estimate and a uniform share.  The
mixture depends on how often the context was seen: contexts fall into buckets
by the logarithm of their count, and each bucket has its own weights.  They are
learned by expectation-maximisation on held-out counts, each training
occurrence being deleted from the counts before it is predicted.

Work is cut into blocks of documents by hash.  A block sends the distinct
n-grams it holds, with its own training counts, to the range of the 64-bit
n-gram hash each belongs to; the range adds up all blocks' counts and answers
each block in the order of its request.  So every n-gram of the corpus is
counted, a frequent one costs a block one entry, and no count table is
broadcast or gathered.  Blocks keep their documents as word numbers in the
shared folder between the two passes.  Rows are sorted before they are cut into
blocks, so a repeated task writes the same file again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.tables import LOWEST, open_fs, save, shuffle_partitions
from seriesloom.llm.text import raw_texts, words
from seriesloom.session import new_table_path

BLOCK_TOKENS = 4_000_000  # words of a block's part that are held at once
CONTEXTS = 32  # buckets by the logarithm of the context's count
SPAN = 200_000  # words whose estimates are computed at once
GRID = 8  # bins per power of ten in the held-out histogram
DECADES = 12
EM_ROUNDS = 60
END, START = (xxhash.xxh64_intdigest(x, 7) for x in (b"\n end", b"\n start"))  # no word holds a line end

UNIGRAM, BIGRAM, TOTALS = 0, 1, 2


def is_held_out(id_column: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64-bit hash of word pairs from the words' hashes."""
    with np.errstate(over="ignore"):
        h = first * np.uint64(0x9E3779B97F4A7C15) + second
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest needs, byte plane by byte plane, compressed."""
    wide = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(wide[:, :width].T).tobytes())


def unpack(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(width, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :width] = planes.T
    return wide.reshape(-1).view("<u8")


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=keys[:1] * 0))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw), dtype=np.uint64)


def range_cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """First place of each of ``ranges`` equal parts of the hash range in sorted keys."""
    edges = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def ranked(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes, and each one's place among them in four bytes."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    new = np.empty(len(ordered), bool)
    new[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    places = np.empty(len(ordered), np.int32)
    places[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], places


class Part:
    """Documents of one block, as places in the sorted list of its word hashes."""

    def __init__(self, ids: list, train: np.ndarray, sizes: np.ndarray, vocabulary: np.ndarray, places: np.ndarray) -> None:
        self.ids, self.train, self.sizes, self.vocabulary, self.places = ids, train, sizes, vocabulary, places

    @classmethod
    def of(cls, ids: list, train: list, texts: list[np.ndarray]) -> Part:
        """texts: word hashes of each document, its end included."""
        sizes = np.array([len(t) for t in texts], np.int64)
        hashes = np.concatenate(texts)
        texts.clear()
        vocabulary, places = ranked(hashes)
        return cls(ids, np.array(train, bool), sizes, vocabulary, places)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted pair hashes, and the place of each word's pair among them."""
        hashes = self.vocabulary[self.places]
        before = np.empty_like(hashes)
        before[1:] = hashes[:-1]
        before[np.cumsum(self.sizes) - self.sizes] = START
        return ranked(pair_hash(before, hashes))

    def contexts(self, first: int, last: int, at: int, end: int) -> np.ndarray:
        """Place of the word before each word of a span; -1 at a start."""
        before = np.empty(end - at, np.int32)
        before[1:] = self.places[at : end - 1]
        sizes = self.sizes[first:last]
        before[np.cumsum(sizes) - sizes] = -1
        return before

    def dump(self) -> bytes:
        null = np.array([i is None for i in self.ids], np.uint8)
        ids = np.array([i or 0 for i in self.ids], np.int64)
        parts = [
            ids.tobytes(), null.tobytes(), self.train.astype(np.uint8).tobytes(), pack(self.sizes),
            pack_sorted(self.vocabulary), pack(self.places),
        ]
        head = np.array([len(self.ids), *map(len, parts)], "<i8").tobytes()
        return head + b"".join(parts)

    @classmethod
    def load(cls, raw: bytes) -> Part:
        head = np.frombuffer(raw[:56], "<i8").tolist()
        at, parts = 56, []
        for n in head[1:]:
            parts.append(raw[at : at + n])
            at += n
        ids, null = np.frombuffer(parts[0], np.int64), np.frombuffer(parts[1], np.uint8)
        return cls(
            [None if n else i for i, n in zip(ids.tolist(), null.tolist())], np.frombuffer(parts[2], np.uint8).astype(bool),
            unpack(parts[3]).astype(np.int64), unpack_sorted(parts[4]), unpack(parts[5]).astype(np.int32),
        )

    def spans(self) -> Iterator[tuple[int, int, int, int]]:
        """Consecutive documents of about `SPAN` words, or one longer document: first and last document and word."""
        ends = np.cumsum(self.sizes)
        first = at = 0
        while first < len(ends):
            last = max(first + 1, int(np.searchsorted(ends, at + SPAN, "right")))
            yield first, last, at, int(ends[last - 1])
            first, at = last, int(ends[last - 1])


REQUEST = "range int, kind int, name string, keys binary, counts binary"
ANSWER = "name string, kind int, range int, counts binary, total bigint, known bigint"


def requests(docs: DataFrame, folder: str, *, id_col: str, text_col: str, blocks: int, ranges: int) -> DataFrame:
    """Rows (range, kind, name, keys, counts): what each part of a block asks of each hash range."""
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumn("train", ~is_held_out(F.col("id")))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))
    rows = rows.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", F.coalesce("id", F.lit(LOWEST)), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        block, number, ids, train, texts, held = None, 0, [], [], [], 0
        digest = xxhash.xxh64_intdigest

        def ask(keys: np.ndarray, inverse: np.ndarray, mask: np.ndarray, kind: int, name: str) -> pa.RecordBatch:
            counts = np.bincount(inverse[mask], minlength=len(keys))
            cuts = range_cuts(keys, ranges)
            some = np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()
            return pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array([kind] * len(some), pa.int32()), pa.array([name] * len(some)),
                 pa.array([pack_sorted(keys[cuts[k] : cuts[k + 1]]) for k in some], pa.binary()),
                 pa.array([pack(counts[cuts[k] : cuts[k + 1]]) for k in some], pa.binary())],
                ["range", "kind", "name", "keys", "counts"],
            )

        def flush() -> Iterator[pa.RecordBatch]:
            part, name = Part.of(ids, train, texts), f"{block:06d}-{number:04d}"
            aside = f"{base}/{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(aside, compression=None) as out:
                out.write(part.dump())
            fs.move(aside, f"{base}/{name}")
            mask = np.repeat(part.train, part.sizes)
            yield ask(part.vocabulary, part.places, mask, UNIGRAM, name)
            yield ask(*part.pairs(), mask, BIGRAM, name)

        for batch in batches:
            for ident, raw, t, b in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), *(batch.column(k).to_pylist() for k in (2, 3))):
                if texts and (b != block or held >= BLOCK_TOKENS):
                    yield from flush()
                    number, ids, train, texts, held = number + 1 if b == block else 0, [], [], [], 0
                block = b
                tokens = words(raw)
                ids.append(ident)
                train.append(t)
                texts.append(np.array([digest(w, 7) for w in tokens] + [END], np.uint64))
                held += len(tokens) + 1
        if texts:
            yield from flush()

    return rows.mapInArrow(run, REQUEST)


def answers(asked: DataFrame, ranges: int) -> DataFrame:
    """Rows (name, kind, range, counts): corpus counts in the order asked; and a row of totals for each range."""
    rows = asked.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "kind", "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def reply() -> Iterator[pa.RecordBatch]:
            at, kind = group
            keys = [unpack_sorted(k) for _, k, _ in held]
            own = np.concatenate([unpack(c) for _, _, c in held]).astype(np.int64)
            distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(distinct), np.int64)
            np.add.at(total, inverse, own)
            every = total[inverse]
            cuts = np.cumsum([0] + [len(k) for k in keys])
            for (name, _, _), a, z in zip(held, cuts, cuts[1:]):
                yield answer(name, kind, at, pack(every[a:z]), 0, 0)
            if kind == UNIGRAM:
                yield answer("", TOTALS, at, b"", int(total.sum()), int((total > 0).sum()))

        def answer(name, kind, at, counts, total, known) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([kind], pa.int32()), pa.array([at], pa.int32()), pa.array([counts], pa.binary()),
                 pa.array([total]), pa.array([known])], ["name", "kind", "range", "counts", "total", "known"],
            )

        for batch in batches:
            for at, kind, name, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if group is not None and group != (at, kind):
                    yield from reply()
                    held = []
                group = (at, kind)
                held.append((name, keys, counts))
        if held:
            yield from reply()

    return rows.mapInArrow(run, ANSWER)


@dataclass
class Totals:
    tokens: int  # training tokens, ends included
    known: int  # distinct training tokens
    starts: int  # training documents


def parts_with_counts(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[tuple[Part, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, its bigram places, unigram counts, bigram counts) from answers sorted by name, kind and range."""
    fs, base = open_fs(folder)

    def load(name: str, counts: dict[int, list[np.ndarray]]):
        with fs.open_input_file(f"{base}/{name}") as file:
            part = Part.load(file.read())
        _, inverse = part.pairs()
        return part, inverse, *(np.concatenate(counts[k]).astype(np.int64) for k in (UNIGRAM, BIGRAM))

    name, counts = None, {UNIGRAM: [], BIGRAM: []}
    for batch in batches:
        for n, kind, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
            if name is not None and n != name:
                yield load(name, counts)
                counts = {UNIGRAM: [], BIGRAM: []}
            name = n
            counts[kind].append(unpack(raw))
    if name is not None:
        yield load(name, counts)


def bucket_of(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, then one bucket for each doubling."""
    return np.minimum(np.frexp(count.astype(float))[1], CONTEXTS - 1)


def learn_weights(histogram: list[tuple[int, int, int, float]], uniform: float) -> np.ndarray:
    """EM per context bucket; rows (bucket, bigram bin, unigram bin, n); weights of bigram, unigram, uniform."""
    weights = np.tile([0.4, 0.5, 0.1], (CONTEXTS, 1))
    weights[0] = [0.0, 0.8, 0.2]
    if not histogram:
        return weights
    bucket, two, one, n = (np.array(c) for c in zip(*histogram))
    value = lambda at: np.where(at < 0, 0.0, 10.0 ** (-(at + 0.5) / GRID))
    p = np.stack([value(two), value(one), np.full(len(n), uniform)], axis=1)
    for _ in range(EM_ROUNDS):
        share = weights[bucket] * p
        total = share.sum(axis=1, keepdims=True)
        share = np.where(total > 0, share / np.maximum(total, 1e-300), 0) * n[:, None]
        new = np.zeros_like(weights)
        for k in range(3):
            new[:, k] = np.bincount(bucket, share[:, k], CONTEXTS)
        # One token's worth of the previous weights keeps empty buckets and zero weights off the edge.
        weights = (new + weights) / (new.sum(axis=1, keepdims=True) + 1)
    return weights


def _estimates(
    part: Part, span: tuple[int, int, int, int], pair: np.ndarray, uni: np.ndarray, two: np.ndarray, totals: Totals, deleted: int
):
    """Bigram and unigram estimates and context bucket of a span's words, after ``deleted`` occurrences are taken out."""
    before, (_, _, at, end) = part.contexts(*span), span
    context = np.where(before < 0, totals.starts, uni[before]) - deleted
    both, single = two[pair[at:end]] - deleted, uni[part.places[at:end]] - deleted
    p2 = np.where(context > 0, both / np.maximum(context, 1), 0.0)
    p1 = single / max(1, totals.tokens - deleted)
    return p2, p1, bucket_of(np.maximum(context, 0))


ROW = (
    "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
)


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: token counts, base score and the model's log10 probability.

    Null and empty texts are the end alone.  Null ids train and are not held
    out.  Repeated rows count and are scored each.  Without training rows the
    counts are zero and only the uniform share is left.  Other columns are
    ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    folder = new_table_path(spark, "lm-blocks")
    ranges = shuffle_partitions(spark)
    blocks = max(1, ranges // 2)
    asked = requests(docs, folder, id_col=id_col, text_col=text_col, blocks=blocks, ranges=ranges)
    told = save(answers(asked, ranges), "lm-answers")
    sums = told.where(F.col("kind") == TOTALS).agg(F.sum("total").alias("n"), F.sum("known").alias("v")).first()
    starts = docs.where(~is_held_out(F.col(id_col))).count()
    totals = Totals(int(sums["n"] or 0), int(sums["v"] or 0), starts)
    uniform = 1 / (totals.known + 1)
    by_part = told.where(F.col("kind") != TOTALS)

    def in_order(rows: DataFrame) -> DataFrame:
        return rows.repartition(blocks, "name").sortWithinPartitions("name", "kind", "range")

    def held_out_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = DECADES * GRID + 1
        table = np.zeros(CONTEXTS * size * size, np.int64)
        for part, pair, uni, two in parts_with_counts(batches, folder):

            def bins(p: np.ndarray) -> np.ndarray:
                with np.errstate(divide="ignore"):
                    at = np.floor(-np.log10(p) * GRID)
                return np.where(p > 0, np.clip(at, 0, size - 2), -1).astype(np.int64) + 1

            for span in part.spans():
                mask = np.repeat(part.train[span[0] : span[1]], part.sizes[span[0] : span[1]])
                p2, p1, bucket = (x[mask] for x in _estimates(part, span, pair, uni, two, totals, 1))
                np.add.at(table, (bucket * size + bins(p2)) * size + bins(p1), 1)
        cells = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells // (size * size)), pa.array(cells // size % size - 1), pa.array(cells % size - 1),
             pa.array(table[cells])], ["bucket", "two", "one", "n"],
        )

    # Every training word of every block; the sums don't depend on how documents were cut into blocks.
    histogram = (
        in_order(by_part).mapInArrow(held_out_counts, "bucket bigint, two bigint, one bigint, n bigint")
        .groupBy("bucket", "two", "one").agg(F.sum("n").alias("n")).collect()
    )
    weights = learn_weights([tuple(r) for r in histogram], uniform)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in ROW.split(", ")]
        for part, pair, uni, two in parts_with_counts(batches, folder):
            for span in part.spans():
                first, last, at, end = span
                p2, p1, bucket = _estimates(part, span, pair, uni, two, totals, 0)
                mixed = np.log10(weights[bucket, 0] * p2 + weights[bucket, 1] * p1 + weights[bucket, 2] * uniform)
                own = uni[part.places[at:end]]
                plain = np.log10((own + 1) / (totals.tokens + totals.known + 1))
                sizes, n = part.sizes[first:last], last - first
                start = np.cumsum(sizes) - sizes
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.ids[first:last], pa.int64()), pa.array(~part.train[first:last]), pa.array(sizes),
                     pa.array(np.add.reduceat((own > 0).astype(np.int64), start)), pa.array(np.full(n, totals.tokens)),
                     pa.array(np.add.reduceat(plain, start)), pa.array(np.add.reduceat(mixed, start))], names,
                )

    return in_order(by_part).mapInArrow(score, ROW)
