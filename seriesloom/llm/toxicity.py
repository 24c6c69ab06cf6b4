"""Toxicity by nearest labelled examples.

A text becomes a TF-IDF vector over the words and word beginnings that are
associated with the label (chi-square above ``LEAST_CHI``, at least ``LEAST_DF``
examples) among the labelled examples; all of them are kept.  Its nearest examples by cosine are found exactly in an
inverted index in blocks: each term keeps the largest weight of each block, so
a block whose bound can't reach the k-th best similarity is never scored.  The
neighbours vote with the inverse of their distance, and a monotone map fitted
on votes of left-out examples turns the vote into a probability.  The
neighbours themselves are the evidence.

The examples are a bounded sample of the labelled rows, by hash order, up to
``EXAMPLES`` of each label; document frequencies cover all documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.llm.tables import save
from seriesloom.llm.text import alnum_words, raw_texts

EXAMPLES = 8_000  # of each label
PREFIXES = (4, 5, 6)  # bytes of a word's beginning
NEIGHBOURS = 15
BLOCK = 64
GROUP = 8  # blocks that are compared with queries at once
QUERIES_AT_ONCE = 256
LEAST_DF = 4
LEAST_CHI = 15.0  # far above chance for the many candidate terms
BINS = 40
NEAR = 0.05  # keeps the weight of an equal vector finite
SHRINK = 2.0  # examples' worth of the base rate in each vote
CACHED = 100_000


def features_of(word: bytes) -> list[bytes]:
    """The word and its beginnings, told apart by a leading byte."""
    return [b"=" + word] + [b"^" + word[:n] for n in PREFIXES if len(word) >= n]


def is_held_out(id_column: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@dataclass
class Model:
    terms: dict[bytes, int]
    idf: np.ndarray
    prior: float  # probability without any known term
    blocks: int = 0
    block: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # lists by block and term, none empty: block,
    term: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # term,
    most: np.ndarray = field(default_factory=lambda: np.zeros(0))  # largest weight
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # and first posting
    at: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # postings of the lists: example
    held: np.ndarray = field(default_factory=lambda: np.zeros(0))  # and weight
    pos: np.ndarray = field(default_factory=lambda: np.zeros(0))
    neg: np.ndarray = field(default_factory=lambda: np.zeros(0))
    named: list[int] = field(default_factory=list)  # an example of each vector
    vectors: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # its terms and weights
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def __post_init__(self) -> None:
        self._words: dict[bytes, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_words": {}}  # filled anew in each process

    def counts(self, raw: bytes) -> dict[int, int]:
        """Term counts of a text."""
        known, out = self._words, {}
        for w, n in Counter(alnum_words(raw)).items():
            ids = known.get(w)
            if ids is None:
                if len(known) >= CACHED:
                    known.clear()
                ids = known[w] = tuple(self.terms[f] for f in features_of(w) if f in self.terms)
            for t in ids:
                out[t] = out.get(t, 0) + n
        return out

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Terms ascending and weights of length one."""
        terms = np.array(sorted(counts), np.int64)
        weight = (1 + np.log(np.array([counts[t] for t in terms.tolist()], float))) * self.idf[terms]
        return terms, weight / np.sqrt((weight**2).sum()) if len(terms) else weight

    def build(self, rows: list[tuple[int, float, float, np.ndarray, np.ndarray]]) -> None:
        """rows: id, weight if positive, weight if negative, terms, weights; equal vectors become one."""
        merged: dict[bytes, list] = {}
        for ident, p, n, terms, weight in sorted(rows, key=lambda r: (r[3].tolist(), r[4].tolist(), r[0] or 0)):
            if len(terms):
                held = merged.setdefault(terms.tobytes() + weight.tobytes(), [ident, 0.0, 0.0, terms, weight])
                held[1] += p
                held[2] += n
        vectors = list(merged.values())
        self.named, self.vectors = [v[0] for v in vectors], [(v[3], v[4]) for v in vectors]
        self.pos, self.neg = np.array([v[1] for v in vectors]), np.array([v[2] for v in vectors])
        self.blocks, width = -(-len(vectors) // BLOCK), max(1, len(self.terms))
        size = [len(v[3]) for v in vectors]
        example = np.repeat(np.arange(len(vectors)), size)
        term = np.concatenate([v[3] for v in vectors]) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([v[4] for v in vectors]) if vectors else np.zeros(0)
        list_of = example // BLOCK * width + term
        order = np.argsort(list_of, kind="stable")
        self.at, self.held = example[order], weight[order]
        lists, start = np.unique(list_of[order], return_index=True)
        self.block, self.term = lists // width, lists % width
        self.first = np.append(start, len(order)).astype(np.int64)
        self.most = np.maximum.reduceat(self.held, start) if len(start) else np.zeros(0)

    def _group(self, g: int, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Postings of GROUP neighbouring blocks: columns of terms that occur there, and a table of examples by these."""
        last = min((g + 1) * GROUP, self.blocks)
        lo, hi = np.searchsorted(self.block, [g * GROUP, last])
        asked = column[self.term[lo:hi]]
        columns = np.unique(asked[asked >= 0])
        place = np.repeat(np.where(asked >= 0, np.searchsorted(columns, asked), -1), np.diff(self.first[lo : hi + 1]))
        has = place >= 0
        some = slice(self.first[lo], self.first[hi])
        table = np.zeros(((last - g * GROUP) * BLOCK, len(columns)), np.float32)
        table[self.at[some][has] - g * GROUP * BLOCK, place[has]] = self.held[some][has]
        return columns, table

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (terms, weights) the k nearest vectors with a common term, nearest first; exact.

        Groups of blocks are taken by falling bound; a group is compared with
        the queries whose bound there reaches their k-th similarity so far.  Only
        terms of the group and of some query have a column.  The tables are of
        single precision, so a few more than k are kept and their similarities
        computed anew in double precision.
        """
        wide = k + 8
        used = np.unique(np.concatenate([np.zeros(0, np.int64), *(terms for terms, _ in queries)]))
        column = np.full(len(self.terms), -1)
        column[used] = np.arange(len(used))
        dense = np.zeros((len(used), len(queries)))
        for j, (terms, weight) in enumerate(queries):
            dense[column[terms], j] = weight
        best = np.full((wide, len(queries)), -1.0, np.float32)
        best_at = np.zeros((wide, len(queries)), np.int64)
        if len(self.named) and queries:
            single = dense.astype(np.float32)
            most = np.zeros((self.blocks, len(used)), np.float32)
            has = column[self.term] >= 0
            most[self.block[has], column[self.term[has]]] = self.most[has]
            bound = most @ single
            bound = np.maximum.reduceat(bound, np.arange(0, len(bound), GROUP), axis=0)
            for g in np.argsort(-bound.max(axis=1), kind="stable").tolist():
                ask = np.flatnonzero((bound[g] > 0) & (bound[g] >= best[-1] - 1e-5))
                if not ask.size:
                    continue
                columns, table = self._group(g, column)
                sims = table @ single[np.ix_(columns, ask)]
                top = np.argpartition(-sims, min(wide, len(sims)) - 1, axis=0)[:wide]
                both = np.concatenate([best[:, ask], np.take_along_axis(sims, top, axis=0)])
                place = np.concatenate([best_at[:, ask], top + g * GROUP * BLOCK])
                order = np.argsort(-both, axis=0, kind="stable")[:wide]
                best[:, ask] = np.take_along_axis(both, order, axis=0)
                best_at[:, ask] = np.take_along_axis(place, order, axis=0)
        out = []
        for j in range(len(queries)):
            at = np.unique(best_at[:, j][best[:, j] > 0])
            whole = np.append(dense[:, j], 0.0)  # terms without a column: the 0 at the end
            sims = np.array([self.vectors[a][1] @ whole[column[self.vectors[a][0]]] for a in at.tolist()])
            order = np.lexsort((at, -sims))[:k] if len(at) else at
            out.append((at[order], sims[order]))
        return out

    def votes(self, counts: list[dict[int, int]], own: list[tuple[float, float]] | None = None) -> list[tuple[float, tuple]]:
        """Vote in 0..1 and evidence (example, similarity) of each; ``own``: weights to leave out of an equal vector."""
        out: list[tuple[float, tuple]] = [(self.prior, ())] * len(counts)
        asked: dict[bytes, tuple] = {}
        waiting: list[tuple[int, bytes]] = []
        for j, c in enumerate(counts):
            if c:
                terms, weight = self.vector(c)
                key = terms.tobytes() + weight.tobytes()
                asked.setdefault(key, (terms, weight))
                waiting.append((j, key))
        found: dict[bytes, tuple] = {}
        keys = list(asked)
        for lo in range(0, len(keys), QUERIES_AT_ONCE):
            part = keys[lo : lo + QUERIES_AT_ONCE]
            found.update(zip(part, self.nearest([asked[key] for key in part])))
        for j, key in waiting:
            at, sims = found[key]
            pos, neg = self.pos[at].copy(), self.neg[at].copy()
            if own is not None and len(at) and sims[0] > 1 - 1e-9:
                pos[0], neg[0] = max(0.0, pos[0] - own[j][0]), max(0.0, neg[0] - own[j][1])
            # Each vector counts as one voter however many equal examples it stands for.
            size = np.maximum(pos + neg, 1e-12)
            pull = np.where(pos + neg > 1e-9, 1 / (1 - np.minimum(sims, 1.0) + NEAR), 0.0) * np.log1p(size)
            share = (pull * pos / size).sum() + SHRINK * self.prior
            evidence = tuple((self.named[a], float(s)) for a, s in zip(at[:5].tolist(), sims))
            out[j] = (share / (pull.sum() + SHRINK), evidence)
        return out

    def scores(self, raws: list[bytes]) -> list[tuple[float, tuple]]:
        """Probability and evidence of each text."""
        out = []
        for vote, evidence in self.votes([self.counts(raw) for raw in raws]):
            if self.knots is not None:
                vote = float(np.interp(vote, *self.knots))
            out.append((min(1.0, max(0.0, vote)), evidence))
        return out


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted isotonic fit of y over ascending x (pool adjacent violators)."""
    out: list[list[float]] = []
    for value, weight in zip(y, w):
        out.append([value, weight, 1])
        while len(out) > 1 and out[-2][0] > out[-1][0]:
            b, a = out.pop(), out.pop()
            total = a[1] + b[1]
            out.append([(a[0] * a[1] + b[0] * b[1]) / total, total, a[2] + b[2]])
    return np.concatenate([[v] * n for v, _, n in out]) if out else np.empty(0)


def sample_of(labels: DataFrame, *, id_col: str, label_col: str, examples: int) -> DataFrame:
    """Rows (sid, y, weight): up to ``examples`` rows of each label by hash order, weighted to all they stand for.

    Ids that are null or held out, and null labels, are left out; of repeated
    ids the larger label counts.
    """
    rows = labels.select(F.col(id_col).cast("bigint").alias("sid"), F.col(label_col).cast("int").alias("y"))
    rows = rows.where(F.col("sid").isNotNull() & F.col("y").isNotNull() & ~is_held_out(F.col("sid")))
    rows = save(rows.groupBy("sid").agg(F.max("y").alias("y")), "labels")
    total = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = [
        rows.where(F.col("y") == y).orderBy(F.xxhash64("sid"), "sid").limit(examples)
        .withColumn("weight", F.lit(max(1.0, total.get(y, 0) / examples)))
        for y in (0, 1)
    ]
    return save(parts[0].unionAll(parts[1]), "examples")


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    examples: int = EXAMPLES,
) -> Model:
    """Learn from labelled rows that are not held out; document frequencies come from all documents.

    The driver receives the terms that pass both tests in the bounded sample,
    the sample's vectors and at most ``BINS`` calibration points.
    """
    sample = sample_of(labels, id_col=id_col, label_col=label_col, examples=examples)
    texts = docs.select(F.col(id_col).cast("bigint").alias("sid"), F.col(text_col).alias("text"))
    # At most 2 x examples rows of three numbers: a bounded broadcast.
    chosen = save(texts.join(F.broadcast(sample), "sid"), "example-texts")
    totals = {r["y"]: r["n"] for r in chosen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = totals.get(1, 0), totals.get(0, 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos: Counter = Counter()
        neg: Counter = Counter()

        def rows() -> pa.RecordBatch:
            keys = list(pos.keys() | neg.keys())
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array([pos[k] for k in keys], pa.int64()),
                 pa.array([neg[k] for k in keys], pa.int64())], ["term", "p", "n"],
            )

        for batch in batches:
            for raw, y in zip(raw_texts(batch.column(0)), batch.column(1).to_pylist()):
                (pos if y else neg).update({f for w in set(alnum_words(raw)) for f in features_of(w)})
            if len(pos) + len(neg) > 500_000:
                yield rows()
                pos.clear()
                neg.clear()
        yield rows()

    table = chosen.select("text", "y").mapInArrow(count, "term binary, p bigint, n bigint").groupBy("term").agg(
        F.sum("p").alias("a"), F.sum("n").alias("b")
    )
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    c, d = F.lit(float(n_pos)) - a, F.lit(float(n_neg)) - b
    spread = (a + b) * (c + d) * (a + c) * (b + d)
    top = (
        table.where(F.col("a") + F.col("b") >= LEAST_DF)
        .withColumn("chi", F.when(spread > 0, (a * d - b * c) ** 2 * (n_pos + n_neg) / spread).otherwise(0.0))
        .where(F.col("chi") > LEAST_CHI).orderBy(F.desc("chi"), "term").collect()
    )
    vocabulary = {bytes(r["term"]): k for k, r in enumerate(top)}
    model = Model(vocabulary, np.ones(len(vocabulary)), 0.0)

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(vocabulary) + 1, np.int64), 0
        for batch in batches:
            for raw in raw_texts(batch.column(0)):
                df[list(model.counts(raw))] += 1
                n += 1
        df[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(df))), pa.array(df)], ["t", "df"])

    found = {
        r["t"]: r["df"] for r in texts.select("text").mapInArrow(frequency, "t bigint, df bigint")
        .groupBy("t").agg(F.sum("df").alias("df")).collect()
    }
    total = found.get(len(vocabulary), 0)
    model.idf = np.array([1 + np.log((1 + total) / (1 + found.get(t, 0))) for t in range(len(vocabulary))])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.counts(raw) for raw in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array([list(g) for g in got], pa.list_(pa.int64())),
                 pa.array([list(g.values()) for g in got], pa.list_(pa.int64()))], ["id", "y", "weight", "terms", "n"],
            )

    kept = save(
        chosen.select("sid", "text", "y", "weight").mapInArrow(
            vectors, "id bigint, y int, weight double, terms array<bigint>, n array<bigint>"
        ), "example-vectors",
    )
    rows, bare = [], [0.0, 0.0]
    for r in kept.collect():  # bounded by the sample
        counts = dict(zip(r["terms"], r["n"]))
        if counts:
            rows.append((r["id"], r["weight"] * r["y"], r["weight"] * (1 - r["y"]), *model.vector(counts)))
        else:
            bare[r["y"]] += r["weight"]
    model.prior = (bare[1] + 0.02) / (bare[0] + bare[1] + 1)
    model.build(rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, weight, terms_, n = (batch.column(k).to_pylist() for k in (1, 2, 3, 4))
            counts = [dict(zip(t, m)) for t, m in zip(terms_, n)]
            got = [v for v, _ in shared.value.votes(counts, [(w * b, w * (1 - b)) for w, b in zip(weight, y)])]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.float64()), batch.column(1), batch.column(2)], ["v", "y", "w"])

    bins = (
        kept.mapInArrow(left_out, "v double, y int, w double")
        .groupBy(F.least(F.floor(F.col("v") * BINS), F.lit(BINS - 1)).alias("bin"))
        .agg(F.sum("w").alias("w"), (F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"),
             (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("y")).collect()
    )
    if bins:
        bins.sort(key=lambda r: r["v"])
        v, y, w = (np.array([r[k] for r in bins], float) for k in ("v", "y", "w"))
        # The base rate weighs as much as SHRINK examples in each bin, so sparse bins stay off 0 and 1.
        rate = float((y * w).sum() / w.sum())
        model.knots = (v, monotone(v, (y * w + SHRINK * rate) / (w + SHRINK), w + SHRINK))
    return model


EVIDENCE = pa.list_(pa.struct([("example", pa.int64()), ("similarity", pa.float64())]))


def score_documents(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score, evidence), one per input row; null and empty texts get the base rate and no evidence.

    Null ids and repeated rows are kept; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = shared.value.scores(raw_texts(batch.column(1)))
            evidence = [[{"example": i, "similarity": s} for i, s in e] for _, e in got]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s for s, _ in got], pa.float64()), pa.array(evidence, EVIDENCE)],
                ["id", "score", "evidence"],
            )

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id bigint, score double, evidence array<struct<example:bigint,similarity:double>>"
    )


def keep_below(docs: DataFrame, model: Model, threshold: float, *, text_col: str = "text") -> DataFrame:
    """The documents, all columns, whose score is below the threshold; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            below = [s < threshold for s, _ in shared.value.scores(raw_texts(batch.column(place)))]
            yield batch.filter(pa.array(below, pa.bool_()))

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))
