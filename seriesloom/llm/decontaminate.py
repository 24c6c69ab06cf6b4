"""Benchmark decontamination: BM25 search of every training passage in an index of test items.

The index is built from the test items, a table that does not grow with the
corpus; it is read in blocks of bounded size, one pass over the documents for
each.  Every document is cut into overlapping passages of twice the longest
item, so any copy of an item lies whole in one.  A passage is a query of its
distinct words.  Scores are BM25 divided by the item's score for itself, so one
threshold fits items of all lengths: all items at or above it are retrieved.

The lightest words of an item, which together hold at most a quarter of its
score, are not searched for: without any other word of the item a passage can't
reach the threshold (WAND with no top-k, so the threshold stands still).  The
other words' postings are grouped into blocks of items with the largest weight
of each word in each block (block-max).  A passage's sum of those maxima and
the block's largest light share bound the score of every item of the block.
Only blocks that a passage has such a word of are looked at, and only those
whose bound reaches the threshold are scored, so the cost grows with the
postings met and not with the number of items.  Retrieved items are verified:
shares of the question's and of the answer's word shingles that the passage
holds.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.llm.tables import save
from seriesloom.llm.text import alnum_words

K1, B = 1.2, 0.75
THRESHOLD = 0.5  # share of the item's own BM25 score
OVERLAP = 0.8  # share of question and of answer shingles
SHINGLE = 5
ITEM_BLOCK = 4  # items whose maxima are kept together
LIGHT = 0.25  # share of an item's score that its lightest words may hold without being searched for
INDEX_CHARS = 16 << 20  # characters of item text in one index
MOST_SEGMENTS = 256

MATCH = "id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"


def fold(text: str) -> list[bytes]:
    return alnum_words(text.lower().encode())


def shingles(tokens: list[bytes]) -> set[bytes]:
    """Runs of five words; fewer words: the whole sequence; none: empty."""
    if not tokens:
        return set()
    n = min(SHINGLE, len(tokens))
    return {b" ".join(tokens[i : i + n]) for i in range(len(tokens) - n + 1)}


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The last sentence is the answer; of a single sentence the last third of its words."""
    parts = [p for p in (fold(s) for s in re.split(r"(?<=[.?!])\s+", text)) if p]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    tokens = parts[0] if parts else []
    cut = len(tokens) - len(tokens) // 3
    return tokens[:cut], tokens[cut:]


def share_of(wanted: set[bytes], n: int, tokens: list[bytes], held: set[bytes]) -> float:
    """Share of the wanted shingles, of n words each, in the passage; 1 if none is wanted."""
    if not wanted:
        return 1.0
    if n < SHINGLE:
        held = {b" ".join(tokens[i : i + n]) for i in range(len(tokens) - n + 1)}
    return len(wanted & held) / len(wanted)


class Index:
    """BM25 postings of one bounded set of items, as flat arrays."""

    def __init__(self, items: list[tuple[int, str]], df: dict[bytes, int], count: int, mean: float) -> None:
        items = sorted(items, key=lambda r: (len(r[1]), r[0]))
        self.ids = [i for i, _ in items]
        folded = [fold(t) for _, t in items]
        self.length = max(map(len, folded), default=1)
        self.parts = []
        for _, text in items:
            q, a = question_and_answer(text)
            self.parts.append((shingles(q), min(SHINGLE, len(q)), shingles(a), min(SHINGLE, len(a))))
        self.blocks = (len(items) + ITEM_BLOCK - 1) // ITEM_BLOCK
        self.term = {w: t for t, w in enumerate(dict.fromkeys(w for tokens in folded for w in tokens))}
        first, term, weight, spare = [0], [], [], []
        essential: list[dict[int, float]] = [{} for _ in self.term]  # by term: block, largest weight of its essential items
        for k, tokens in enumerate(folded):
            tf = Counter(tokens)
            norm = K1 * (1 - B + B * len(tokens) / max(mean, 1e-9))
            weights = {
                self.term[w]: np.log1p((count - df[w] + 0.5) / (df[w] + 0.5)) * f * (K1 + 1) / (f + norm) for w, f in tf.items()
            }
            own, light = sum(weights.values()), 0.0
            for t, x in sorted(weights.items(), key=lambda r: (r[1], r[0])):
                x /= own
                term.append(t)
                weight.append(x)
                if light + x <= LIGHT:
                    light += x
                else:
                    essential[t][k // ITEM_BLOCK] = max(essential[t].get(k // ITEM_BLOCK, 0.0), x)
            first.append(len(term))
            spare.append(light)
        self.item_first, self.item_term, self.item_weight = np.array(first), np.array(term, np.int64), np.array(weight)
        # What the light words of any of a block's items can add at most.
        self.light = np.array([max(spare[b : b + ITEM_BLOCK]) for b in range(0, len(spare), ITEM_BLOCK)])
        self.block_first = np.cumsum([0, *map(len, essential)])  # of a term's blocks
        self.block = np.array([b for found in essential for b in found], np.int64)
        self.most = np.array([x for found in essential for x in found.values()])
    @staticmethod
    def _spans(first: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of all entries of the terms, and the place in ``terms`` each belongs to."""
        size = first[terms + 1] - first[terms]
        owner = np.repeat(np.arange(len(terms)), size)
        start = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(terms) else size
        return np.arange(len(owner)) - start[owner] + first[terms][owner], owner

    def search(self, tokens: list[bytes], threshold: float) -> Iterator[tuple[int, int, int, float]]:
        """(item place, first word, past-last word, score) of every passage and item at or above the threshold."""
        if threshold <= LIGHT:
            raise ValueError(f"the threshold must lie above {LIGHT}, or light words alone could reach it")
        get, step = self.term.get, self.length
        whole = np.array([get(w, -1) for w in tokens], np.int64)
        for at in range(0, max(1, len(tokens)), step * MOST_SEGMENTS):
            terms = whole[at : at + step * (MOST_SEGMENTS + 1)]
            segments = -(-len(terms) // step)
            known = np.flatnonzero(terms >= 0)
            if not known.size:
                continue
            # Each word once a segment; two neighbouring segments are a passage.
            pairs = np.unique(known // step * len(self.term) + terms[known])
            segment, distinct = pairs // len(self.term), pairs % len(self.term)
            place, owner = self._spans(self.block_first, distinct)
            if not place.size:
                continue
            cells, inverse = np.unique(segment[owner] * self.blocks + self.block[place], return_inverse=True)
            bound = np.bincount(inverse, self.most[place])
            if segments > 1:  # a segment counts for the passages that begin with it and with the one before it
                both = np.concatenate([cells, cells - self.blocks])
                inside = (both >= 0) & (both < (segments - 1) * self.blocks)
                cells, inverse = np.unique(both[inside], return_inverse=True)
                bound = np.bincount(inverse, np.concatenate([bound, bound])[inside])
            cells = cells[bound + self.light[cells % self.blocks] >= threshold - 1e-9]
            if not cells.size:
                continue
            # All items of the blocks left, each with its words, looked up among the passage's words at once.
            items = (cells % self.blocks)[:, None] * ITEM_BLOCK + np.arange(ITEM_BLOCK)
            passages = np.repeat(cells // self.blocks, ITEM_BLOCK)[items.ravel() < len(self.ids)]
            items = items.ravel()[items.ravel() < len(self.ids)]
            place, owner = self._spans(self.item_first, items)
            key = passages[owner] * len(self.term) + self.item_term[place]
            there = self._among(pairs, key) | self._among(pairs, key + len(self.term))
            scores = np.bincount(owner[there], self.item_weight[place[there]], len(items))
            found = np.flatnonzero(scores >= threshold - 1e-9)
            for f in found[np.lexsort((items[found], passages[found]))].tolist():
                lo = int(passages[f]) * step
                yield int(items[f]), at + lo, at + min(len(terms), lo + 2 * step), float(scores[f])

    @staticmethod
    def _among(ordered: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        at = np.searchsorted(ordered, wanted)
        return ordered[np.minimum(at, len(ordered) - 1)] == wanted

    def matches(self, tokens: list[bytes], threshold: float, overlap: float) -> dict[int, tuple[float, float, float]]:
        """Verified items: largest score, and overlaps of the best verified passage."""
        found: dict[int, tuple[float, float, float]] = {}
        at, held = None, set()
        for k, lo, hi, score in self.search(tokens, threshold):
            if (lo, hi) != at:
                at, held = (lo, hi), shingles(tokens[lo:hi])
            q, nq, a, na = self.parts[k]
            qs, as_ = share_of(q, nq, tokens[lo:hi], held), share_of(a, na, tokens[lo:hi], held)
            if (q or a) and qs >= overlap and as_ >= overlap:
                old = found.get(k, (0.0, 0.0, 0.0))
                found[k] = (max(score, old[0]), *max(old[1:], (qs, as_)))
        return found


def indexes(
    items: DataFrame, *, item_id_col: str = "item_id", item_text_col: str = "text", index_chars: int = INDEX_CHARS
) -> Iterator[Broadcast]:
    """Broadcast indexes over all items, each of about ``index_chars`` characters of item text at most.

    Document frequencies and lengths are those of all items.
    """
    given = items.select(
        F.col(item_id_col).cast("bigint").alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text")
    ).distinct()
    slots = max(1, -(-int(given.agg(F.sum(F.char_length("text"))).first()[0] or 0) // index_chars))
    given = save(given.withColumn("slot", F.pmod(F.xxhash64("item_id", "text"), F.lit(slots))), "items")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot, word, total = [], [], []
            for s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = fold(t)
                for w in set(tokens):
                    slot.append(s)
                    word.append(w)
                if tokens:  # the empty word carries the length
                    slot.append(s)
                    word.append(b"")
                total += [0] * len(set(tokens)) + [len(tokens)] * bool(tokens)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot, pa.int64()), pa.array(word, pa.binary()), pa.array(total, pa.int64())], ["slot", "w", "n"]
            )

    per_slot = save(
        given.select("slot", "text").mapInArrow(terms, "slot bigint, w binary, n bigint")
        .groupBy("slot", "w").agg(F.count("*").alias("df"), F.sum("n").alias("n")),
        "item-terms",
    )
    everywhere = per_slot.groupBy("w").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
    lengths = everywhere.where(F.octet_length("w") == 0).first()
    for slot in range(slots if lengths else 0):
        here = [(r["item_id"], r["text"]) for r in given.where(F.col("slot") == slot).collect() if fold(r["text"])]
        if here:
            words_here = per_slot.where(F.col("slot") == slot).select("w")
            df = {bytes(r["w"]): r["df"] for r in everywhere.join(words_here, "w", "left_semi").collect()}
            index = Index(here, df, lengths["df"], lengths["n"] / lengths["df"])
            yield items.sparkSession.sparkContext.broadcast(index)


def contaminated(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, index_chars: int = INDEX_CHARS,
) -> DataFrame:
    """Rows (id, item_id, score, question_overlap, answer_overlap): verified matches, one per document and item.

    A row per document row and matching item: repeated documents repeat their
    rows, items of equal text all match.  Null or wordless texts and items
    match nothing; null ids are kept; other columns are ignored; an empty table
    on either side gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    result = None
    for shared in indexes(items, item_id_col=item_id_col, item_text_col=item_text_col, index_chars=index_chars):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                out = []
                for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if text:
                        for k, found in index.matches(fold(text), threshold, overlap).items():
                            out.append((ident, index.ids[k], *found))
                if out:
                    kinds = [pa.int64()] * 2 + [pa.float64()] * 3
                    names = [c.split()[0] for c in MATCH.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        part = rows.mapInArrow(run, MATCH)
        result = part if result is None else result.unionAll(part)
    return docs.sparkSession.createDataFrame([], MATCH) if result is None else result


def keep_clean(
    docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, index_chars: int = INDEX_CHARS,
) -> DataFrame:
    """The documents, all columns, without a verified item; nothing is shuffled."""
    place = docs.columns.index(text_col)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema])
    for shared in indexes(items, item_id_col=item_id_col, item_text_col=item_text_col, index_chars=index_chars):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(place).to_pylist()
                clean = [not (t and shared.value.matches(fold(t), threshold, overlap)) for t in texts]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
