"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash
range, so its size follows the document and the sketches of two documents of
any sizes are samples of their shingles at one common rate.  Hence the sketch
of a union is made from the two sketches alone, and containment and
resemblance are read off them.  A document with no hash below the fraction
keeps its smallest hash, so none that has a word is without a sketch; a union
drops such a hash as soon as one below the fraction joins it, which is the
sketch the union itself would have.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seriesloom.llm.tables import in_ranges
from seriesloom.llm.text import shingle_hashes, words

SHINGLE = 5
SCALE = 8  # one hash in so many is kept


def _keep(hashes: np.ndarray, scale: int) -> np.ndarray:
    if not len(hashes):
        return hashes
    low = hashes[hashes < np.uint64((1 << 64) // scale)] if scale > 1 else hashes
    return np.unique(low) if len(low) else hashes.min(keepdims=True)


def sketch(tokens: list[bytes], *, shingle: int = SHINGLE, scale: int = SCALE) -> np.ndarray:
    """Sorted hashes; empty only for no words.  Fewer words than a shingle: the whole sequence is the one shingle."""
    return _keep(shingle_hashes(tokens, shingle), scale)


def merge(a: np.ndarray, b: np.ndarray, *, scale: int = SCALE) -> np.ndarray:
    """Sketch of the union of the two shingle sets."""
    return _keep(np.concatenate([a, b]), scale)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated resemblance: common shingles over all; two empty sketches are alike, an empty and another are not."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    total = len(a) + len(b) - both
    return both / total if total else 1.0


def to_text(values: np.ndarray) -> str:
    """Base64 of the sorted hashes as little-endian 64-bit numbers."""
    return base64.b64encode(values.astype("<u8").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8")


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many, or all, of the following text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


ROW = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, contained_in_next double"
)
_NAMES = [c.split()[0] for c in ROW.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]


def fingerprint_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, scale: int = SCALE
) -> DataFrame:
    """One row per input row: fingerprints of the text and of its edited text, and their likeness.

    The next document follows by id, then by text; the first follows the last.
    Null texts are empty, null ids come first, repeated rows follow each other.
    A table of one row has itself as next.  Other columns are ignored; an empty
    table gives an empty one.  Each partition holds one pair of documents.
    """
    def measure(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        hashes = shingle_hashes(tokens, shingle)
        return hashes, _keep(hashes, scale)

    def edited_sketch(text: str, tokens: list[bytes], hashes: np.ndarray, new: str) -> np.ndarray:
        """Only shingles that reach past the kept words are hashed anew."""
        kept = text[: len(text) - len(text) // 4]
        same = max(0, len(words(kept.encode())) - 1)  # the last kept word may grow
        whole = words(new.encode())
        if same < shingle or len(tokens) <= shingle or len(whole) <= shingle:
            return _keep(shingle_hashes(whole, shingle), scale)
        first = same - shingle + 1
        return _keep(np.concatenate([hashes[:first], shingle_hashes(whole[first:], shingle)]), scale)

    def row(here, after) -> tuple:
        ident, text, tokens, (hashes, own) = here
        new = edited(text, after[1])
        other = edited_sketch(text, tokens, hashes, new)
        nxt = after[3][1]
        return (
            ident, len(text), hashlib.sha256(new.encode()).hexdigest(), to_text(own), to_text(other),
            likeness(own, other), likeness(own, nxt), containment(own, nxt),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, bucket, out = None, None, []
        for batch in batches:
            for b, guard, ident, text in zip(*(c.to_pylist() for c in batch.columns)):
                if b != bucket:
                    before, bucket = None, b
                if guard and before is None:
                    continue  # a further guard: the bucket's last row is done
                tokens = words(text.encode())
                here = (ident, text, tokens, measure(tokens))
                if before is not None:
                    out.append(row(before, here))
                before = None if guard else here
                if len(out) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), _KINDS)], _NAMES)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), _KINDS)], _NAMES)

    rows, _ = in_ranges(docs, id_col, text_col, guard=True)
    return rows.mapInArrow(run, ROW)
