"""Words and shingles of a text, as bytes, for use inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
# Everything but letters, digits and non-ASCII becomes a space; A-Z is lowered.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def words(raw: bytes) -> list[bytes]:
    """Runs of ``[^\\x20\\x09-\\x0D]`` after lowering A-Z."""
    return raw.translate(LOWER).split()


def alnum_words(raw: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII bytes after lowering A-Z."""
    return raw.translate(ALNUM).split()


def shingle_hashes(tokens: list[bytes], size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``size`` words, repeats included; fewer words: of the whole sequence; none: empty."""
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array(
        [digest(joined[a:z], seed) for a, z in zip(starts, ends[size - 1 :].tolist())], np.uint64
    )


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]
