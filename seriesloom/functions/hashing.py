"""Fingerprints of rows, of arrays inside a row and of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_json(columns: Sequence[str]) -> Column:
    """Canonical JSON text of a row: keys sorted, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def row_hash(columns: Sequence[str]) -> Column:
    return F.sha2(row_json(columns), 256)


def array_fingerprint(hashes: Column) -> Column:
    """SHA-256 over the sorted lines of an array held by one row."""
    return F.sha2(F.array_join(F.array_sort(hashes), "\n"), 256)


def group_fingerprint(row_digest: Column) -> Column:
    """Order-free fingerprint of a group, as an aggregate.

    A hash over a sorted list needs the whole group in one task. Adding up four
    64-bit limbs of each row digest needs four running sums, combines on the map
    side and gives the same text for the same multiset of rows in any order. It
    finds accidents; sums can be made to collide on purpose.
    """
    limbs = [
        F.conv(F.substring(row_digest, 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)")
        for i in range(4)
    ]
    sums = [F.coalesce(F.sum(limb), F.lit(0)).cast("string") for limb in limbs]
    return F.sha2(F.concat_ws(":", F.count(row_digest).cast("string"), *sums), 256)
