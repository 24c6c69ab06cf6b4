"""Integer k-means whose distances are sums of table entries.

Vectors are stored once in blocks: for each dimension the integers that occur
in the block, and for each vector the index of its integer.  In each round
every block tabulates, per dimension, the squared difference of each occurring
integer and each centroid; a vector's distances are then gathered from those
tables with NumPy and summed.  A block has at most `BLOCK` vectors, so a table
has at most that many rows, whatever values occur.

Between rounds only one row per centroid passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.tables import save

BLOCK = 4096
LARGEST = 10**15  # a larger component is refused; a block's sum of this size still fits 63 bits
LONGEST = (1 << 63) - 1

BLOCK_SCHEMA = "ids array<bigint>, sizes array<int>, integers array<double>, codes binary"


def usable(vector: Column, dims: int) -> Column:
    """Exactly ``dims`` components, none null or non-finite."""
    return (F.size(vector) == dims) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )


def _encode(dims: int):
    """Arrow batches of (id, v) to rows of blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                n = part.num_rows
                grid = np.floor(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, dims) * 256.0)
                if not (np.abs(grid) <= LARGEST).all():
                    raise ValueError(f"a component exceeds {LARGEST / 256:g}")
                sizes, integers, codes = [], [], np.empty((dims, n), "<u2")
                for d in range(dims):
                    seen, codes[d] = np.unique(grid[:, d], return_inverse=True)
                    sizes.append(len(seen))
                    integers.append(seen)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())),
                        pa.array([np.concatenate(integers)], pa.list_(pa.float64())), pa.array([codes.tobytes()], pa.binary()),
                    ],
                    names=["ids", "sizes", "integers", "codes"],
                )

    return run


def blocks_of(vectors: DataFrame, *, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """The usable vectors as a written table of blocks; components are floor(256 x)."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where(usable(F.col("v"), dims))
    return save(rows.mapInArrow(_encode(dims), BLOCK_SCHEMA), "vector-blocks")


def first_centroids(
    vectors: DataFrame, k: int, *, id_col: str, vector_col: str, dims: int, seed: int
) -> list[list[int]]:
    """The vectors of the ``k`` smallest SHA-256 of ``seed:id``, in that order; fewer if there are fewer.

    Ids are chosen before their vectors are read, so tasks send hashes only.
    Rows that share an id are ordered by vector; rows without an id aren't chosen.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & usable(F.col("v"), dims)
    )
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h")
    ids = [r["id"] for r in rows.select(digest, "id").orderBy("h").limit(k).collect()]
    found = (
        rows.where(F.col("id").isin(sorted(set(ids)))).select(digest, F.transform("v", lambda x: F.floor(x * 256.0)).alias("c"))
        .groupBy("h", "c").count().orderBy("h", "c").limit(k).collect()
    )
    return [list(map(int, r["c"])) for r in found for _ in range(min(k, r["count"]))][:k]


def _distances(codes: np.ndarray, sizes: Sequence[int], integers: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (vectors x centroids) by one table per dimension; Python integers where 64 bits may not do."""
    largest = int(max(np.abs(integers).max(initial=0), np.abs(centroids).max(initial=0)))
    exact = np.int64 if 4 * largest * largest * len(sizes) <= LONGEST else object
    whole = integers.astype(np.int64).astype(exact)
    centres = centroids.astype(exact)
    total = np.zeros((codes.shape[1], len(centres)), exact)
    at = 0
    for d, n in enumerate(sizes):
        gap = whole[at : at + n, None] - centres[None, :, d]
        total += (gap * gap)[codes[d]]
        at += n
    return total


def _read_blocks(batch: pa.RecordBatch, centroids: np.ndarray):
    """Per block: ids, codes, sizes, integers, nearest centroid (ties: the smaller number) and its distance."""
    for row in batch.to_pylist():
        sizes, integers = row["sizes"], np.array(row["integers"])
        codes = np.frombuffer(row["codes"], "<u2").reshape(len(sizes), -1)
        far = _distances(codes, sizes, integers, centroids)
        near = np.argmin(far, axis=1)
        yield row["ids"], codes, sizes, integers, near, far[np.arange(len(near)), near]


def _sum_up(centroids: np.ndarray):
    """Arrow batches of blocks to one row per centroid of the task: count and component sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        count, sums = np.zeros(k, np.int64), np.zeros((k, dims), object)
        for batch in batches:
            for _, codes, sizes, integers, near, _ in _read_blocks(batch, centroids):
                count += np.bincount(near, minlength=k)
                at = 0
                for d, n in enumerate(sizes):
                    times = np.bincount(near * n + codes[d], minlength=k * n).reshape(k, n)
                    sums[:, d] += times @ integers[at : at + n].astype(np.int64)
                    at += n
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(used, pa.int32()), pa.array(count[used], pa.int64()),
                pa.array([[str(x) for x in sums[c]] for c in used], pa.list_(pa.string())),
            ],
            names=["cluster", "n", "sums"],
        )

    return run


def _assign(centroids: np.ndarray):
    """Arrow batches of blocks to (id, cluster, distance); a distance above 63 bits is null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, _, _, near, far in _read_blocks(batch, centroids):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()), pa.array(near, pa.int32()),
                        pa.array([int(x) if x <= LONGEST else None for x in far], pa.int64()),
                    ],
                    names=["id", "cluster", "distance"],
                )

    return run


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every non-empty centroid becomes the floor of its vectors' mean, in exact integers."""
    parts = blocks.mapInArrow(_sum_up(centroids), "cluster int, n bigint, sums array<string>")
    found = (
        parts.select("cluster", "n", F.posexplode("sums").alias("d", "s"))
        .groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    )
    new = centroids.copy()
    for r in found:
        new[r["cluster"], r["d"]] = int(r["s"]) // r["n"]
    return new


def cluster(
    vectors: DataFrame, *, k: int = 40, rounds: int = 5, dims: int = 64, seed: int = 2,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """Rows (id, cluster, distance, cluster_inertia, inertia, centroid): the vectors after ``rounds`` rounds and one assignment.

    Vectors of other lengths, and with a null or non-finite component, are
    left out, as are null vectors.  A null id stays, but is no first centroid.
    Equal and repeated vectors count each; equally near centroids: the smaller
    number; an empty centroid stays where it is; fewer vectors than ``k`` make
    fewer centroids; no vectors, no rows; vectors but none with an id, rows
    without a cluster.  Other columns aren't read.
    ``centroid`` is the final centroid as an array of integers.  Components
    above 10^15 / 256 are refused with an error; a distance that doesn't fit
    63 bits is null.
    """
    spark = vectors.sparkSession
    names = {"id_col": id_col, "vector_col": vector_col, "dims": dims}
    blocks = blocks_of(vectors, **names)
    now = np.array(first_centroids(vectors, k, seed=seed, **names), np.int64).reshape(-1, dims)
    if not len(now):
        return blocks.select(F.explode("ids").alias("id")).selectExpr(
            "id", "CAST(NULL AS INT) AS cluster", "CAST(NULL AS BIGINT) AS distance", "CAST(NULL AS BIGINT) AS cluster_inertia",
            "CAST(NULL AS BIGINT) AS inertia", "CAST(NULL AS ARRAY<BIGINT>) AS centroid",
        )
    for _ in range(rounds):
        now = moved(blocks, now)
    rows = save(blocks.mapInArrow(_assign(now), "id bigint, cluster int, distance bigint"), "assigned")
    # A row per centroid, which the driver has as well.
    found = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).where("s IS NOT NULL")
    sums = {r["cluster"]: int(r["s"]) for r in found.collect()}
    whole = sum(sums.values())

    def fits(x: int | None) -> int | None:
        return x if x is not None and x <= LONGEST else None

    table = save(
        spark.createDataFrame(
            [(c, fits(sums.get(c)), fits(whole), list(map(int, now[c]))) for c in range(len(now))],
            "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>",
        ),
        "centroids",
    )
    return rows.join(table, "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_digest(centroid: Column) -> Column:
    """SHA-256 of the components as decimal integers joined by commas."""
    return F.sha2(F.array_join(F.transform(centroid, lambda x: x.cast("string")), ","), 256)

