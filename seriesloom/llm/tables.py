"""Tables and files under the shared folder, and order over partitions."""

from __future__ import annotations

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.session import new_table_path

LOWEST = -(2**63)


def save(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives a lost executor."""
    spark = df.sparkSession
    path = new_table_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder or file in the shared store."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def id_bounds(docs: DataFrame, order: Column, parts: int) -> list[int]:
    """Smallest ids of at most ``parts`` ranges of about equal row counts, ascending.

    Only the id column is read; the driver receives one number per range.
    """
    ids = docs.select(order.alias("v")).repartitionByRange(parts, "v")
    found = ids.groupBy(F.spark_partition_id().alias("p")).agg(F.min("v").alias("v")).collect()
    return sorted({r["v"] for r in found})


def range_of(order: Column, bounds: list[int]) -> Column:
    """Index of the range an id falls in: binary search over the bounds, JVM-side."""
    steps = max(1, len(bounds).bit_length())
    table = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    n = len(bounds)

    def step(lo: Column, power: Column) -> Column:
        nxt = lo + power
        return F.when((nxt <= n) & (F.get(table, nxt - 1) <= order), nxt).otherwise(lo)

    powers = F.array(*[F.lit(1 << s) for s in reversed(range(steps))])
    return F.aggregate(powers, F.lit(0), step) - 1


def in_ranges(
    docs: DataFrame, id_col: str, text_col: str, *, guard: bool = False, parts: int | None = None
) -> tuple[DataFrame, int]:
    """Rows (bucket, guard, id, text), each bucket in one partition and sorted by id, then text.

    Buckets ascend with the id; null ids come first, null texts are empty.  With
    ``guard`` the first rows of each bucket appear once more at the end of the
    bucket before it (those of the first bucket at the end of the last), marked
    1, so that every row finds the row after it.  The text is shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    order = F.coalesce(F.col("id"), F.lit(LOWEST))
    bounds = id_bounds(docs.select(F.col(id_col).cast("bigint").alias("id")), order, parts or shuffle_partitions(spark))
    n = max(1, len(bounds))
    rows = rows.withColumn("bucket", (range_of(order, bounds) if bounds else F.lit(0)).cast("int"))
    if guard:
        table = F.array(*[F.lit(b).cast("bigint") for b in bounds or [LOWEST]])
        places = F.when(
            order == F.get(table, F.col("bucket")),
            F.array(
                F.struct(F.col("bucket").alias("b"), F.lit(0).alias("g")),
                F.struct(F.pmod(F.col("bucket") - 1, F.lit(n)).alias("b"), F.lit(1).alias("g")),
            ),
        ).otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("g"))))
        rows = rows.withColumn("place", F.explode(places)).select(
            F.col("place.b").alias("bucket"), F.col("place.g").alias("guard"), "id", "text"
        )
    else:
        rows = rows.select("bucket", F.lit(0).alias("guard"), "id", "text")
    return (
        rows.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "guard", F.col("id").asc_nulls_first(), "text"),
        n,
    )
