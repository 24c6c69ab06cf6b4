"""Prior outputs and reference tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_last_good(
    prior: DataFrame, aliases: DataFrame, *, by: str = "series_id", date: str = "obs_date"
) -> DataFrame:
    """The stored points of each series under its current id, else under a legacy
    one: the first id (by ``priority``) that has any point wins.

    ``aliases``: series_id, stored_id, priority.
    """
    stored = prior.withColumnRenamed(by, "stored_id")
    held = stored.groupBy("stored_id").agg(F.count(F.lit(1)).alias("_n"))
    chosen = aliases.join(held, "stored_id").groupBy(by).agg(
        F.min_by("stored_id", "priority").alias("stored_id")
    )
    return stored.join(chosen, "stored_id").select(
        by, date, *[c for c in prior.columns if c not in (by, date)], "stored_id"
    )


def reference_table_problems(table: DataFrame, key: Sequence[str]) -> DataFrame:
    """Blank or repeated keys of a keyed configuration table."""
    blank = F.lit(False)
    for k in key:
        blank = blank | F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == "")
    return table.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where(
        blank | (F.col("rows") > 1)
    ).withColumn("problem", F.when(blank, "BLANK_KEY").otherwise("DUPLICATE_KEY"))
