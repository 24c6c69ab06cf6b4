"""One wide record per series: the published row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.scalars import expected_next_update
from seriesloom.operators.bands import midrank_endpoint
from seriesloom.operators.windows import (
    changes_by_frequency, latest_per_series, tail_array, tail_rows, trailing_slope, valid_only,
)


def tail_statistics(obs: DataFrame, n: int = 20) -> DataFrame:
    """Number of valid rows, and mid-rank and slope of the last 20."""
    valid = valid_only(obs)
    counts = valid.groupBy("series_id").agg(F.count(F.lit(1)).alias("sample_size"))
    rank = midrank_endpoint(obs, window=n, minimum=1).select(
        "series_id", F.col("midrank").alias("tail_percentile")
    )
    slope = trailing_slope(tail_rows(valid, n).drop("rn"), n).groupBy("series_id").agg(
        F.max_by("slope", "obs_date").alias("tail_slope")
    )
    return counts.join(rank, "series_id").join(slope, "series_id")


def composite_latest_record(
    obs: DataFrame, registry: DataFrame, states: DataFrame, *, tail: int = 22
) -> DataFrame:
    """Value, changes, statistics, quality, context and provenance per series.

    ``registry``: series_id, label, unit, frequency, availability, is_proxy,
    source_id, flags. ``states``: series_id, health, freshness, last_success_at,
    last_attempt_at, released_at, updated_at, failure_reason. A series that is
    not active shows no value and no state.
    """
    known = obs.join(registry.select("series_id", "frequency"), "series_id")
    ends = latest_per_series(obs, columns=["value"])
    changes = changes_by_frequency(known).drop("frequency", "obs_date", "latest")
    change_names = [c for c in changes.columns if c != "series_id"]
    rows = (
        registry.join(ends, "series_id", "left").join(changes, "series_id", "left")
        .join(tail_statistics(obs), "series_id", "left")
        .join(tail_array(obs, tail), "series_id", "left")
        .join(states, "series_id", "left")
    )
    active = F.col("availability").isin("ACTIVE_FREE", "ACTIVE_PROXY")

    def shown(name: str):
        return F.when(active, F.col(name))

    value, health = shown("value"), F.when(active, F.col("health")).otherwise("NOT_APPLICABLE")
    return rows.select(
        "series_id", "label", "unit", "frequency", "availability", value.alias("value"),
        shown("obs_date").alias("obs_date"), shown("released_at").alias("released_at"),
        shown("updated_at").alias("updated_at"),
        F.when(active, expected_next_update("obs_date", "frequency")).alias("expected_next_update"),
        F.struct(*[shown(c).alias(c) for c in change_names]).alias("changes"),
        F.struct(
            *[shown(c).alias(c) for c in ("sample_size", "tail_percentile", "tail_slope")]
        ).alias("statistics"),
        F.struct(
            health.alias("status"),
            F.when(active, F.col("freshness")).otherwise("UNKNOWN").alias("freshness"),
            *[shown(c).alias(c) for c in ("last_success_at", "last_attempt_at", "failure_reason")],
        ).alias("quality"),
        F.struct(
            F.array_sort(F.array_distinct("flags")).alias("flags"), "is_proxy",
            F.when(active & (F.col("health") == "OK"), "HIGH")
            .when(active & F.col("value").isNotNull(), "MEDIUM").otherwise("UNKNOWN")
            .alias("confidence"),
        ).alias("context"),
        F.when(active, F.col("source_id")).alias("source_id"), shown("tail").alias("tail"),
    )
