"""Daily indicators: raw events to observations, features and alert tier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.windows import spread_stats
from seriesloom.rules.alerts import tiered_alert


def to_observations(
    raw: DataFrame, *, series: Column, day: Column, value: Column, scale: int = 12
) -> DataFrame:
    """Raw rows to (series_id, obs_date, value): exact sums that combine on the
    map side, so a busy series leaves each task as one row per day."""
    return raw.groupBy(series.alias("series_id"), day.alias("obs_date")).agg(
        F.sum(value.cast(f"decimal(28,{scale})")).cast("double").alias("value")
    )


def alert_inputs(
    obs: DataFrame, *, main: str, confirmations: Sequence[str], threshold: float
) -> DataFrame:
    """One row with the main series' stats and those of the confirming series."""
    stats = spread_stats(obs.where(F.col("series_id").isin(main, *confirmations)), threshold=threshold)
    c = F.col

    def of(sid: str, name: str) -> Column:
        return F.max(F.when(c("series_id") == sid, c(name)))

    return stats.groupBy().agg(
        F.max(F.when(c("series_id") == main, c("obs_date"))).alias("obs_date"),
        of(main, "latest").alias("latest"), of(main, "positive_streak").alias("positive_streak"),
        *[of(s, "change_5obs").alias(f"change5_{s}") for s in confirmations],
        *[of(s, "slope_5obs").alias(f"slope5_{s}") for s in confirmations],
    )


def daily_alert(
    obs: DataFrame, *, main: str, confirmations: Sequence[str], threshold: float = 3.0,
    use_days: Column | None = None, stock_change: Column | None = None,
    stock_p10: Column | None = None, status: Column | None = None, flags: Column | None = None,
) -> DataFrame:
    """The alert of one main series, with optional evidence columns."""
    rows = alert_inputs(obs, main=main, confirmations=confirmations, threshold=threshold)
    none = F.lit(None)
    return tiered_alert(
        rows.select(
            "*",
            (none.cast("bigint") if use_days is None else use_days).alias("use_days"),
            (none.cast("double") if stock_change is None else stock_change).alias("stock_change"),
            (none.cast("double") if stock_p10 is None else stock_p10).alias("stock_p10"),
            (F.lit("OK") if status is None else status).alias("input_status"),
            (F.array().cast("array<string>") if flags is None else flags).alias("flags"),
        ),
        watch_threshold=threshold, confirmations=confirmations,
    )
