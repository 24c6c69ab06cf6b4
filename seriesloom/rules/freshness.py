"""Freshness by cadence, and what a success, a failure or a skipped run leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.scalars import as_col, local_deadline, quarter_ordinal, redact
from seriesloom.operators.aggregates import (
    FRESHNESS_RANK, HEALTH_RANK, rank_of,
)
from seriesloom.operators.joins import next_scheduled_release


def _pair(freshness: str, health: str) -> Column:
    return F.struct(F.lit(freshness).alias("freshness"), F.lit(health).alias("health"))


def freshness_by_frequency(obs_date: Column | str, frequency: Column | str, today) -> Column:
    """Struct (freshness, health) from the age in days and the cadence."""
    day, f = as_col(obs_date), as_col(frequency)
    lag = F.datediff(F.lit(today).cast("date"), day)
    return (
        F.when(lag.isNull() | (lag < 0), _pair("UNKNOWN", "ERROR"))
        .when((f == "weekly") & (lag <= 10), _pair("FRESH", "OK"))
        .when((f == "weekly") & (lag <= 17), _pair("LATE", "OK"))
        .when(f == "weekly", _pair("STALE", "STALE"))
        .when((f == "policy_event") & (lag <= 45), _pair("FRESH", "OK"))
        .when(f == "policy_event", _pair("LATE", "OK"))
        .when(f.isin("business_daily", "daily") & (lag <= 3), _pair("FRESH", "OK"))
        .when(f.isin("business_daily", "daily") & (lag <= 7), _pair("LATE", "OK"))
        .when(f.isin("business_daily", "daily"), _pair("STALE", "STALE"))
        .otherwise(_pair("UNKNOWN", "OK"))
    )


def release_cycle_freshness(obs_date: Column | str, today) -> Column:
    """Weekly levels dated Wednesday and released Thursday: an older level than
    the expected Wednesday is not released yet, unless it is already stale."""
    day, now = as_col(obs_date), F.lit(today).cast("date")
    base = freshness_by_frequency(day, F.lit("weekly"), today)
    since = F.pmod(F.weekday(now) - 2, F.lit(7))
    expected = F.date_sub(now, since.cast("int"))
    expected = F.when(F.weekday(now) == 2, F.date_sub(expected, 7)).otherwise(expected)
    waiting = (base["health"] != "STALE") & (day < expected)
    return F.when(waiting, _pair("LATE", "NOT_RELEASED_YET")).otherwise(base)


def schedule_freshness(
    states: DataFrame, schedule: DataFrame, *, now, zone: str = "America/New_York",
    deadline: tuple[int, int] = (17, 30),
) -> DataFrame:
    """Freshness against a reviewed release schedule with two hours of grace.

    Without a schedule the state is an error: no cadence is invented.
    """
    at = F.lit(now).cast("timestamp")
    today = F.from_utc_timestamp(at, zone).cast("date")
    base = freshness_by_frequency("obs_date", F.lit("weekly"), today)
    rows = next_scheduled_release(states, schedule).withColumn("_base", base)
    overdue = (
        (at > local_deadline(F.col("next_release"), *deadline, zone=zone))
        & (F.col("obs_date") < F.col("next_report"))
    )
    verdict = (
        F.when(~F.col("has_schedule"), _pair("UNKNOWN", "ERROR"))
        .when(F.col("obs_date").isNull() | (F.col("_base.health") == "STALE"), F.col("_base"))
        .when(F.coalesce(overdue, F.lit(False)), _pair("LATE", "NOT_RELEASED_YET"))
        .otherwise(F.col("_base"))
    )
    return rows.withColumn("_v", verdict).select(
        *states.columns, "next_release", "next_report",
        F.col("_v.freshness").alias("freshness"), F.col("_v.health").alias("health"),
    )


def quarter_lag_freshness(obs_date: Column | str, today) -> Column:
    """Two quarters behind is fresh, three late, more stale; the future an error."""
    day, now = as_col(obs_date), F.lit(today).cast("date")
    lag = quarter_ordinal(now) - quarter_ordinal(day)
    return (
        F.when(day.isNull() | (day > now), _pair("UNKNOWN", "ERROR"))
        .when(lag <= 2, _pair("FRESH", "OK")).when(lag == 3, _pair("LATE", "OK"))
        .otherwise(_pair("STALE", "STALE"))
    )


def record_age_state(asof_date: Column | str, today, max_age: int = 120) -> Column:
    """Reviewed evidence: fresh for 120 days, then stale; the future is an error."""
    lag = F.datediff(F.lit(today).cast("date"), as_col(asof_date))
    return (
        F.when(lag.isNull() | (lag < 0), _pair("UNKNOWN", "ERROR"))
        .when(lag > max_age, _pair("STALE", "STALE")).otherwise(_pair("FRESH", "OK"))
    )


def _worse(a: Column, b: Column, ranks) -> Column:
    return F.when(
        F.coalesce(rank_of(b, ranks), F.lit(-9)) > F.coalesce(rank_of(a, ranks), F.lit(-9)), b
    ).otherwise(a)


def last_good_state(
    attempts: DataFrame, prior: DataFrame, *, today, by: str = "series_id"
) -> DataFrame:
    """The next state of each series after a run.

    ``attempts``: series_id, frequency, outcome (SUCCESS, FAILURE, SKIPPED),
    attempted_at, obs_date, released_at, reason. ``prior``: series_id, obs_date,
    health, freshness, last_success_at, last_attempt_at, released_at, updated_at,
    failure_reason.

    Success: freshness from the data. Failure: rows are kept but the state is
    STALE, or ERROR with nothing to keep. Skipped: the worse of the recomputed
    and the stored state, with the stored stamps.
    """
    stored = prior.select(
        by, *[F.col(c).alias(f"_p_{c}") for c in prior.columns if c != by]
    )
    rows = attempts.join(stored, by, "left")
    c = F.col
    day = F.when(c("outcome") == "SUCCESS", F.greatest(c("obs_date"), c("_p_obs_date"))).otherwise(
        c("_p_obs_date")
    )
    rows = rows.withColumn("_day", day).withColumn(
        "_fresh", freshness_by_frequency("_day", "frequency", today)
    )
    ok, failed = c("outcome") == "SUCCESS", c("outcome") == "FAILURE"
    has = c("_day").isNotNull()
    health = (
        F.when(ok, c("_fresh.health"))
        .when(failed, F.when(has, "STALE").otherwise("ERROR"))
        .otherwise(_worse(c("_fresh.health"), c("_p_health"), HEALTH_RANK))
    )
    freshness = (
        F.when(ok, c("_fresh.freshness"))
        .when(failed, F.when(has, "STALE").otherwise("UNKNOWN"))
        .otherwise(_worse(c("_fresh.freshness"), c("_p_freshness"), FRESHNESS_RANK))
    )
    reason = (
        F.when(failed, redact("reason"))
        .when(
            c("outcome") == "SKIPPED",
            F.when(~has & c("_p_failure_reason").isNull(), "NO_LAST_GOOD")
            .otherwise(redact("_p_failure_reason")),
        )
    )
    return rows.select(
        by, "outcome", c("_day").alias("obs_date"), health.alias("health"),
        freshness.alias("freshness"),
        F.when(ok, c("attempted_at")).otherwise(c("_p_last_success_at")).alias("last_success_at"),
        F.when(c("outcome") == "SKIPPED", c("_p_last_attempt_at")).otherwise(c("attempted_at"))
        .alias("last_attempt_at"),
        F.when(ok, c("released_at")).otherwise(c("_p_released_at")).alias("released_at"),
        F.when(ok, c("attempted_at")).otherwise(c("_p_updated_at")).alias("updated_at"),
        reason.alias("failure_reason"),
    )
