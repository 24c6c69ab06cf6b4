"""Tiered alert, its confidence, and the older additive alert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.scalars import codes
from seriesloom.operators.aggregates import canonical_status
from seriesloom.operators.windows import (
    tail_rows, valid_only,
)

# Confidence steps from lowest to highest.
CONFIDENCE = ("LOW", "MEDIUM", "HIGH")


def downgrade_confidence(confidence: Column, when: Column, steps: int = 1) -> Column:
    """Move down ``steps`` where the condition holds, never below LOW."""
    table = F.array(*[F.lit(c) for c in CONFIDENCE])
    rank = F.array_position(table, confidence)
    lowered = F.try_element_at(table, F.greatest(rank - steps, F.lit(1)).cast("int"))
    return F.when(when & (rank > 0), lowered).otherwise(confidence)


def tiered_alert(
    inputs: DataFrame, *, watch_threshold: float = 3.0, streak_required: int = 3,
    confirmations: Sequence[str] = ("a", "b", "c"), base_confidence: str = "HIGH",
) -> DataFrame:
    """NORMAL, WATCH, ELEVATED, STRESS or UNAVAILABLE with the evidence for it.

    Columns read: latest, positive_streak, change5_<c> and slope5_<c> for each
    confirming series c, use_days (positive days of the latest three),
    stock_change, stock_p10, input_status (worst of all inputs), flags.

    WATCH: the level is above the threshold or the streak is long enough.
    ELEVATED: WATCH and at least one confirming series rising by change and slope.
    STRESS: ELEVATED and repeated use, a drop at or below its p10, or three
    confirmations. Flags lower the confidence one step and change nothing else.
    """
    confirmed = {
        c: F.coalesce((F.col(f"change5_{c}") > 0) & (F.col(f"slope5_{c}") > 0), F.lit(False))
        for c in confirmations
    }
    ids = F.array_sort(codes([(cond, c) for c, cond in confirmed.items()]))
    status = canonical_status("input_status")
    out = inputs.select(
        *inputs.columns, status.alias("quality_status"), ids.alias("confirmation_ids"),
        F.size(ids).alias("confirmation_count"),
        (F.col("latest").isNotNull() & F.coalesce(status == "OK", F.lit(False)))
        .alias("_evaluated"),
    )
    ev, n = F.col("_evaluated"), F.col("confirmation_count")
    above = ev & F.coalesce(F.col("latest") > watch_threshold, F.lit(False))
    streak = F.coalesce(F.col("positive_streak") >= streak_required, F.lit(False))
    drop = F.coalesce(
        (F.col("stock_change") < 0) & (F.col("stock_change") <= F.col("stock_p10")), F.lit(False)
    )
    reasons = codes(
        [
            (F.coalesce(F.col("use_days") >= 2, F.lit(False)), "NONTECHNICAL_USE_2_OF_3"),
            (drop, "STOCK_CHANGE_AT_OR_BELOW_TRAILING_P10"),
            (n >= 3, "MULTIPLE_FUNDING_SPREADS_UP"),
        ]
    )
    out = out.select(
        *[c for c in out.columns if c != "_evaluated"], ev.alias("_evaluated"),
        above.alias("above_threshold"), streak.alias("streak_met"), drop.alias("stock_stress"),
        (ev & (above | streak)).alias("watch_triggered"), reasons.alias("_reasons"),
    )
    watch = F.col("watch_triggered")
    elevated = watch & (n >= 1)
    stress = elevated & (F.size("_reasons") > 0)
    flagged = F.coalesce(F.size("flags"), F.lit(0)) > 0
    return out.select(
        *[c for c in out.columns if not c.startswith("_")],
        elevated.alias("elevated_triggered"), stress.alias("stress_triggered"),
        F.when(~ev, "UNAVAILABLE").when(stress, "STRESS").when(elevated, "ELEVATED")
        .when(watch, "WATCH").otherwise("NORMAL").alias("level"),
        F.when(stress, F.col("_reasons")).otherwise(F.array().cast("array<string>"))
        .alias("stress_reasons"),
        F.when(~ev, "LOW").otherwise(downgrade_confidence(F.lit(base_confidence), flagged))
        .alias("confidence"),
    )


def legacy_alert(
    spreads: DataFrame, context: DataFrame, *, by: Sequence[str] = ("series_id",),
    date: str = "obs_date", value: str = "value",
) -> DataFrame:
    """normal, info, watch or warning with an additive score.

    Only the last rows of a series decide: the last two levels, and whether the
    last three are all positive, in which case every positive level counts.
    ``context``: by, technical, confirmation, stock_drain, backstop (booleans).
    """
    valid = valid_only(spreads, value)
    runs = valid.groupBy(*by).agg(F.count_if(F.col(value) > 0).alias("_positive"))
    last = tail_rows(valid, 3, by=by, date=date).groupBy(*by).agg(
        F.max(F.when(F.col("rn") == 1, F.col(value))).alias("_v1"),
        F.max(F.when(F.col("rn") == 2, F.col(value))).alias("_v2"),
        F.bool_and(F.col(value) > 0).alias("_all"),
    )
    rows = runs.join(last, list(by)).join(context, list(by), "left")
    v1, v2 = F.col("_v1"), F.col("_v2")
    positive = F.when((v1 != 0) & F.col("_all"), F.col("_positive")).when(v1 > 0, 1).otherwise(0)
    technical = F.coalesce("technical", F.lit(False))
    level = (
        F.when((v1 > 3) & F.coalesce(v2 > 3, F.lit(False)) & ~technical, "warning")
        .when(v1 > 3, "watch").when(positive >= 3, "watch").when(v1 > 0, "info")
        .otherwise("normal")
    )
    score = F.when(level.isin("watch", "warning"), 1).otherwise(0)
    for c in ("confirmation", "stock_drain", "backstop"):
        score = score + F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)
    return rows.select(
        *by, level.alias("level"), score.alias("score"),
        F.when(technical, "medium").otherwise("high").alias("confidence"),
        positive.cast("bigint").alias("consecutive_positive"),
    )
