"""Evidence states, clauses and the three-tier model in three-valued logic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.scalars import as_col, codes
from seriesloom.functions.tristate import compare
from seriesloom.operators.windows import tail_rows
from seriesloom.rules.alerts import downgrade_confidence


def evidence_state(
    value: Column | str, status: Column | str, freshness: Column | str
) -> Column:
    """CURRENT, LAST_GOOD, STALE or MISSING."""
    v, s, f = as_col(value), as_col(status), F.coalesce(as_col(freshness), F.lit("UNKNOWN"))
    return (
        F.when(v.isNull() | s.isNull(), "MISSING")
        .when((s == "OK") & (f == "FRESH"), "CURRENT")
        .when((s == "NOT_RELEASED_YET") | ((s == "OK") & (f == "LATE")), "LAST_GOOD")
        .when((s == "STALE") | (f == "STALE"), "STALE")
        .otherwise("MISSING")
    )


def usable(state: Column) -> Column:
    return state.isin("CURRENT", "LAST_GOOD")


def data_state(value: Column | str, status: Column | str, freshness: Column | str) -> Column:
    """The reader's variant of the same: UNKNOWN in place of MISSING, and
    staleness outranks everything but a missing value."""
    v, s, f = as_col(value), as_col(status), as_col(freshness)
    return (
        F.when(v.isNull(), "UNKNOWN")
        .when((f == "STALE") | (s == "STALE"), "STALE")
        .when((s == "OK") & (f == "FRESH"), "CURRENT")
        .when((s == "NOT_RELEASED_YET") | ((s == "OK") & (f == "LATE")), "LAST_GOOD")
        .otherwise("UNKNOWN")
    )


def evaluate_clauses(
    metrics: DataFrame, clauses: DataFrame, *, entity: Sequence[str] = (), metric: str = "metric_id"
) -> DataFrame:
    """One row per clause: ``met`` is the comparison, or null without usable evidence.

    ``metrics``: entity, metric_id, value, status, freshness. ``clauses``: a rule
    table clause_id, metric_id, operator, threshold.
    """
    state = evidence_state("value", "status", "freshness")
    rows = metrics.join(clauses, metric).withColumn("evidence_state", state)
    holds = compare(F.col("operator"), F.col("value"), F.col("threshold"))
    return rows.select(
        *entity, metric, "clause_id", "operator", "threshold", "value", "evidence_state",
        F.when(usable(F.col("evidence_state")), holds).alias("met"),
    )


def k_of_n_days(
    days: DataFrame, *, n: int = 3, k: int = 2, by: Sequence[str], date: str = "obs_date",
    tolerance: float = 1e-6,
) -> DataFrame:
    """At least k positive among the last n classified days.

    Columns read: accepted, eligible, exercise, has_exercise, exercise_only,
    classified. A day whose classification is incomplete makes the count null, a
    short window makes the verdict null; totals that do not add up are violations.
    """
    complete = F.coalesce(F.col("classified"), F.lit(False)) & ~(
        F.col("accepted").isNull() | F.col("eligible").isNull() | F.col("exercise").isNull()
        | F.col("has_exercise").isNull() | F.col("exercise_only").isNull()
    )
    off = F.coalesce(
        (F.abs(F.col("accepted") - F.col("eligible") - F.col("exercise")) > tolerance)
        | (F.col("exercise_only") & (~F.col("has_exercise") | (F.col("eligible") != 0))),
        F.lit(False),
    )
    whole = days.groupBy(*by).agg(
        F.bool_and(complete).alias("classification_complete"),
        F.count(F.lit(1)).alias("days_available"), F.count_if(off).alias("violations"),
        F.max(date).alias("latest_day"),
    )
    last = tail_rows(days, n, by=by, date=date).groupBy(*by).agg(
        F.count_if(F.col("eligible") > 0).alias("_positive")
    )
    count = F.when(F.col("classification_complete"), F.col("_positive"))
    return whole.join(last, list(by), "left").select(
        *by, "latest_day", "days_available", "classification_complete", "violations",
        count.alias("positive_days"),
        F.when(
            F.col("classification_complete") & (F.col("days_available") >= n), count >= k
        ).alias("k_of_n_met"),
    )


@dataclass(frozen=True)
class ModelThresholds:
    """Levels of the three tiers, in the units of the input columns."""

    streak: int = 3
    stock_low: float = 2900.0
    stock_lower: float = 2800.0
    stock_lowest: float = 2500.0
    balance_floor: float = 950.0
    spread: float = 3.0
    use_days_required: int = 2
    enabled: bool = True


# Clause names by model tier, in order.
EVIDENCE_CLAUSES = (
    "positive_streak", "stock_below_low", "stock_change_negative", "balance_near_target",
    "spread_above", "use_days", "rapid_decline",
)


def tri_state_model(inputs: DataFrame, t: ModelThresholds = ModelThresholds()) -> DataFrame:
    """GREEN, YELLOW, RED, EXTREME_* or UNAVAILABLE per row, unknowns carried through.

    Columns read: spread, streak, stock, stock_change, stock_p10, balance, use_days
    and use_complete (count and whether the window is complete), the status and
    freshness columns ``<m>_status``/``<m>_freshness`` for m in spread, stock,
    balance, use, then context (UNKNOWN, MAJOR_CRISIS_PRESENT, NO_MAJOR_CRISIS)
    and flags.

    A false term settles an AND and a true one an OR. An unknown higher tier
    blocks the lower ones only while it could still win.
    """
    def state(value: Column, metric: str) -> Column:
        return evidence_state(value, f"{metric}_status", f"{metric}_freshness")

    c = F.col
    both = F.when(c("stock_change").isNotNull() & c("stock_p10").isNotNull(), F.lit(1.0))
    window = F.when(c("use_complete"), c("use_days"))
    tests: Mapping[str, tuple[Column, Column]] = {
        "positive_streak": (state(c("streak"), "spread"), c("streak") >= t.streak),
        "stock_below_low": (state(c("stock"), "stock"), c("stock") < t.stock_low),
        "stock_change_negative": (state(c("stock_change"), "stock"), c("stock_change") < 0),
        "balance_near_target": (state(c("balance"), "balance"), c("balance") >= t.balance_floor),
        "spread_above": (state(c("spread"), "spread"), c("spread") > t.spread),
        "stock_below_lower": (state(c("stock"), "stock"), c("stock") < t.stock_lower),
        "use_days": (state(window, "use"), window >= t.use_days_required),
        "stock_below_lowest": (state(c("stock"), "stock"), c("stock") < t.stock_lowest),
        "rapid_decline": (state(both, "stock"), c("stock_change") <= c("stock_p10")),
    }
    rows = inputs.select(
        *inputs.columns, *[s.alias(f"_e_{n}") for n, (s, _) in tests.items()]
    ).select(
        *inputs.columns, *[f"_e_{n}" for n in tests],
        *[F.when(usable(c(f"_e_{n}")), m).alias(f"met_{n}") for n, (_, m) in tests.items()],
    )

    def m(name: str) -> Column:
        return c(f"met_{name}")

    quiet = F.when(c("context") == "NO_MAJOR_CRISIS", True).when(
        c("context") == "MAJOR_CRISIS_PRESENT", False
    )
    rows = rows.select(
        "*",
        (m("positive_streak") & m("stock_below_low") & m("stock_change_negative")
         & m("balance_near_target")).alias("yellow"),
        (m("spread_above") & m("stock_below_lower")).alias("red_route_a"),
        m("use_days").alias("red_route_b"),
        ((m("spread_above") & m("stock_below_lower")) | m("use_days")).alias("red"),
        (m("stock_below_lowest") & m("rapid_decline")).alias("extreme_candidate"),
        quiet.alias("_quiet"),
    ).withColumn("extreme", c("extreme_candidate") & c("_quiet"))
    candidate, no = c("extreme_candidate"), F.lit(False)
    needs_context = F.coalesce(candidate, no) & c("_quiet").isNull()
    may_outrank = candidate.isNull() & F.coalesce(c("_quiet"), F.lit(True))
    status = (
        F.when(c("extreme"), "EXTREME_CONFIRMED")
        .when(needs_context, "EXTREME_CONTEXT_REQUIRED")
        .when(may_outrank, "UNAVAILABLE")
        .when(c("red"), "RED").when(c("red").isNull(), "UNAVAILABLE")
        .when(c("yellow"), "YELLOW").when(c("yellow").isNull(), "UNAVAILABLE")
        .otherwise("GREEN")
    )
    states = F.array(*[c(f"_e_{n}") for n in EVIDENCE_CLAUSES])
    rows = rows.withColumn("status", status).withColumn(
        "data_status",
        F.when(c("status") == "UNAVAILABLE", "UNAVAILABLE")
        .when(F.arrays_overlap(states, F.array(F.lit("STALE"), F.lit("MISSING"))), "PARTIAL")
        .when(F.array_contains(states, "LAST_GOOD"), "LAST_GOOD").otherwise("CURRENT"),
    )
    confidence = (
        F.when(c("status") == "UNAVAILABLE", "UNKNOWN")
        .when((c("data_status") == "CURRENT") & (c("status") != "EXTREME_CONTEXT_REQUIRED"), "HIGH")
        .otherwise("MEDIUM")
    )
    flagged = F.coalesce(F.size("flags"), F.lit(0)) > 0
    unknown = F.array_sort(codes([(m(n).isNull(), n) for n in EVIDENCE_CLAUSES]))
    out = rows.select(
        *inputs.columns, *[f"met_{n}" for n in tests], "yellow", "red_route_a", "red_route_b",
        "red", "extreme_candidate", "extreme", needs_context.alias("context_required"),
        "status", "data_status", downgrade_confidence(confidence, flagged).alias("confidence"),
        unknown.alias("unknown_ids"),
        F.when(c("status") == "UNAVAILABLE", "EVIDENCE_UNAVAILABLE").alias("availability_reason"),
    )
    return out if t.enabled else _disabled(out, list(inputs.columns))


def _disabled(out: DataFrame, keep: list[str]) -> DataFrame:
    """A switched-off model: every verdict is blank and the reason says so."""
    fixed = {
        "status": F.lit("UNAVAILABLE"), "data_status": F.lit("UNAVAILABLE"),
        "confidence": F.lit("UNKNOWN"), "availability_reason": F.lit("DISABLED"),
        "context_required": F.lit(False), "unknown_ids": F.array().cast("array<string>"),
    }
    return out.select(
        *[
            F.col(n) if n in keep
            else fixed[n].alias(n) if n in fixed
            else F.lit(None).cast("boolean").alias(n)
            for n in out.columns
        ]
    )
