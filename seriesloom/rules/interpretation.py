"""Descriptive reads of metrics: directions, band states, ladders, boundaries.

They never change an alert. Each family returns the same columns (see COLUMNS),
so the router is a union. Wording is not generated; states, severities and rule
bases are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.scalars import as_col, sign_label
from seriesloom.operators.bands import (
    prior_n_floor, prior_only_band, prior_only_change_band, qname,
)
from seriesloom.operators.windows import BY, tail_rows, trailing_slope, valid_only
from seriesloom.rules.model import data_state

COLUMNS = (
    "metric_id", "family", "state", "severity", "direction", "impact", "data_state",
    "rule_basis", "boundary_label", "boundary_threshold", "boundary_distance",
)

# Kinds of rule basis.
SOURCE_RULE, OPERATIONAL = "SOURCE_RULE", "OPERATIONALIZATION"
STATISTICAL, CONTEXT = "STATISTICAL_BAND", "CONTEXT_ONLY"

# Change column behind each direction window.
DIRECTION_WINDOWS = {
    "ONE_OBSERVATION": "one_observation",
    "FIVE_OBSERVATIONS": "five_observations",
    "FOUR_WEEKS": "four_weeks",
}
# Effect of a rising and of a falling value by metric class.
IMPACTS: Mapping[str, tuple[str, str]] = {
    "spread": ("TIGHTENING", "EASING"),
    "fiscal_balance": ("TIGHTENING", "EASING"),
    "stock": ("EASING", "TIGHTENING"),
    "balance_sheet": ("EASING", "TIGHTENING"),
}


def direction_of_change(window: Column | str, changes: Mapping[str, str] = DIRECTION_WINDOWS) -> Column:
    """RISING, FALLING, FLAT or UNKNOWN from the change of the metric's own window."""
    w = as_col(window)
    change = F.lit(None).cast("double")
    for name, column in changes.items():
        change = F.when(w == name, F.col(column)).otherwise(change)
    return sign_label(change, "RISING", "FALLING")


def direction_by_frequency(frequency: Column | str) -> Column:
    """The change a reader sees first for a cadence, as a label and a value."""
    f = F.lower(as_col(frequency))
    one = F.col("one_observation")

    def pick(label: str, column: str | None) -> Column:
        value = one if column is None else F.coalesce(F.col(column), one)
        return F.struct(F.lit(label).alias("label"), value.alias("value"))

    return (
        F.when(f.contains("quarter"), pick("1Q", "one_quarter"))
        .when(f.contains("month"), pick("1M", "one_month"))
        .when(f.contains("week"), pick("1W", "one_week"))
        .otherwise(pick("1 OBS", None))
    )


def impact_of_direction(metric_class: Column | str, direction: Column, state: Column) -> Column:
    k = as_col(metric_class)
    out = (
        F.when(k == "policy_anchor", "POLICY_ANCHOR")
        .when(direction == "UNKNOWN", "UNKNOWN")
        .when(k.isin("absolute_rate", "buffer", "cross_check"), "AMBIGUOUS")
    )
    for name, (rising, falling) in IMPACTS.items():
        out = out.when(
            k == name,
            F.when(direction == "RISING", rising).when(direction == "FALLING", falling)
            .otherwise("NEUTRAL"),
        )
    return out.when(
        k == "backstop",
        F.when(state == "OPERATIONAL_EXERCISE", "AMBIGUOUS")
        .when(state.isin("ISOLATED_USE", "PERSISTENT_USE"), "TIGHTENING").otherwise("NEUTRAL"),
    ).otherwise("UNKNOWN")


def finish(
    rows: DataFrame, family: str, *, state: Column, severity: Column, basis: Column,
    boundary: Column | None = None,
) -> DataFrame:
    """Put a family's verdict into the common columns.

    ``rows`` carries the metric's record: metric_id, metric_class, value, status,
    freshness, direction_window and its change columns.
    """
    none = F.struct(
        F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("threshold"),
        F.lit(None).cast("double").alias("distance"),
    )
    staged = rows.select(
        "*", state.alias("_state"), severity.alias("_severity"), basis.alias("_basis"),
        (none if boundary is None else F.coalesce(boundary, none)).alias("_boundary"),
        direction_of_change("direction_window").alias("_direction"),
    )
    return staged.select(
        "metric_id", F.lit(family).alias("family"), F.col("_state").alias("state"),
        F.col("_severity").alias("severity"), F.col("_direction").alias("direction"),
        impact_of_direction("metric_class", F.col("_direction"), F.col("_state")).alias("impact"),
        data_state("value", "status", "freshness").alias("data_state"),
        F.array_distinct("_basis").alias("rule_basis"),
        F.col("_boundary.label").alias("boundary_label"),
        F.col("_boundary.threshold").alias("boundary_threshold"),
        F.col("_boundary.distance").alias("boundary_distance"),
    )


def _bases(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names])


def _context_severity() -> Column:
    return F.when(F.col("value").isNull(), "UNKNOWN").otherwise("CONTEXT_ONLY")


# --- families --------------------------------------------------------------


def context_only_read(records: DataFrame) -> DataFrame:
    """A level without a risk band of its own."""
    state = F.when(F.col("metric_class") == "policy_anchor", "POLICY_ANCHOR").otherwise(
        "NO_STANDALONE_RISK_BAND"
    )
    return finish(
        records, "context_only", state=state, severity=_context_severity(), basis=_bases(CONTEXT)
    )


def confirmation_states(
    history: DataFrame, *, minimum: int = 60, elevated: float = 0.80, extreme: float = 0.95,
    slope_rows: int = 5, by: Sequence[str] = BY, date: str = "obs_date", value: str = "value",
) -> DataFrame:
    """Level band plus recent slope: ORDINARY, ELEVATED, EXTREME and ``confirming``."""
    lo, hi = qname(elevated), qname(extreme)
    band = prior_only_band(
        history, quantiles=[elevated, extreme], minimum=minimum, by=by, date=date, value=value
    )
    recent = tail_rows(valid_only(history, value), slope_rows, by=by, date=date).drop("rn")
    slope = trailing_slope(
        recent, slope_rows, by=by, date=date, value=value, full_window=True
    ).groupBy(*by).agg(F.max_by("slope", date).alias("slope"))
    c = F.col("current")
    return band.join(slope, list(by), "left").select(
        "*",
        F.when(c.isNull(), "UNKNOWN")
        .when(F.col(lo).isNull() | F.col(hi).isNull(), "INSUFFICIENT_HISTORY")
        .when(c >= F.col(hi), "EXTREME").when(c >= F.col(lo), "ELEVATED").otherwise("ORDINARY")
        .alias("state"),
        F.when(
            F.col(lo).isNotNull() & F.col("slope").isNotNull(),
            (c >= F.col(lo)) & (F.col("slope") > 0),
        ).alias("confirming"),
    )


def confirmation_read(records: DataFrame, states: DataFrame) -> DataFrame:
    rows = records.join(states.select(F.col("series_id").alias("metric_id"), "state", "confirming"),
                        "metric_id")
    severity = (
        F.when(F.col("value").isNull(), "UNKNOWN").when(F.col("confirming"), "WATCH")
        .otherwise("NORMAL")
    )
    return finish(
        rows, "confirmation", state=F.col("state"), severity=severity, basis=_bases(STATISTICAL)
    )


def breadth_counter(states: DataFrame, *, by: Sequence[str], members: int = 3) -> DataFrame:
    """How many confirming members agree; null while any of them is unknown."""
    complete = (F.count_if(F.col("confirming").isNull()) == 0) & (
        F.count(F.lit(1)) == members
    )
    count = F.count_if("confirming")
    labels = F.array(
        *[F.lit(x) for x in ("NO_CONFIRMATION", "ISOLATED", "BROADENING", "BROAD_FUNDING_PRESSURE")]
    )
    return states.groupBy(*by).agg(
        F.when(complete, count).alias("confirming_count"), F.count(F.lit(1)).alias("members"),
        F.when(complete, F.try_element_at(labels, (count + 1).cast("int")))
        .otherwise("INSUFFICIENT_HISTORY").alias("state"),
    )


def flow_state(
    current: Column, notable: Column, large: Column
) -> Column:
    """Balance flow: a release, or a drain by its prior-history quantiles."""
    return (
        F.when(current.isNull(), "UNKNOWN").when(current <= 0, "LIQUIDITY_RELEASE")
        .when(notable.isNull() | large.isNull(), "INSUFFICIENT_HISTORY")
        .when(current >= large, "LARGE_DRAIN").when(current >= notable, "NOTABLE_DRAIN")
        .otherwise("MILD_DRAIN")
    )


# Order of flow states from weakest to strongest.
FLOW_ORDER = (
    "UNKNOWN", "LIQUIDITY_RELEASE", "INSUFFICIENT_HISTORY", "MILD_DRAIN", "NOTABLE_DRAIN",
    "LARGE_DRAIN",
)


def flow_states(
    history: DataFrame, *, lags: tuple[int, int] = (5, 20), notable: float = 0.75,
    large: float = 0.90, minimum: int = 60, by: Sequence[str] = BY, date: str = "obs_date",
    value: str = "value",
) -> DataFrame:
    """Short and long flow state and the stronger of the two."""
    out = None
    for name, lag in zip(("short", "long"), lags):
        band = prior_only_change_band(
            history, lag=lag, quantiles=[notable, large], minimum=minimum, by=by, date=date,
            value=value,
        ).select(
            *by,
            F.col("current").alias(f"{name}_flow"), F.col("percentile").alias(f"{name}_percentile"),
            F.col("sample_size").alias(f"{name}_sample"),
            flow_state(F.col("current"), F.col(qname(notable)), F.col(qname(large)))
            .alias(f"{name}_state"),
        )
        out = band if out is None else out.join(band, list(by))
    order = F.array(*[F.lit(s) for s in FLOW_ORDER])
    a, b = F.col("short_state"), F.col("long_state")
    return out.withColumn(
        "flow_state",
        F.when(F.array_position(order, b) > F.array_position(order, a), b).otherwise(a),
    )


def technical_suffix(state: Column, technical: Column) -> Column:
    """Name a drain on a flagged date technical; it is never called stress."""
    drain = state.isin("MILD_DRAIN", "NOTABLE_DRAIN", "LARGE_DRAIN")
    return F.when(technical & drain, F.concat(state, F.lit("_TECHNICAL_DRAIN"))).otherwise(state)


def is_technical(flags: Column | str) -> Column:
    return F.coalesce(
        F.exists(as_col(flags), lambda f: (f == "TAX_WINDOW") | f.contains("SETTLEMENT")),
        F.lit(False),
    )


def impulse_states(
    history: DataFrame, *, lag: int = 4, lower: float = 0.25, upper: float = 0.75,
    minimum: int = 104, by: Sequence[str] = BY, date: str = "obs_date", value: str = "value",
) -> DataFrame:
    """CONTRACTING below the lower quantile, EXPANDING above the upper one."""
    band = prior_only_change_band(
        history, lag=lag, quantiles=[lower, upper], minimum=minimum, by=by, date=date, value=value
    )
    c, lo, hi = F.col("current"), F.col(qname(lower)), F.col(qname(upper))
    return band.withColumn(
        "state",
        F.when(c.isNull(), "UNKNOWN").when(lo.isNull() | hi.isNull(), "INSUFFICIENT_HISTORY")
        .when(c < lo, "CONTRACTING").when(c > hi, "EXPANDING").otherwise("BROADLY_FLAT"),
    )


def buffer_states(
    history: DataFrame, direction: Column, *, window: int = 20, minimum: int = 20,
    quantile: float = 0.10, by: Sequence[str] = BY, date: str = "obs_date", value: str = "value",
) -> DataFrame:
    """Floor of the last 20 prior values; ``direction`` may use the columns of
    the band rows."""
    band = prior_n_floor(
        history, window=window, minimum=minimum, quantile=quantile, by=by, date=date, value=value
    )
    c, floor = F.col("current"), F.col(qname(quantile))
    return band.withColumn(
        "state",
        F.when(c.isNull(), "UNKNOWN").when(c == 0, "AT_FLOOR")
        .when(floor.isNull(), "INSUFFICIENT_HISTORY").when(c <= floor, "NEAR_FLOOR")
        .when(direction == "FALLING", "DEPLETING_BUFFER").otherwise("AVAILABLE_BUFFER"),
    )


def usage_state(
    value: Column, positive_days: Column, required: int, exercise_today: Column
) -> Column:
    return (
        F.when(value.isNull() | positive_days.isNull(), "UNKNOWN")
        .when(positive_days >= required, "PERSISTENT_USE")
        .when(exercise_today & (positive_days == 0), "OPERATIONAL_EXERCISE")
        .when(positive_days == 1, "ISOLATED_USE").otherwise("DORMANT")
    )


def cross_check_read(records: DataFrame, bands: DataFrame) -> DataFrame:
    rows = records.join(
        bands.select(F.col("check_id").alias("metric_id"), "state"), "metric_id"
    )
    severity = F.when(F.col("state") == "NOT_RELEASED", "UNKNOWN").otherwise("CONTEXT_ONLY")
    return finish(
        rows, "cross_check", state=F.col("state"), severity=severity,
        basis=_bases(CONTEXT, STATISTICAL),
    )


# --- ladders ---------------------------------------------------------------


def regime_ladder(
    levels: DataFrame, zones: DataFrame, *, on: Sequence[str] = ("ladder_id",),
    entity: Sequence[str] = ("series_id",), value: str = "value",
) -> DataFrame:
    """Every zone of a ladder with ``active`` and ``met`` (null for a null level).

    ``zones``: ladder_id, zone_no, label, lower, upper (half open [lower, upper),
    null = unbounded), severity, basis.
    """
    v = F.col(value)
    inside = (F.col("lower").isNull() | (v >= F.col("lower"))) & (
        F.col("upper").isNull() | (v < F.col("upper"))
    )
    return levels.join(zones, list(on)).select(
        *on, *[e for e in entity if e not in on], value, "zone_no", "label", "lower", "upper",
        "severity", "basis",
        F.coalesce(v.isNotNull() & inside, F.lit(False)).alias("active"),
        F.when(v.isNotNull(), inside).alias("met"),
    )


def next_boundary(
    levels: DataFrame, boundaries: DataFrame, *, on: Sequence[str] = ("ladder_id",),
    entity: Sequence[str] = ("series_id",), value: str = "value",
) -> DataFrame:
    """The nearest threshold still ahead and the signed distance to it.

    ``boundaries``: ladder_id, label, threshold, side (``above``: reached by
    rising, ``below``: reached by falling).
    """
    v, t = F.col(value), F.col("threshold")
    gap = F.when(F.col("side") == "above", t - v).otherwise(v - t)
    ahead = F.when(F.col("side") == "above", v < t).otherwise(v >= t)
    keys = [*on, *[e for e in entity if e not in on]]
    return levels.join(boundaries, list(on)).where(v.isNotNull() & ahead).groupBy(
        *keys, value
    ).agg(
        F.min_by("label", gap).alias("label"), F.min_by("threshold", gap).alias("threshold"),
        F.round(F.min(gap), 6).alias("distance"),
    )


def spread_ladder_read(
    records: DataFrame, *, positive_line: float = 0.0, streak_required: int = 3,
    red_line: float = 3.0, stock_red: float = 2800.0,
) -> DataFrame:
    """Spread ladder. ``records`` also carries streak and stock_value.

    The spread leg alone never counts as the full red route: that also needs the
    stock below its red line.
    """
    v, s, stock = F.col("value"), F.col("streak"), F.col("stock_value")
    no = F.lit(False)
    leg = F.coalesce(v > red_line, no)
    full = leg & F.coalesce(stock < stock_red, no)
    yellow = v.isNotNull() & F.coalesce(s >= streak_required, no)
    state = (
        F.when(v.isNull(), "UNKNOWN").when(full, "FULL_RED_ROUTE_A").when(leg, "RED_SPREAD_LEG")
        .when(yellow, "YELLOW_CLAUSE_MET").when(v > positive_line, "POSITIVE_PRINT")
        .otherwise("NO_PRICE_PRESSURE")
    )
    severity = (
        F.when(v.isNull(), "UNKNOWN").when(full, "RED").when(leg & yellow, "YELLOW")
        .when(leg, "WATCH").when(yellow, "YELLOW").otherwise("NORMAL")
    )

    def at(label: str, threshold: float, distance: Column) -> Column:
        return F.struct(
            F.lit(label).alias("label"), F.lit(float(threshold)).alias("threshold"),
            F.round(distance, 6).alias("distance"),
        )

    boundary = (
        F.when(v <= positive_line, at("POSITIVE_PRINT", positive_line, F.lit(positive_line) - v))
        .when(v <= red_line, at("RED_SPREAD_LEG", red_line, F.lit(red_line) - v))
        .when(v.isNotNull() & ~full, at("STOCK_CONFIRMATION", stock_red, stock - stock_red))
    )
    return finish(
        records, "spread_ladder", state=state, severity=severity,
        basis=_bases(SOURCE_RULE, OPERATIONAL, STATISTICAL), boundary=boundary,
    )


def stock_ladder_read(
    records: DataFrame, *, yellow: float = 2900.0, red: float = 2800.0, extreme: float = 2500.0
) -> DataFrame:
    """Stock level zone × four-week speed. ``records`` carries change_4w and p10."""
    v, change, p10 = F.col("value"), F.col("change_4w"), F.col("p10")
    level = (
        F.when(v.isNull(), "UNKNOWN").when(v < extreme, "EXTREME_LEVEL_CANDIDATE")
        .when(v < red, "RED_CONFIRMATION_ZONE").when(v < yellow, "YELLOW_ZONE")
        .otherwise("ABOVE_YELLOW_ZONE")
    )
    speed = (
        F.when(change.isNull(), "INSUFFICIENT_HISTORY").when(change > 0, "REPLENISHING")
        .when(p10.isNull(), "INSUFFICIENT_HISTORY").when(change <= p10, "RAPID_DRAIN")
        .otherwise("ORDINARY_DRAIN")
    )
    severity = (
        F.when(v.isNull(), "UNKNOWN").when(v < extreme, "EXTREME").when(v < red, "RED")
        .when(v < yellow, "YELLOW").otherwise("NORMAL")
    )
    target = F.when(v >= yellow, yellow).when(v >= red, red).when(v >= extreme, extreme)
    label = (
        F.when(v >= yellow, "YELLOW_ZONE").when(v >= red, "RED_CONFIRMATION_ZONE")
        .when(v >= extreme, "EXTREME_LEVEL_CANDIDATE")
    )
    boundary = F.when(
        target.isNotNull(),
        F.struct(
            label.alias("label"), target.cast("double").alias("threshold"),
            F.round(v - target, 6).alias("distance"),
        ),
    )
    return finish(
        records, "stock_ladder", state=F.concat_ws("|", level, speed), severity=severity,
        basis=_bases(SOURCE_RULE, OPERATIONAL, STATISTICAL), boundary=boundary,
    )


def balance_ladder_read(
    records: DataFrame, *, floor: float = 950.0, target: float = 1000.0
) -> DataFrame:
    """Balance level × flow. ``records`` carries flow_state and flags."""
    v = F.col("value")
    level = (
        F.when(v.isNull(), "UNKNOWN").when(v < floor, "BELOW_PROXIMITY_ZONE")
        .when(v < target, "APPROACHING_TARGET").otherwise("ABOVE_TARGET")
    )
    flow = technical_suffix(F.col("flow_state"), is_technical("flags"))
    ahead = F.when(v < floor, floor).when(v < target, target)
    boundary = F.when(
        ahead.isNotNull(),
        F.struct(
            F.when(v < floor, "APPROACHING_TARGET").otherwise("ABOVE_TARGET").alias("label"),
            ahead.cast("double").alias("threshold"), F.round(ahead - v, 6).alias("distance"),
        ),
    )
    return finish(
        records, "balance_ladder", state=F.concat_ws("|", level, flow),
        severity=_context_severity(),
        basis=_bases(CONTEXT, STATISTICAL, OPERATIONAL, SOURCE_RULE), boundary=boundary,
    )


def banded_read(records: DataFrame, states: DataFrame, family: str) -> DataFrame:
    """A context read whose state comes from a band (buffer, impulse)."""
    rows = records.join(states.select(F.col("series_id").alias("metric_id"), "state"), "metric_id")
    return finish(
        rows, family, state=F.col("state"), severity=_context_severity(),
        basis=_bases(CONTEXT, STATISTICAL),
    )


def usage_read(records: DataFrame, *, required: int = 2) -> DataFrame:
    """``records`` carries positive_days and exercise_today."""
    state = usage_state(
        F.col("value"), F.col("positive_days"), required, F.col("exercise_today")
    )
    severity = (
        F.when(F.col("value").isNull() | F.col("positive_days").isNull(), "UNKNOWN")
        .when(F.col("positive_days") >= required, "RED").otherwise("NORMAL")
    )
    return finish(records, "usage", state=state, severity=severity, basis=_bases(OPERATIONAL))


# --- router ----------------------------------------------------------------


def interpretation_router(
    reads: Sequence[DataFrame], routing: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(reads of the routed metrics, violations).

    ``routing``: metric_id, family. A routed metric without a read, or with a
    read of another family, is a violation; metrics outside the table stay out.
    """
    union = reads[0]
    for other in reads[1:]:
        union = union.unionByName(other)
    wanted = routing.select("metric_id", F.col("family").alias("_wanted"))
    joined = wanted.join(union, "metric_id", "left")
    problem = F.when(F.col("family").isNull(), "MISSING_INTERPRETATION").when(
        F.col("family") != F.col("_wanted"), "FAMILY_MISMATCH"
    )
    good = joined.where("family = _wanted").select(*COLUMNS)
    bad = joined.withColumn("check_id", problem).where("check_id IS NOT NULL").select(
        "check_id", F.col("metric_id").alias("key"), F.col("_wanted").alias("detail")
    )
    return good, bad


def distinct_bases(reads: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """The distinct rule bases behind a group of reads (a fixed vocabulary)."""
    return reads.select(*by, F.explode("rule_basis").alias("basis")).groupBy(*by).agg(
        F.array_sort(F.collect_set("basis")).alias("rule_basis")
    )


