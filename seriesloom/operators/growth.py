"""Quarterly operators: exact ordinals, growth and acceleration, decumulation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.scalars import (
    pct_change, quarter_end, quarter_label, quarter_ordinal, ratio, sign_label,
)
from seriesloom.operators.clean import fold_duplicates, latest_restatement


def to_quarters(
    obs: DataFrame, *, by: Sequence[str] = ("series_id",), date: str = "obs_date",
    payload: Sequence[str] = ("value",), strict: bool = False,
) -> DataFrame:
    """One row per (series, quarter ordinal); two different rows conflict.

    The source date is part of the payload, so two dates in one quarter conflict.
    """
    keyed = obs.withColumn("ordinal", quarter_ordinal(date))
    return fold_duplicates(keyed, [*by, "ordinal"], [date, *payload], strict=strict)


def quarter_ratio(
    numerator: DataFrame, denominator: DataFrame, *, numerator_scale: float = 1000.0,
    by: Sequence[str] = ("pair",), provenance: Sequence[str] = (),
) -> DataFrame:
    """Ratio in percent on exact common quarters; both source dates are kept.

    Inputs carry by, ordinal, obs_date, value and the provenance columns. A null
    or zero component gives a null ratio, never a filled one.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            *by, "ordinal", F.col("obs_date").alias(f"{name}_source_date"),
            F.col("value").alias(f"_{name}"),
            *[F.col(c).alias(f"{name}_{c}") for c in provenance],
        )

    joined = side(numerator, "numerator").join(side(denominator, "denominator"), [*by, "ordinal"])
    top = F.col("_numerator") / F.lit(numerator_scale)
    extra = [f"{n}_{c}" for c in provenance for n in ("numerator", "denominator")]
    return joined.select(
        *by, "ordinal", quarter_end(F.col("ordinal")).alias("obs_date"),
        quarter_label("numerator_source_date").alias("quarter"),
        (ratio(top, F.col("_denominator")) * 100).alias("ratio"),
        F.round(top, 6).alias("numerator"), F.round("_denominator", 6).alias("denominator"),
        "numerator_source_date", "denominator_source_date", *extra,
    )


def ordinal_window_stats(
    ratios: DataFrame, *, by: Sequence[str] = ("pair",), window: int = 40,
    value: str = "ratio",
) -> DataFrame:
    """Changes against exactly one and four quarters ago, mid-rank over 40 quarters.

    All by ordinal, so a missing quarter gives null instead of an older value.
    The 40-quarter frame bounds the array that each mid-rank reads.
    """
    w = Window.partitionBy(*by).orderBy("ordinal")
    back = lambda k: F.first(value).over(w.rangeBetween(-k, -k))
    rows = ratios.select(
        "*", back(1).alias("_t1"), back(4).alias("_t4"),
        F.collect_list(value).over(w.rangeBetween(-(window - 1), 0)).alias("_past"),
    )
    v = F.col(value)
    below = F.size(F.filter("_past", lambda x: x < v))
    equal = F.size(F.filter("_past", lambda x: x == v))
    midrank = (below + equal * 0.5) / F.nullif(F.size("_past").cast("double"), F.lit(0.0)) * 100
    return rows.select(
        *ratios.columns,
        F.round(v, 6).alias("value"),
        F.round(v - F.col("_t1"), 6).alias("change_1_quarter_pp"),
        F.round(pct_change(v, F.col("_t1")), 6).alias("qoq_pct"),
        F.round(pct_change(v, F.col("_t4")), 6).alias("yoy_pct"),
        F.round(F.when(v.isNotNull(), midrank), 6).alias("midrank"),
        F.size("_past").cast("bigint").alias("midrank_sample_size"),
    )


def macro_package(
    stats: DataFrame, metadata: DataFrame, *, by: Sequence[str] = ("pair",)
) -> DataFrame:
    """Latest-quarter statistics with source dates and both sources' metadata.

    A null latest quarter is reported as null. ``metadata``: by, role, title,
    units, seasonal_adjustment, last_updated.
    """
    payload = [c for c in stats.columns if c not in (*by, "ordinal")]
    latest = stats.groupBy(*by).agg(
        F.max_by(F.struct(*payload), "ordinal").alias("_row"),
        F.count(F.lit(1)).alias("common_quarters"),
    ).select(*by, "_row.*", "common_quarters")
    fields = [c for c in metadata.columns if c not in (*by, "role")]
    meta = metadata.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("role") == role, F.col(c))).alias(f"{role}_{c}")
            for role in ("numerator", "denominator") for c in fields
        ]
    )
    return latest.join(meta, list(by), "left")


# --- growth ----------------------------------------------------------------


def growth_acceleration(
    obs: DataFrame, *, by: Sequence[str] = ("series_id",), date: str = "obs_date",
    value: str = "value",
) -> DataFrame:
    """Growth by position and the change of growth, from rounded stored figures.

    The level and growth of earlier rows enter as stored, rounded to six places;
    the current figure enters unrounded. A zero base gives null.
    """
    w = Window.partitionBy(*by).orderBy(date)
    stored = obs.withColumn("_stored", F.round(value, 6))
    grown = stored.select(
        "*",
        pct_change(F.col(value), F.lag("_stored", 1).over(w)).alias("_qoq"),
        pct_change(F.col(value), F.lag("_stored", 4).over(w)).alias("_yoy"),
    ).withColumn("qoq_pct", F.round("_qoq", 6)).withColumn("yoy_pct", F.round("_yoy", 6))
    out = grown.select(
        *obs.columns, "qoq_pct", "yoy_pct",
        F.round(F.col("_qoq") - F.lag("qoq_pct").over(w), 6).alias("qoq_acceleration_pp"),
        F.round(F.col("_yoy") - F.lag("yoy_pct").over(w), 6).alias("yoy_acceleration_pp"),
    )
    return out.withColumn(
        "direction", sign_label("yoy_acceleration_pp", "ACCELERATING", "DECELERATING")
    )


def fiscal_year(end: Column, fye_month: Column) -> Column:
    """Fiscal year of a period end for a year that closes at a month end.

    The closing day is the month's last day in a leap year, so 29 February of a
    leap year still belongs to the closing year.
    """
    after = F.month(end) > fye_month
    return F.year(end) + F.when(after, 1).otherwise(0)


def fiscal_quarter(start: Column, end: Column, fye_month: Column) -> Column:
    """1–4 when [start, end] is exactly a year-to-date context, else null."""
    fy = fiscal_year(end, fye_month)
    year_end = F.last_day(F.make_date(fy, fye_month, F.lit(1)))
    opening = F.date_add(F.last_day(F.make_date(fy - 1, fye_month, F.lit(1))), 1)
    choice = F.lit(None).cast("int")
    for q in (1, 2, 3, 4):
        close = F.last_day(F.add_months(year_end, (q - 4) * 3))
        choice = F.when((start == opening) & (end == close), F.lit(q)).otherwise(choice)
    return choice


def decumulate_ytd(
    facts: DataFrame, *, by: Sequence[str] = ("entity", "tag"), fye_month: str = "fye_month",
    optional: bool = False, strict: bool = False,
) -> DataFrame:
    """Single quarters from year-to-date facts.

    Facts without filing provenance are left out; per exact context the latest
    restatement counts. A quarter whose predecessor is missing is skipped. A
    negative quarter is an error (``is_negative``, or a failing job in strict
    mode), or is skipped for an optional concept.
    """
    usable = F.col("accepted_at").isNotNull() & ~F.coalesce("metadata_missing", F.lit(False))
    start, end, fye = F.col("ctx_start"), F.col("ctx_end"), F.col(fye_month)
    keyed = facts.where(usable).select(
        "*", fiscal_year(end, fye).alias("fiscal_year"),
        fiscal_quarter(start, end, fye).alias("fiscal_q"),
    ).where("fiscal_q IS NOT NULL")
    chosen = latest_restatement(
        keyed, [*by, "fiscal_year", "fiscal_q"], filing="accession", strict=strict
    )
    w = Window.partitionBy(*by, "fiscal_year").orderBy("fiscal_q")
    follows = F.lag("fiscal_q").over(w) == F.col("fiscal_q") - 1
    single = F.when(F.col("fiscal_q") == 1, F.col("value")).when(
        follows, F.col("value") - F.lag("value").over(w)
    )
    methods = F.create_map(
        *[
            F.lit(x)
            for pair in {1: "Q1_YTD", 2: "H1_MINUS_Q1", 3: "9M_MINUS_H1", 4: "FY_MINUS_9M"}.items()
            for x in pair
        ]
    )
    out = chosen.withColumn("quarter_value", single).where("quarter_value IS NOT NULL").select(
        *by, F.col("ctx_end").alias("obs_date"), "fiscal_year", "fiscal_q",
        F.concat(
            F.lit("FY"), F.col("fiscal_year").cast("string"), F.lit("Q"),
            F.col("fiscal_q").cast("string"),
        ).alias("fiscal_quarter"),
        F.col("quarter_value").alias("value"),
        methods[F.col("fiscal_q")].alias("method"),
        "accession", "form", "filed", "accepted_at", "ctx_start", "is_conflict",
        (F.col("quarter_value") < 0).alias("is_negative"),
    )
    if optional:
        return out.where(~F.col("is_negative"))
    if strict:
        return out.where(
            F.when(
                F.col("is_negative"),
                F.raise_error(F.concat(F.lit("negative quarter "), F.col("fiscal_quarter")))
                .cast("boolean"),
            ).otherwise(F.lit(True))
        )
    return out


def attach_optional(
    primary: DataFrame, optional: DataFrame, *, by: Sequence[str] = ("entity",)
) -> DataFrame:
    """The optional concept beside the primary one, only from the same filing."""
    side = optional.select(
        *by, "obs_date", F.col("accession").alias("_acc"), F.col("value").alias("_val"),
        F.col("method").alias("_method"),
    )
    joined = primary.join(side, [*by, "obs_date"], "left")
    same = F.col("_acc") == F.col("accession")
    return joined.select(
        *primary.columns, F.when(same, F.col("_val")).alias("optional_value"),
        F.when(same, F.col("_acc")).alias("optional_accession"),
        F.when(same, F.col("_method")).alias("optional_method"),
    )


def sum_then_growth(
    entity_rows: DataFrame, *, entities: int | None = None, entity: str = "entity",
    date: str = "obs_date", value: str = "value", group: Sequence[str] = ("group_id",),
) -> tuple[DataFrame, DataFrame]:
    """(aggregate rows, aligned entity rows).

    Only dates common to every entity count. Entities are added first and growth
    is taken of the sum; breadth counts the entities whose direction agrees. The
    entity rows stay a table of their own, keyed by date, instead of an array.
    """
    per_date = entity_rows.groupBy(*group, date).agg(F.countDistinct(entity).alias("_n"))
    if entities is None:
        wanted = entity_rows.groupBy(*group).agg(F.countDistinct(entity).alias("_wanted"))
        per_date = per_date.join(wanted, list(group)).where("_n = _wanted").drop("_wanted")
    else:
        per_date = per_date.where(F.col("_n") == entities)
    dates = per_date.drop("_n")
    base = [c for c in entity_rows.columns if c not in ("qoq_pct", "yoy_pct", "direction")]
    aligned = growth_acceleration(
        entity_rows.select(*base).join(dates, [*group, date], "left_semi"),
        by=[*group, entity], date=date, value=value,
    )
    totals = aligned.groupBy(*group, date).agg(
        F.sum(F.col(value).cast("decimal(38,6)")).cast("double").alias("total"),
        F.count(F.lit(1)).alias("entity_total"),
        F.count_if(F.col("direction") != "UNKNOWN").alias("_known"),
        *[
            F.count_if(F.col("direction") == d).alias(f"_is_{d}")
            for d in ("ACCELERATING", "DECELERATING", "FLAT")
        ],
        *(
            [F.count("optional_value").alias("disclosure_breadth")]
            if "optional_value" in entity_rows.columns else []
        ),
        *(
            [F.count_if(F.col("review_required")).alias("review_count")]
            if "review_required" in entity_rows.columns else []
        ),
    )
    grown = growth_acceleration(totals, by=list(group), date=date, value="total")
    agree = F.lit(0)
    for d in ("ACCELERATING", "DECELERATING", "FLAT"):
        agree = F.when(F.col("direction") == d, F.col(f"_is_{d}")).otherwise(agree)
    breadth = agree.cast("bigint")
    share = F.when(
        F.col("direction") != "UNKNOWN",
        ratio(breadth.cast("double"), F.col("_known").cast("double")),
    )
    aggregate = grown.select(
        "*", breadth.alias("breadth"), F.round(share, 6).alias("breadth_ratio")
    ).drop("_known", "_is_ACCELERATING", "_is_DECELERATING", "_is_FLAT")
    return aggregate, aligned


def growth_package(
    aggregate: DataFrame, *, group: Sequence[str] = ("group_id",), date: str = "obs_date"
) -> DataFrame:
    """Two metrics from one base series: the level and its yearly acceleration,
    each with its one-step change; rows are (group, metric) endpoints."""
    long = aggregate.select(*group, date, "total", "yoy_acceleration_pp").unpivot(
        [*group, date], ["total", "yoy_acceleration_pp"], "metric", "value"
    )
    w = Window.partitionBy(*group, "metric").orderBy(date)
    rows = long.select(
        "*", F.round(F.col("value") - F.lag("value").over(w), 6).alias("change_1_quarter"),
        F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("quarter_count"),
        F.lead(date).over(w).isNull().alias("_last"),
    )
    return rows.where("_last").drop("_last")
