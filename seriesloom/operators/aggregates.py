"""Group-by operators. All combine on the map side; none gathers a group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.hashing import group_fingerprint
from seriesloom.functions.scalars import any_of, finite, ratio
from seriesloom.operators.clean import fold_duplicates, raise_refused
from seriesloom.operators.quantiles import grouped_quantile

MONEY = "decimal(38,6)"


def exact_sum(value: Column | str, scale: int = 12) -> Column:
    """Sum as a decimal: the same in any order of addition.

    Twelve decimals are kept before adding, so small amounts add up; callers
    round the sum once.
    """
    c = F.col(value) if isinstance(value, str) else value
    return F.sum(c.cast(f"decimal(28,{scale})"))


# --- operations ------------------------------------------------------------


def daily_operation_totals(
    ops: DataFrame, *, by: Sequence[str] = ("op_date",), submitted: str = "submitted",
    accepted: str = "accepted", released: str | None = "released_at", divisor: float = 1e9,
) -> DataFrame:
    """Per day: accepted and submitted totals, count, latest release. Amounts that
    break 0 ≤ accepted ≤ submitted are counted as violations."""
    bad = (F.col(submitted) < 0) | (F.col(accepted) < 0) | (F.col(accepted) > F.col(submitted))
    return ops.groupBy(*by).agg(
        F.round(exact_sum(accepted).cast("double") / divisor, 6).alias("value"),
        F.round(exact_sum(submitted).cast("double") / divisor, 6).alias("submitted"),
        exact_sum(accepted).cast("double").alias("source_accepted"),
        exact_sum(submitted).cast("double").alias("source_submitted"),
        F.count(F.lit(1)).alias("operation_count"),
        F.count_if(F.coalesce(bad, F.lit(True))).alias("violations"),
        *([F.max(released).alias("released_at")] if released else []),
    )


def conditional_daily_totals(
    ops: DataFrame, *, exercise: Column, by: Sequence[str] = ("op_date",), op_id: str = "op_id",
    submitted: str = "submitted", accepted: str = "accepted", rate: str = "rate",
) -> DataFrame:
    """Total, eligible and exercise sums per day, with operation counts and flags.

    Distinct operations are counted by grouping on (day, operation) first; the
    second step adds those up.
    """
    flagged = ops.withColumn("_ex", exercise)
    per_op = flagged.groupBy(*by, op_id).agg(
        exact_sum(submitted).alias("_sub"), exact_sum(accepted).alias("_acc"),
        exact_sum(F.when(~F.col("_ex"), F.col(accepted))).alias("_elig"),
        F.max("_ex").alias("_ex"), F.min(rate).alias("_rate_lo"), F.max(rate).alias("_rate_hi"),
    )
    day = per_op.groupBy(*by).agg(
        F.sum("_sub").alias("_sub"), F.sum("_acc").alias("_acc"),
        F.coalesce(F.sum("_elig"), F.lit(0).cast(MONEY)).alias("_elig"),
        F.count(F.lit(1)).alias("operation_count"),
        F.count_if("_ex").alias("exercise_operation_count"),
        F.min("_rate_lo").alias("_rate_lo"), F.max("_rate_hi").alias("_rate_hi"),
    )
    return day.select(
        *by, F.col("_sub").cast("double").alias("submitted"),
        F.col("_acc").cast("double").alias("accepted"),
        F.col("_elig").cast("double").alias("eligible"),
        (F.col("_acc") - F.col("_elig")).cast("double").alias("exercise"),
        "operation_count", "exercise_operation_count",
        (F.col("exercise_operation_count") > 0).alias("has_exercise"),
        (
            (F.col("exercise_operation_count") > 0)
            & (F.col("exercise_operation_count") == F.col("operation_count"))
        ).alias("exercise_only"),
        F.when(F.col("_rate_lo") == F.col("_rate_hi"), F.col("_rate_lo")).alias("single_rate"),
    )


def category_breakdown(
    ops: DataFrame, categories: Sequence[str], *, by: Sequence[str] = ("op_date",),
    category: str = "category", measures: Mapping[str, Column],
) -> DataFrame:
    """One map column category → struct of sums; absent categories are zero.

    The category list is fixed, so the map is a set of conditional sums.
    """
    entries: list[Column] = []
    for name in categories:
        here = F.col(category) == name
        entries += [
            F.lit(name),
            F.struct(
                *[
                    F.coalesce(exact_sum(F.when(here, m)).cast("double"), F.lit(0.0)).alias(k)
                    for k, m in measures.items()
                ]
            ),
        ]
    return ops.groupBy(*by).agg(F.create_map(*entries).alias("breakdown"))


def daily_totals_with_breakdown(
    details: DataFrame, *, exercise: Column, by: Sequence[str] = ("op_date",),
    op_id: str = "op_id", category: str = "category", submitted: str = "submitted",
    accepted: str = "accepted", rate: str = "rate", released: str = "released_at",
) -> DataFrame:
    """Per day: totals, the greatest rate, operation counts, exercise flags and a
    map category → (submitted, accepted, greatest rate).

    The day's map is built from one row per category, a fixed vocabulary.
    """
    per_category = details.groupBy(*by, category).agg(
        exact_sum(submitted).alias("_sub"), exact_sum(accepted).alias("_acc"),
        F.max(rate).alias("_rate"), F.max(released).alias("_rel"),
    )
    entry = F.struct(
        F.col(category).alias("key"),
        F.struct(
            F.col("_sub").cast("double").alias("submitted"),
            F.col("_acc").cast("double").alias("accepted"), F.col("_rate").alias("rate"),
        ).alias("value"),
    )
    totals = per_category.groupBy(*by).agg(
        F.sum("_sub").cast("double").alias("submitted"),
        F.sum("_acc").cast("double").alias("accepted"), F.max("_rate").alias("max_rate"),
        F.max("_rel").alias("released_at"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("breakdown"),
    )
    ops = details.groupBy(*by, op_id).agg(F.max(exercise).alias("_ex")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("operation_count"),
        F.bool_or("_ex").alias("has_exercise"), F.bool_and("_ex").alias("exercise_only"),
    )
    return totals.join(ops, list(by))


def header_detail_check(
    details: DataFrame, *, by: Sequence[str] = ("op_date", "op_id"),
    header: Mapping[str, str], tolerance: float = 1e-6,
) -> DataFrame:
    """Operations whose detail sums differ from the header totals.

    ``header``: detail column → header column carried on each detail row.
    """
    sums = details.groupBy(*by).agg(
        *[F.sum(d).alias(f"_d_{d}") for d in header],
        *[F.max(h).alias(f"_h_{h}") for h in header.values()],
    )
    off = F.lit(False)
    for d, h in header.items():
        off = off | ~F.coalesce(
            F.abs(F.col(f"_d_{d}") - F.col(f"_h_{h}")) <= tolerance, F.lit(False)
        )
    return sums.where(off).select(*by)


def settlement_totals(
    auctions: DataFrame, *, key: Sequence[str] = ("security_id", "auction_date", "issue_date"),
    day: str = "issue_date", amount: str = "amount", by: Sequence[str] = (), strict: bool = False,
) -> DataFrame:
    """Amount and number of distinct auctions per settlement date.

    The keys behind a date stay rows of the folded table; the date carries their
    order-free fingerprint instead of an array that grows with the date.
    """
    folded = fold_duplicates(auctions, [*by, *key], [amount], strict=strict)
    digest = F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in key]), 256)
    return folded.groupBy(*by, day).agg(
        exact_sum(amount).cast("double").alias("value"),
        F.count(F.lit(1)).alias("security_count"),
        F.count_if("is_conflict").alias("conflicts"),
        group_fingerprint(digest).alias("keys_fingerprint"),
    )


# --- filings ---------------------------------------------------------------

# The three states of a filing's plan flag.
PLAN_BUCKETS = ("FALSE", "TRUE", "UNKNOWN")


def bucketed_totals(
    transactions: DataFrame, *, by: Sequence[str] = ("accession",), flag: str = "flag",
    side: str = "code", buy: str = "P", sell: str = "S", shares: str = "shares",
    dollars: str = "dollars",
) -> DataFrame:
    """Counts, shares and dollars per filing and flag, with an ALL row per filing."""
    is_buy, is_sell = F.col(side) == buy, F.col(side) == sell
    priced = F.col(dollars).isNotNull()

    def total(cond: Column, c: str) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0).cast(MONEY)).cast("decimal(38,6)")

    rows = transactions.where(is_buy | is_sell)
    fine = rows.groupBy(*by, flag).agg(
        F.count(F.lit(1)).alias("eligible_count"), F.count_if(priced).alias("priced_count"),
        F.count_if(is_buy).alias("buy_count"), F.count_if(is_sell).alias("sell_count"),
        F.count_if(is_buy & priced).alias("buy_priced"),
        F.count_if(is_sell & priced).alias("sell_priced"),
        total(is_buy, shares).alias("buy_shares"), total(is_sell, shares).alias("sell_shares"),
        total(is_buy, dollars).alias("buy_dollars"), total(is_sell, dollars).alias("sell_dollars"),
    )
    # The flag rows are at most a few per filing, so they are dealt by filing without
    # skew. The ALL row is rolled up from them where they are, and what is grouped by
    # filing later stays there too.
    measures = [c for c in fine.columns if c not in (*by, flag)]
    dealt = fine.select(*by, F.col(flag).alias("bucket"), *measures).repartition(*by)
    whole = dealt.groupBy(*by).agg(*[F.sum(m).cast(fine.schema[m].dataType).alias(m) for m in measures])
    return dealt.unionByName(whole.select(*by, F.lit("ALL").alias("bucket"), *measures))


# Amendment states that count, and parse states that are usable.
EFFECTIVE = ("ORIGINAL_EFFECTIVE", "AMENDMENT_EFFECTIVE")
PARSED = ("PARSED", "PARSED_WITH_QUARANTINED_ROWS")
AUDIT_STAGES = ("SUBMISSION", "TRANSACTION_PARSE", "TRANSACTION_QUARANTINE")


def window_summary(
    entries: DataFrame, completed_days: DataFrame, *, windows: Sequence[int] = (5, 20),
    by: Sequence[str], day: str = "index_date", coverage_floor: float = 0.80,
    audits: DataFrame | None = None,
) -> DataFrame:
    """Ratios over the last n completed days; one row per key and window length.

    ``entries`` has one row per filing: by, index_date, accession, issuer, form,
    flag, amendment_status, parse_status, linked_original and the ALL and FALSE
    counts. Each completed day carries the windows it belongs to, so entries
    meet their windows in one equi join on the day.
    """
    from seriesloom.operators.windows import tail_rows

    ranked = tail_rows(
        completed_days.select(*by, day).distinct(), max(windows), by=by, date=day
    )
    days = ranked.select(
        *by, day, F.explode(
            F.filter(F.array(*[F.lit(n) for n in windows]), lambda n: n >= F.col("rn"))
        ).alias("window_days"),
    )
    span = days.groupBy(*by, "window_days").agg(
        F.count(F.lit(1)).alias("completed_day_count"), F.min(day).alias("window_start"),
        F.max(day).alias("window_end"),
    )
    effective = F.col("amendment_status").isin(*EFFECTIVE) & F.col("parse_status").isin(*PARSED)
    key = [*by, "window_days"]
    # Issuers are counted by grouping on the issuer first: a window that owns
    # most filings spreads over its issuers before the final sums. Entries before
    # every window are left out ahead of the shuffle.
    recent = entries.where(F.col(day) >= days.agg(F.min(day)).scalar())
    per_issuer = recent.join(days, [*by, day]).groupBy(*key, "issuer").agg(
        *[
            F.coalesce(F.sum(F.when(effective, F.col(c))), F.lit(0)).alias(c)
            for c in (
                "buy_count", "sell_count", "priced_count", "eligible_count",
                "false_buy_count", "false_sell_count", "false_eligible_count",
            )
        ],
        *[
            F.coalesce(F.sum(F.when(effective, F.col(c))), F.lit(0).cast(MONEY)).alias(c)
            for c in ("buy_dollars", "sell_dollars")
        ],
        F.max(effective.cast("int")).alias("unique_issuers"),
        F.count(F.lit(1)).alias("filings_processed"),
        F.count_if(F.col("is_amendment")).alias("amendment_count"),
        F.count_if(F.col("is_amendment") & F.col("linked_original").isNotNull())
        .alias("amendments_linked"),
        F.count_if(F.col("amendment_status") == "UNLINKED_REVIEW").alias("amendments_review"),
        *[
            F.count_if(effective & (F.col("flag") == f)).alias(f"flag_{f.lower()}_filings")
            for f in PLAN_BUCKETS
        ],
    )
    counts = [c for c in per_issuer.columns if c not in (*key, "issuer")]
    totals = per_issuer.groupBy(*key).agg(*[F.sum(c).alias(c) for c in counts])
    joined = span.join(totals, key, "left").fillna(
        0, subset=[c for c in counts if not c.endswith("_dollars")]
    )
    if audits is not None:
        failures = audits.where(F.col("stage").isin(*AUDIT_STAGES)).join(
            days, [*by, day]
        ).groupBy(*key).agg(F.count(F.lit(1)).alias("parse_failures"))
        joined = joined.join(failures, key, "left").fillna(0, subset=["parse_failures"])

    complete = F.col("completed_day_count") == F.col("window_days")
    some = complete & (F.col("eligible_count") > 0)

    def smoothed(buy: str, sell: str) -> Column:
        return (F.col(buy) + 1).cast("decimal(20,0)") / (F.col(sell) + 1).cast("decimal(20,0)")

    def share(part: str, whole: str) -> Column:
        return F.col(part).cast("decimal(20,0)") / F.nullif(
            F.col(whole).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")
        )

    coverage = F.when(some, share("priced_count", "eligible_count"))
    status = (
        F.when(~complete, "INSUFFICIENT_COMPLETED_DAYS")
        .when(F.col("eligible_count") == 0, "NO_ELIGIBLE_ROWS")
        .when(coverage < F.lit(coverage_floor), "INSUFFICIENT_PRICE_COVERAGE")
        .when(F.coalesce("sell_dollars", F.lit(0)) == 0, "NO_SALES_DOLLAR_DENOMINATOR")
        .otherwise("PUBLISHED")
    )
    dollar = F.col("buy_dollars") / F.nullif(
        F.col("sell_dollars"), F.lit(0).cast(joined.schema["sell_dollars"].dataType)
    )

    def out(c: Column) -> Column:
        return F.round(c, 6).cast("double")

    return joined.select(
        *key, "completed_day_count", "window_start", "window_end",
        out(F.when(some, smoothed("buy_count", "sell_count"))).alias("count_ratio"),
        out(F.when(status == "PUBLISHED", dollar)).alias("dollar_ratio"),
        out(coverage).alias("dollar_coverage"), status.alias("dollar_status"),
        out(
            F.when(
                complete & (F.col("false_eligible_count") > 0),
                smoothed("false_buy_count", "false_sell_count"),
            )
        ).alias("false_count_ratio"),
        out(F.when(some, share("false_eligible_count", "eligible_count"))).alias("false_coverage"),
        *[c for c in counts if not c.startswith("false_") and not c.endswith("_dollars")],
        *(["parse_failures"] if audits is not None else []),
    )


def filing_statistics(
    summary: DataFrame, *, by: Sequence[str], windows: Sequence[int] = (5, 20)
) -> DataFrame:
    """Both windows in one wide row per key."""
    values = [c for c in summary.columns if c not in (*by, "window_days")]
    return summary.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("window_days") == n, F.col(c))).alias(f"{c}_{n}d")
            for n in windows for c in values
        ]
    )


def audit_counts(
    audits: DataFrame, days: DataFrame, *, by: Sequence[str] = (), day: str = "index_date"
) -> DataFrame:
    """Failures and reviews per stage over the given days."""
    return audits.join(days.select(*by, day).distinct(), [*by, day], "left_semi").groupBy(
        *by, "stage"
    ).agg(F.count(F.lit(1)).alias("rows"))


def split_anomalies(anomalies: Column, row_prefix: str = "ROW_") -> tuple[Column, Column]:
    """(metadata codes, row codes) of an anomaly array."""
    return (
        F.filter(anomalies, lambda c: ~c.startswith(row_prefix)),
        F.filter(anomalies, lambda c: c.startswith(row_prefix)),
    )


def day_completeness(
    index_days: DataFrame, filings: DataFrame, *, by: Sequence[str] = (), day: str = "index_date",
    read_ok: str = "index_read", status: str = "status",
) -> DataFrame:
    """A day is complete when its index was read and no listed filing failed."""
    failed = filings.groupBy(*by, day).agg(
        F.count(F.lit(1)).alias("filings"),
        F.count_if(~F.col(status).isin("PARSED", "REUSED")).alias("failed"),
    )
    return index_days.join(failed, [*by, day], "left").select(
        *by, day, F.coalesce("filings", F.lit(0)).alias("filings"),
        F.coalesce("failed", F.lit(0)).alias("failed"),
        (F.col(read_ok) & (F.coalesce("failed", F.lit(0)) == 0)).alias("is_complete"),
    )


# --- venues ----------------------------------------------------------------


def settlement_rules(
    *, by: Sequence[str] = ("asset",), venue: str = "venue", time: str = "settled_at", rate: str = "rate",
    interval: str = "interval_hours",
) -> list[tuple[Column, str]]:
    """What a settlement must not be; `clean.refused` lists the rows, ``venue_summary(strict=True)`` fails on them."""
    names = [F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "") for c in (*by, venue)]
    return [
        (any_of(names), "NO_VENUE"), (F.col(time).isNull(), "NO_TIME"),
        (finite(rate).isNull(), "NOT_NUMERIC"), (~(F.col(interval) > 0), "INTERVAL"),
    ]


def venue_summary(
    events: DataFrame, *, as_of, by: Sequence[str] = ("asset",), venue: str = "venue",
    time: str = "settled_at", rate: str = "rate", interval: str = "interval_hours", strict: bool = False,
) -> DataFrame:
    """Per (asset, venue): latest settlement, 24 h sum and 7 d figures.

    Rows with an interval that isn't positive are left out here and listed by
    `clean.refused` with `settlement_rules`; ``strict`` raises on the first.

    The 24 h window is open at its left end, the 7 d one closed. The mid-rank of
    the latest rate comes from counts per distinct rate, so it needs no window
    over a venue's settlements.
    """
    end = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    if strict:
        events = raise_refused(events, settlement_rules(by=by, venue=venue, time=time, rate=rate, interval=interval))
    daily = F.col(rate) * 24 / F.col(interval)
    recent = events.where(
        (F.col(time) <= end)
        & (F.col(time) >= end - F.expr("interval 7 days")) & (F.col(interval) > 0)
    ).select(
        *by, venue, time, F.col(rate).alias("_rate"), F.col(interval).alias("_hours"),
        daily.alias("_daily"), end.alias("_as_of"),
    )
    key = [*by, venue]
    base = recent.groupBy(*key).agg(
        F.max(time).alias("latest_settled_at"),
        F.max_by("_rate", time).alias("latest_rate"),
        F.max_by("_hours", time).alias("latest_interval_hours"),
        F.max_by("_daily", time).alias("latest_daily_rate"),
        F.coalesce(
            F.sum(
                F.when(
                    F.col(time) > F.col("_as_of") - F.expr("interval 24 hours"),
                    F.col("_rate").cast("decimal(28,12)"),
                )
            ).cast("double"), F.lit(0.0),
        ).alias("settled_sum_24h"),
        (F.sum(F.col("_daily").cast("decimal(28,12)")).cast("double") / F.count(F.lit(1)))
        .alias("mean_daily_7d"),
        F.count(F.lit(1)).alias("sample_size_7d"),
    )
    per_rate = recent.groupBy(*key, "_daily").agg(F.count(F.lit(1)).alias("_c"))
    ranks = per_rate.join(base.select(*key, "latest_daily_rate"), key).groupBy(*key).agg(
        F.sum(F.when(F.col("_daily") < F.col("latest_daily_rate"), F.col("_c")).otherwise(0))
        .alias("_below"),
        F.sum(F.when(F.col("_daily") == F.col("latest_daily_rate"), F.col("_c")).otherwise(0))
        .alias("_equal"),
    )
    midrank = (F.col("_below") + F.col("_equal") * 0.5) / F.col("sample_size_7d")
    return base.join(ranks, key).select(*base.columns, midrank.alias("percentile_7d"))


def median_across(
    venues: DataFrame, measures: Sequence[str], *, by: Sequence[str] = ("asset",),
    venue: str = "venue",
) -> DataFrame:
    """Medians over venues with the venue count and the confidence it gives."""
    stats = venues.groupBy(*by).agg(
        F.count(F.lit(1)).alias("venue_count"), F.min(venue).alias("_only")
    )
    # The measures travel as one long column, so all medians come from one pass.
    long = venues.unpivot([*by, venue], list(measures), "_measure", "_value")
    medians = grouped_quantile(
        long, [*by, "_measure"], "_value", [0.5], names=["_median"]
    ).groupBy(*by).agg(
        *[F.max(F.when(F.col("_measure") == m, F.col("_median"))).alias(m) for m in measures]
    )
    stats = stats.join(medians, list(by), "left")
    n = F.col("venue_count")
    return stats.select(
        *by, "venue_count",
        F.when(n == 1, F.col("_only")).otherwise("MULTI_VENUE_MEDIAN").alias("venue"),
        F.when(n == 1, "LOW").when(n == 2, "MEDIUM").otherwise("HIGH").alias("confidence"),
        *measures,
    )


# --- directions, states and counts -----------------------------------------


def consensus(direction: Column) -> Column:
    """One distinct direction wins, several give MIXED, any unknown or none UNKNOWN."""
    unknown = F.count_if(direction.isNull() | (direction == "UNKNOWN")) > 0
    return (
        F.when(unknown | (F.count(direction) == 0), "UNKNOWN")
        .when(F.min(direction) == F.max(direction), F.min(direction))
        .otherwise("MIXED")
    )


def consensus_direction(
    df: DataFrame, *, by: Sequence[str], direction: str = "direction",
    comparable: str | None = None,
) -> DataFrame:
    """Consensus per group; with ``comparable`` only those rows vote."""
    d = F.col(direction)
    if comparable is not None:
        votes = F.when(F.col(comparable), d)
        unknown = F.count_if(F.col(comparable) & (d.isNull() | (d == "UNKNOWN"))) > 0
        verdict = (
            F.when(unknown | (F.count(votes) == 0), "UNKNOWN")
            .when(F.min(votes) == F.max(votes), F.min(votes)).otherwise("MIXED")
        )
    else:
        verdict = consensus(d)
    return df.groupBy(*by).agg(verdict.alias("direction"), F.count(F.lit(1)).alias("members"))


def breadth(
    df: DataFrame, *, by: Sequence[str], agrees: Column, members: int | None = None
) -> DataFrame:
    """Members that agree, the share over known ones, null count when incomplete."""
    complete = F.count_if(agrees.isNull()) == 0
    if members is not None:
        complete = complete & (F.count(F.lit(1)) == members)
    known = F.count(agrees)
    return df.groupBy(*by).agg(
        F.when(complete, F.count_if(agrees)).alias("agreeing"),
        F.count(F.lit(1)).alias("members"), known.alias("known"),
        F.round(ratio(F.count_if(agrees).cast("double"), known.cast("double")), 6)
        .alias("agree_ratio"),
    )


# Ranks of states, from best to worst.
STATUS_RANK = {
    "OK": 0, "NOT_RELEASED_YET": 1, "STALE": 2, "UNAVAILABLE": 3, "MISSING": 4, "ERROR": 5,
}
HEALTH_RANK = {"NOT_APPLICABLE": -1, "OK": 0, "NOT_RELEASED_YET": 1, "STALE": 2, "ERROR": 3}
FRESHNESS_RANK = {"FRESH": 0, "LATE": 1, "STALE": 2, "UNKNOWN": 3}


def rank_of(state: Column | str, ranks: Mapping[str, int]) -> Column:
    c = F.col(state) if isinstance(state, str) else state
    table = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    return F.try_element_at(table, c)


def canonical_status(status: Column | str) -> Column:
    c = F.upper(F.trim(F.col(status) if isinstance(status, str) else status))
    return F.when(c == "NOT_RELEASED", "NOT_RELEASED_YET").when(c.isin(*STATUS_RANK), c)


def worst(state: Column | str, ranks: Mapping[str, int]) -> Column:
    """The state with the greatest rank, as an aggregate (null for no rows)."""
    names = {rank: name for name, rank in ranks.items()}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.try_element_at(table, F.max(rank_of(state, ranks)))


def worst_of(
    df: DataFrame, *, by: Sequence[str], status: str = "status",
    ranks: Mapping[str, int] = STATUS_RANK,
) -> DataFrame:
    return df.groupBy(*by).agg(worst(status, ranks).alias("status"))


def derived_state(
    inputs: DataFrame, *, by: Sequence[str] = ("derived_id",), attempted_at: Column,
    has_points: Column | None = None,
) -> DataFrame:
    """State of a derived series from its inputs' states.

    The oldest success counts while everything is well, else the newest. Distinct
    failure reasons are joined; they are a small vocabulary of codes.
    """
    points = F.lit(True) if has_points is None else F.bool_or(has_points)
    rolled = inputs.groupBy(*by).agg(
        F.coalesce(worst("health", HEALTH_RANK), F.lit("NOT_APPLICABLE")).alias("_health"),
        worst("freshness", FRESHNESS_RANK).alias("freshness"),
        F.min("last_success_at").alias("_first"), F.max("last_success_at").alias("_last"),
        F.max("released_at").alias("released_at"),
        F.array_join(F.array_sort(F.collect_set("failure_reason")), "; ").alias("_reasons"),
        points.alias("_points"),
    )
    health = F.when(
        ~F.col("_points") & ~F.col("_health").isin("ERROR", "STALE"), "ERROR"
    ).otherwise(F.col("_health"))
    return rolled.select(
        *by, health.alias("health"), "freshness",
        F.when(health == "OK", F.col("_first")).otherwise(F.col("_last")).alias("last_success_at"),
        attempted_at.alias("last_attempt_at"), "released_at",
        F.when(health == "OK", attempted_at).otherwise(F.col("_last")).alias("updated_at"),
        F.nullif("_reasons", F.lit("")).alias("failure_reason"),
    )


def source_rollup(states: DataFrame, *, by: Sequence[str] = ("source_id",)) -> DataFrame:
    """Per source: worst states, latest dates, success stamp and joined reasons."""
    all_ok = F.bool_and(F.col("health") == "OK")
    return states.groupBy(*by).agg(
        worst("health", HEALTH_RANK).alias("status"),
        worst("freshness", FRESHNESS_RANK).alias("freshness"),
        F.max("obs_date").alias("obs_date"), F.max("released_at").alias("released_at"),
        F.when(all_ok, F.min("last_success_at")).otherwise(F.max("last_success_at"))
        .alias("last_success_at"),
        F.max("expected_next_update").alias("expected_next_update"),
        F.nullif(
            F.array_join(F.array_sort(F.collect_set("failure_reason")), "; "), F.lit("")
        ).alias("failure_reason"),
    )


def category_counts(
    df: DataFrame, categories: Mapping[str, Column], *, by: Sequence[str] = ()
) -> DataFrame:
    return df.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in categories.items()])


def global_latest(obs: DataFrame, date: str = "obs_date") -> DataFrame:
    return obs.agg(F.max(date).alias("latest"))


def block_rollup(
    blocks: DataFrame, *, by: Sequence[str] = ("switch_id",), none: str = "UNKNOWN",
    few: int = 2,
) -> DataFrame:
    """Available and total evidence blocks and the confidence that count gives."""
    rolled = blocks.groupBy(*by).agg(
        F.count_if("available").alias("available_blocks"), F.count(F.lit(1)).alias("total_blocks")
    )
    n = F.col("available_blocks")
    return rolled.withColumn(
        "confidence", F.when(n == 0, none).when(n <= few, "LOW").otherwise("MEDIUM")
    )


def reviewed_observations(
    spans: DataFrame, *, by: Sequence[str] = ("metric_id",), entity: str = "company_id", as_of: str = "as_of",
) -> DataFrame:
    """Per metric and as-of date: counts and direction over the records that are latest on it.

    ``spans`` are the rows of `joins.entity_spans`. A record is not repeated
    for the days it covers. Counts are running sums of one entry and one exit
    per record. Extremes can't be taken back at an exit; but a span is covered
    by two runs of 2^k days, which may overlap, since counting a value twice
    doesn't change an extreme. Both kinds of row combine on the map side to one
    row per metric and day (and k); runs are unrolled after that, at a cost that
    depends on the calendar, not on the number of records.
    """
    one, comparable = F.lit(1), F.coalesce(F.col("comparable"), F.lit(False))
    counts = {
        "record_count": one, "company_count": F.col(entity).isNotNull().cast("int"),
        "comparable_count": comparable.cast("int"),
        "_unknown": (comparable & (F.col("direction") == "UNKNOWN")).cast("int"),
        "_votes": (comparable & F.col("direction").isNotNull()).cast("int"),
    }
    moves = F.array(
        F.struct(F.col(as_of).alias("day"), F.lit(1).alias("sign"), F.lit(1).alias("asked")),
        F.struct(F.date_add("until", 1).alias("day"), F.lit(-1).alias("sign"), F.lit(0).alias("asked")),
    )
    moved = spans.select("*", F.explode(moves).alias("_m")).groupBy(*by, F.col("_m.day").alias("asof_date")).agg(
        *[F.sum(F.coalesce(c, F.lit(0)) * F.col("_m.sign")).alias(n) for n, c in counts.items()],
        F.max("_m.asked").alias("_asked"),
    )
    until_day = Window.partitionBy(*by).orderBy("asof_date").rowsBetween(Window.unboundedPreceding, 0)
    running = moved.select(*by, "asof_date", "_asked", *[F.sum(n).over(until_day).alias(n) for n in counts]).where("_asked = 1")

    vote = F.when(F.col("comparable"), F.col("direction"))
    k = F.floor(F.log2(F.datediff("until", as_of) + 1)).cast("int")
    starts = F.array(F.col(as_of), F.date_sub(F.date_add("until", 1), F.pow(F.lit(2), k).cast("int")))
    runs = spans.select(*by, k.alias("_k"), F.explode(starts).alias("_start"), vote.alias("_v"), "accepted_at", "reviewed_at")

    def extremes(rows: DataFrame, *keys: str, low: str, high: str) -> DataFrame:
        return rows.groupBy(*by, *keys).agg(
            F.min(low).alias("_low"), F.max(high).alias("_high"),
            F.max("accepted_at").alias("accepted_at"), F.max("reviewed_at").alias("reviewed_at"),
        )

    length = F.pow(F.lit(2), F.col("_k")).cast("int") - 1
    days = F.explode(F.sequence("_start", F.date_add("_start", length), F.expr("interval 1 day"))).alias("asof_date")
    unrolled = extremes(runs, "_k", "_start", low="_v", high="_v").select("*", days)
    found = extremes(unrolled, "asof_date", low="_low", high="_high")
    return running.join(found, [*by, "asof_date"]).select(
        *by, "asof_date",
        F.when((F.col("_unknown") > 0) | (F.col("_votes") == 0), "UNKNOWN")
        .when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise("MIXED").alias("direction"),
        "record_count", "company_count", "comparable_count",
        F.col("accepted_at").alias("latest_accepted_at"), F.col("reviewed_at").alias("latest_reviewed_at"),
    )


def reviewed_states(
    points: DataFrame, metrics: DataFrame, *, by: Sequence[str] = ("metric_id",)
) -> DataFrame:
    """Metric state from its last point; a metric without points is MANUAL_READY."""
    fields = [c for c in points.columns if c not in (*by, "asof_date")]
    latest = points.groupBy(*by).agg(
        F.max_by(F.struct("asof_date", *fields), "asof_date").alias("_p")
    ).select(*by, "_p.*")
    return metrics.select(*by).distinct().join(latest, list(by), "left").select(
        *by,
        F.when(F.col("asof_date").isNotNull(), "ACTIVE_FREE").otherwise("MANUAL_READY")
        .alias("availability"),
        "asof_date", F.coalesce("direction", F.lit("UNKNOWN")).alias("direction"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in fields if c.endswith("_count")],
        "latest_accepted_at", "latest_reviewed_at",
    )
