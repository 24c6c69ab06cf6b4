"""Window and sequence operators over (series, day) observations.

``by`` is always a partition key, and one partition holds at most one row per
calendar day. Operators that only need the end of a series take its last k rows
first: Spark then keeps k rows per series in every map task, before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from seriesloom.functions.scalars import all_of, ratio, sign_label
from seriesloom.operators.clean import raise_refused
from seriesloom.operators.joins import pair_on_date

BY = ("series_id",)


def ordered(by: Sequence[str] = BY, date: str = "obs_date") -> WindowSpec:
    return Window.partitionBy(*by).orderBy(date)


def trailing(n: int, by: Sequence[str] = BY, date: str = "obs_date") -> WindowSpec:
    return ordered(by, date).rowsBetween(-(n - 1), 0)


def valid_only(obs: DataFrame, value: str = "value") -> DataFrame:
    """"k observations ago" counts valid rows, so nulls go before any lag."""
    return obs.where(F.col(value).isNotNull())


# --- endpoints and tails ---------------------------------------------------


def latest_per_series(
    obs: DataFrame, *, by: Sequence[str] = BY, date: str = "obs_date",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The endpoint row of each series; a null endpoint stays null."""
    columns = columns or [c for c in obs.columns if c not in (*by, date)]
    return obs.groupBy(*by).agg(
        F.max(date).alias(date), *[F.max_by(c, date).alias(c) for c in columns]
    )


def tail_rows(
    obs: DataFrame, k: int, *, by: Sequence[str] = BY, date: str = "obs_date"
) -> DataFrame:
    """The last k rows per series with ``rn`` counted from the end (1 = latest)."""
    w = Window.partitionBy(*by).orderBy(F.desc(date))
    return obs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def tail_array(
    obs: DataFrame, k: int = 22, *, by: Sequence[str] = BY, date: str = "obs_date",
    value: str = "value",
) -> DataFrame:
    """The last k points of a series as one array, oldest first."""
    point = F.struct(F.col(date), F.col(value))
    return tail_rows(obs, k, by=by, date=date).groupBy(*by).agg(
        F.array_sort(F.collect_list(point)).alias("tail")
    )


def positive_days(
    obs: DataFrame, k: int = 3, *, by: Sequence[str] = BY, date: str = "obs_date",
    value: str = "value",
) -> DataFrame:
    """How many of the last k days are positive."""
    return tail_rows(obs, k, by=by, date=date).groupBy(*by).agg(
        F.count_if(F.col(value) > 0).alias("positive_days"),
        F.count(F.lit(1)).alias("days"),
    )


def last_n_days(days: DataFrame, n: int, *, by: Sequence[str], day: str = "index_date") -> DataFrame:
    """The last n distinct days per key."""
    return tail_rows(days.select(*by, day).distinct(), n, by=by, date=day)


# --- changes ---------------------------------------------------------------


def k_obs_changes(
    obs: DataFrame, ks: Sequence[int], *, by: Sequence[str] = BY, date: str = "obs_date",
    value: str = "value", dp: int = 6,
) -> DataFrame:
    """Value minus the value k valid observations earlier, on every row."""
    w = ordered(by, date)
    return valid_only(obs, value).select(
        "*",
        *[
            F.round(F.col(value) - F.lag(value, k).over(w), dp).alias(f"change_{k}")
            for k in ks
        ],
    )


def endpoint_changes(
    obs: DataFrame, ks: Sequence[int], *, by: Sequence[str] = BY, date: str = "obs_date",
    value: str = "value", dp: int = 6,
) -> DataFrame:
    """The same for the endpoint only, from the last max(k)+1 rows per series."""
    tail = tail_rows(valid_only(obs, value), max(ks) + 1, by=by, date=date)

    def at(rank: int) -> Column:
        return F.max(F.when(F.col("rn") == rank, F.col(value)))

    return tail.groupBy(*by).agg(
        F.max(date).alias(date), at(1).alias("latest"),
        *[F.round(at(1) - at(k + 1), dp).alias(f"change_{k}") for k in ks],
    )


# Change labels that a frequency reports besides 1, 5 and 20 observations.
FREQUENCY_CHANGES: Mapping[str, Mapping[str, int]] = {
    "weekly": {"one_week": 1, "four_weeks": 4, "eight_weeks": 8, "twelve_weeks": 12},
    "monthly": {"one_month": 1},
    "quarterly": {"one_quarter": 1},
}


def changes_by_frequency(
    obs: DataFrame, *, by: Sequence[str] = BY, date: str = "obs_date", value: str = "value",
    frequency: str = "frequency",
) -> DataFrame:
    """Endpoint changes under their frequency labels; labels that do not apply are null."""
    labels = sorted({(name, k) for table in FREQUENCY_CHANGES.values() for name, k in table.items()})
    ks = sorted({1, 5, 20, *[k for _, k in labels]})
    base = endpoint_changes(obs, ks, by=[*by, frequency], date=date, value=value)
    out = [
        F.col("change_1").alias("one_observation"), F.col("change_5").alias("five_observations"),
        F.col("change_20").alias("twenty_observations"),
    ]
    for name, k in labels:
        uses = [f for f, table in FREQUENCY_CHANGES.items() if table.get(name) == k]
        out.append(F.when(F.col(frequency).isin(*uses), F.col(f"change_{k}")).alias(name))
    return base.select(*by, frequency, date, "latest", *out)


def spread_stats(
    obs: DataFrame, *, threshold: float = 3.0, n: int = 5, by: Sequence[str] = BY,
    date: str = "obs_date", value: str = "value",
) -> DataFrame:
    """Latest, changes over 1 and 5, 5-row mean and slope, both streaks, sample size."""
    w, near = ordered(by, date), trailing(n, by, date)
    v = F.col(value)
    rows = valid_only(obs, value).withColumn("_rn", F.row_number().over(w)).select(
        *by, date,
        v.alias("latest"),
        F.round(v - F.lag(value, 1).over(w), 4).alias("change_1obs"),
        F.round(v - F.lag(value, 5).over(w), 4).alias("change_5obs"),
        F.round(F.avg(value).over(near), 4).alias("mean_5obs"),
        F.round(
            F.when(F.count(value).over(near) >= 2, F.regr_slope(v, F.col("_rn")).over(near)), 4
        ).alias("slope_5obs"),
        streak(v > 0, w).alias("positive_streak"),
        streak(v > threshold, w).alias("above_streak"),
        F.count(value).over(near).alias("observations_used"),
        F.lead(date).over(w).isNull().alias("_last"),
    )
    return rows.where("_last").drop("_last")


def weekly_stats(
    obs: DataFrame, *, by: Sequence[str] = BY, date: str = "obs_date", value: str = "value"
) -> DataFrame:
    """Level with its one- and four-observation change (3 decimals)."""
    return endpoint_changes(obs, [1, 4], by=by, date=date, value=value, dp=3).select(
        *by, date, F.col("latest").alias("level"), F.col("change_1").alias("change_1w"),
        F.col("change_4").alias("change_4w"),
    )


# --- slopes, streaks, islands ----------------------------------------------


def trailing_slope(
    obs: DataFrame, n: int, *, by: Sequence[str] = BY, date: str = "obs_date",
    value: str = "value", dp: int = 6, full_window: bool = False,
) -> DataFrame:
    """OLS slope against the row index over the last n rows; one row gives null."""
    near = trailing(n, by, date)
    rows = valid_only(obs, value).withColumn("_rn", F.row_number().over(ordered(by, date)))
    used = F.count(value).over(near)
    slope = F.regr_slope(F.col(value), F.col("_rn")).over(near)
    return rows.select(
        "*", F.round(F.when(used >= (n if full_window else 2), slope), dp).alias("slope")
    ).drop("_rn")


def streak(holds: Column, w: WindowSpec, position: str = "_rn") -> Column:
    """Length of the run of true rows that ends at each row: the distance from
    the row's position to the position of the last row that does not hold."""
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    broken = F.max(F.when(~F.coalesce(holds, F.lit(False)), F.col(position))).over(upto)
    return F.col(position) - F.coalesce(broken, F.lit(0))


def trailing_streak(
    obs: DataFrame, holds: Column, *, by: Sequence[str] = BY, date: str = "obs_date"
) -> DataFrame:
    """Every row with the length of the run of ``holds`` that ends at it."""
    w = ordered(by, date)
    return obs.withColumn("_rn", F.row_number().over(w)).withColumn(
        "streak", streak(holds, w)
    ).drop("_rn")


def streak_skipping(
    obs: DataFrame, holds: Column, skip: Column, *, by: Sequence[str] = BY, date: str = "obs_date"
) -> DataFrame:
    """The same after leaving skipped rows out of the sequence altogether."""
    return trailing_streak(obs.where(~skip), holds, by=by, date=date)


def consecutive_suffix(
    obs: DataFrame, *, minimum: int = 1, by: Sequence[str] = BY, ordinal: str = "ordinal",
    strict: bool = False,
) -> DataFrame:
    """The unbroken run of ordinals that ends at the latest row of each series.

    A shorter run than ``minimum`` fails the job in strict mode, else is dropped.
    """
    w = Window.partitionBy(*by).orderBy(ordinal)
    whole = Window.partitionBy(*by)
    islands = obs.withColumn("_island", F.col(ordinal) - F.row_number().over(w))
    # The island number never falls along the series, so the last run has the greatest.
    suffix = islands.withColumn("_last", F.max("_island").over(whole)).where(
        "_island = _last"
    ).withColumn("run_length", F.count(F.lit(1)).over(whole))
    if strict:
        short = F.when(
            F.col("run_length") < minimum,
            F.raise_error(F.lit(f"fewer than {minimum} consecutive periods")).cast("boolean"),
        ).otherwise(F.lit(True))
        suffix = suffix.where(short)
    else:
        suffix = suffix.where(F.col("run_length") >= minimum)
    return suffix.drop("_island", "_last")


def null_gap_segments(
    obs: DataFrame, *, by: Sequence[str] = BY, date: str = "obs_date", value: str = "value"
) -> DataFrame:
    """Unbroken stretches of valued rows: first and last date and row count."""
    upto = ordered(by, date).rowsBetween(Window.unboundedPreceding, 0)
    gaps = F.count_if(F.col(value).isNull()).over(upto)
    return valid_only(obs.withColumn("_gap", gaps), value).groupBy(*by, "_gap").agg(
        F.min(date).alias("start_date"), F.max(date).alias("end_date"),
        F.count(F.lit(1)).alias("points"),
    ).drop("_gap")


def anchored_history(
    obs: DataFrame, endpoints: DataFrame, *, by: Sequence[str] = BY, date: str = "obs_date",
    value: str = "value",
) -> DataFrame:
    """History up to the published endpoint of each series.

    ``endpoints``: by, published_date, published_value. When the row on that date
    is missing, null or different, the whole history is withheld.
    """
    whole = Window.partitionBy(*by)
    joined = obs.join(endpoints, list(by)).where(F.col(date) <= F.col("published_date"))
    anchor = F.max(
        (F.col(date) == F.col("published_date"))
        & F.coalesce(F.col(value) == F.col("published_value"), F.lit(False))
    ).over(whole)
    return joined.withColumn("_anchored", anchor).where("_anchored").drop("_anchored")


def period_end_flags(
    obs: DataFrame, *, by: Sequence[str] = BY, date: str = "obs_date", today=None,
    max_lag: int = 4,
) -> DataFrame:
    """MONTH/QUARTER/YEAR end decided by the next actual observation.

    The last row has no next one. It is classified against ``today`` only when
    that lies in the following month and at most four days later.
    """
    day = F.col(date)
    nxt = F.lead(date).over(ordered(by, date))
    if today is not None:
        now = F.lit(today).cast("date")
        months = (F.year(now) * 12 + F.month(now)) - (F.year(day) * 12 + F.month(day))
        fresh = F.datediff(now, day).between(1, max_lag) & (months == 1)
        nxt = F.coalesce(nxt, F.when(fresh, now))
    rows = obs.withColumn("_next", nxt)
    return rows.withColumn("flags", boundary_flags(day, F.col("_next"))).drop("_next")


def boundary_flags(day: Column, following: Column) -> Column:
    year = F.year(day) != F.year(following)
    quarter = year | (F.quarter(day) != F.quarter(following))
    month = year | (F.month(day) != F.month(following))
    return F.array_compact(
        F.array(
            F.when(month, "MONTH_END"), F.when(quarter, "QUARTER_END"), F.when(year, "YEAR_END")
        )
    )


def calendar_end_flags(day: Column) -> Column:
    """The same decided by the next calendar day."""
    return boundary_flags(day, F.date_add(day, 1))


# --- moments ---------------------------------------------------------------


def population_z(
    obs: DataFrame, n: int = 156, *, by: Sequence[str] = BY, date: str = "obs_date",
    value: str = "value", dp: int = 6,
) -> DataFrame:
    """(x − mean) / population deviation over exactly n rows.

    Short history and equal values give null. The deviation is updated row by
    row inside a frame, so equal values give an exact zero, not a residue. The
    sample size is a position, not one more aggregate over each frame.
    """
    near, w = trailing(n, by, date), ordered(by, date)
    z = ratio(F.col(value) - F.avg(value).over(near), F.stddev_pop(value).over(near))
    rows = valid_only(obs, value).select("*", z.alias("_z"), F.row_number().over(w).alias("_rn"))
    used = F.least(F.col("_rn"), F.lit(n)).cast("bigint")
    return rows.select(
        *obs.columns, F.round(F.when(used == n, F.col("_z")), dp).alias("z_score"),
        used.alias("z_sample_size"),
    )


def momentum_regime(
    obs: DataFrame, *, short: int = 20, long: int = 60, by: Sequence[str] = BY,
    date: str = "obs_date", value: str = "value",
) -> DataFrame:
    """k-observation returns in percent, two moving averages and the regime."""
    w, v = ordered(by, date), F.col(value)
    rows = valid_only(obs, value)

    def mean(k: int) -> Column:
        near = trailing(k, by, date)
        return F.when(F.count(value).over(near) == k, F.avg(value).over(near))

    out = rows.select(
        "*",
        ((ratio(v, F.lag(value, short).over(w)) - 1) * 100).alias("return_short_pct"),
        ((ratio(v, F.lag(value, long).over(w)) - 1) * 100).alias("return_long_pct"),
        mean(short).alias("average_short"), mean(long).alias("average_long"),
    )
    a, b = F.col("average_short"), F.col("average_long")
    return out.withColumn(
        "regime",
        F.when(a.isNull() | b.isNull(), "UNKNOWN")
        .when((v > a) & (v > b), "ABOVE_BOTH")
        .when((v < a) & (v < b), "BELOW_BOTH")
        .when((v == a) & (v == b), "FLAT")
        .otherwise("MIXED"),
    )


def price_rules(kinds: Mapping[str, str], *, by: str = "series_id", value: str = "value") -> list[tuple[Column, str]]:
    """What an observation must not be: a price of zero or less. A missing value is no fault."""
    prices = [k for k, kind in kinds.items() if kind == "price"]
    return [(F.coalesce(F.col(by).isin(*prices) & (F.col(value) <= 0), F.lit(False)), "NOT_POSITIVE")]


def step_changes(
    obs: DataFrame, kinds: Mapping[str, str], *, by: str = "series_id",
    date: str = "obs_date", value: str = "value", strict: bool = False,
) -> DataFrame:
    """Log return for ``price`` series, basis-point difference for ``yield`` ones.

    There is no step to or from a price of zero or less; `clean.refused` with
    `price_rules` lists these rows, ``strict`` raises on the first.
    """
    if strict:
        obs = raise_refused(obs, price_rules(kinds, by=by, value=value))
    previous = F.lag(value).over(ordered([by], date))
    kind = F.try_element_at(
        F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col(by)
    )
    step = F.when(
        (kind == "price") & (F.col(value) > 0) & (previous > 0), F.log(F.col(value) / previous)
    ).when(kind == "yield", (F.col(value) - previous) * 100)
    return valid_only(obs.where(F.col(by).isin(*kinds)), value).select(
        by, date, step.alias("value")
    ).where(F.col("value").isNotNull())


def pairwise_correlation(
    changes: DataFrame, pairs: Sequence[tuple[str, str, str]], *,
    windows: Sequence[tuple[int, int]] = ((20, 15), (60, 40)), by: str = "series_id",
    date: str = "obs_date", value: str = "value",
) -> DataFrame:
    """Pearson correlation of common changes over the last n rows of each pair.

    ``windows`` holds (n, minimum sample). No variance, or too few rows: null.
    """
    both = pair_on_date(changes, pairs, by=by, date=date, value=value)
    out = [F.col("pair"), F.col(date)]
    for n, minimum in windows:
        near = trailing(n, ["pair"], date)
        used = F.count(F.lit(1)).over(near)
        moves = (F.min("left_value").over(near) < F.max("left_value").over(near)) & (
            F.min("right_value").over(near) < F.max("right_value").over(near)
        )
        spread = F.sqrt(F.var_pop("left_value").over(near) * F.var_pop("right_value").over(near))
        rho = ratio(F.covar_pop("left_value", "right_value").over(near), spread)
        out += [
            F.when((used >= minimum) & moves, rho).alias(f"correlation_{n}"),
            used.alias(f"sample_{n}"),
        ]
    return both.select(*out)


def position_rules(
    categories: Mapping[str, tuple[str, str]], *, date: str = "obs_date", total: str = "open_interest",
) -> list[tuple[Column, str]]:
    """What a report must not be: without a date, without open interest, with a negative or missing position."""
    sides = [F.col(c) >= 0 for pair in categories.values() for c in pair]
    return [(F.col(date).isNull(), "NO_DATE"), (~(F.col(total) > 0), "OPEN_INTEREST"), (~all_of(sides), "POSITION")]


def position_series(
    reports: DataFrame, categories: Mapping[str, tuple[str, str]], *,
    by: Sequence[str] = ("contract",), date: str = "obs_date", total: str = "open_interest", strict: bool = False,
) -> DataFrame:
    """Net position and net percent of open interest per trader category.

    Reports without open interest have no percentage and are left out here;
    `clean.refused` with `position_rules` lists them, ``strict`` raises on the
    first report that breaks a rule.
    """
    if strict:
        reports = raise_refused(reports, position_rules(categories, date=date, total=total))
    entry = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("category"), F.col(long).cast("bigint").alias("long_position"),
                    F.col(short).cast("bigint").alias("short_position"),
                )
                for name, (long, short) in categories.items()
            ]
        )
    )
    flat = reports.where(F.col(total) > 0).select(*by, date, total, entry.alias("_e")).select(
        *by, date, total, "_e.*"
    )
    net = F.col("long_position") - F.col("short_position")
    raw = F.lit(100.0) * net / F.col(total)
    return flat.select(
        "*", net.alias("net_position"), raw.alias("net_pct_raw"), F.round(raw, 6).alias("value")
    )


def position_stats(
    positions: DataFrame, *, by: Sequence[str] = ("contract", "category"),
    date: str = "obs_date", n: int = 156,
) -> DataFrame:
    """Endpoint statistics of position series: changes over 8 and 12 reports, z-score."""
    w, v = ordered(by, date), F.col("net_pct_raw")
    rows = population_z(positions, n, by=by, date=date, value="net_pct_raw").select(
        *by, date, "net_position", "open_interest", v.alias("net_pct"),
        F.round(v - F.lag(v, 8).over(w), 6).alias("change_8_weeks"),
        F.round(v - F.lag(v, 12).over(w), 6).alias("change_12_weeks"),
        F.col("z_score").alias("z_score_3_year"),
        F.col("z_sample_size").alias("z_score_sample_size"),
        F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("sample_size"),
        F.lead(date).over(w).isNull().alias("_last"),
    )
    return rows.where("_last").drop("_last").withColumn(
        "direction", sign_label("change_8_weeks", "MORE_NET_LONG", "MORE_NET_SHORT")
    )
