"""Percentiles, bands and ranks. Three kinds coexist and must not be mixed:

* mid-rank: (below + half of equal) / n, the row inside its own window;
* nearest rank with an ECDF (≤): strictly prior history, the row never ranks itself;
* linear interpolation at (n − 1)·q: strictly prior history of some calendar years.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.scalars import calendar_key, calendar_years_frame, years_before
from seriesloom.operators.windows import BY, ordered, tail_rows, trailing_slope, valid_only


def qname(q: float) -> str:
    """Column suffix of a quantile: 0.8 → ``q80``."""
    return f"q{round(q * 100):02d}"


# --- mid-rank --------------------------------------------------------------


def midrank_endpoint(
    obs: DataFrame, *, window: int = 756, minimum: int = 252, by: Sequence[str] = BY,
    date: str = "obs_date", value: str = "value", dp: int | None = 6,
) -> DataFrame:
    """Mid-rank of the endpoint inside its last ``window`` valid rows.

    The tail is cut per map task before the shuffle; the ranks are two sums.
    """
    tail = tail_rows(valid_only(obs, value), window, by=by, date=date)
    latest = F.max(F.when(F.col("rn") == 1, F.col(value))).over(Window.partitionBy(*by))
    ranked = tail.withColumn("_latest", latest).groupBy(*by).agg(
        F.max(date).alias(date), F.max("_latest").alias("latest"),
        F.count(F.lit(1)).alias("sample_size"),
        F.count_if(F.col(value) < F.col("_latest")).alias("_below"),
        F.count_if(F.col(value) == F.col("_latest")).alias("_equal"),
    )
    rank = (F.col("_below") + F.col("_equal") * 0.5) / F.col("sample_size")
    rank = rank if dp is None else F.round(rank, dp)
    return ranked.select(
        *by, date, "latest", F.when(F.col("sample_size") >= minimum, rank).alias("midrank"),
        "sample_size",
    )


def level_change_percentile(
    obs: DataFrame, *, changes: Sequence[int] = (5, 20), window: int = 756, minimum: int = 252,
    by: Sequence[str] = BY, date: str = "obs_date", value: str = "value",
) -> DataFrame:
    """Endpoint level, its change over k observations and its mid-rank in the trailing window.

    A change over more rows than the series has is null, as is a rank over fewer
    than ``minimum`` rows. Only tails leave the map tasks.
    """
    tail = tail_rows(valid_only(obs, value), max(changes) + 1, by=by, date=date)
    at = lambda k: F.max(F.when(F.col("rn") == k, F.col(value)))
    moved = tail.groupBy(*by).agg(*[(at(1) - at(k + 1)).alias(f"change_{k}") for k in changes])
    ranked = midrank_endpoint(obs, window=window, minimum=minimum, by=by, date=date, value=value)
    return ranked.join(moved, list(by)).select(
        *by, date, F.col("latest").alias("level"), *[f"change_{k}" for k in changes],
        F.col("midrank").alias("percentile"), "sample_size",
    )


def _sorted_stream(
    rows: DataFrame, by: Sequence[str], date: str, columns: str, rank, keep
) -> DataFrame:
    """Add columns that look back along each series.

    No aggregate over a frame can refer to the frame's current row, and an array
    per row would hold the whole frame for each of them. So Spark shuffles by
    series and sorts, and a task walks its sorted stream batch by batch, whatever
    the number of series in a batch. ``rank(data, starts)`` gets a batch with the
    first position of each row's series and returns the new columns; ``keep(data)``
    picks the rows that the next batch must still see.
    """
    keys = list(by)
    arranged = rows.repartition(*by).sortWithinPartitions(*by, date)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        carry = None
        for batch in batches:
            if batch.empty:
                continue
            data = batch if carry is None else pd.concat([carry, batch], ignore_index=True)
            held = len(data) - len(batch)
            changed = np.zeros(len(data), dtype=bool)
            changed[0] = True
            for k in keys:
                column = data[k].to_numpy()
                changed[1:] |= column[1:] != column[:-1]
            starts = np.maximum.accumulate(np.where(changed, np.arange(len(data)), 0))
            yield data.assign(**rank(data, starts)).iloc[held:]
            carry = data[starts == starts[-1]]
            carry = carry[keep(carry)]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return arranged.mapInPandas(run, f"{schema}, {columns}")


def midrank_trailing(
    obs: DataFrame, *, window: int = 756, minimum: int = 252, by: Sequence[str] = BY,
    date: str = "obs_date", value: str = "value",
) -> DataFrame:
    """Mid-rank of every row inside its own trailing window.

    The sorted values are compared with themselves shifted by 1, 2, … rows, for
    all series of a batch at once.
    """
    rows = valid_only(obs, value).select(*by, date, F.col(value).cast("double").alias("value"))

    def rank(data, starts):
        import numpy as np
        import pandas as pd

        index = np.arange(len(data))
        depth = index - np.maximum(starts, index - window + 1)
        v = data["value"].to_numpy()
        below, equal = np.zeros(len(data)), np.ones(len(data))
        for shift in range(1, min(window, len(data))):
            reach = depth[shift:] >= shift
            if not reach.any():
                break
            now, then = v[shift:], v[:-shift]
            below[shift:] += reach & (then < now)
            equal[shift:] += reach & (then == now)
        size = depth + 1
        midrank = pd.Series((below + 0.5 * equal) / size, index=data.index)
        return {"midrank": midrank.where(size >= minimum), "sample_size": size}

    def keep(data):
        import numpy as np

        return np.arange(len(data)) >= len(data) - (window - 1)

    return _sorted_stream(
        rows, by, date, "midrank double, sample_size bigint", rank, keep
    )


def near_floor_context(
    obs: DataFrame, *, window: int = 20, floor: float = 0.10, by: Sequence[str] = BY,
    date: str = "obs_date", value: str = "value",
) -> DataFrame:
    """Where the endpoint lies in its last 20 rows; near_floor needs all 20."""
    ranked = midrank_endpoint(obs, window=window, minimum=1, by=by, date=date, value=value)
    return ranked.withColumn(
        "near_floor", F.when(F.col("sample_size") >= window, F.col("midrank") <= floor)
    )


# --- strictly prior history, endpoint form ---------------------------------


def _prior_band(
    rows: DataFrame, *, by: Sequence[str], date: str, value: str, minimum: int,
    quantiles: Sequence[float], dp: int | None, percentile: str = "percentile",
) -> DataFrame:
    """Nearest-rank thresholds and ECDF of the last row against all rows before it.

    One shuffle: the window that finds the endpoint leaves the rows partitioned
    the way the aggregate needs them.
    """
    whole = Window.partitionBy(*by)
    marked = rows.select(
        *by, date, value,
        F.max(date).over(whole).alias("_end"), F.max_by(value, date).over(whole).alias("_current"),
    )
    past = (F.col(date) < F.col("_end")) & F.col(value).isNotNull()
    prior = F.when(past, F.col(value))
    marked = marked.withColumn("_prior", prior)
    band = marked.groupBy(*by, "_end").agg(
        F.max("_current").alias("current"), F.count("_prior").alias("sample_size"),
        F.count_if(F.col("_prior") <= F.col("_current")).alias("_at_or_below"),
        *[
            F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY _prior)").alias(qname(q))
            for q in quantiles
        ],
    )
    enough = F.col("current").isNotNull() & (F.col("sample_size") >= minimum)

    def out(c: Column) -> Column:
        return F.when(enough, c if dp is None else F.round(c, dp))

    return band.select(
        *by, F.col("_end").alias(date),
        (F.col("current") if dp is None else F.round("current", dp)).alias("current"),
        "sample_size",
        F.round(F.when(enough, F.col("_at_or_below") / F.col("sample_size")), 6)
        .alias(percentile),
        *[out(F.col(qname(q))).alias(qname(q)) for q in quantiles],
    )


def prior_only_band(
    obs: DataFrame, *, quantiles: Sequence[float], minimum: int, by: Sequence[str] = BY,
    date: str = "obs_date", value: str = "value",
) -> DataFrame:
    """The endpoint level against strictly prior levels; a null endpoint stays null."""
    return _prior_band(
        obs, by=by, date=date, value=value, minimum=minimum, quantiles=quantiles, dp=None
    )


def prior_only_change_band(
    obs: DataFrame, *, lag: int, quantiles: Sequence[float], minimum: int,
    by: Sequence[str] = BY, date: str = "obs_date", value: str = "value",
) -> DataFrame:
    """The endpoint's change over ``lag`` valid rows against strictly prior changes.

    With no more than ``lag`` valid rows the change is null and the history empty.
    """
    w = ordered(by, date)
    changes = valid_only(obs, value).select(
        *by, date, (F.col(value) - F.lag(value, lag).over(w)).alias("_change")
    )
    return _prior_band(
        changes, by=by, date=date, value="_change", minimum=minimum, quantiles=quantiles, dp=6
    )


def prior_n_floor(
    obs: DataFrame, *, window: int = 20, minimum: int = 20, quantile: float = 0.10,
    slope_rows: int = 6, by: Sequence[str] = BY, date: str = "obs_date", value: str = "value",
) -> DataFrame:
    """The endpoint against its last 20 valid prior values, with a recent slope."""
    w = Window.partitionBy(*by).orderBy(F.desc(date))
    ranked = obs.select(
        *by, date, value, F.row_number().over(w).alias("_rn"),
        F.count(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_valid_rank"),
    )
    # Valid prior rows counted from the end, without the endpoint itself.
    endpoint_valid = F.max(F.when(F.col("_rn") == 1, F.col(value))).over(Window.partitionBy(*by))
    shift = F.when(endpoint_valid.isNotNull(), 1).otherwise(0)
    near = ranked.withColumn("_shift", shift).where(
        (F.col("_rn") == 1)
        | (F.col(value).isNotNull() & (F.col("_valid_rank") - F.col("_shift") <= window))
    )
    level = _prior_band(
        near.select(*by, date, value), by=by, date=date, value=value, minimum=minimum,
        quantiles=[quantile], dp=None,
    )
    recent = tail_rows(valid_only(obs, value), slope_rows, by=by, date=date).drop("rn")
    slopes = trailing_slope(recent, slope_rows, by=by, date=date, value=value).groupBy(*by).agg(
        F.max_by("slope", date).alias("slope")
    )
    return level.join(slopes, list(by), "left")


def difference_band(
    differences: DataFrame, endpoints: DataFrame, *, quantiles: Sequence[float] = (0.80, 0.95),
    minimum: int = 104, by: Sequence[str] = ("check_id",), date: str = "obs_date",
    value: str = "difference",
) -> DataFrame:
    """Common-date differences ranked against earlier ones; the current one must
    lie on the endpoint date of the slower series (``endpoints``: by, end_date)."""
    at_end = differences.join(endpoints, list(by), "right")
    placed = at_end.where(
        F.col(date).isNull() | (F.col(date) <= F.col("end_date"))
    ).select(*by, date, value).unionByName(
        endpoints.select(
            *by, F.col("end_date").alias(date), F.lit(None).cast("double").alias(value)
        )
    )
    filled = placed.where(F.col(date).isNotNull()).groupBy(*by, date).agg(
        F.max(value).alias(value)
    )
    lo, hi = qname(quantiles[0]), qname(quantiles[1])
    band = _prior_band(
        filled, by=by, date=date, value=value, minimum=minimum, quantiles=quantiles, dp=None
    )
    c = F.col("current")
    return band.withColumn(
        "state",
        F.when(c.isNull(), "NOT_RELEASED")
        .when(F.col(lo).isNull() | F.col(hi).isNull(), "INSUFFICIENT_HISTORY")
        .when(c <= F.col(lo), "ALIGNED")
        .when(c <= F.col(hi), "TIMING_DIFFERENCE")
        .otherwise("MATERIAL_DIVERGENCE"),
    ).withColumn("current", F.round("current", 6))


# --- calendar years --------------------------------------------------------


def calendar_year_percentile(
    daily: DataFrame, *, years: int = 3, quantile: float = 0.90, minimum: int = 60,
    by: Sequence[str] = BY, date: str = "obs_date", value: str = "value",
) -> DataFrame:
    """Per row: the linear quantile of the positive values of the k calendar years
    strictly before it, the sample size and whether the row reaches it.

    The interval is a numeric range over :func:`calendar_key`, so no pair of rows
    is ever joined.
    """
    back, before = calendar_years_frame(years)
    rows = daily.select(
        *by, date, F.col(value).cast("double").alias("_v"), calendar_key(date).alias("_key")
    )
    floor = max(minimum, 1)

    def rank(data, starts):
        import numpy as np

        key, v = data["_key"].to_numpy(), data["_v"].to_numpy()
        size, found = np.zeros(len(data), dtype="int64"), np.full(len(data), np.nan)
        edges = np.append(np.unique(starts), len(data))
        for lo, hi in zip(edges[:-1], edges[1:]):
            used = v[lo:hi] > 0
            keys, values = key[lo:hi][used], v[lo:hi][used]
            first = np.searchsorted(keys, key[lo:hi] + back, "left")
            last = np.searchsorted(keys, key[lo:hi] + before, "right")
            size[lo:hi] = last - first
            # The window only moves forward: each value enters and leaves the sorted list once.
            past, taken, dropped, given = [], 0, 0, values.tolist()
            for i, (start, stop) in enumerate(zip(first.tolist(), last.tolist())):
                for x in given[taken:stop]:
                    insort(past, x)
                taken = max(taken, stop)
                for x in given[dropped:start]:
                    del past[bisect_left(past, x)]
                dropped = max(dropped, start)
                if stop - start >= floor:
                    position = (len(past) - 1) * quantile
                    low = int(position)
                    high = min(low + 1, len(past) - 1)
                    weight = position - low
                    found[lo + i] = past[low] * (1 - weight) + past[high] * weight
        return {"_q": found, "sample_size": size}

    def keep(data):
        return (data["_key"] >= data["_key"].iloc[-1] + back).to_numpy()

    ranked = _sorted_stream(rows, by, date, "_q double, sample_size bigint", rank, keep)
    threshold = F.when(~F.isnan("_q"), F.col("_q"))
    return ranked.select(
        *by, date, F.col("_v").alias(value), "sample_size",
        F.round(threshold, 6).alias("threshold"),
        F.when(
            threshold.isNotNull(), (F.col("_v") >= threshold) & (F.col("_v") > 0)
        ).alias("is_large"),
    )


def settlement_flags(
    value: str = "value", large: str = "is_large", flags: Column | None = None
) -> Column:
    """Append the settlement flags to an existing flag array, without repeats."""
    base = F.array().cast("array<string>") if flags is None else flags
    added = F.array_compact(
        F.array(
            F.when(F.col(value) > 0, "TREASURY_SETTLEMENT"),
            F.when(F.col(large), "LARGE_TREASURY_SETTLEMENT"),
        )
    )
    return F.array_union(base, added)


def change_vs_trailing_p10(
    obs: DataFrame, *, lag: int = 4, years: int = 5, quantile: float = 0.10,
    by: Sequence[str] = BY, date: str = "obs_date", value: str = "value", dp: int = 3,
) -> DataFrame:
    """The endpoint's 4-row change against the p10 of earlier changes in 5 years.

    The current change is rounded, the history is not; only the quantile is
    rounded at the end.
    """
    w, whole = ordered(by, date), Window.partitionBy(*by)
    rows = valid_only(obs, value).select(
        *by, date, (F.col(value) - F.lag(value, lag).over(w)).alias("_change"),
        F.max(date).over(whole).alias("_end"),
    )
    # The row count is taken into account through the change itself: it is null
    # on the first ``lag`` rows.
    past = (F.col(date) < F.col("_end")) & (F.col(date) >= years_before("_end", years))
    rows = rows.withColumn("_past", F.when(past, F.col("_change")))
    return rows.groupBy(*by, "_end").agg(
        F.round(F.max(F.when(F.col(date) == F.col("_end"), F.col("_change"))), dp).alias("change"),
        F.round(F.percentile("_past", F.lit(quantile)), dp).alias("trailing_p10"),
        F.count("_past").alias("sample_size"),
    ).withColumnRenamed("_end", date)
