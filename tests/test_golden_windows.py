"""Hand-computed expectations for window, band and growth operators."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from conftest import one, rows
from seriesloom.functions import scalars
from seriesloom.operators import bands, growth, joins, windows
from seriesloom.rules import interpretation as ip


def test_asof_and_spread(obs):
    both = obs([("a", "2026-08-10", 5.33), ("bench", "2026-08-07", 5.30)])
    got = one(joins.spread_to_benchmark(both, "bench"))
    assert got["spread_bp"] == 3.0
    assert got["right_obs_date"] == date(2026, 8, 7)


def test_left_rows_before_the_first_right_row_are_dropped(obs):
    both = obs([("a", "2026-08-01", 1.0), ("a", "2026-08-09", 2.0), ("bench", "2026-08-07", 1.0)])
    assert [r["obs_date"] for r in rows(joins.spread_to_benchmark(both, "bench"))] == [date(2026, 8, 9)]


def test_spread_stats(daily):
    got = one(windows.spread_stats(daily([8, -1, 0, 1, 2, None, 4], "2026-08-01")))
    assert got["latest"] == 4 and got["change_1obs"] == 2 and got["change_5obs"] == -4
    assert got["mean_5obs"] == 1.2 and got["slope_5obs"] == 1.2
    assert got["positive_streak"] == 3 and got["above_streak"] == 1 and got["observations_used"] == 5


def test_weekly_stats(daily):
    got = one(windows.weekly_stats(daily([3000, 2990, 2985, 2970, 2960], step=7)))
    assert (got["level"], got["change_1w"], got["change_4w"]) == (2960, -10, -40)


def test_change_against_p10(daily):
    got = one(bands.change_vs_trailing_p10(daily([100, 99, 98, 97, 96, 94, 93, 91, 90, 85], step=7)))
    assert (got["change"], got["trailing_p10"], got["sample_size"]) == (-9, -6, 5)


def test_calendar_year_percentile_history(daily):
    history = daily([*range(1, 61), 0, 54.1], step=14)
    got = rows(bands.calendar_year_percentile(history, years=3), "obs_date")[-1]
    assert got["threshold"] == 54.1 and got["sample_size"] == 60 and got["is_large"] is True


@pytest.mark.parametrize("count, known", [(59, False), (60, True)])
def test_calendar_year_percentile_needs_sixty(daily, count, known):
    got = rows(bands.calendar_year_percentile(daily([*range(1, count + 1), 5], step=7)), "obs_date")[-1]
    assert (got["threshold"] is not None) is known


def test_calendar_years_admit_28_february_for_a_leap_day(obs):
    data = obs([("s", "2021-02-27", 1.0), ("s", "2021-02-28", 2.0), ("s", "2024-02-28", 3.0),
                ("s", "2024-02-29", 9.0)])
    got = {r["obs_date"]: r["sample_size"] for r in rows(bands.calendar_year_percentile(data, minimum=1))}
    assert got[date(2024, 2, 29)] == 2 and got[date(2024, 2, 28)] == 1


def test_period_end_flags_by_next_observation(obs):
    data = obs([("s", "2026-06-29", 1.0), ("s", "2026-07-01", 1.0), ("s", "2026-12-31", 1.0),
                ("s", "2027-01-04", 1.0)])
    got = {r["obs_date"]: r["flags"] for r in rows(windows.period_end_flags(data))}
    assert got[date(2026, 6, 29)] == ["MONTH_END", "QUARTER_END"]
    assert got[date(2026, 12, 31)] == ["MONTH_END", "QUARTER_END", "YEAR_END"]
    assert got[date(2027, 1, 4)] == []


@pytest.mark.parametrize("today, flags", [("2026-07-02", ["MONTH_END", "QUARTER_END"]), ("2026-07-05", []),
                                          ("2026-06-30", [])])
def test_last_row_uses_today_only_just_after_the_boundary(obs, today, flags):
    data = obs([("s", "2026-06-30", 1.0)])
    assert one(windows.period_end_flags(data, today=today))["flags"] == flags


@pytest.mark.parametrize("day, flags", [("2026-06-30", ["MONTH_END", "QUARTER_END"]),
                                        ("2026-12-31", ["MONTH_END", "QUARTER_END", "YEAR_END"]),
                                        ("2026-12-30", [])])
def test_calendar_end_flags(spark, day, flags):
    df = spark.range(1).select(windows.calendar_end_flags(F.lit(day).cast("date")).alias("f"))
    assert one(df)["f"] == flags


def test_population_z_of_equal_values_is_null(daily):
    got = rows(windows.population_z(daily([1.1] * 156)), "obs_date")[-1]
    assert got["z_score"] is None and got["z_sample_size"] == 156


def test_population_z_needs_the_whole_window(daily):
    got = rows(windows.population_z(daily(range(155))), "obs_date")[-1]
    assert got["z_score"] is None


def test_midrank_trailing(daily):
    got = rows(bands.midrank_trailing(daily([0.8, 0.9, 1.0, 1.2]), window=4, minimum=3), "obs_date")
    assert got[0]["midrank"] is None and got[-1]["midrank"] == 0.875


def test_level_change_and_percentile(daily):
    data = daily(range(100, 121))
    change = one(windows.endpoint_changes(data, [5, 20]))
    rank = one(bands.midrank_endpoint(data, window=21, minimum=21, dp=None))
    assert (change["change_5"], change["change_20"]) == (5, 20)
    assert rank["midrank"] == pytest.approx(20.5 / 21)


def test_momentum_regime(daily):
    got = rows(windows.momentum_regime(daily(range(1, 62))), "obs_date")[-1]
    assert got["return_short_pct"] == pytest.approx((61 / 41 - 1) * 100)
    assert got["return_long_pct"] == pytest.approx(6000)
    assert (got["average_short"], got["average_long"], got["regime"]) == (51.5, 31.5, "ABOVE_BOTH")


@pytest.mark.parametrize("common, short, long", [(14, False, False), (39, True, False), (40, True, True)])
def test_correlation_sample_floors(daily, common, short, long):
    a = daily([(i * 7) % 11 + 1 for i in range(common)], series="a")
    b = daily([(i * 5) % 13 + 1 for i in range(common)], series="b")
    got = rows(windows.pairwise_correlation(a.unionByName(b), [("ab", "a", "b")]), "obs_date")[-1]
    assert (got["correlation_20"] is not None) is short
    assert (got["correlation_60"] is not None) is long


def test_correlation_of_a_constant_is_null(daily):
    a, b = daily([1.0] * 20, series="a"), daily(range(20), series="b")
    got = rows(windows.pairwise_correlation(a.unionByName(b), [("ab", "a", "b")]), "obs_date")[-1]
    assert got["correlation_20"] is None


@pytest.mark.parametrize("values, expected", [([1, 2, 3, 4], 3), ([1, 1, 1, 9], 1)])
def test_nearest_rank(daily, values, expected):
    got = one(bands.prior_only_band(daily([*values, 0]), quantiles=[0.75], minimum=1))
    assert got["q75"] == expected


@pytest.mark.parametrize("count, q80, percentile", [(60, 47, 1.0), (59, None, None)])
def test_prior_only_level_band(daily, count, q80, percentile):
    got = one(bands.prior_only_band(daily([*range(count), 100]), quantiles=[0.80], minimum=60))
    assert (got["q80"], got["percentile"], got["sample_size"]) == (q80, percentile, count)


def test_prior_only_level_band_null_endpoint(daily):
    got = one(bands.prior_only_band(daily([*range(80), None]), quantiles=[0.80], minimum=60))
    assert got["current"] is None and got["q80"] is None and got["sample_size"] == 80


@pytest.mark.parametrize("count, value, sample", [(108, None, 103), (109, 4, 104)])
def test_prior_only_change_band(daily, count, value, sample):
    got = one(bands.prior_only_change_band(daily(range(count)), lag=4, quantiles=[0.5], minimum=104))
    assert (got["q50"], got["sample_size"]) == (value, sample)


def test_nulls_are_dropped_before_lag_and_slope(daily):
    band = one(bands.prior_only_change_band(daily([0, 1, None, 2, 3, 4, 5]), lag=2, quantiles=[0.5], minimum=1))
    assert (band["current"], band["sample_size"]) == (2, 3)
    slope = rows(windows.trailing_slope(daily([1, 2, None, 3, 4, 5]), 5), "obs_date")[-1]
    assert slope["slope"] == 1.0


def test_slope_of_one_row_is_null_and_of_flat_values_zero(daily):
    assert one(windows.trailing_slope(daily([3]), 5))["slope"] is None
    assert rows(windows.trailing_slope(daily([3, 3, 3]), 5), "obs_date")[-1]["slope"] == 0


def test_equal_differences_are_aligned(spark, daily):
    differences = daily([2.0] * 105).select(
        F.col("series_id").alias("check_id"), "obs_date", F.col("value").alias("difference")
    )
    ends = differences.groupBy("check_id").agg(F.max("obs_date").alias("end_date"))
    got = one(bands.difference_band(differences, ends))
    assert (got["percentile"], got["state"], got["sample_size"]) == (1.0, "ALIGNED", 104)


def test_difference_not_on_the_endpoint_is_not_released(daily):
    differences = daily([2.0] * 105).select(
        F.col("series_id").alias("check_id"), "obs_date", F.col("value").alias("difference")
    )
    ends = differences.groupBy("check_id").agg(F.date_add(F.max("obs_date"), 1).alias("end_date"))
    assert one(bands.difference_band(differences, ends))["state"] == "NOT_RELEASED"


def test_streak_skips_flagged_rows_and_resets_on_zero(daily):
    data = daily([5, 0, 3, 99, 4]).withColumn("skip", F.col("value") == 99)
    got = rows(windows.streak_skipping(data, F.col("value") > 0, F.col("skip")), "obs_date")
    assert [r["streak"] for r in got] == [1, 0, 1, 2]


def test_ordinal_gap_gives_null(spark):
    data = spark.createDataFrame([("s", 1, 10.0), ("s", 3, 30.0), ("s", 4, 40.0)],
                                 "series_id string, ordinal int, value double")
    got = rows(joins.ordinal_offset(data, [1]), "ordinal")
    assert [r["value_t1"] for r in got] == [None, None, 30.0]


def _ratio(spark, pairs):
    def side(index, name):
        return spark.createDataFrame(
            [("p", 8100 + i, *([None] if p[index] is None else [float(p[index])])) for i, p in enumerate(pairs)],
            "pair string, ordinal int, value double",
        ).withColumn("obs_date", scalars.quarter_end(F.col("ordinal")))

    return growth.ordinal_window_stats(growth.quarter_ratio(side(0, "n"), side(1, "d")))


def test_ordinal_stats_published_pair(spark):
    got = rows(_ratio(spark, [(24320995, 17804.228), (25319362, 17912.079)]), "ordinal")
    assert (got[0]["value"], got[0]["midrank"], got[0]["midrank_sample_size"]) == (136.602356, 50.0, 1)
    assert got[1]["value"] == 141.353564 and got[1]["change_1_quarter_pp"] == 4.751207
    assert got[1]["qoq_pct"] == 3.47813 and got[1]["midrank"] == 75.0


def test_ratio_of_null_and_zero_denominator_is_null(spark):
    got = rows(_ratio(spark, [(1000, 10), (1000, 0), (None, 10)]), "ordinal")
    assert [r["value"] for r in got] == [10.0, None, None]


def _facts(spark, rows_, fye):
    df = spark.createDataFrame(
        rows_, "s string, e string, value double, accession string, form string, f string"
    )
    return df.select(
        F.lit("x").alias("entity"), F.lit("t").alias("tag"), F.lit(fye).alias("fye_month"),
        F.to_date("s").alias("ctx_start"), F.to_date("e").alias("ctx_end"), "value", "accession", "form",
        F.to_date("f").alias("filed"), F.to_date("f").cast("timestamp").alias("accepted_at"),
        F.lit(False).alias("metadata_missing"),
    )


def test_decumulation_for_a_june_year_end_uses_the_amendment(spark):
    facts = _facts(spark, [
        ("2024-07-01", "2024-09-30", 14.0, "a1", "10-Q", "2024-10-24"),
        ("2024-07-01", "2024-12-31", 31.0, "a2", "10-Q", "2025-01-29"),
        ("2024-07-01", "2024-12-31", 32.0, "a3", "10-Q/A", "2025-02-03"),
        ("2024-07-01", "2025-03-31", 50.0, "a4", "10-Q", "2025-04-30"),
        ("2024-07-01", "2025-06-30", 72.0, "a5", "10-K", "2025-07-30"),
        ("2025-01-01", "2025-06-30", 9.0, "a6", "10-K", "2025-07-30"),
    ], 6)
    got = rows(growth.decumulate_ytd(facts), "obs_date")
    assert [r["value"] for r in got] == [14, 18, 18, 22]
    assert got[1]["accession"] == "a3" and got[3]["method"] == "FY_MINUS_9M"
    assert got[0]["fiscal_quarter"] == "FY2025Q1"


def test_decumulation_simple(spark):
    facts = _facts(spark, [
        ("2023-01-01", "2023-03-31", 10.0, "a", "10-Q", "2023-05-01"),
        ("2023-01-01", "2023-06-30", 22.0, "b", "10-Q", "2023-08-01"),
        ("2023-01-01", "2023-09-30", 36.0, "c", "10-Q", "2023-11-01"),
        ("2023-01-01", "2023-12-31", 52.0, "d", "10-K", "2024-02-01"),
    ], 12)
    assert [r["value"] for r in rows(growth.decumulate_ytd(facts), "obs_date")] == [10, 12, 14, 16]


def test_decumulation_skips_a_missing_predecessor_and_marks_negatives(spark):
    facts = _facts(spark, [
        ("2023-01-01", "2023-03-31", 10.0, "a", "10-Q", "2023-05-01"),
        ("2023-01-01", "2023-09-30", 36.0, "c", "10-Q", "2023-11-01"),
        ("2023-01-01", "2023-12-31", 30.0, "d", "10-K", "2024-02-01"),
    ], 12)
    got = rows(growth.decumulate_ytd(facts), "obs_date")
    assert [(r["value"], r["is_negative"]) for r in got] == [(10, False), (-6, True)]
    assert len(rows(growth.decumulate_ytd(facts, optional=True))) == 1
    with pytest.raises(Exception, match="negative quarter"):
        growth.decumulate_ytd(facts, strict=True).collect()


def test_consecutive_suffix_minimum(spark):
    data = spark.createDataFrame([("s", o) for o in (1, 2, 5, 6, 7)], "series_id string, ordinal int")
    assert [r["ordinal"] for r in rows(windows.consecutive_suffix(data, minimum=3), "ordinal")] == [5, 6, 7]
    assert rows(windows.consecutive_suffix(data, minimum=4)) == []
    with pytest.raises(Exception, match="fewer than 4"):
        windows.consecutive_suffix(data, minimum=4, strict=True).collect()


def test_positions(spark):
    reports = spark.createDataFrame(
        [("c1", 2116079, 1162320, 225287), ("c2", 334748, 40114, 140754)],
        "contract string, open_interest bigint, l bigint, s bigint",
    ).withColumn("obs_date", F.lit("2026-08-11").cast("date"))
    got = rows(windows.position_series(reports, {"a": ("l", "s")}), "contract")
    assert [(r["net_position"], r["value"]) for r in got] == [(937033, 44.28157), (-100640, -30.064407)]


def test_buffer_floor_and_null_endpoint(daily):
    state = lambda df: one(ip.buffer_states(df, F.lit("FLAT")))["state"]
    assert state(daily([*range(1, 21), 0])) == "AT_FLOOR"
    assert state(daily([*range(1, 21), 2])) == "NEAR_FLOOR"
    assert state(daily([*range(1, 20), 2])) == "INSUFFICIENT_HISTORY"
    assert state(daily([*range(1, 21), None])) == "UNKNOWN"


def test_anchored_history_withholds_a_mismatch(obs, spark):
    data = obs([("a", "2024-01-01", 1.0), ("a", "2024-01-02", None), ("b", "2024-01-01", 5.0)])
    ends = spark.createDataFrame(
        [("a", date(2024, 1, 2), 1.0), ("b", date(2024, 1, 1), 5.0)],
        "series_id string, published_date date, published_value double",
    )
    assert [r["series_id"] for r in rows(windows.anchored_history(data, ends))] == ["b"]


def test_range_window_counts_from_the_global_latest(obs):
    from seriesloom.operators.clean import range_window_filter

    data = obs([("a", "2024-01-31", 1.0), ("b", "2023-12-31", 1.0), ("b", "2023-12-30", 1.0)])
    assert sorted(r["obs_date"] for r in rows(range_window_filter(data, 31))) == [date(2023, 12, 31), date(2024, 1, 31)]
    assert range_window_filter(data, None).count() == 3


# --- rows that must not be -----------------------------------------------------


def test_refused_market_rows_are_listed_and_strict_raises(spark):
    from seriesloom.operators import aggregates, clean, windows

    columns = "asset string, venue string, settled_at timestamp, rate double, interval_hours double"
    at = datetime(2024, 1, 10)
    good, bad = ("a", "v", at, 0.1, 8.0), [("a", "v", at, 0.1, 0.0), ("a", " ", None, None, None), ("a", "v", at, float("inf"), -1.0)]
    rules = aggregates.settlement_rules()
    found = [r["violations"] for r in clean.refused(spark.createDataFrame([good, *bad], columns), rules).collect()]
    assert sorted(found) == sorted([["INTERVAL"], ["NO_VENUE", "NO_TIME", "NOT_NUMERIC", "INTERVAL"], ["NOT_NUMERIC", "INTERVAL"]])
    assert aggregates.venue_summary(spark.createDataFrame([good], columns), as_of=at, strict=True).count() == 1
    for row in bad:
        with pytest.raises(Exception, match="INTERVAL"):
            aggregates.venue_summary(spark.createDataFrame([good, row], columns), as_of=at, strict=True).collect()

    kinds = {"p": "price", "y": "yield"}
    obs = spark.createDataFrame([("p", date(2024, 1, 1), 1.0), ("p", date(2024, 1, 2), 0.0), ("p", date(2024, 1, 3), None), ("y", date(2024, 1, 1), -1.0)], "series_id string, obs_date date, value double")
    assert [(r["series_id"], r["value"]) for r in clean.refused(obs, windows.price_rules(kinds)).collect()] == [("p", 0.0)]
    with pytest.raises(Exception, match="NOT_POSITIVE"):
        windows.step_changes(obs, kinds, strict=True).collect()
    assert windows.step_changes(obs.where("value <> 0"), kinds, strict=True).count() == 0

    reports = spark.createDataFrame([("c", date(2024, 1, 1), 10, 1, 1), ("c", None, 10, 1, 1), ("c", date(2024, 1, 2), 0, 1, -1), ("c", date(2024, 1, 3), None, None, 1)],
                                    "contract string, obs_date date, open_interest long, l long, s long")
    sides = {"x": ("l", "s")}
    found = [r["violations"] for r in clean.refused(reports, windows.position_rules(sides)).collect()]
    assert sorted(found) == [["NO_DATE"], ["OPEN_INTEREST", "POSITION"], ["OPEN_INTEREST", "POSITION"]]
    with pytest.raises(Exception, match="OPEN_INTEREST|NO_DATE"):
        windows.position_series(reports, sides, strict=True).collect()
