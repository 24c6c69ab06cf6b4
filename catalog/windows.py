"""Window, band and sequence queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.common import (
    EVENTS_CTE, ORDERS_CTE, QUARTER_CTE, SHIP_CTE, USERS_CTE,
    event_obs, order_obs, quarter_obs, query, ship_obs, table, user_obs,
)
from seriesloom.functions.scalars import quarter_ordinal
from seriesloom.operators import bands, clean, growth, windows
from seriesloom.plans.records import tail_statistics


@query("observations_daily", f"""WITH {EVENTS_CTE} SELECT series_id,
  CAST(obs_date AS VARCHAR) AS obs_date, value FROM ev""")
def observations_daily(spark, sf):
    return event_obs(spark, sf)


@query("latest_per_series", f"""WITH {USERS_CTE} SELECT series_id,
  CAST(MAX(obs_date) AS VARCHAR) AS obs_date, arg_max(value, obs_date) AS value FROM us GROUP BY 1""")
def latest_per_series(spark, sf):
    return windows.latest_per_series(user_obs(spark, sf))


@query("last_n_days", """WITH d AS (SELECT DISTINCT o_orderpriority AS series_id,
    CAST(o_orderdate AS DATE) AS index_date FROM orders)
  SELECT series_id, CAST(index_date AS VARCHAR) AS index_date, rn FROM (
    SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY index_date DESC) AS rn FROM d)
  WHERE rn <= 20""")
def last_n_days(spark, sf):
    days = order_obs(spark, sf).withColumnRenamed("obs_date", "index_date")
    return windows.last_n_days(days, 20, by=["series_id"])


@query("k_obs_changes", f"""WITH {EVENTS_CTE} SELECT series_id, CAST(obs_date AS VARCHAR) AS obs_date,
  value, round(value - lag(value, 1) OVER w, 6) AS change_1,
  round(value - lag(value, 5) OVER w, 6) AS change_5,
  round(value - lag(value, 20) OVER w, 6) AS change_20
  FROM ev WINDOW w AS (PARTITION BY series_id ORDER BY obs_date)""")
def k_obs_changes(spark, sf):
    return windows.k_obs_changes(event_obs(spark, sf), [1, 5, 20])


@query("endpoint_changes", f"""WITH {USERS_CTE}, r AS (SELECT *,
    row_number() OVER (PARTITION BY series_id ORDER BY obs_date DESC) AS rn FROM us)
  SELECT series_id, CAST(MAX(obs_date) AS VARCHAR) AS obs_date,
  MAX(CASE WHEN rn = 1 THEN value END) AS latest,
  round(MAX(CASE WHEN rn = 1 THEN value END) - MAX(CASE WHEN rn = 2 THEN value END), 6) AS change_1,
  round(MAX(CASE WHEN rn = 1 THEN value END) - MAX(CASE WHEN rn = 6 THEN value END), 6) AS change_5
  FROM r WHERE rn <= 6 GROUP BY 1""")
def endpoint_changes(spark, sf):
    return windows.endpoint_changes(user_obs(spark, sf), [1, 5])


@query("changes_by_frequency", f"""WITH {ORDERS_CTE}, r AS (SELECT *,
    CASE series_id WHEN '1-URGENT' THEN 'weekly' WHEN '2-HIGH' THEN 'quarterly' ELSE 'daily' END AS frequency,
    row_number() OVER (PARTITION BY series_id ORDER BY obs_date DESC) AS rn FROM ob),
  p AS (SELECT series_id, frequency, MAX(obs_date) AS obs_date,
    MAX(CASE WHEN rn = 1 THEN value END) AS latest, MAX(CASE WHEN rn = 2 THEN value END) AS v1,
    MAX(CASE WHEN rn = 5 THEN value END) AS v4, MAX(CASE WHEN rn = 6 THEN value END) AS v5,
    MAX(CASE WHEN rn = 9 THEN value END) AS v8, MAX(CASE WHEN rn = 13 THEN value END) AS v12,
    MAX(CASE WHEN rn = 21 THEN value END) AS v20 FROM r WHERE rn <= 21 GROUP BY 1, 2)
  SELECT series_id, frequency, CAST(obs_date AS VARCHAR) AS obs_date, latest,
  round(latest - v1, 6) AS one_observation, round(latest - v5, 6) AS five_observations,
  round(latest - v20, 6) AS twenty_observations,
  CASE WHEN frequency = 'weekly' THEN round(latest - v8, 6) END AS eight_weeks,
  CASE WHEN frequency = 'weekly' THEN round(latest - v4, 6) END AS four_weeks,
  CASE WHEN frequency = 'monthly' THEN round(latest - v1, 6) END AS one_month,
  CASE WHEN frequency = 'quarterly' THEN round(latest - v1, 6) END AS one_quarter,
  CASE WHEN frequency = 'weekly' THEN round(latest - v1, 6) END AS one_week,
  CASE WHEN frequency = 'weekly' THEN round(latest - v12, 6) END AS twelve_weeks FROM p""")
def changes_by_frequency(spark, sf):
    frequency = (
        F.when(F.col("series_id") == "1-URGENT", "weekly")
        .when(F.col("series_id") == "2-HIGH", "quarterly").otherwise("daily")
    )
    return windows.changes_by_frequency(order_obs(spark, sf).withColumn("frequency", frequency))


@query("spread_stats", f"""WITH {USERS_CTE}, c AS (SELECT series_id, obs_date, value - 20 AS value FROM us),
  n AS (SELECT *, row_number() OVER w AS rn FROM c WINDOW w AS (PARTITION BY series_id ORDER BY obs_date)),
  b AS (SELECT *, MAX(CASE WHEN NOT value > 0 THEN rn END) OVER u AS brk0,
    MAX(CASE WHEN NOT value > 3 THEN rn END) OVER u AS brk3,
    lag(value, 1) OVER w AS l1, lag(value, 5) OVER w AS l5, avg(value) OVER f AS m5,
    regr_slope(value, rn) OVER f AS s5, count(*) OVER f AS n5,
    lead(obs_date) OVER w AS nxt FROM n
    WINDOW w AS (PARTITION BY series_id ORDER BY obs_date),
      u AS (PARTITION BY series_id ORDER BY obs_date ROWS UNBOUNDED PRECEDING),
      f AS (PARTITION BY series_id ORDER BY obs_date ROWS 4 PRECEDING))
  SELECT series_id, CAST(obs_date AS VARCHAR) AS obs_date, value AS latest,
  round(value - l1, 4) AS change_1obs, round(value - l5, 4) AS change_5obs,
  round(m5, 4) AS mean_5obs, CASE WHEN n5 >= 2 THEN round(s5, 4) END AS slope_5obs,
  rn - coalesce(brk0, 0) AS positive_streak, rn - coalesce(brk3, 0) AS above_streak,
  n5 AS observations_used FROM b WHERE nxt IS NULL""")
def spread_stats(spark, sf):
    obs = user_obs(spark, sf).withColumn("value", F.col("value") - 20)
    return windows.spread_stats(obs)


@query("trailing_slope", f"""WITH {ORDERS_CTE}, n AS (SELECT *, row_number() OVER w AS rn FROM ob
    WINDOW w AS (PARTITION BY series_id ORDER BY obs_date))
  SELECT series_id, CAST(obs_date AS VARCHAR) AS obs_date, value,
  CASE WHEN count(*) OVER f >= 2 THEN round(regr_slope(value, rn) OVER f, 4) END AS slope FROM n
  WINDOW f AS (PARTITION BY series_id ORDER BY obs_date ROWS 19 PRECEDING)""")
def trailing_slope(spark, sf):
    return windows.trailing_slope(order_obs(spark, sf), 20, dp=4)


@query("trailing_streak", f"""WITH {EVENTS_CTE}, n AS (SELECT *, row_number() OVER w AS rn FROM ev
    WINDOW w AS (PARTITION BY series_id ORDER BY obs_date))
  SELECT series_id, CAST(obs_date AS VARCHAR) AS obs_date, value, rn - coalesce(MAX(
    CASE WHEN NOT value > 1000 THEN rn END) OVER (PARTITION BY series_id ORDER BY obs_date
    ROWS UNBOUNDED PRECEDING), 0) AS streak FROM n""")
def trailing_streak(spark, sf):
    return windows.trailing_streak(event_obs(spark, sf), F.col("value") > 1000)


@query("streak_skipping", f"""WITH {ORDERS_CTE}, k AS (SELECT * FROM ob WHERE isodow(obs_date) < 6),
  n AS (SELECT *, row_number() OVER w AS rn FROM k
    WINDOW w AS (PARTITION BY series_id ORDER BY obs_date))
  SELECT series_id, CAST(obs_date AS VARCHAR) AS obs_date, value, rn - coalesce(MAX(
    CASE WHEN NOT value > 200000 THEN rn END) OVER (PARTITION BY series_id ORDER BY obs_date
    ROWS UNBOUNDED PRECEDING), 0) AS streak FROM n""")
def streak_skipping(spark, sf):
    return windows.streak_skipping(
        order_obs(spark, sf), F.col("value") > 200000, F.weekday("obs_date") >= 5
    )


@query("population_z", f"""WITH {ORDERS_CTE} SELECT series_id, CAST(obs_date AS VARCHAR) AS obs_date, value,
  CASE WHEN count(*) OVER f = 156 AND min(value) OVER f < max(value) OVER f
    THEN round((value - avg(value) OVER f) / stddev_pop(value) OVER f, 6) END AS z_score,
  count(*) OVER f AS z_sample_size FROM ob
  WINDOW f AS (PARTITION BY series_id ORDER BY obs_date ROWS 155 PRECEDING)""")
def population_z(spark, sf):
    return windows.population_z(order_obs(spark, sf))


@query("midrank_trailing", f"""WITH {SHIP_CTE}, n AS (SELECT *, row_number() OVER (
    PARTITION BY series_id ORDER BY obs_date) AS rn FROM sh)
  SELECT a.series_id, CAST(a.obs_date AS VARCHAR) AS obs_date, a.value,
  CASE WHEN count(*) >= 60 THEN round((count(*) FILTER (WHERE b.value < a.value)
    + 0.5 * count(*) FILTER (WHERE b.value = a.value)) / count(*), 9) END AS midrank,
  count(*) AS sample_size FROM n a JOIN n b ON a.series_id = b.series_id
    AND b.rn BETWEEN a.rn - 251 AND a.rn GROUP BY a.series_id, a.obs_date, a.value""")
def midrank_trailing(spark, sf):
    ranked = bands.midrank_trailing(ship_obs(spark, sf), window=252, minimum=60)
    return ranked.withColumn("midrank", F.round("midrank", 9))


@query("midrank_endpoint", f"""WITH {ORDERS_CTE}, r AS (SELECT *, row_number() OVER (
    PARTITION BY series_id ORDER BY obs_date DESC) AS rn,
    first_value(value) OVER (PARTITION BY series_id ORDER BY obs_date DESC) AS latest FROM ob)
  SELECT series_id, CAST(MAX(obs_date) AS VARCHAR) AS obs_date, MAX(latest) AS latest,
  CASE WHEN count(*) >= 252 THEN round((count(*) FILTER (WHERE value < latest)
    + 0.5 * count(*) FILTER (WHERE value = latest)) / count(*), 6) END AS midrank,
  count(*) AS sample_size FROM r WHERE rn <= 756 GROUP BY 1""")
def midrank_endpoint(spark, sf):
    return bands.midrank_endpoint(order_obs(spark, sf))


@query("near_floor_context", f"""WITH {USERS_CTE}, r AS (SELECT *, row_number() OVER (
    PARTITION BY series_id ORDER BY obs_date DESC) AS rn,
    first_value(value) OVER (PARTITION BY series_id ORDER BY obs_date DESC) AS latest FROM us),
  g AS (SELECT series_id, CAST(MAX(obs_date) AS VARCHAR) AS obs_date, MAX(latest) AS latest,
    round((count(*) FILTER (WHERE value < latest)
    + 0.5 * count(*) FILTER (WHERE value = latest)) / count(*), 6) AS midrank,
    count(*) AS sample_size FROM r WHERE rn <= 20 GROUP BY 1)
  SELECT *, CASE WHEN sample_size >= 20 THEN midrank <= 0.1 END AS near_floor FROM g""")
def near_floor_context(spark, sf):
    return bands.near_floor_context(user_obs(spark, sf))


@query("prior_only_band", f"""WITH {ORDERS_CTE}, e AS (SELECT series_id, MAX(obs_date) AS obs_date,
    arg_max(value, obs_date) AS current FROM ob GROUP BY 1)
  SELECT e.series_id, CAST(e.obs_date AS VARCHAR) AS obs_date, e.current, count(*) AS sample_size,
  CASE WHEN count(*) >= 60 THEN round(count(*) FILTER (WHERE o.value <= e.current) / count(*), 6) END AS percentile,
  CASE WHEN count(*) >= 60 THEN quantile_disc(o.value, 0.8) END AS q80,
  CASE WHEN count(*) >= 60 THEN quantile_disc(o.value, 0.95) END AS q95
  FROM e JOIN ob o ON o.series_id = e.series_id AND o.obs_date < e.obs_date GROUP BY 1, 2, 3""")
def prior_only_band(spark, sf):
    return bands.prior_only_band(order_obs(spark, sf), quantiles=[0.80, 0.95], minimum=60)


@query("prior_only_change_band", f"""WITH {ORDERS_CTE}, c AS (SELECT series_id, obs_date,
    value - lag(value, 5) OVER (PARTITION BY series_id ORDER BY obs_date) AS ch FROM ob),
  e AS (SELECT series_id, MAX(obs_date) AS obs_date, arg_max(ch, obs_date) AS current FROM c GROUP BY 1)
  SELECT e.series_id, CAST(e.obs_date AS VARCHAR) AS obs_date, round(e.current, 6) AS current,
  count(c.ch) AS sample_size,
  CASE WHEN count(c.ch) >= 60 THEN round(count(*) FILTER (WHERE c.ch <= e.current) / count(c.ch), 6) END AS percentile,
  CASE WHEN count(c.ch) >= 60 THEN round(quantile_disc(c.ch, 0.75), 6) END AS q75,
  CASE WHEN count(c.ch) >= 60 THEN round(quantile_disc(c.ch, 0.9), 6) END AS q90
  FROM e JOIN c ON c.series_id = e.series_id AND c.obs_date < e.obs_date GROUP BY 1, 2, e.current""")
def prior_only_change_band(spark, sf):
    return bands.prior_only_change_band(
        order_obs(spark, sf), lag=5, quantiles=[0.75, 0.90], minimum=60
    )


@query("prior_n_floor", f"""WITH {USERS_CTE}, r AS (SELECT *, row_number() OVER (
    PARTITION BY series_id ORDER BY obs_date DESC) AS rn FROM us),
  e AS (SELECT * FROM r WHERE rn = 1),
  p AS (SELECT e.series_id, e.obs_date, e.value AS current, count(r.value) AS n,
    count(*) FILTER (WHERE r.value <= e.value) AS below, quantile_disc(r.value, 0.1) AS q
    FROM e LEFT JOIN r ON r.series_id = e.series_id AND r.rn BETWEEN 2 AND 21 GROUP BY 1, 2, 3),
  s AS (SELECT series_id, CASE WHEN count(*) >= 2 THEN round(regr_slope(value, -rn), 6) END AS slope
    FROM r WHERE rn <= 6 GROUP BY 1)
  SELECT p.series_id, CAST(p.obs_date AS VARCHAR) AS obs_date, current, n AS sample_size,
  CASE WHEN n >= 20 THEN round(below / n, 6) END AS percentile,
  CASE WHEN n >= 20 THEN q END AS q10, slope FROM p JOIN s ON p.series_id = s.series_id""")
def prior_n_floor(spark, sf):
    return bands.prior_n_floor(user_obs(spark, sf))


@query("calendar_year_percentile", f"""WITH {ORDERS_CTE}
  SELECT a.series_id, CAST(a.obs_date AS VARCHAR) AS obs_date, a.value, count(b.value) AS sample_size,
  CASE WHEN count(b.value) >= 60 THEN round(quantile_cont(b.value, 0.9), 6) END AS threshold,
  CASE WHEN count(b.value) >= 60 THEN a.value >= quantile_cont(b.value, 0.9) AND a.value > 0 END AS is_large
  FROM ob a LEFT JOIN ob b ON a.series_id = b.series_id AND b.obs_date < a.obs_date
    AND b.obs_date >= a.obs_date - INTERVAL 3 YEAR AND b.value > 0
  GROUP BY 1, 2, 3""")
def calendar_year_percentile(spark, sf):
    return bands.calendar_year_percentile(order_obs(spark, sf))


@query("change_vs_p10", f"""WITH {ORDERS_CTE}, c AS (SELECT series_id, obs_date,
    value - lag(value, 4) OVER (PARTITION BY series_id ORDER BY obs_date) AS ch FROM ob),
  e AS (SELECT series_id, MAX(obs_date) AS obs_date, arg_max(ch, obs_date) AS ch FROM c GROUP BY 1)
  SELECT e.series_id, CAST(e.obs_date AS VARCHAR) AS obs_date, round(e.ch, 3) AS change,
  round(quantile_cont(c.ch, 0.1), 3) AS trailing_p10, count(c.ch) AS sample_size
  FROM e LEFT JOIN c ON c.series_id = e.series_id AND c.obs_date < e.obs_date
    AND c.obs_date >= e.obs_date - INTERVAL 5 YEAR GROUP BY 1, 2, e.ch""")
def change_vs_p10(spark, sf):
    return bands.change_vs_trailing_p10(order_obs(spark, sf))


@query("momentum_regime", f"""WITH {ORDERS_CTE}, r AS (SELECT *, lag(value, 20) OVER w AS l20,
    lag(value, 60) OVER w AS l60,
    CASE WHEN count(*) OVER s = 20 THEN avg(value) OVER s END AS a20,
    CASE WHEN count(*) OVER l = 60 THEN avg(value) OVER l END AS a60 FROM ob
    WINDOW w AS (PARTITION BY series_id ORDER BY obs_date),
      s AS (PARTITION BY series_id ORDER BY obs_date ROWS 19 PRECEDING),
      l AS (PARTITION BY series_id ORDER BY obs_date ROWS 59 PRECEDING))
  SELECT series_id, CAST(obs_date AS VARCHAR) AS obs_date, value,
  round((value / l20 - 1) * 100, 6) AS return_short_pct, round((value / l60 - 1) * 100, 6) AS return_long_pct,
  round(a20, 4) AS average_short, round(a60, 4) AS average_long,
  CASE WHEN a20 IS NULL OR a60 IS NULL THEN 'UNKNOWN' WHEN value > a20 AND value > a60 THEN 'ABOVE_BOTH'
    WHEN value < a20 AND value < a60 THEN 'BELOW_BOTH' WHEN value = a20 AND value = a60 THEN 'FLAT'
    ELSE 'MIXED' END AS regime FROM r""")
def momentum_regime(spark, sf):
    out = windows.momentum_regime(order_obs(spark, sf))
    for c, dp in (("return_short_pct", 6), ("return_long_pct", 6), ("average_short", 4), ("average_long", 4)):
        out = out.withColumn(c, F.round(c, dp))
    return out


KINDS = {"click": "price", "view": "price", "error": "yield", "purchase": "yield", "signup": "price"}
PAIRS = [("click_view", "click", "view"), ("click_error", "click", "error"),
         ("purchase_signup", "purchase", "signup")]
STEPS_SQL = f"""{EVENTS_CTE}, lg AS (SELECT series_id, obs_date, value,
    lag(value) OVER (PARTITION BY series_id ORDER BY obs_date) AS prev FROM ev),
  ch AS (SELECT series_id, obs_date, CASE WHEN series_id IN ('click', 'view', 'signup')
      THEN CASE WHEN value > 0 AND prev > 0 THEN ln(value / prev) END
      WHEN series_id IN ('error', 'purchase') THEN (value - prev) * 100 END AS v FROM lg)"""


@query("step_changes", f"""WITH {STEPS_SQL} SELECT series_id, CAST(obs_date AS VARCHAR) AS obs_date,
  round(v, 9) AS value FROM ch WHERE v IS NOT NULL""")
def step_changes(spark, sf):
    out = windows.step_changes(event_obs(spark, sf), KINDS)
    return out.withColumn("value", F.round("value", 9))


@query("refused_prices", f"""WITH {EVENTS_CTE} SELECT series_id, CAST(obs_date AS VARCHAR) AS obs_date, 'NOT_POSITIVE' AS violations FROM ev
  WHERE series_id IN ('click', 'view', 'signup') AND dayofmonth(obs_date) <= 5""")
def refused_prices(spark, sf):
    low = F.dayofmonth("obs_date") <= 5
    obs = event_obs(spark, sf).withColumn("value", F.when(low, F.dayofmonth("obs_date") - 5.0).otherwise(F.col("value")))
    return clean.refused(obs, windows.price_rules(KINDS)).select("series_id", "obs_date", "violations")


@query("refused_positions", """SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_linenumber = 3 THEN 'NO_DATE' END,
    CASE WHEN l_returnflag = 'N' THEN 'OPEN_INTEREST' END, CASE WHEN l_linestatus = 'F' AND l_linenumber = 1 THEN 'POSITION' END) AS violations
  FROM lineitem WHERE l_linenumber = 3 OR l_returnflag = 'N' OR l_linestatus = 'F' AND l_linenumber = 1""")
def refused_positions(spark, sf):
    li = table(spark, sf, "lineitem")
    reports = li.select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 3, F.to_date("l_shipdate")).alias("obs_date"),
        F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice").cast("bigint")).alias("open_interest"),
        F.when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1), -1).otherwise(1).alias("a_long"), F.lit(0).alias("a_short"),
    )
    return clean.refused(reports, windows.position_rules({"a": ("a_long", "a_short")})).select("l_orderkey", "l_linenumber", "violations")


@query("pairwise_corr", f"""WITH {STEPS_SQL}, p AS (SELECT 'click_view' AS pair, 'click' AS l, 'view' AS r
    UNION ALL SELECT 'click_error', 'click', 'error' UNION ALL SELECT 'purchase_signup', 'purchase', 'signup'),
  j AS (SELECT pair, a.obs_date, a.v AS x, b.v AS y FROM p JOIN ch a ON a.series_id = p.l
    JOIN ch b ON b.series_id = p.r AND a.obs_date = b.obs_date
    WHERE a.v IS NOT NULL AND b.v IS NOT NULL)
  SELECT pair, CAST(obs_date AS VARCHAR) AS obs_date,
  CASE WHEN count(*) OVER s >= 15 THEN round(covar_pop(x, y) OVER s
    / sqrt(var_pop(x) OVER s * var_pop(y) OVER s), 9) END AS correlation_20, count(*) OVER s AS sample_20,
  CASE WHEN count(*) OVER l >= 40 THEN round(covar_pop(x, y) OVER l
    / sqrt(var_pop(x) OVER l * var_pop(y) OVER l), 9) END AS correlation_60, count(*) OVER l AS sample_60
  FROM j WINDOW s AS (PARTITION BY pair ORDER BY obs_date ROWS 19 PRECEDING),
    l AS (PARTITION BY pair ORDER BY obs_date ROWS 59 PRECEDING)""")
def pairwise_corr(spark, sf):
    steps = windows.step_changes(event_obs(spark, sf), KINDS)
    out = windows.pairwise_correlation(steps, PAIRS)
    for c in ("correlation_20", "correlation_60"):
        out = out.withColumn(c, F.round(c, 9))
    return out


@query("consecutive_suffix", f"""WITH {USERS_CTE}, o AS (SELECT series_id, obs_date,
    date_diff('day', DATE '2024-01-01', obs_date) AS ordinal, value FROM us),
  i AS (SELECT *, ordinal - row_number() OVER (PARTITION BY series_id ORDER BY ordinal) AS isl FROM o),
  l AS (SELECT *, MAX(isl) OVER (PARTITION BY series_id) AS last_isl FROM i),
  k AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS run_length FROM l WHERE isl = last_isl)
  SELECT series_id, CAST(obs_date AS VARCHAR) AS obs_date, ordinal, value, run_length FROM k
  WHERE run_length >= 2""")
def consecutive_suffix(spark, sf):
    obs = user_obs(spark, sf).select(
        "series_id", "obs_date", F.datediff("obs_date", F.lit("2024-01-01").cast("date")).alias("ordinal"),
        "value",
    )
    return windows.consecutive_suffix(obs, minimum=2)


@query("null_gap_segments", f"""WITH {USERS_CTE}, v AS (SELECT series_id, obs_date,
    CASE WHEN value < 10 THEN NULL ELSE value END AS value FROM us),
  g AS (SELECT *, count(*) FILTER (WHERE value IS NULL) OVER (PARTITION BY series_id ORDER BY obs_date
    ROWS UNBOUNDED PRECEDING) AS gap FROM v)
  SELECT series_id, CAST(MIN(obs_date) AS VARCHAR) AS start_date, CAST(MAX(obs_date) AS VARCHAR) AS end_date,
  count(*) AS points FROM g WHERE value IS NOT NULL GROUP BY series_id, gap""")
def null_gap_segments(spark, sf):
    obs = user_obs(spark, sf).withColumn(
        "value", F.when(F.col("value") >= 10, F.col("value"))
    )
    return windows.null_gap_segments(obs)


@query("anchored_history", f"""WITH {ORDERS_CTE}, e AS (SELECT series_id, MAX(obs_date) AS d,
    CASE WHEN series_id = '5-LOW' THEN -1 ELSE arg_max(value, obs_date) END AS v FROM ob GROUP BY 1),
  ok AS (SELECT e.* FROM e JOIN ob ON ob.series_id = e.series_id AND ob.obs_date = e.d AND ob.value = e.v)
  SELECT ob.series_id, CAST(ob.obs_date AS VARCHAR) AS obs_date, ob.value,
  CAST(ok.d AS VARCHAR) AS published_date, ok.v AS published_value
  FROM ob JOIN ok ON ob.series_id = ok.series_id AND ob.obs_date <= ok.d""")
def anchored_history(spark, sf):
    obs = order_obs(spark, sf)
    ends = windows.latest_per_series(obs).select(
        "series_id", F.col("obs_date").alias("published_date"),
        F.when(F.col("series_id") == "5-LOW", F.lit(-1.0)).otherwise(F.col("value"))
        .alias("published_value"),
    )
    return windows.anchored_history(obs, ends)


@query("next_obs_period_end", f"""WITH {ORDERS_CTE}, n AS (SELECT *, lead(obs_date) OVER (
    PARTITION BY series_id ORDER BY obs_date) AS nxt FROM ob)
  SELECT series_id, CAST(obs_date AS VARCHAR) AS obs_date, value, concat_ws(',',
    CASE WHEN year(obs_date) <> year(nxt) OR month(obs_date) <> month(nxt) THEN 'MONTH_END' END,
    CASE WHEN year(obs_date) <> year(nxt) OR quarter(obs_date) <> quarter(nxt) THEN 'QUARTER_END' END,
    CASE WHEN year(obs_date) <> year(nxt) THEN 'YEAR_END' END) AS flags FROM n""")
def next_obs_period_end(spark, sf):
    return windows.period_end_flags(order_obs(spark, sf))


@query("tail_array", f"""WITH {EVENTS_CTE}, r AS (SELECT *, row_number() OVER (
    PARTITION BY series_id ORDER BY obs_date DESC) AS rn FROM ev)
  SELECT series_id, count(*) AS points, string_agg(CAST(obs_date AS VARCHAR) || '=' ||
    CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), ';' ORDER BY obs_date) AS tail
  FROM r WHERE rn <= 22 GROUP BY 1""")
def tail_array(spark, sf):
    tails = windows.tail_array(event_obs(spark, sf), 22)
    text = F.transform(
        "tail", lambda p: F.concat_ws(
            "=", p["obs_date"].cast("string"), F.round(p["value"] * 100).cast("bigint").cast("string")
        )
    )
    return tails.select(
        "series_id", F.size("tail").alias("points"), F.array_join(text, ";").alias("tail")
    )


@query("positive_days_of_last", f"""WITH {USERS_CTE}, r AS (SELECT *, row_number() OVER (
    PARTITION BY series_id ORDER BY obs_date DESC) AS rn FROM us)
  SELECT series_id, count(*) FILTER (WHERE value - 15 > 0) AS positive_days, count(*) AS days
  FROM r WHERE rn <= 3 GROUP BY 1""")
def positive_days_of_last(spark, sf):
    return windows.positive_days(
        user_obs(spark, sf).withColumn("value", F.col("value") - 15), 3
    )


@query("tail_statistics", f"""WITH {ORDERS_CTE}, r AS (SELECT *, row_number() OVER (
    PARTITION BY series_id ORDER BY obs_date DESC) AS rn,
    first_value(value) OVER (PARTITION BY series_id ORDER BY obs_date DESC) AS latest,
    count(*) OVER (PARTITION BY series_id) AS n FROM ob)
  SELECT series_id, MAX(n) AS sample_size, round((count(*) FILTER (WHERE value < latest)
    + 0.5 * count(*) FILTER (WHERE value = latest)) / count(*), 6) AS tail_percentile,
  round(regr_slope(value, -rn), 4) AS tail_slope FROM r WHERE rn <= 20 GROUP BY 1""")
def tail_statistics_query(spark, sf):
    return tail_statistics(order_obs(spark, sf)).withColumn("tail_slope", F.round("tail_slope", 4))


POSITIONS_SQL = """pos AS (SELECT l_returnflag AS contract, CAST(l_shipdate AS DATE) AS obs_date,
    SUM(CAST(floor(l_extendedprice) AS BIGINT)) AS open_interest,
    SUM(CAST(l_quantity AS BIGINT)) AS a_long, SUM(CAST(l_linenumber AS BIGINT)) AS a_short,
    COUNT(*) AS b_long, SUM(CAST(l_quantity AS BIGINT)) AS b_short FROM lineitem GROUP BY 1, 2),
  cat AS (SELECT contract, obs_date, open_interest, 'a' AS category, a_long AS lp, a_short AS sp FROM pos
    UNION ALL SELECT contract, obs_date, open_interest, 'b', b_long, b_short FROM pos),
  net AS (SELECT *, lp - sp AS np, 100.0::DOUBLE * (lp - sp) / open_interest AS raw FROM cat)"""


def _positions(spark, sf):
    li = table(spark, sf, "lineitem")
    reports = li.groupBy(
        F.col("l_returnflag").alias("contract"), F.to_date("l_shipdate").alias("obs_date")
    ).agg(
        F.sum(F.floor("l_extendedprice").cast("bigint")).alias("open_interest"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("a_long"),
        F.sum(F.col("l_linenumber").cast("bigint")).alias("a_short"),
        F.count(F.lit(1)).alias("b_long"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("b_short"),
    )
    return windows.position_series(reports, {"a": ("a_long", "a_short"), "b": ("b_long", "b_short")})


@query("position_series", f"""WITH {POSITIONS_SQL} SELECT contract, category,
  CAST(obs_date AS VARCHAR) AS obs_date, CAST(open_interest AS BIGINT) AS open_interest,
  CAST(lp AS BIGINT) AS long_position, CAST(sp AS BIGINT) AS short_position,
  CAST(np AS BIGINT) AS net_position, round(raw, 9) AS net_pct_raw, round(raw, 6) AS value FROM net""")
def position_series(spark, sf):
    return _positions(spark, sf).withColumn("net_pct_raw", F.round("net_pct_raw", 9))


@query("position_stats", f"""WITH {POSITIONS_SQL}, w AS (SELECT *, lag(raw, 8) OVER o AS l8,
    lag(raw, 12) OVER o AS l12, count(*) OVER f AS n, avg(raw) OVER f AS m, stddev_pop(raw) OVER f AS s,
    min(raw) OVER f AS lo, max(raw) OVER f AS hi, lead(obs_date) OVER o AS nxt,
    count(*) OVER (PARTITION BY contract, category) AS total FROM net
    WINDOW o AS (PARTITION BY contract, category ORDER BY obs_date),
      f AS (PARTITION BY contract, category ORDER BY obs_date ROWS 155 PRECEDING))
  SELECT contract, category, CAST(obs_date AS VARCHAR) AS obs_date, CAST(np AS BIGINT) AS net_position,
  CAST(open_interest AS BIGINT) AS open_interest, round(raw, 9) AS net_pct,
  round(raw - l8, 6) AS change_8_weeks, round(raw - l12, 6) AS change_12_weeks,
  CASE WHEN n = 156 AND lo < hi THEN round((raw - m) / s, 6) END AS z_score_3_year,
  n AS z_score_sample_size, total AS sample_size,
  CASE WHEN l8 IS NULL THEN 'UNKNOWN' WHEN round(raw - l8, 6) > 0 THEN 'MORE_NET_LONG'
    WHEN round(raw - l8, 6) < 0 THEN 'MORE_NET_SHORT' ELSE 'FLAT' END AS direction
  FROM w WHERE nxt IS NULL""")
def position_stats(spark, sf):
    return windows.position_stats(_positions(spark, sf)).withColumn("net_pct", F.round("net_pct", 9))


# --- quarterly -------------------------------------------------------------

RATIO_SQL = f"""{QUARTER_CTE}, den AS (SELECT CAST(year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS BIGINT) AS ordinal,
    MAX(CAST(l_shipdate AS DATE)) AS d, CAST(SUM(CAST(l_extendedprice AS DECIMAL(28,2))) AS DOUBLE) AS v
    FROM lineitem GROUP BY 1),
  rt AS (SELECT qo.series_id AS pair, qo.ordinal, qo.value / 1000 / nullif(den.v, 0) * 100 AS ratio,
    round(qo.value / 1000, 6) AS numerator, round(den.v, 6) AS denominator,
    qo.obs_date AS nd, den.d AS dd FROM qo JOIN den ON qo.ordinal = den.ordinal)"""


def _ratios(spark, sf, scale=1000.0):
    top = quarter_obs(spark, sf).withColumnRenamed("series_id", "pair")
    li = table(spark, sf, "lineitem")
    bottom = li.groupBy(quarter_ordinal("l_shipdate").alias("ordinal")).agg(
        F.max(F.to_date("l_shipdate")).alias("obs_date"),
        F.sum(F.col("l_extendedprice").cast("decimal(28,2)")).cast("double").alias("value"),
    )
    # One denominator series serves every pair: the pair is looked up by quarter.
    spread = bottom.join(top.select("pair", "ordinal"), "ordinal")
    return growth.quarter_ratio(top, spread, numerator_scale=scale)


@query("quarter_ratio", f"""WITH {RATIO_SQL} SELECT pair, ordinal,
  CAST(last_day(make_date(CAST(ordinal // 4 AS BIGINT), CAST((ordinal % 4 + 1) * 3 AS BIGINT), 1)) AS VARCHAR) AS obs_date,
  CAST(year(nd) AS VARCHAR) || '-Q' || CAST(quarter(nd) AS VARCHAR) AS quarter, round(ratio, 9) AS ratio,
  numerator, denominator, CAST(nd AS VARCHAR) AS numerator_source_date,
  CAST(dd AS VARCHAR) AS denominator_source_date FROM rt""")
def quarter_ratio(spark, sf):
    return _ratios(spark, sf).withColumn("ratio", F.round("ratio", 9))


@query("ordinal_window_stats", f"""WITH {RATIO_SQL}
  SELECT a.pair, a.ordinal, round(a.ratio, 6) AS value, round(a.ratio - p.ratio, 6) AS change_1_quarter_pp,
  round((a.ratio / nullif(p.ratio, 0) - 1) * 100, 6) AS qoq_pct,
  round((a.ratio / nullif(y.ratio, 0) - 1) * 100, 6) AS yoy_pct,
  (SELECT round((count(*) FILTER (WHERE b.ratio < a.ratio) + 0.5 * count(*) FILTER (WHERE b.ratio = a.ratio))
    / count(*) * 100, 6) FROM rt b WHERE b.pair = a.pair AND b.ordinal BETWEEN a.ordinal - 39 AND a.ordinal) AS midrank,
  (SELECT count(b.ratio) FROM rt b WHERE b.pair = a.pair AND b.ordinal BETWEEN a.ordinal - 39 AND a.ordinal) AS midrank_sample_size
  FROM rt a LEFT JOIN rt p ON p.pair = a.pair AND p.ordinal = a.ordinal - 1
  LEFT JOIN rt y ON y.pair = a.pair AND y.ordinal = a.ordinal - 4""")
def ordinal_window_stats(spark, sf):
    return growth.ordinal_window_stats(_ratios(spark, sf)).select(
        "pair", "ordinal", "value", "change_1_quarter_pp", "qoq_pct", "yoy_pct", "midrank",
        "midrank_sample_size",
    )


@query("macro_package", f"""WITH {RATIO_SQL}, z AS (SELECT *, lag(ratio) OVER (PARTITION BY pair ORDER BY ordinal) AS p,
    lag(ordinal) OVER (PARTITION BY pair ORDER BY ordinal) AS po,
    row_number() OVER (PARTITION BY pair ORDER BY ordinal DESC) AS rn,
    count(*) OVER (PARTITION BY pair) AS n FROM rt)
  SELECT pair, CAST(year(nd) AS VARCHAR) || '-Q' || CAST(quarter(nd) AS VARCHAR) AS quarter,
  round(ratio, 6) AS value, CASE WHEN po = ordinal - 1 THEN round(ratio - p, 6) END AS change_1_quarter_pp,
  n AS common_quarters, 'orders of ' || pair AS numerator_title, 'shipments' AS denominator_title
  FROM z WHERE rn = 1""")
def macro_package(spark, sf):
    stats = growth.ordinal_window_stats(_ratios(spark, sf))
    pairs = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("pair")).distinct()
    metadata = pairs.select(
        "pair", F.explode(
            F.array(
                F.struct(F.lit("numerator").alias("role"),
                         F.concat(F.lit("orders of "), "pair").alias("title")),
                F.struct(F.lit("denominator").alias("role"), F.lit("shipments").alias("title")),
            )
        ).alias("m"),
    ).select("pair", "m.*")
    return growth.macro_package(stats, metadata).select(
        "pair", "quarter", "value", "change_1_quarter_pp", "common_quarters", "numerator_title",
        "denominator_title",
    )


GROWTH_SQL = f"""{QUARTER_CTE}, st AS (SELECT series_id, obs_date, value, round(value, 6) AS stored FROM qo),
  g AS (SELECT *, (value / nullif(lag(stored, 1) OVER w, 0) - 1) * 100 AS q,
    (value / nullif(lag(stored, 4) OVER w, 0) - 1) * 100 AS y FROM st
    WINDOW w AS (PARTITION BY series_id ORDER BY obs_date)),
  gr AS (SELECT series_id, obs_date, value, round(q, 6) AS qoq_pct, round(y, 6) AS yoy_pct,
    round(q - lag(round(q, 6)) OVER w, 6) AS qoq_acceleration_pp,
    round(y - lag(round(y, 6)) OVER w, 6) AS yoy_acceleration_pp FROM g
    WINDOW w AS (PARTITION BY series_id ORDER BY obs_date)),
  gd AS (SELECT *, CASE WHEN yoy_acceleration_pp IS NULL THEN 'UNKNOWN' WHEN yoy_acceleration_pp > 0
    THEN 'ACCELERATING' WHEN yoy_acceleration_pp < 0 THEN 'DECELERATING' ELSE 'FLAT' END AS direction FROM gr)"""


@query("growth_acceleration", f"""WITH {GROWTH_SQL} SELECT series_id, CAST(obs_date AS VARCHAR) AS obs_date,
  value, qoq_pct, yoy_pct, qoq_acceleration_pp, yoy_acceleration_pp, direction FROM gd""")
def growth_acceleration(spark, sf):
    return growth.growth_acceleration(quarter_obs(spark, sf).drop("ordinal"))


AGGREGATE_SQL = """ent AS (SELECT o_orderstatus AS g, o_orderpriority AS series_id,
    last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS obs_date,
    CAST(SUM(CAST(o_totalprice AS DECIMAL(28,2))) AS DOUBLE) AS value FROM orders GROUP BY 1, 2, 3),
  en AS (SELECT g, count(DISTINCT series_id) AS n FROM ent GROUP BY 1),
  cd AS (SELECT ent.g, obs_date FROM ent JOIN en ON ent.g = en.g GROUP BY 1, 2, en.n HAVING count(DISTINCT series_id) = en.n),
  al AS (SELECT ent.*, round(value, 6) AS stored FROM ent JOIN cd ON ent.g = cd.g AND ent.obs_date = cd.obs_date),
  e1 AS (SELECT *, (value / nullif(lag(stored, 4) OVER w, 0) - 1) * 100 AS y FROM al
    WINDOW w AS (PARTITION BY g, series_id ORDER BY obs_date)),
  e2 AS (SELECT *, round(y - lag(round(y, 6)) OVER (PARTITION BY g, series_id ORDER BY obs_date), 6) AS acc FROM e1),
  tot AS (SELECT g, obs_date, CAST(SUM(CAST(value AS DECIMAL(38,6))) AS DOUBLE) AS total, count(*) AS n,
    count(acc) AS known, count(*) FILTER (WHERE acc > 0) AS up, count(*) FILTER (WHERE acc < 0) AS down,
    count(*) FILTER (WHERE acc = 0) AS flat FROM e2 GROUP BY 1, 2),
  t1 AS (SELECT *, (total / nullif(lag(round(total, 6), 1) OVER w, 0) - 1) * 100 AS q,
    (total / nullif(lag(round(total, 6), 4) OVER w, 0) - 1) * 100 AS y FROM tot WINDOW w AS (PARTITION BY g ORDER BY obs_date)),
  t2 AS (SELECT *, round(q - lag(round(q, 6)) OVER w, 6) AS qa, round(y - lag(round(y, 6)) OVER w, 6) AS ya
    FROM t1 WINDOW w AS (PARTITION BY g ORDER BY obs_date)),
  t3 AS (SELECT *, CASE WHEN ya IS NULL THEN 'UNKNOWN' WHEN ya > 0 THEN 'ACCELERATING' WHEN ya < 0 THEN
    'DECELERATING' ELSE 'FLAT' END AS direction,
    CASE WHEN ya > 0 THEN up WHEN ya < 0 THEN down WHEN ya = 0 THEN flat ELSE 0 END AS breadth FROM t2)"""


def _aggregate(spark, sf):
    """Groups are order states, entities are priorities."""
    rows = table(spark, sf, "orders").groupBy(
        F.col("o_orderstatus").alias("group_id"), F.col("o_orderpriority").alias("entity"),
        F.last_day(F.add_months(F.date_trunc("quarter", "o_orderdate").cast("date"), 2)).alias("obs_date"),
    ).agg(F.sum(F.col("o_totalprice").cast("decimal(28,2)")).cast("double").alias("value"))
    return growth.sum_then_growth(rows)


@query("sum_then_growth", f"""WITH {AGGREGATE_SQL} SELECT g AS group_id, CAST(obs_date AS VARCHAR) AS obs_date,
  total, n AS entity_total, round(q, 6) AS qoq_pct, round(y, 6) AS yoy_pct, qa AS qoq_acceleration_pp,
  ya AS yoy_acceleration_pp, direction, breadth,
  CASE WHEN direction <> 'UNKNOWN' THEN round(breadth / nullif(known, 0), 6) END AS breadth_ratio FROM t3""")
def sum_then_growth(spark, sf):
    return _aggregate(spark, sf)[0]


@query("growth_package", f"""WITH {AGGREGATE_SQL}, l AS (SELECT g, obs_date, 'total' AS metric, total AS value FROM t3
    UNION ALL SELECT g, obs_date, 'yoy_acceleration_pp', ya FROM t3),
  w AS (SELECT *, round(value - lag(value) OVER (PARTITION BY g, metric ORDER BY obs_date), 6) AS ch,
    row_number() OVER (PARTITION BY g, metric ORDER BY obs_date DESC) AS rn,
    count(*) OVER (PARTITION BY g, metric) AS n FROM l)
  SELECT g AS group_id, CAST(obs_date AS VARCHAR) AS obs_date, metric, value, ch AS change_1_quarter,
  n AS quarter_count FROM w WHERE rn = 1""")
def growth_package(spark, sf):
    return growth.growth_package(_aggregate(spark, sf)[0])


YTD_SQL = """q AS (SELECT o_orderpriority AS entity, year(o_orderdate) AS fy, quarter(o_orderdate) AS fq,
    CAST(SUM(CAST(o_totalprice AS DECIMAL(28,2))) AS DOUBLE) AS v FROM orders GROUP BY 1, 2, 3),
  cum AS (SELECT entity, fy, fq, SUM(v) OVER (PARTITION BY entity, fy ORDER BY fq) AS ytd,
    fq = row_number() OVER (PARTITION BY entity, fy ORDER BY fq) AS whole FROM q)"""


@query("decumulate_ytd", f"""WITH {YTD_SQL} SELECT entity,
  CAST(last_day(make_date(CAST(fy AS BIGINT), CAST(fq * 3 AS BIGINT), 1)) AS VARCHAR) AS obs_date,
  'FY' || CAST(fy AS VARCHAR) || 'Q' || CAST(fq AS VARCHAR) AS fiscal_quarter, round(v, 4) AS value,
  CASE fq WHEN 1 THEN 'Q1_YTD' WHEN 2 THEN 'H1_MINUS_Q1' WHEN 3 THEN '9M_MINUS_H1' ELSE 'FY_MINUS_9M' END AS method,
  CASE WHEN fq = 2 THEN '10-Q/A' WHEN fq = 4 THEN '10-K' ELSE '10-Q' END AS form
  FROM (SELECT q.* FROM q JOIN cum USING (entity, fy, fq) WHERE whole)""")
def decumulate_ytd(spark, sf):
    """Year-to-date facts are built from the orders, each second quarter with an
    earlier, wrong filing that its amendment replaces."""
    o = table(spark, sf, "orders")
    q = o.groupBy(
        F.col("o_orderpriority").alias("entity"), F.year("o_orderdate").alias("fy"),
        F.quarter("o_orderdate").alias("fq"),
    ).agg(F.sum(F.col("o_totalprice").cast("decimal(28,2)")).cast("double").alias("v"))
    w = Window.partitionBy("entity", "fy").orderBy("fq")
    ytd = q.select(
        "*", F.sum("v").over(w).alias("ytd"), (F.row_number().over(w) == F.col("fq")).alias("_whole")
    ).where("_whole")
    end = F.last_day(F.make_date("fy", F.col("fq") * 3, F.lit(1)))
    fact = lambda form, value, days: F.struct(
        form.alias("form"), value.alias("value"), F.date_add(end, days).alias("filed")
    )
    form = F.when(F.col("fq") == 4, "10-K").otherwise("10-Q")
    versions = F.when(
        F.col("fq") == 2,
        F.array(fact(form, F.col("ytd") + 5, 30), fact(F.lit("10-Q/A"), F.col("ytd"), 40)),
    ).otherwise(F.array(fact(form, F.col("ytd"), 30)))
    facts = ytd.select("entity", "fy", "fq", F.explode(versions).alias("f")).select(
        "entity", F.lit("tag").alias("tag"), F.lit(12).alias("fye_month"),
        F.make_date("fy", F.lit(1), F.lit(1)).alias("ctx_start"), end.alias("ctx_end"),
        F.col("f.value").alias("value"), F.col("f.form").alias("form"), F.col("f.filed").alias("filed"),
        F.col("f.filed").cast("timestamp").alias("accepted_at"),
        F.concat_ws("-", "entity", "fy", "fq", "f.form").alias("accession"),
        F.lit(False).alias("metadata_missing"),
    )
    return growth.decumulate_ytd(facts).select(
        "entity", "obs_date", "fiscal_quarter", F.round("value", 4).alias("value"), "method", "form"
    )


@query("level_change_percentile", f"""WITH {ORDERS_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY obs_date DESC) AS k FROM ob WHERE value IS NOT NULL),
  e AS (SELECT series_id, MAX(obs_date) AS d, MAX(CASE WHEN k = 1 THEN value END) AS level, MAX(CASE WHEN k = 6 THEN value END) AS v5, MAX(CASE WHEN k = 21 THEN value END) AS v20 FROM r GROUP BY 1),
  p AS (SELECT r.series_id, count(*) AS n, SUM(CASE WHEN r.value < e.level THEN 1.0 WHEN r.value = e.level THEN 0.5 ELSE 0 END)::DOUBLE AS s FROM r JOIN e ON r.series_id = e.series_id WHERE k <= 756 GROUP BY 1)
  SELECT e.series_id, CAST(d AS VARCHAR) AS obs_date, level, level - v5 AS change_5, level - v20 AS change_20,
  CASE WHEN n >= 252 THEN round(s / n, 6) END AS percentile, n AS sample_size FROM e JOIN p ON e.series_id = p.series_id""")
def level_change_percentile(spark, sf):
    return bands.level_change_percentile(order_obs(spark, sf))
