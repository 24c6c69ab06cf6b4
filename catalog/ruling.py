"""Rule queries: alerts, the three-tier model, freshness, descriptive reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import EVENTS_CTE, ORDERS_CTE, USERS_CTE, event_obs, order_obs, query, table, user_obs
from catalog.aggregating import input_states
from catalog.joining import SCHEDULE_SQL, release_schedule, release_states
from seriesloom.functions import scalars
from seriesloom.functions.tristate import all_known_true, any_known_true
from seriesloom.operators import aggregates, bands, windows
from seriesloom.plans.daily import daily_alert
from seriesloom.plans.records import composite_latest_record
from seriesloom.rules import alerts, evidence, freshness, interpretation as ip, model

# --- alerts ----------------------------------------------------------------

STATS_SQL = """n AS (SELECT *, row_number() OVER w AS rn FROM {src} WINDOW w AS (PARTITION BY series_id ORDER BY obs_date)),
  b AS (SELECT *, MAX(CASE WHEN NOT value > 0 THEN rn END) OVER u AS brk, lag(value, 5) OVER w AS l5, regr_slope(value, rn) OVER f AS s5, count(*) OVER f AS n5,
    lead(obs_date) OVER w AS nxt FROM n WINDOW w AS (PARTITION BY series_id ORDER BY obs_date), u AS (PARTITION BY series_id ORDER BY obs_date ROWS UNBOUNDED PRECEDING),
      f AS (PARTITION BY series_id ORDER BY obs_date ROWS 4 PRECEDING)),
  st AS (SELECT series_id, obs_date, value AS latest, round(value - l5, 4) AS c5, CASE WHEN n5 >= 2 THEN round(s5, 4) END AS s5, rn - coalesce(brk, 0) AS streak FROM b WHERE nxt IS NULL)"""


@query("tiered_alert", f"""WITH {EVENTS_CTE}, {STATS_SQL.format(src='ev')},
  i AS (SELECT MAX(CASE WHEN series_id = 'click' THEN obs_date END) AS d, MAX(CASE WHEN series_id = 'click' THEN latest END) AS latest, MAX(CASE WHEN series_id = 'click' THEN streak END) AS streak,
    count(*) FILTER (WHERE series_id IN ('error', 'purchase', 'view') AND c5 > 0 AND s5 > 0) AS n,
    string_agg(CASE WHEN series_id IN ('error', 'purchase', 'view') AND c5 > 0 AND s5 > 0 THEN series_id END, ',' ORDER BY series_id) AS ids FROM st)
  SELECT CAST(d AS VARCHAR) AS obs_date, latest, streak AS positive_streak, n AS confirmation_count, coalesce(ids, '') AS confirmation_ids,
  latest > 500 OR streak >= 3 AS watch_triggered, n >= 1 AND (latest > 500 OR streak >= 3) AS elevated_triggered, n >= 3 AND (latest > 500 OR streak >= 3) AS stress_triggered,
  CASE WHEN latest > 500 OR streak >= 3 THEN CASE WHEN n >= 3 THEN 'STRESS' WHEN n >= 1 THEN 'ELEVATED' ELSE 'WATCH' END ELSE 'NORMAL' END AS level, 'HIGH' AS confidence FROM i""")
def tiered_alert(spark, sf):
    """Raw events to daily series, features and the alert tier."""
    return daily_alert(
        event_obs(spark, sf), main="click", confirmations=["error", "purchase", "view"], threshold=500.0
    ).select(
        "obs_date", "latest", "positive_streak", "confirmation_count", "confirmation_ids", "watch_triggered",
        "elevated_triggered", "stress_triggered", "level", "confidence",
    )


@query("alert_per_entity", f"""WITH {USERS_CTE}, {STATS_SQL.format(src='us')}, e AS (SELECT series_id, latest, streak, c5, s5, coalesce(c5 > 0 AND s5 > 0, false) AS conf,
    latest > 30 AS flag, coalesce(c5 < 0 AND c5 <= -20, false) AS drp FROM st)
  SELECT series_id, CASE WHEN latest > 40 OR streak >= 12 THEN CASE WHEN conf AND (drp OR latest > 60) THEN 'STRESS' WHEN conf THEN 'ELEVATED' ELSE 'WATCH' END ELSE 'NORMAL' END AS level,
  CASE WHEN flag THEN 'MEDIUM' ELSE 'HIGH' END AS confidence FROM e""")
def alert_per_entity(spark, sf):
    """The same decision for every user series at once."""
    stats = windows.spread_stats(user_obs(spark, sf))
    rows = stats.select(
        "series_id", "latest", "positive_streak", F.col("change_5obs").alias("change5_a"),
        F.col("slope_5obs").alias("slope5_a"), F.when(F.col("latest") > 60, 2).otherwise(0).alias("use_days"),
        F.col("change_5obs").alias("stock_change"), F.lit(-20.0).alias("stock_p10"),
        F.lit(" ok ").alias("input_status"),
        F.when(F.col("latest") > 30, F.array(F.lit("TAX_WINDOW"))).otherwise(F.array().cast("array<string>")).alias("flags"),
    )
    out = alerts.tiered_alert(rows, watch_threshold=40.0, streak_required=12, confirmations=["a"])
    return out.select("series_id", "level", "confidence")


@query("legacy_alert", f"""WITH {USERS_CTE}, c AS (SELECT series_id, obs_date, value - 15 AS value FROM us),
  st AS (SELECT series_id, count(*) FILTER (WHERE value > 0) AS streak FROM c GROUP BY 1),
  r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY obs_date DESC) AS k FROM c),
  l AS (SELECT series_id, MAX(CASE WHEN k = 1 THEN value END) AS v1, MAX(CASE WHEN k = 2 THEN value END) AS v2, bool_and(value > 0) AS allp FROM r WHERE k <= 3 GROUP BY 1),
  p AS (SELECT l.*, st.streak, l.series_id LIKE 'click/%' AS tech, CASE WHEN v1 <> 0 AND allp THEN streak WHEN v1 > 0 THEN 1 ELSE 0 END AS pos FROM l JOIN st ON l.series_id = st.series_id),
  v AS (SELECT *, CASE WHEN v1 > 3 AND coalesce(v2 > 3, false) AND NOT tech THEN 'warning' WHEN v1 > 3 THEN 'watch' WHEN pos >= 3 THEN 'watch' WHEN v1 > 0 THEN 'info' ELSE 'normal' END AS level FROM p)
  SELECT series_id, level, CAST(CASE WHEN level IN ('watch', 'warning') THEN 1 ELSE 0 END + CASE WHEN tech THEN 1 ELSE 0 END AS BIGINT) AS score,
  CASE WHEN tech THEN 'medium' ELSE 'high' END AS confidence, pos AS consecutive_positive FROM v""")
def legacy_alert(spark, sf):
    obs = user_obs(spark, sf).withColumn("value", F.col("value") - 15)
    click = F.col("series_id").startswith("click/")
    context = obs.select("series_id").distinct().select(
        "series_id", click.alias("technical"), click.alias("confirmation"), F.lit(False).alias("stock_drain"),
        F.lit(None).cast("boolean").alias("backstop"),
    )
    return alerts.legacy_alert(obs, context)


# --- three-valued model ----------------------------------------------------

STATUS_SQL = "CASE o_orderstatus WHEN 'F' THEN 'OK' WHEN 'O' THEN 'NOT_RELEASED_YET' ELSE 'STALE' END"


def _metrics(spark, sf):
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "OK").when(
        F.col("o_orderstatus") == "O", "NOT_RELEASED_YET"
    ).otherwise("STALE")
    return o.select(
        F.col("o_orderkey").alias("entity"), F.col("o_orderpriority").alias("metric_id"),
        F.when(F.col("o_totalprice") > 20000, F.col("o_totalprice")).alias("value"),
        status.alias("status"), F.lit("FRESH").alias("freshness"),
    )


def _clauses(spark):
    # A table whose size Spark knows: records meet their clauses without a shuffle by their few metrics.
    return spark.sql("""SELECT * FROM VALUES ('low', '5-LOW', '<', 250000D), ('urgent', '1-URGENT', '>=', 250000D),
      ('urgent_top', '1-URGENT', '>', 400000D), ('high', '2-HIGH', '<=', 100000D) AS t(clause_id, metric_id, operator, threshold)""")


CLAUSE_SQL = """cl AS (SELECT * FROM (VALUES ('low', '5-LOW', '<', 250000.0::DOUBLE), ('urgent', '1-URGENT', '>=', 250000.0), ('urgent_top', '1-URGENT', '>', 400000.0), ('high', '2-HIGH', '<=', 100000.0)) t(clause_id, metric_id, op, thr)),
  mt AS (SELECT o_orderkey AS entity, o_custkey, o_orderpriority AS metric_id, CASE WHEN o_totalprice > 20000 THEN o_totalprice END AS value, o_orderstatus AS s FROM orders),
  ev AS (SELECT mt.*, cl.clause_id, cl.op, cl.thr, CASE WHEN value IS NULL THEN 'MISSING' WHEN s = 'F' THEN 'CURRENT' WHEN s = 'O' THEN 'LAST_GOOD' ELSE 'STALE' END AS es FROM mt JOIN cl ON mt.metric_id = cl.metric_id),
  mm AS (SELECT *, CASE WHEN es IN ('CURRENT', 'LAST_GOOD') THEN CASE op WHEN '<' THEN value < thr WHEN '>=' THEN value >= thr WHEN '>' THEN value > thr ELSE value <= thr END END AS met FROM ev)"""


@query("evaluate_clauses", f"WITH {CLAUSE_SQL} SELECT entity, metric_id, clause_id, op AS operator, thr AS threshold, value, es AS evidence_state, met FROM mm")
def evaluate_clauses(spark, sf):
    return model.evaluate_clauses(_metrics(spark, sf), _clauses(spark), entity=["entity"])


@query("kleene_groups", f"""WITH {CLAUSE_SQL} SELECT o_custkey, CASE WHEN bool_or(NOT met) THEN false WHEN count(*) FILTER (WHERE met IS NULL) > 0 THEN NULL ELSE true END AS all_met,
  CASE WHEN bool_or(met) THEN true WHEN count(*) FILTER (WHERE met IS NULL) > 0 THEN NULL ELSE false END AS any_met FROM mm GROUP BY 1""")
def kleene_groups(spark, sf):
    clauses = model.evaluate_clauses(_metrics(spark, sf), _clauses(spark), entity=["entity"])
    owner = table(spark, sf, "orders").select(F.col("o_orderkey").alias("entity"), "o_custkey")
    return clauses.join(owner, "entity").groupBy("o_custkey").agg(
        all_known_true(F.col("met")).alias("all_met"), any_known_true(F.col("met")).alias("any_met")
    )


@query("k_of_n_days", f"""WITH {USERS_CTE}, d AS (SELECT *, value * 0.5 AS el, CASE WHEN value > 15 THEN value * 0.5 ELSE 0 END AS elig, row_number() OVER (PARTITION BY series_id ORDER BY obs_date DESC) AS rn FROM us)
  SELECT series_id, CAST(MAX(obs_date) AS VARCHAR) AS latest_day, count(*) AS days_available, bool_and(value < 300) AS classification_complete,
  CASE WHEN bool_and(value < 300) THEN count(*) FILTER (WHERE rn <= 3 AND elig > 0) END AS positive_days,
  CASE WHEN bool_and(value < 300) AND count(*) >= 3 THEN count(*) FILTER (WHERE rn <= 3 AND elig > 0) >= 2 END AS k_of_n_met FROM d GROUP BY 1""")
def k_of_n_days(spark, sf):
    eligible = F.when(F.col("value") > 15, F.col("value") * 0.5).otherwise(0.0)
    days = user_obs(spark, sf).select(
        "series_id", "obs_date", F.col("value").alias("accepted"), eligible.alias("eligible"),
        (F.col("value") - eligible).alias("exercise"), F.lit(True).alias("has_exercise"),
        F.lit(False).alias("exercise_only"), (F.col("value") < 300).alias("classified"),
    )
    return model.k_of_n_days(days, by=["series_id"]).drop("violations")


MODEL_SQL = """mi AS (SELECT o_orderkey AS k, CASE WHEN o_totalprice > 30000 THEN o_totalprice / 100000 END AS spread, o_custkey % 7 AS streak,
    CASE WHEN o_custkey % 11 <> 0 THEN 2300 + o_totalprice / 500 END AS stock, o_totalprice / 1000 - 250 AS chg, CASE WHEN o_custkey % 5 <> 0 THEN -150.0::DOUBLE END AS p10,
    900 + o_custkey % 200 AS bal, o_custkey % 4 AS use_days, o_custkey % 13 <> 0 AS complete, o_orderstatus AS s, o_orderpriority AS pr FROM orders),
  me AS (SELECT *, s <> 'P' AS ok, CASE pr WHEN '1-URGENT' THEN true WHEN '2-HIGH' THEN false END AS quiet FROM mi),
  mc AS (SELECT *, CASE WHEN ok THEN streak >= 3 END AS a1, CASE WHEN ok THEN stock < 2900 END AS a2, chg < 0 AS a3, bal >= 950 AS a4, CASE WHEN ok THEN spread > 3 END AS b1,
    CASE WHEN ok THEN stock < 2800 END AS b2, CASE WHEN complete THEN use_days >= 2 END AS b3, CASE WHEN ok THEN stock < 2500 END AS c1, CASE WHEN p10 IS NOT NULL AND ok THEN chg <= p10 END AS c2 FROM me),
  mg AS (SELECT *, CASE WHEN NOT ok THEN NULL ELSE a3 END AS a3k FROM mc),
  mt AS (SELECT *, a1 AND a2 AND a3k AND a4 AS yellow, (b1 AND b2) OR b3 AS red, c1 AND c2 AS cand FROM mg),
  ms AS (SELECT *, CASE WHEN coalesce(cand AND quiet, false) THEN 'EXTREME_CONFIRMED' WHEN coalesce(cand, false) AND quiet IS NULL THEN 'EXTREME_CONTEXT_REQUIRED'
    WHEN cand IS NULL AND coalesce(quiet, true) THEN 'UNAVAILABLE' WHEN coalesce(red, false) THEN 'RED' WHEN red IS NULL THEN 'UNAVAILABLE' WHEN coalesce(yellow, false) THEN 'YELLOW'
    WHEN yellow IS NULL THEN 'UNAVAILABLE' ELSE 'GREEN' END AS status FROM mt)"""


@query("tri_state_model", f"""WITH {MODEL_SQL}, md AS (SELECT *, CASE WHEN status = 'UNAVAILABLE' THEN 'UNAVAILABLE'
    WHEN NOT ok OR spread IS NULL OR stock IS NULL OR p10 IS NULL OR NOT complete THEN 'PARTIAL' WHEN s = 'O' THEN 'LAST_GOOD' ELSE 'CURRENT' END AS ds FROM ms),
  mf AS (SELECT *, CASE WHEN status = 'UNAVAILABLE' THEN 'UNKNOWN' WHEN ds = 'CURRENT' AND status <> 'EXTREME_CONTEXT_REQUIRED' THEN 'HIGH' ELSE 'MEDIUM' END AS c0 FROM md)
  SELECT k AS entity, yellow, red, cand AS extreme_candidate, cand AND quiet AS extreme, status, ds AS data_status,
  CASE WHEN pr = '3-MEDIUM' THEN CASE c0 WHEN 'HIGH' THEN 'MEDIUM' WHEN 'MEDIUM' THEN 'LOW' ELSE c0 END ELSE c0 END AS confidence,
  concat_ws(',', CASE WHEN a4 IS NULL THEN 'balance_near_target' END, CASE WHEN a1 IS NULL THEN 'positive_streak' END, CASE WHEN c2 IS NULL THEN 'rapid_decline' END,
    CASE WHEN b1 IS NULL THEN 'spread_above' END, CASE WHEN a2 IS NULL THEN 'stock_below_low' END, CASE WHEN a3k IS NULL THEN 'stock_change_negative' END,
    CASE WHEN b3 IS NULL THEN 'use_days' END) AS unknown_ids FROM mf""")
def tri_state_model(spark, sf):
    o = table(spark, sf, "orders")
    cust, price = F.col("o_custkey"), F.col("o_totalprice")
    status = F.when(F.col("o_orderstatus") == "F", "OK").when(
        F.col("o_orderstatus") == "O", "NOT_RELEASED_YET"
    ).otherwise("STALE")
    pr = F.col("o_orderpriority")
    rows = o.select(
        F.col("o_orderkey").alias("entity"), F.when(price > 30000, price / 100000).alias("spread"),
        (cust % 7).alias("streak"), F.when(cust % 11 != 0, price / 500 + 2300).alias("stock"),
        (price / 1000 - 250).alias("stock_change"), F.when(cust % 5 != 0, -150.0).alias("stock_p10"),
        (cust % 200 + 900).alias("balance"), (cust % 4).alias("use_days"), (cust % 13 != 0).alias("use_complete"),
        *[status.alias(f"{m}_status") for m in ("spread", "stock")],
        *[F.lit("OK").alias(f"{m}_status") for m in ("balance", "use")],
        *[F.lit("FRESH").alias(f"{m}_freshness") for m in ("spread", "stock", "balance", "use")],
        F.when(pr == "1-URGENT", "NO_MAJOR_CRISIS").when(pr == "2-HIGH", "MAJOR_CRISIS_PRESENT")
        .otherwise("UNKNOWN").alias("context"),
        F.when(pr == "3-MEDIUM", F.array(F.lit("X"))).otherwise(F.array().cast("array<string>")).alias("flags"),
    )
    return model.tri_state_model(rows).select(
        "entity", "yellow", "red", "extreme_candidate", "extreme", "status", "data_status", "confidence",
        "unknown_ids",
    )


# --- freshness -------------------------------------------------------------


def _dated(spark, sf):
    o = table(spark, sf, "orders")
    f = F.col("o_orderpriority")
    return o.select(
        F.col("o_orderkey").alias("series_id"), F.to_date("o_orderdate").alias("obs_date"),
        F.when(f == "1-URGENT", "weekly").when(f == "2-HIGH", "policy_event").when(f == "3-MEDIUM", "quarterly")
        .otherwise("daily").alias("frequency"),
    )


DATED_SQL = """dt AS (SELECT o_orderkey AS series_id, CAST(o_orderdate AS DATE) AS d, CASE o_orderpriority WHEN '1-URGENT' THEN 'weekly' WHEN '2-HIGH' THEN 'policy_event'
    WHEN '3-MEDIUM' THEN 'quarterly' ELSE 'daily' END AS f FROM orders), lg AS (SELECT *, date_diff('day', d, DATE '2001-07-20') AS lag FROM dt),
  fr AS (SELECT *, CASE WHEN lag < 0 THEN 'UNKNOWN,ERROR' WHEN f = 'weekly' THEN CASE WHEN lag <= 10 THEN 'FRESH,OK' WHEN lag <= 17 THEN 'LATE,OK' ELSE 'STALE,STALE' END
    WHEN f = 'policy_event' THEN CASE WHEN lag <= 45 THEN 'FRESH,OK' ELSE 'LATE,OK' END
    WHEN f = 'daily' THEN CASE WHEN lag <= 3 THEN 'FRESH,OK' WHEN lag <= 7 THEN 'LATE,OK' ELSE 'STALE,STALE' END ELSE 'UNKNOWN,OK' END AS st,
    CASE WHEN lag < 0 THEN 'UNKNOWN,ERROR' WHEN lag <= 10 THEN 'FRESH,OK' WHEN lag <= 17 THEN 'LATE,OK' ELSE 'STALE,STALE' END AS wk FROM lg)"""


def _text(state):
    return F.concat_ws(",", state["freshness"], state["health"])


@query("freshness", f"""WITH {DATED_SQL} SELECT series_id, st AS by_frequency,
  CASE WHEN wk NOT LIKE '%,STALE' AND d < DATE '2001-07-18' THEN 'LATE,NOT_RELEASED_YET' ELSE wk END AS by_cycle,
  CASE WHEN d > DATE '2001-07-20' THEN 'UNKNOWN,ERROR' WHEN (2001 * 4 + 2) - (year(d) * 4 + quarter(d) - 1) <= 2 THEN 'FRESH,OK'
    WHEN (2001 * 4 + 2) - (year(d) * 4 + quarter(d) - 1) = 3 THEN 'LATE,OK' ELSE 'STALE,STALE' END AS by_quarter,
  CASE WHEN lag < 0 THEN 'UNKNOWN,ERROR' WHEN lag > 120 THEN 'STALE,STALE' ELSE 'FRESH,OK' END AS by_age FROM fr""")
def freshness_query(spark, sf):
    today = "2001-07-20"
    return _dated(spark, sf).select(
        "series_id",
        _text(freshness.freshness_by_frequency("obs_date", "frequency", today)).alias("by_frequency"),
        _text(freshness.release_cycle_freshness("obs_date", today)).alias("by_cycle"),
        _text(freshness.quarter_lag_freshness("obs_date", today)).alias("by_quarter"),
        _text(freshness.record_age_state("obs_date", today)).alias("by_age"),
    )


@query("schedule_freshness", f"""WITH {SCHEDULE_SQL}, lg AS (SELECT *, date_diff('day', d, DATE '2001-07-20') AS lag FROM nx)
  SELECT state_id, CASE WHEN lag < 0 THEN 'UNKNOWN,ERROR' WHEN lag > 17 THEN 'STALE,STALE'
    WHEN TIMESTAMP '2001-07-20 23:00:00' > timezone('UTC', timezone('America/New_York', CAST(slot[1] AS TIMESTAMP) + INTERVAL '17 hours 30 minutes')) AND d < slot[2] THEN 'LATE,NOT_RELEASED_YET'
    WHEN lag <= 10 THEN 'FRESH,OK' ELSE 'LATE,OK' END AS state FROM lg""")
def schedule_freshness(spark, sf):
    out = freshness.schedule_freshness(
        release_states(spark, sf), release_schedule(spark, sf), now="2001-07-20 23:00:00"
    )
    return out.select("state_id", F.concat_ws(",", "freshness", "health").alias("state"))


@query("expected_next_update", f"""WITH {DATED_SQL} SELECT series_id, CAST(CASE WHEN f = 'weekly' THEN d + CAST((CASE WHEN isodow(d) < 4 THEN 4 - isodow(d) ELSE 11 - isodow(d) END) AS INTEGER)
  WHEN f = 'daily' THEN d + CAST((CASE isodow(d) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END) AS INTEGER) END AS VARCHAR) AS next_update FROM dt""")
def expected_next_update(spark, sf):
    return _dated(spark, sf).select(
        "series_id", scalars.expected_next_update("obs_date", "frequency").alias("next_update")
    )


@query("last_good_state", f"""WITH {DATED_SQL}, a AS (SELECT fr.*, CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'FAILURE' ELSE 'SKIPPED' END AS oc, o_custkey % 3 <> 0 AS has FROM fr JOIN orders ON o_orderkey = series_id),
  b AS (SELECT *, CASE oc WHEN 'SUCCESS' THEN d ELSE CASE WHEN has THEN d - 2 END END AS day,
    CASE WHEN has THEN lag + 2 END AS plag FROM a)
  SELECT series_id, oc AS outcome, CAST(day AS VARCHAR) AS obs_date,
  CASE oc WHEN 'SUCCESS' THEN split_part(st, ',', 2) WHEN 'FAILURE' THEN CASE WHEN has THEN 'STALE' ELSE 'ERROR' END ELSE
    CASE WHEN plag IS NULL OR plag < 0 THEN 'ERROR' WHEN f = 'weekly' AND plag > 17 OR f = 'daily' AND plag > 7 THEN 'STALE' ELSE 'NOT_RELEASED_YET' END END AS health,
  CASE WHEN oc = 'FAILURE' THEN 'boom' WHEN oc = 'SKIPPED' AND NOT has THEN 'NO_LAST_GOOD' END AS failure_reason FROM b""")
def last_good_state(spark, sf):
    o = table(spark, sf, "orders")
    dated = _dated(spark, sf)
    outcome = F.when(F.col("o_orderstatus") == "F", "SUCCESS").when(
        F.col("o_orderstatus") == "O", "FAILURE"
    ).otherwise("SKIPPED")
    stamp = F.lit("2001-07-20").cast("timestamp")
    attempts = dated.join(
        o.select(F.col("o_orderkey").alias("series_id"), outcome.alias("outcome")), "series_id"
    ).select("*", stamp.alias("attempted_at"), stamp.alias("released_at"), F.lit("boom").alias("reason"))
    none = F.lit(None)
    prior = o.where(F.col("o_custkey") % 3 != 0).select(
        F.col("o_orderkey").alias("series_id"), F.date_sub(F.to_date("o_orderdate"), 2).alias("obs_date"),
        F.lit("NOT_RELEASED_YET").alias("health"), F.lit("FRESH").alias("freshness"),
        stamp.alias("last_success_at"), stamp.alias("last_attempt_at"), stamp.alias("released_at"),
        stamp.alias("updated_at"), none.cast("string").alias("failure_reason"),
    )
    return freshness.last_good_state(attempts, prior, today="2001-07-20").select(
        "series_id", "outcome", "obs_date", "health", "failure_reason"
    )


# --- descriptive reads -----------------------------------------------------

# One ladder per event type, here with the same zones.
TYPES = ("click", "error", "purchase", "signup", "view")
ZONES = [(0, "DORMANT", None, 20.0), (1, "ORDINARY", 20.0, 60.0), (2, "ELEVATED", 60.0, None)]


def _levels(spark, sf):
    return windows.latest_per_series(user_obs(spark, sf)).withColumn(
        "ladder_id", F.split("series_id", "/")[0]
    )


@query("regime_ladder", f"""WITH {USERS_CTE}, l AS (SELECT series_id, arg_max(value, obs_date) AS value FROM us GROUP BY 1),
  z AS (SELECT * FROM (VALUES (0, 'DORMANT', NULL::DOUBLE, 20.0::DOUBLE), (1, 'ORDINARY', 20.0, 60.0), (2, 'ELEVATED', 60.0, NULL)) t(zone_no, label, lower, upper))
  SELECT series_id, value, CAST(zone_no AS BIGINT) AS zone_no, label, (lower IS NULL OR value >= lower) AND (upper IS NULL OR value < upper) AS active FROM l, z""")
def regime_ladder(spark, sf):
    zones = spark.createDataFrame(
        [(t, *z, "NORMAL", "SOURCE_RULE") for t in TYPES for z in ZONES],
        "ladder_id string, zone_no int, label string, lower double, upper double, severity string, basis string",
    )
    return ip.regime_ladder(_levels(spark, sf), zones).select("series_id", "value", "zone_no", "label", "active")


@query("next_boundary", f"""WITH {USERS_CTE}, l AS (SELECT series_id, arg_max(value, obs_date) AS value FROM us GROUP BY 1)
  SELECT series_id, value, CASE WHEN value < 20 THEN 'ORDINARY' WHEN value < 60 THEN 'ELEVATED' END AS label, CASE WHEN value < 20 THEN 20.0::DOUBLE ELSE 60.0 END AS threshold,
  round(CASE WHEN value < 20 THEN 20 - value ELSE 60 - value END, 6) AS distance FROM l WHERE value < 60""")
def next_boundary(spark, sf):
    lines = spark.createDataFrame(
        [(t, *line) for t in TYPES for line in (("ORDINARY", 20.0, "above"), ("ELEVATED", 60.0, "above"))],
        "ladder_id string, label string, threshold double, side string",
    )
    return ip.next_boundary(_levels(spark, sf), lines).select("series_id", "value", "label", "threshold", "distance")


@query("confirmation_states", f"""WITH {ORDERS_CTE}, n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY obs_date DESC) AS rn FROM ob),
  e AS (SELECT * FROM n WHERE rn = 1), b AS (SELECT e.series_id, e.value AS cur, quantile_disc(n.value, 0.8) AS q80, quantile_disc(n.value, 0.95) AS q95
    FROM e JOIN n ON n.series_id = e.series_id AND n.rn > 1 GROUP BY 1, 2), s AS (SELECT series_id, regr_slope(value, -rn) AS sl FROM n WHERE rn <= 5 GROUP BY 1)
  SELECT b.series_id, CASE WHEN cur >= q95 THEN 'EXTREME' WHEN cur >= q80 THEN 'ELEVATED' ELSE 'ORDINARY' END AS state, cur >= q80 AND round(sl, 6) > 0 AS confirming
  FROM b JOIN s ON b.series_id = s.series_id""")
def confirmation_states(spark, sf):
    return ip.confirmation_states(order_obs(spark, sf)).select("series_id", "state", "confirming")


@query("breadth_counter", f"""WITH {USERS_CTE}, n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY obs_date DESC) AS rn FROM us),
  e AS (SELECT * FROM n WHERE rn = 1), b AS (SELECT e.series_id, e.value AS cur, count(n.value) AS k, quantile_disc(n.value, 0.8) AS q80
    FROM e LEFT JOIN n ON n.series_id = e.series_id AND n.rn > 1 GROUP BY 1, 2), s AS (SELECT series_id, CASE WHEN count(*) = 5 THEN round(regr_slope(value, -rn), 6) END AS sl FROM n WHERE rn <= 5 GROUP BY 1),
  c AS (SELECT split_part(b.series_id, '/', 2) AS u, CASE WHEN k >= 3 AND sl IS NOT NULL THEN cur >= q80 AND sl > 0 END AS cf FROM b JOIN s ON b.series_id = s.series_id)
  SELECT u AS user_id, CASE WHEN count(cf) = count(*) AND count(*) = 5 THEN count(*) FILTER (WHERE cf) END AS confirming_count, count(*) AS members FROM c GROUP BY 1""")
def breadth_counter(spark, sf):
    states = ip.confirmation_states(user_obs(spark, sf), minimum=3).withColumn(
        "user_id", F.split("series_id", "/")[1]
    )
    return ip.breadth_counter(states, by=["user_id"], members=5).select(
        "user_id", "confirming_count", "members"
    )


FLOW_SQL = f"""{ORDERS_CTE}, fl AS (SELECT series_id, obs_date, value - lag(value, 5) OVER w AS c5, value - lag(value, 20) OVER w AS c20, row_number() OVER (PARTITION BY series_id ORDER BY obs_date DESC) AS rn FROM ob
    WINDOW w AS (PARTITION BY series_id ORDER BY obs_date)),
  fe AS (SELECT * FROM fl WHERE rn = 1), fb AS (SELECT fe.series_id, fe.c5, fe.c20, quantile_disc(fl.c5, 0.75) AS a1, quantile_disc(fl.c5, 0.9) AS a2, quantile_disc(fl.c20, 0.75) AS b1, quantile_disc(fl.c20, 0.9) AS b2
    FROM fe JOIN fl ON fl.series_id = fe.series_id AND fl.rn > 1 GROUP BY 1, 2, 3),
  fs AS (SELECT series_id, CASE WHEN c5 <= 0 THEN 1 WHEN c5 >= a2 THEN 5 WHEN c5 >= a1 THEN 4 ELSE 3 END AS s, CASE WHEN c20 <= 0 THEN 1 WHEN c20 >= b2 THEN 5 WHEN c20 >= b1 THEN 4 ELSE 3 END AS l FROM fb)"""
FLOW_NAMES = "CASE {x} WHEN 1 THEN 'LIQUIDITY_RELEASE' WHEN 3 THEN 'MILD_DRAIN' WHEN 4 THEN 'NOTABLE_DRAIN' ELSE 'LARGE_DRAIN' END"


@query("flow_states", f"""WITH {FLOW_SQL} SELECT series_id, {FLOW_NAMES.format(x='s')} AS short_state, {FLOW_NAMES.format(x='l')} AS long_state,
  {FLOW_NAMES.format(x='greatest(s, l)')} AS flow_state FROM fs""")
def flow_states(spark, sf):
    return ip.flow_states(order_obs(spark, sf)).select(
        "series_id", "short_state", "long_state", "flow_state"
    )


@query("impulse_states", f"""WITH {ORDERS_CTE}, c AS (SELECT series_id, value - lag(value, 4) OVER (PARTITION BY series_id ORDER BY obs_date) AS ch, row_number() OVER (PARTITION BY series_id ORDER BY obs_date DESC) AS rn FROM ob),
  e AS (SELECT * FROM c WHERE rn = 1) SELECT e.series_id, CASE WHEN round(e.ch, 6) < round(quantile_disc(c.ch, 0.25), 6) THEN 'CONTRACTING' WHEN round(e.ch, 6) > round(quantile_disc(c.ch, 0.75), 6) THEN 'EXPANDING' ELSE 'BROADLY_FLAT' END AS state
  FROM e JOIN c ON c.series_id = e.series_id AND c.rn > 1 GROUP BY e.series_id, e.ch""")
def impulse_states(spark, sf):
    return ip.impulse_states(order_obs(spark, sf)).select("series_id", "state")


@query("buffer_states", f"""WITH {USERS_CTE}, n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY obs_date DESC) AS rn FROM us),
  e AS (SELECT series_id, MAX(CASE WHEN rn = 1 THEN value END) AS cur, count(*) FILTER (WHERE rn BETWEEN 2 AND 21) AS k, quantile_disc(value, 0.1) FILTER (WHERE rn BETWEEN 2 AND 21) AS q,
    CASE WHEN count(*) >= 2 THEN round(regr_slope(value, -rn) FILTER (WHERE rn <= 6), 6) END AS sl FROM n GROUP BY 1)
  SELECT series_id, CASE WHEN cur = 0 THEN 'AT_FLOOR' WHEN k < 20 THEN 'INSUFFICIENT_HISTORY' WHEN cur <= q THEN 'NEAR_FLOOR' WHEN sl < 0 THEN 'DEPLETING_BUFFER' ELSE 'AVAILABLE_BUFFER' END AS state FROM e""")
def buffer_states(spark, sf):
    falling = F.when(F.col("slope") < 0, "FALLING").otherwise("RISING")
    return ip.buffer_states(user_obs(spark, sf), falling).select("series_id", "state")


def metric_records(spark, sf):
    """A published record per priority: value, changes, class, status."""
    obs = order_obs(spark, sf).withColumn("frequency", F.lit("weekly"))
    classes = {"1-URGENT": "spread", "2-HIGH": "stock", "3-MEDIUM": "fiscal_balance",
               "4-NOT SPECIFIED": "absolute_rate", "5-LOW": "buffer"}
    table_ = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair])
    ch = windows.changes_by_frequency(obs)
    return ch.select(
        F.col("series_id").alias("metric_id"), table_[F.col("series_id")].alias("metric_class"),
        F.col("latest").alias("value"), F.lit("OK").alias("status"), F.lit("FRESH").alias("freshness"),
        F.lit("ONE_OBSERVATION").alias("direction_window"), "one_observation", "five_observations", "four_weeks",
        F.lit(3).cast("bigint").alias("streak"), F.lit(2700.0).alias("stock_value"),
        F.col("four_weeks").alias("change_4w"), F.lit(-1000.0).alias("p10"),
        F.lit("MILD_DRAIN").alias("flow_state"), F.array(F.lit("TAX_WINDOW")).alias("flags"),
    )


def metric_reads(spark, sf):
    rec = metric_records(spark, sf)
    of = lambda *names: rec.where(F.col("metric_id").isin(*names))
    return [
        ip.spread_ladder_read(of("1-URGENT")), ip.stock_ladder_read(of("2-HIGH")),
        ip.balance_ladder_read(of("3-MEDIUM")), ip.context_only_read(of("4-NOT SPECIFIED", "5-LOW")),
    ]


def metric_routing(spark, sf):
    ids = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("metric_id")).distinct()
    family = {"1-URGENT": "spread_ladder", "2-HIGH": "stock_ladder", "3-MEDIUM": "balance_ladder",
              "4-NOT SPECIFIED": "context_only", "5-LOW": "buffer"}
    table_ = F.create_map(*[F.lit(x) for pair in family.items() for x in pair])
    return ids.withColumn("family", table_[F.col("metric_id")])


READ_SQL = f"""{ORDERS_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY obs_date DESC) AS rn FROM ob),
  m AS (SELECT series_id AS metric_id, MAX(CASE WHEN rn = 1 THEN value END) AS v, round(MAX(CASE WHEN rn = 1 THEN value END) - MAX(CASE WHEN rn = 2 THEN value END), 6) AS c1,
    round(MAX(CASE WHEN rn = 1 THEN value END) - MAX(CASE WHEN rn = 5 THEN value END), 6) AS c4 FROM r WHERE rn <= 5 GROUP BY 1),
  d AS (SELECT *, CASE WHEN c1 > 0 THEN 'RISING' WHEN c1 < 0 THEN 'FALLING' ELSE 'FLAT' END AS direction FROM m)"""


@query("interpretation_router", f"""WITH {READ_SQL}
  SELECT metric_id, CASE metric_id WHEN '1-URGENT' THEN 'spread_ladder' WHEN '2-HIGH' THEN 'stock_ladder' WHEN '3-MEDIUM' THEN 'balance_ladder' ELSE 'context_only' END AS family,
  CASE metric_id WHEN '1-URGENT' THEN 'FULL_RED_ROUTE_A' WHEN '2-HIGH' THEN 'ABOVE_YELLOW_ZONE|' || CASE WHEN c4 > 0 THEN 'REPLENISHING' WHEN c4 <= -1000 THEN 'RAPID_DRAIN' ELSE 'ORDINARY_DRAIN' END
    WHEN '3-MEDIUM' THEN 'ABOVE_TARGET|MILD_DRAIN_TECHNICAL_DRAIN' ELSE 'NO_STANDALONE_RISK_BAND' END AS state,
  CASE metric_id WHEN '1-URGENT' THEN 'RED' WHEN '2-HIGH' THEN 'NORMAL' ELSE 'CONTEXT_ONLY' END AS severity, direction,
  CASE metric_id WHEN '4-NOT SPECIFIED' THEN 'AMBIGUOUS' WHEN '2-HIGH' THEN CASE direction WHEN 'RISING' THEN 'EASING' ELSE 'TIGHTENING' END ELSE CASE direction WHEN 'RISING' THEN 'TIGHTENING' ELSE 'EASING' END END AS impact,
  CASE metric_id WHEN '2-HIGH' THEN 'YELLOW_ZONE' END AS boundary_label, CASE metric_id WHEN '2-HIGH' THEN round(v - 2900, 6) END AS boundary_distance FROM d WHERE metric_id <> '5-LOW'""")
def interpretation_router(spark, sf):
    good, _ = ip.interpretation_router(metric_reads(spark, sf), metric_routing(spark, sf))
    return good.select(
        "metric_id", "family", "state", "severity", "direction", "impact", "boundary_label",
        "boundary_distance",
    )


@query("interpretation_mismatch", """SELECT 'FAMILY_MISMATCH' AS check_id, o_orderpriority AS key, 'buffer' AS detail FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 2""")
def interpretation_mismatch(spark, sf):
    return ip.interpretation_router(metric_reads(spark, sf), metric_routing(spark, sf))[1]


@query("rule_bases", """SELECT f.family, CASE f.family WHEN 'spread_ladder' THEN 'OPERATIONALIZATION,SOURCE_RULE,STATISTICAL_BAND' WHEN 'stock_ladder' THEN 'OPERATIONALIZATION,SOURCE_RULE,STATISTICAL_BAND'
  WHEN 'balance_ladder' THEN 'CONTEXT_ONLY,OPERATIONALIZATION,SOURCE_RULE,STATISTICAL_BAND' ELSE 'CONTEXT_ONLY' END AS rule_basis FROM
  (SELECT DISTINCT CASE o_orderpriority WHEN '1-URGENT' THEN 'spread_ladder' WHEN '2-HIGH' THEN 'stock_ladder' WHEN '3-MEDIUM' THEN 'balance_ladder' ELSE 'context_only' END AS family FROM orders) f""")
def rule_bases(spark, sf):
    reads = metric_reads(spark, sf)
    union = reads[0]
    for r in reads[1:]:
        union = union.unionByName(r)
    return ip.distinct_bases(union, by=["family"])


@query("direction_by_frequency", f"""WITH {ORDERS_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY obs_date DESC) AS rn FROM ob)
  SELECT series_id, '1W' AS label, round(MAX(CASE WHEN rn = 1 THEN value END) - MAX(CASE WHEN rn = 2 THEN value END), 6) AS change FROM r WHERE rn <= 2 GROUP BY 1""")
def direction_by_frequency(spark, sf):
    obs = order_obs(spark, sf).withColumn("frequency", F.lit("weekly"))
    rows = windows.changes_by_frequency(obs).withColumn("_d", ip.direction_by_frequency("frequency"))
    return rows.select("series_id", F.col("_d.label").alias("label"), F.col("_d.value").alias("change"))


# --- evidence --------------------------------------------------------------


@query("liquidity_blocks", """WITH b AS (SELECT o_orderkey AS k, o_totalprice / 100000 AS latest, o_custkey % 5 AS streak, o_custkey % 4 AS n, o_custkey % 3 AS u, o_orderstatus = 'F' AS ok FROM orders)
  SELECT k AS entity, 'funding_price' AS block_id, ok AS available, CASE WHEN ok THEN latest > 3 OR streak >= 3 END AS triggered, CASE WHEN NOT ok THEN 'UNAVAILABLE' WHEN latest > 3 OR streak >= 3 THEN 'WATCH' ELSE 'NORMAL' END AS status FROM b
  UNION ALL SELECT k, 'funding_confirmations', true, n > 0, CAST(n AS VARCHAR) || '/3 UP' FROM b
  UNION ALL SELECT k, 'backstop', true, u >= 2, CAST(u AS VARCHAR) || '/3 POSITIVE' FROM b
  UNION ALL SELECT k, 'stock_quantity', ok, CASE WHEN ok THEN u = 1 END, CASE WHEN NOT ok THEN 'UNAVAILABLE' WHEN u = 1 THEN 'P10 BREACH' ELSE 'NO P10 BREACH' END FROM b""")
def liquidity_blocks(spark, sf):
    o = table(spark, sf, "orders")
    cust, ok = F.col("o_custkey"), F.col("o_orderstatus") == "F"
    rows = o.select(
        F.col("o_orderkey").alias("entity"), (F.col("o_totalprice") / 100000).alias("latest"),
        (cust % 5).alias("positive_streak"), (cust % 4).alias("confirmation_count"), (cust % 3).alias("use_days"),
        (cust % 3 == 1).alias("stock_stress"), F.lit("HIGH").alias("confidence"),
        F.lit(3.0).alias("watch_threshold"), F.lit(3).alias("streak_required"), ok.alias("price_ok"),
        F.lit(True).alias("confirmations_ok"), F.lit(True).alias("use_ok"), ok.alias("stock_ok"),
    )
    return evidence.liquidity_blocks(rows, keep=["entity"]).select(
        "entity", "block_id", "available", "triggered", "status"
    )


@query("evidence_switches", """WITH p AS (SELECT o_custkey AS e, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN MIN(o_orderstatus) ELSE 'MIXED' END AS d FROM orders GROUP BY 1)
  SELECT e AS entity, 'positioning' AS switch_id, CAST(1 AS BIGINT) AS available_blocks, CAST(4 AS BIGINT) AS total_blocks, 'LOW' AS confidence FROM p
  UNION ALL SELECT e, 'fundamental', CASE WHEN d = 'MIXED' THEN 3 ELSE 1 END, 4, CASE WHEN d = 'MIXED' THEN 'MEDIUM' ELSE 'LOW' END FROM p
  UNION ALL SELECT e, 'liquidity', 0, 4, 'UNKNOWN' FROM p""")
def evidence_switches(spark, sf):
    per = aggregates.consensus_direction(
        table(spark, sf, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderstatus").alias("direction")),
        by=["entity"],
    )
    mixed = F.col("direction") == "MIXED"
    inputs = per.select(
        "entity", F.lit(True).alias("positions_ok"), F.col("direction").alias("positions_direction"),
        mixed.alias("automated_ok"), F.col("direction").alias("aggregate_direction"),
        F.col("direction").alias("entity_direction"), F.lit(True).alias("orders_active"),
        F.lit(True).alias("orders_healthy"), F.lit("UP").alias("orders_direction"),
        F.lit(True).alias("commitments_active"), F.lit(False).alias("commitments_healthy"),
        F.lit("UP").alias("commitments_direction"),
    )
    blocks = (
        evidence.positioning_blocks(inputs, keep=["entity"])
        .unionByName(evidence.fundamental_blocks(inputs, keep=["entity"]))
        .unionByName(evidence.default_blocks(inputs, "liquidity", keep=["entity"]))
    )
    return aggregates.block_rollup(blocks, by=["entity", "switch_id"])


@query("composite_latest_record", f"""WITH {ORDERS_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY obs_date DESC) AS rn,
    first_value(value) OVER (PARTITION BY series_id ORDER BY obs_date DESC) AS latest, count(*) OVER (PARTITION BY series_id) AS n FROM ob),
  a AS (SELECT series_id, MAX(obs_date) AS d, MAX(latest) AS v, MAX(n) AS n, round(MAX(latest) - MAX(CASE WHEN rn = 2 THEN value END), 6) AS c1,
    round((count(*) FILTER (WHERE value < latest) + 0.5 * count(*) FILTER (WHERE value = latest)) / count(*), 6) AS pr FROM r WHERE rn <= 20 GROUP BY 1)
  SELECT series_id, CASE WHEN series_id <> '5-LOW' THEN v END AS value, CASE WHEN series_id <> '5-LOW' THEN CAST(d AS VARCHAR) END AS obs_date,
  CASE WHEN series_id <> '5-LOW' THEN c1 END AS one_observation, CASE WHEN series_id <> '5-LOW' THEN n END AS sample_size, CASE WHEN series_id <> '5-LOW' THEN pr END AS tail_percentile,
  CASE WHEN series_id <> '5-LOW' THEN 'OK' ELSE 'NOT_APPLICABLE' END AS status, CASE WHEN series_id <> '5-LOW' THEN 'HIGH' ELSE 'UNKNOWN' END AS confidence,
  CASE WHEN series_id <> '5-LOW' THEN CAST(22 AS BIGINT) END AS tail_points FROM a""")
def composite_latest_record_query(spark, sf):
    obs = order_obs(spark, sf)
    ids = obs.select("series_id").distinct()
    registry = ids.select(
        "series_id", F.col("series_id").alias("label"), F.lit("USD").alias("unit"), F.lit("daily").alias("frequency"),
        F.when(F.col("series_id") == "5-LOW", "UNAVAILABLE_FREE").otherwise("ACTIVE_FREE").alias("availability"),
        F.lit(False).alias("is_proxy"), F.lit("src").alias("source_id"), F.array(F.lit("B"), F.lit("A")).alias("flags"),
    )
    stamp = F.lit("2001-08-02").cast("timestamp")
    states = ids.select(
        "series_id", F.lit("OK").alias("health"), F.lit("FRESH").alias("freshness"),
        *[stamp.alias(c) for c in ("last_success_at", "last_attempt_at", "released_at", "updated_at")],
        F.lit(None).cast("string").alias("failure_reason"),
    )
    return composite_latest_record(obs, registry, states).select(
        "series_id", "value", "obs_date", F.col("changes.one_observation").alias("one_observation"),
        F.col("statistics.sample_size").alias("sample_size"),
        F.col("statistics.tail_percentile").alias("tail_percentile"), F.col("quality.status").alias("status"),
        F.col("context.confidence").alias("confidence"), F.size("tail").alias("tail_points"),
    )


@query("settlement_flags", f"""WITH {ORDERS_CTE}, h AS (SELECT a.series_id, a.obs_date, a.value, count(b.value) AS n, quantile_cont(b.value, 0.9) AS q FROM ob a LEFT JOIN ob b
    ON a.series_id = b.series_id AND b.obs_date < a.obs_date AND b.obs_date >= a.obs_date - INTERVAL 3 YEAR AND b.value > 0 GROUP BY 1, 2, 3)
  SELECT series_id, CAST(obs_date AS VARCHAR) AS obs_date, concat_ws(',', CASE WHEN value > 0 THEN 'TREASURY_SETTLEMENT' END, CASE WHEN n >= 60 AND value >= q THEN 'LARGE_TREASURY_SETTLEMENT' END) AS flags FROM h""")
def settlement_flags(spark, sf):
    daily = bands.calendar_year_percentile(order_obs(spark, sf))
    return daily.select("series_id", "obs_date", bands.settlement_flags().alias("flags"))


@query("state_ranks", """SELECT DISTINCT o_orderstatus AS s, CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS BIGINT) AS rank FROM orders""")
def state_ranks(spark, sf):
    rows = input_states(spark, sf).select(
        "health", aggregates.rank_of("health", aggregates.HEALTH_RANK).alias("rank")
    ).distinct()
    back = F.when(F.col("health") == "OK", "F").when(F.col("health") == "NOT_RELEASED_YET", "O").otherwise("P")
    return rows.select(back.alias("s"), "rank")
