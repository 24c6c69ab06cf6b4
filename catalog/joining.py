"""As-of, calendar and agreement join queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from catalog.common import (
    EVENTS_CTE, ORDERS_CTE, QUARTER_CTE, SHIP_CTE, USERS_CTE,
    event_obs, order_obs, quarter_obs, query, ship_obs, table, user_obs,
)
from catalog.sources import TYPED_SQL, typed_reviewed
from seriesloom.operators import aggregates, bands, joins

ASOF_SQL = f"""WITH {USERS_CTE}, big AS (SELECT series_id, obs_date, value AS rate FROM us WHERE value > 20)
  SELECT us.series_id, CAST(us.obs_date AS VARCHAR) AS obs_date, us.value,
  CAST(big.obs_date AS VARCHAR) AS right_obs_date, big.rate
  FROM us ASOF JOIN big ON us.series_id = big.series_id AND us.obs_date >= big.obs_date"""


def _sides(spark, sf):
    left = user_obs(spark, sf)
    return left, left.where("value > 20").withColumnRenamed("value", "rate")


@query("asof_backward", ASOF_SQL)
def asof_backward(spark, sf):
    left, right = _sides(spark, sf)
    return joins.asof_join_backward(left, right, by=["series_id"], right_columns=["rate"])


@query("asof_backward_blocked", """WITH e AS (SELECT event_type, ts, event_id, value FROM events),
  p AS (SELECT event_type, ts, MAX(value) AS rate FROM events WHERE value > 60 GROUP BY 1, 2)
  SELECT e.event_type, e.event_id, p.rate, strftime(p.ts, '%Y-%m-%d %H:%M:%S') AS right_ts
  FROM e ASOF JOIN p ON e.event_type = p.event_type AND e.ts >= p.ts""")
def asof_backward_blocked(spark, sf):
    """At event grain a type may own most rows: its time axis is cut where its rows are."""
    ev = table(spark, sf, "events").select(
        "event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value"
    )
    right = ev.where("value > 60").groupBy("event_type", "ts").agg(F.max("value").alias("rate"))
    return joins.asof_join_backward(
        ev, right, by=["event_type"], time="ts", right_columns=["rate"], right_time="right_ts",
        parts=64,
    ).select("event_type", "event_id", "rate", "right_ts")


@query("spread_to_benchmark", f"""WITH {ORDERS_CTE}, b AS (SELECT obs_date, value FROM ob WHERE series_id = '1-URGENT')
  SELECT ob.series_id, CAST(ob.obs_date AS VARCHAR) AS obs_date, round((ob.value - b.value) * 100, 4) AS spread_bp,
  ob.value AS left_value, b.value AS benchmark, CAST(b.obs_date AS VARCHAR) AS right_obs_date
  FROM ob ASOF JOIN b ON ob.obs_date >= b.obs_date WHERE ob.series_id <> '1-URGENT'""")
def spread_to_benchmark(spark, sf):
    return joins.spread_to_benchmark(order_obs(spark, sf), "1-URGENT")


@query("inner_dates", f"""WITH {ORDERS_CTE}, {SHIP_CTE} SELECT CAST(o.obs_date AS VARCHAR) AS obs_date, o.series_id,
  s.series_id AS flag, o.value AS left_value, s.value AS right_value FROM ob o JOIN sh s ON o.obs_date = s.obs_date""")
def inner_dates(spark, sf):
    right = ship_obs(spark, sf).withColumnRenamed("series_id", "flag")
    return joins.inner_on(order_obs(spark, sf), right, ["obs_date"])


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("pair_on_date", f"""WITH {EVENTS_CTE} SELECT a.series_id || '-' || b.series_id AS pair, CAST(a.obs_date AS VARCHAR) AS obs_date,
  a.value AS left_value, b.value AS right_value FROM ev a JOIN ev b ON a.obs_date = b.obs_date WHERE a.series_id < b.series_id""")
def pair_on_date(spark, sf):
    """Every two event types."""
    pairs = [(f"{a}-{b}", a, b) for a, b in combinations(EVENT_TYPES, 2)]
    return joins.pair_on_date(event_obs(spark, sf), pairs)


@query("inner_quarters", f"""WITH {QUARTER_CTE} SELECT a.series_id, b.series_id AS other, a.ordinal, CAST(a.obs_date AS VARCHAR) AS left_date,
  CAST(b.obs_date AS VARCHAR) AS right_date, a.value AS left_value, b.value AS right_value FROM qo a JOIN qo b ON a.ordinal = b.ordinal""")
def inner_quarters(spark, sf):
    """Every two priorities, each with itself too: at most 25 rows a quarter."""
    q = quarter_obs(spark, sf)
    return joins.inner_on(
        q.withColumnRenamed("obs_date", "left_date"),
        q.withColumnsRenamed({"obs_date": "right_date", "series_id": "other"}), ["ordinal"],
    )


@query("common_dates", f"""WITH {ORDERS_CTE} SELECT CAST(obs_date AS VARCHAR) AS obs_date, count(DISTINCT series_id) AS entities FROM ob
  GROUP BY 1 HAVING count(DISTINCT series_id) = (SELECT count(DISTINCT series_id) FROM ob)""")
def common_dates(spark, sf):
    return joins.common_dates(order_obs(spark, sf))


@query("missing_flag_left", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, o_orderpriority AS priority, o_orderkey IS NULL AS metadata_missing,
  (o_orderkey IS NOT NULL AND l_linestatus IS DISTINCT FROM o_orderstatus) AS metadata_mismatch, false AS metadata_conflict
  FROM lineitem LEFT JOIN orders o ON l_orderkey = o_orderkey + 300""")
def missing_flag_left(spark, sf):
    facts = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("accession"), "l_linenumber", F.col("l_linestatus").alias("status")
    )
    # Keys moved on, so that both sides have rows without a partner.
    filings = table(spark, sf, "orders").select(
        (F.col("o_orderkey") + 300).alias("accession"), F.col("o_orderstatus").alias("state"),
        F.col("o_orderpriority").alias("priority"),
    )
    out = joins.left_with_missing_flag(
        facts, filings, ["accession"], agree={"status": "state"}, provenance=["priority"]
    )
    return out.select(
        F.col("accession").alias("l_orderkey"), "l_linenumber", "priority", "metadata_missing",
        "metadata_mismatch", "metadata_conflict",
    )


@query("known_anti", """SELECT o_orderkey AS accession, CASE WHEN c_custkey IS NULL THEN 'NEW' WHEN o_custkey % 10 = 0 THEN 'CONFLICT' WHEN c_nationkey < 12 THEN 'REUSED' ELSE 'MISMATCH' END AS reuse_status
  FROM orders LEFT JOIN customer c ON o_custkey = c_custkey + 30""")
def known_anti(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("accession"), F.col("o_custkey").alias("cust"), F.lit("4").alias("form")
    )
    known = table(spark, sf, "customer").select(
        (F.col("c_custkey") + 30).alias("cust"), F.when(F.col("c_nationkey") < 12, "4").otherwise("4/A").alias("form")
    )
    known = known.union(known.where("cust % 10 = 0").withColumn("form", F.lit("8-K")))
    return joins.reuse_known(o, known, key="cust", agree=["form"]).select("accession", "reuse_status")


@query("attach_calendar_flags", f"""WITH {ORDERS_CTE}
  SELECT series_id, CAST(obs_date AS VARCHAR) AS obs_date, value, CASE WHEN dayofmonth(obs_date) = 15 THEN 'TAX_WINDOW' ELSE '' END AS flags FROM ob""")
def attach_calendar_flags(spark, sf):
    obs = order_obs(spark, sf)
    events = obs.where(F.dayofmonth("obs_date") == 15).select("obs_date").distinct().withColumn(
        "flags", F.array(F.lit("TAX_WINDOW"))
    )
    return joins.attach_calendar_flags(obs, events)


@query("next_observation", f"""WITH {USERS_CTE} SELECT series_id, CAST(obs_date AS VARCHAR) AS obs_date, value,
  CAST(lead(obs_date) OVER (PARTITION BY series_id ORDER BY obs_date) AS VARCHAR) AS next_date FROM us""")
def next_observation(spark, sf):
    return joins.next_observation(user_obs(spark, sf))


LINK_SQL = """f AS (SELECT o_orderkey AS k, o_orderstatus AS form, CAST(o_orderdate AS DATE) AS filed, o_custkey // 50 AS issuer,
    CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(floor(o_totalprice / 250000) AS BIGINT) END AS bucket, CAST(o_orderdate AS DATE) AS orig FROM orders),
  c AS (SELECT filed, issuer, bucket, count(*) AS n, min(k) AS original FROM f WHERE form = 'F' AND bucket IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) = 1),
  a AS (SELECT f.*, c.original FROM f LEFT JOIN c ON f.orig = c.filed AND f.issuer = c.issuer AND f.bucket = c.bucket WHERE form = 'O'),
  w AS (SELECT original, MAX(k) AS winner FROM a WHERE original IS NOT NULL GROUP BY 1)"""


@query("exactly_one_link", f"""WITH {LINK_SQL}
  SELECT k AS accession, CASE WHEN w.original IS NULL THEN 'ORIGINAL_EFFECTIVE' ELSE 'ORIGINAL_SUPERSEDED' END AS amendment_status, CAST(NULL AS BIGINT) AS linked_original
    FROM f LEFT JOIN w ON f.k = w.original WHERE form = 'F'
  UNION ALL SELECT k, CASE WHEN a.original IS NULL THEN 'UNLINKED_REVIEW' WHEN w.winner = k THEN 'AMENDMENT_EFFECTIVE' ELSE 'AMENDMENT_SUPERSEDED' END, a.original
    FROM a LEFT JOIN w ON a.original = w.original
  UNION ALL SELECT k, 'OTHER_FORM', NULL FROM f WHERE form NOT IN ('F', 'O')""")
def exactly_one_link(spark, sf):
    day = F.to_date("o_orderdate")
    rows = table(spark, sf, "orders").select(
        F.lpad(F.col("o_orderkey").cast("string"), 20, "0").alias("accession"),
        F.col("o_orderstatus").alias("form"), day.alias("filed"), day.alias("original_date"),
        F.floor(F.col("o_custkey") / 50).alias("issuer"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.floor(F.col("o_totalprice") / 250000)).alias("bucket"),
        F.col("o_orderdate").alias("accepted_at"),
    )
    out = joins.link_amendments(rows, base_form="F", amended_form="O", identity=["issuer", "bucket"])
    return out.select(
        F.col("accession").cast("bigint").alias("accession"), "amendment_status",
        F.col("linked_original").cast("bigint").alias("linked_original"),
    )


NEIGHBOURS_SQL = f"""WITH {ORDERS_CTE}, cal AS (SELECT series_id, obs_date, row_number() OVER (PARTITION BY series_id ORDER BY obs_date) AS idx FROM ob),
  dl AS (SELECT series_id, MAX(obs_date) AS observed, year(obs_date) AS y, month(obs_date) AS m FROM ob GROUP BY 1, 3, 4),
  x AS (SELECT n.series_id, n.obs_date, CAST(m AS VARCHAR) AS kind, observed FROM dl JOIN cal c ON c.series_id = dl.series_id AND c.obs_date = dl.observed
    JOIN cal n ON n.series_id = c.series_id AND abs(n.idx - c.idx) <= 1)
  SELECT series_id AS calendar_id, CAST(obs_date AS VARCHAR) AS obs_date, 'TAX_WINDOW' AS flags,
  string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, 'src' AS sources,
  string_agg(DISTINCT CAST(observed AS VARCHAR) || '->' || CAST(observed AS VARCHAR), ',' ORDER BY CAST(observed AS VARCHAR) || '->' || CAST(observed AS VARCHAR)) AS deadlines
  FROM x GROUP BY 1, 2"""


@query("calendar_neighbours", NEIGHBOURS_SQL)
def calendar_neighbours(spark, sf):
    cal = order_obs(spark, sf).select(F.col("series_id").alias("calendar_id"), "obs_date")
    deadlines = cal.groupBy("calendar_id", F.year("obs_date"), F.month("obs_date").alias("m")).agg(
        F.max("obs_date").alias("observed")
    ).select(
        "calendar_id", F.col("m").cast("string").alias("kind"), F.col("observed").alias("original"),
        "observed", F.lit("src").alias("source"),
    )
    return joins.calendar_neighbours(deadlines, cal)


@query("nearest_calendar_date", f"""WITH {USERS_CTE}, dl AS (SELECT DISTINCT series_id, date_trunc('week', obs_date)::DATE + 2 AS dd FROM us),
  n AS (SELECT dl.series_id, dd, MAX(CASE WHEN us.obs_date < dd THEN us.obs_date END) AS p, MIN(CASE WHEN us.obs_date > dd THEN us.obs_date END) AS q
    FROM dl LEFT JOIN us ON us.series_id = dl.series_id AND us.obs_date BETWEEN dd - 7 AND dd + 7 GROUP BY 1, 2)
  SELECT series_id AS calendar_id, CAST(dd AS VARCHAR) AS deadline, CAST(coalesce(p, dd - 1) AS VARCHAR) AS previous_date, CAST(coalesce(q, dd + 1) AS VARCHAR) AS next_date FROM n""")
def nearest_calendar_date(spark, sf):
    cal = user_obs(spark, sf).select(F.col("series_id").alias("calendar_id"), "obs_date")
    deadlines = cal.select(
        "calendar_id", F.date_add(F.date_trunc("week", "obs_date").cast("date"), 2).alias("deadline")
    )
    return joins.nearest_calendar_date(deadlines, cal)


def release_schedule(spark, sf):
    """A reviewed weekly schedule per priority: report on Tuesday, release on Friday."""
    return order_obs(spark, sf).where(F.weekday("obs_date") == 1).select(
        F.col("series_id").alias("schedule_id"), F.date_add("obs_date", 3).alias("release_date"),
        F.col("obs_date").alias("report_date"),
    )


def release_states(spark, sf):
    """One state per customer: its last order, reported a day later."""
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("state_id")).agg(
        F.max(F.to_date("o_orderdate")).alias("obs_date"),
        F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("schedule_id"),
    ).withColumn("released_at", F.date_add("obs_date", 1).cast("timestamp"))


SCHEDULE_SQL = f"""{ORDERS_CTE}, sc AS (SELECT series_id AS sid, obs_date + 3 AS rel, obs_date AS rep FROM ob WHERE isodow(obs_date) = 2),
  st AS (SELECT o_custkey AS state_id, MAX(CAST(o_orderdate AS DATE)) AS d, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS sid FROM orders GROUP BY 1),
  nx AS (SELECT state_id, d, st.sid, (SELECT MIN((rel, rep)) FROM sc WHERE sc.sid = st.sid AND rel > d + 1 AND rep > d) AS slot FROM st)"""


@query("next_scheduled_release", f"""WITH {SCHEDULE_SQL} SELECT state_id, CAST(d AS VARCHAR) AS obs_date, CAST(slot[1] AS VARCHAR) AS next_release,
  CAST(slot[2] AS VARCHAR) AS next_report FROM nx""")
def next_scheduled_release(spark, sf):
    return joins.next_scheduled_release(release_states(spark, sf), release_schedule(spark, sf)).select(
        "state_id", "obs_date", "next_release", "next_report"
    )


@query("ordinal_offset_growth", f"""WITH {USERS_CTE}, o AS (SELECT series_id, date_diff('day', DATE '2024-01-01', obs_date) AS ordinal, value FROM us)
  SELECT a.series_id, a.ordinal, a.value, b.value AS value_t1, c.value AS value_t4 FROM o a
  LEFT JOIN o b ON b.series_id = a.series_id AND b.ordinal = a.ordinal - 1
  LEFT JOIN o c ON c.series_id = a.series_id AND c.ordinal = a.ordinal - 4""")
def ordinal_offset_growth(spark, sf):
    obs = user_obs(spark, sf).select(
        "series_id", F.datediff("obs_date", F.lit("2024-01-01").cast("date")).alias("ordinal"), "value"
    )
    return joins.ordinal_offset(obs, [1, 4])


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
PIVOT_SQL = ", ".join(f"MAX(CASE WHEN series_id = '{p}' THEN value END) AS \"{p}\"" for p in PRIORITIES)


@query("align_outer_pivot", f"""WITH {ORDERS_CTE} SELECT CAST(obs_date AS VARCHAR) AS obs_date, {PIVOT_SQL} FROM ob GROUP BY 1""")
def align_outer_pivot(spark, sf):
    return joins.align_outer(order_obs(spark, sf), PRIORITIES)


FLAGS = ["A", "N", "R"]
CROSS_SQL = f"""{ORDERS_CTE}, {SHIP_CTE}, ck AS (SELECT series_id || '/' || flag AS check_id, flag, obs_date, value
    FROM ob, (VALUES ('A'), ('N'), ('R')) AS v(flag)), df AS (SELECT ck.check_id, ck.obs_date, abs(ck.value - s.value) AS difference
    FROM ck JOIN sh s ON ck.obs_date = s.obs_date AND s.series_id = ck.flag)"""


def _differences(spark, sf):
    """Each priority's orders against each flag's shipments of the day."""
    obs = order_obs(spark, sf).withColumn("flag", F.explode(F.array(*[F.lit(f) for f in FLAGS])))
    obs = obs.select(F.concat_ws("/", "series_id", "flag").alias("check_id"), "flag", "obs_date", "value")
    ship = ship_obs(spark, sf).withColumnRenamed("series_id", "flag")
    right = ship.join(obs.select("check_id", "flag", "obs_date"), ["flag", "obs_date"]).drop("flag")
    obs = obs.drop("flag")
    return joins.same_date_difference(obs, right), obs


@query("same_date_cross_check", f"WITH {CROSS_SQL} SELECT check_id, CAST(obs_date AS VARCHAR) AS obs_date, difference FROM df")
def same_date_cross_check(spark, sf):
    return _differences(spark, sf)[0]


@query("cross_difference_band", f"""WITH {CROSS_SQL}, e AS (SELECT check_id, MAX(obs_date) AS d FROM ck GROUP BY 1),
  c AS (SELECT e.check_id, e.d, df.difference AS cur FROM e LEFT JOIN df ON df.check_id = e.check_id AND df.obs_date = e.d),
  b AS (SELECT c.check_id, c.d, c.cur, count(p.difference) AS n, count(*) FILTER (WHERE p.difference <= c.cur) AS k,
    quantile_disc(p.difference, 0.8) AS q1, quantile_disc(p.difference, 0.95) AS q2
    FROM c LEFT JOIN df p ON p.check_id = c.check_id AND p.obs_date < c.d GROUP BY 1, 2, 3)
  SELECT check_id, CAST(d AS VARCHAR) AS obs_date, round(cur, 6) AS current, n AS sample_size,
  CASE WHEN cur IS NOT NULL AND n >= 104 THEN round(k / n, 6) END AS percentile,
  CASE WHEN cur IS NOT NULL AND n >= 104 THEN q1 END AS q80, CASE WHEN cur IS NOT NULL AND n >= 104 THEN q2 END AS q95,
  CASE WHEN cur IS NULL THEN 'NOT_RELEASED' WHEN n < 104 THEN 'INSUFFICIENT_HISTORY' WHEN cur <= q1 THEN 'ALIGNED'
    WHEN cur <= q2 THEN 'TIMING_DIFFERENCE' ELSE 'MATERIAL_DIVERGENCE' END AS state FROM b""")
def cross_difference_band(spark, sf):
    differences, obs = _differences(spark, sf)
    ends = obs.groupBy("check_id").agg(F.max("obs_date").alias("end_date"))
    return bands.difference_band(differences, ends)


# --- reviewed records ------------------------------------------------------

TIE = ["period_end", "accepted_at", "reviewed_at", "accession"]
LATEST_SQL = f"""{TYPED_SQL}, dd AS (SELECT DISTINCT metric_id, as_of AS asof_date FROM tr),
  cand AS (SELECT dd.metric_id, dd.asof_date, tr.company_id, tr.direction, tr.comparable, tr.accession, tr.as_of, tr.accepted, tr.reviewed,
    row_number() OVER (PARTITION BY dd.metric_id, dd.asof_date, tr.company_id ORDER BY tr.as_of DESC, period_end DESC, accepted DESC, reviewed DESC, accession DESC) AS rn
    FROM dd JOIN tr ON tr.metric_id = dd.metric_id AND tr.as_of <= dd.asof_date AND date_diff('day', tr.as_of, dd.asof_date) <= 120),
  lr AS (SELECT * FROM cand WHERE rn = 1)"""


@query("latest_per_entity_asof", f"""WITH {LATEST_SQL} SELECT metric_id, CAST(asof_date AS VARCHAR) AS asof_date, company_id,
  CAST(as_of AS VARCHAR) AS as_of, accession, direction FROM lr""")
def latest_per_entity_asof(spark, sf):
    return joins.latest_per_entity_asof(typed_reviewed(spark, sf), tie=TIE).select(
        "metric_id", "asof_date", "company_id", "as_of", "accession", "direction"
    )


REVIEW_POINTS_SQL = f"""{LATEST_SQL}, pt AS (SELECT metric_id, asof_date,
    CASE WHEN count(*) FILTER (WHERE comparable AND direction = 'UNKNOWN') > 0 OR count(*) FILTER (WHERE comparable) = 0 THEN 'UNKNOWN'
      WHEN count(DISTINCT CASE WHEN comparable THEN direction END) = 1 THEN MAX(CASE WHEN comparable THEN direction END) ELSE 'MIXED' END AS direction,
    count(*) AS record_count, count(DISTINCT company_id) AS company_count, count(*) FILTER (WHERE comparable) AS comparable_count,
    MAX(accepted) AS acc, MAX(reviewed) AS rev FROM lr GROUP BY 1, 2)"""


@query("reviewed_observations", f"""WITH {REVIEW_POINTS_SQL} SELECT metric_id, CAST(asof_date AS VARCHAR) AS asof_date, direction, record_count,
  company_count, comparable_count, CAST(acc AS VARCHAR) || ' 00:00:00' AS latest_accepted_at, CAST(rev AS VARCHAR) || ' 00:00:00' AS latest_reviewed_at FROM pt""")
def reviewed_observations(spark, sf):
    return aggregates.reviewed_observations(joins.entity_spans(typed_reviewed(spark, sf), tie=TIE))


@query("reviewed_states", f"""WITH {REVIEW_POINTS_SQL}, z AS (SELECT *, row_number() OVER (PARTITION BY metric_id ORDER BY asof_date DESC) AS rn FROM pt)
  SELECT metric_id, 'ACTIVE_FREE' AS availability, CAST(asof_date AS VARCHAR) AS asof_date, direction, record_count, company_count, comparable_count FROM z WHERE rn = 1
  UNION ALL SELECT 'none', 'MANUAL_READY', NULL, 'UNKNOWN', 0, 0, 0""")
def reviewed_states(spark, sf):
    rows = typed_reviewed(spark, sf)
    points = aggregates.reviewed_observations(joins.entity_spans(rows, tie=TIE))
    metrics = rows.select(F.explode(F.array("metric_id", F.lit("none"))).alias("metric_id")).distinct()
    return aggregates.reviewed_states(points, metrics).select(
        "metric_id", "availability", "asof_date", "direction", "record_count", "company_count",
        "comparable_count",
    )


@query("reconcile_records", """WITH r AS (SELECT CAST(o_custkey AS VARCHAR) AS company_id, o_orderkey AS accession, CAST(o_orderdate AS DATE) AS as_of, o_orderstatus AS form FROM orders),
  f AS (SELECT CAST(o_custkey AS VARCHAR) AS company_id, o_orderkey AS accession, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS form FROM orders WHERE o_orderpriority <> '5-LOW')
  SELECT r.company_id, r.accession, CASE WHEN f.accession IS NULL THEN 'ABSENT' ELSE 'MISMATCH_FORM' END AS reasons FROM r LEFT JOIN f
  ON r.company_id = f.company_id AND r.accession = f.accession WHERE (f.accession IS NULL AND as_of >= DATE '2001-08-01' - 400) OR f.form <> r.form""")
def reconcile_records(spark, sf):
    o = table(spark, sf, "orders")
    records = o.select(
        F.col("o_custkey").cast("string").alias("company_id"), F.col("o_orderkey").alias("accession"),
        F.to_date("o_orderdate").alias("as_of"), F.col("o_orderstatus").alias("form"),
    )
    filings = o.where("o_orderpriority <> '5-LOW'").select(
        F.col("o_custkey").cast("string").alias("company_id"), F.col("o_orderkey").alias("accession"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "X").otherwise(F.col("o_orderstatus")).alias("form"),
    )
    out = joins.reconcile_records(
        records, filings, now="2001-08-01", lookback_days=400, agree={"form": "form"}
    )
    return out.select("company_id", "accession", "reasons")


QUEUE_SQL = """rec AS (SELECT o_custkey AS company_id, o_orderpriority AS metric_id, o_orderkey AS accession, CAST(o_orderdate AS DATE) AS as_of FROM orders WHERE o_orderstatus = 'F'),
  fil AS (SELECT o_custkey AS company_id, o_orderkey AS accession, o_orderdate AS accepted FROM orders WHERE o_orderdate > TIMESTAMP '2001-08-02' - INTERVAL 100 DAY),
  met AS (SELECT unnest(['1-URGENT', '2-HIGH']) AS metric_id), grid AS (SELECT c_custkey AS company_id, metric_id FROM customer, met),
  la AS (SELECT company_id, metric_id, MAX(as_of) AS as_of, arg_max(accession, (as_of, accession)) AS accession FROM rec GROUP BY 1, 2),
  cd AS (SELECT fil.company_id, met.metric_id, fil.accession, accepted FROM fil, met WHERE NOT EXISTS (SELECT 1 FROM rec
    WHERE rec.company_id = fil.company_id AND rec.metric_id = met.metric_id AND rec.accession = fil.accession)),
  nw AS (SELECT company_id, metric_id, count(*) AS n, MAX(accepted) AS newest FROM cd GROUP BY 1, 2)"""


def _queue_inputs(spark, sf):
    o = table(spark, sf, "orders")
    day = F.to_date("o_orderdate")
    records = o.where("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("company_id"), F.col("o_orderpriority").alias("metric_id"),
        F.col("o_orderkey").alias("accession"), day.alias("as_of"),
        day.cast("timestamp").alias("reviewed_at"),
    )
    filings = o.select(
        F.col("o_custkey").alias("company_id"), F.col("o_orderkey").alias("accession"),
        F.col("o_orderdate").cast("timestamp").alias("accepted_at"),
    )
    entities = table(spark, sf, "customer").select(F.col("c_custkey").alias("company_id"))
    return entities, records, filings


@query("review_queue", f"""WITH {QUEUE_SQL} SELECT g.company_id, g.metric_id, concat_ws(',', CASE WHEN la.company_id IS NULL THEN 'NO_REVIEWED_ROW' END,
    CASE WHEN date_diff('day', la.as_of, DATE '2001-08-02') > 365 THEN 'REVIEW_OVERDUE' END, CASE WHEN nw.n > 0 THEN 'NEW_FILING' END) AS reasons,
  la.accession AS latest_reviewed_filing, coalesce(nw.n, 0) AS candidate_count FROM grid g LEFT JOIN la ON la.company_id = g.company_id AND la.metric_id = g.metric_id
  LEFT JOIN nw ON nw.company_id = g.company_id AND nw.metric_id = g.metric_id
  WHERE la.company_id IS NULL OR date_diff('day', la.as_of, DATE '2001-08-02') > 365 OR nw.n > 0""")
def review_queue(spark, sf):
    entities, records, filings = _queue_inputs(spark, sf)
    return joins.review_queue(
        entities, ["1-URGENT", "2-HIGH"], records, filings, now="2001-08-02", overdue_days=365,
        lookback_days=100, tie=["as_of", "accession"],
    ).select("company_id", "metric_id", "reasons", "latest_reviewed_filing", "candidate_count")


@query("review_candidates", f"""WITH {QUEUE_SQL} SELECT company_id, metric_id, accession FROM cd""")
def review_candidates(spark, sf):
    _, records, filings = _queue_inputs(spark, sf)
    return joins.review_candidates(
        ["1-URGENT", "2-HIGH"], records, filings, now="2001-08-02", lookback_days=100
    ).select("company_id", "metric_id", "accession")
