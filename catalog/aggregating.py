"""Group-by queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import EVENTS_CTE, ORDERS_CTE, order_obs, event_obs, query, table
from catalog.sources import AUCTIONS_SQL, FILED_SQL, LIMBS, ownership_docs
from seriesloom.operators import aggregates as agg
from seriesloom.functions.scalars import sign_label
from seriesloom.operators import clean, windows
from seriesloom.operators.quantiles import grouped_quantile
from seriesloom.plans import filing_path
from seriesloom.sources.filings import parse_ownership_docs


@query("daily_operation_totals", """SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS op_date, round(SUM(CAST(o_totalprice AS DECIMAL(28,6))) / 1000, 6)::DOUBLE AS value,
  round(SUM(CAST(o_totalprice AS DECIMAL(28,6)) + CASE WHEN o_orderstatus = 'P' THEN -1 ELSE 1 END) / 1000, 6)::DOUBLE AS submitted, count(*) AS operation_count,
  count(*) FILTER (WHERE o_orderstatus = 'P') AS violations FROM orders GROUP BY 1""")
def daily_operation_totals(spark, sf):
    price = F.col("o_totalprice")
    ops = table(spark, sf, "orders").select(
        F.to_date("o_orderdate").alias("op_date"), price.alias("accepted"),
        F.when(F.col("o_orderstatus") == "P", price - 1).otherwise(price + 1).alias("submitted"),
    )
    return agg.daily_operation_totals(ops, released=None, divisor=1e3).select(
        "op_date", "value", "submitted", "operation_count", "violations"
    )


CONDITIONAL_SQL = """li AS (SELECT CAST(l_shipdate AS DATE) AS d, l_orderkey, l_returnflag = 'R' AS ex, CAST(l_extendedprice AS DECIMAL(28,6)) AS acc,
    CAST(l_quantity AS DECIMAL(28,6)) AS sub, l_tax FROM lineitem),
  op AS (SELECT d, l_orderkey, bool_or(ex) AS ex, SUM(acc) AS acc, SUM(sub) AS sub, SUM(CASE WHEN NOT ex THEN acc ELSE 0 END) AS el,
    MIN(l_tax) AS r0, MAX(l_tax) AS r1 FROM li GROUP BY 1, 2)"""


@query("conditional_totals", f"""WITH {CONDITIONAL_SQL} SELECT CAST(d AS VARCHAR) AS op_date, CAST(SUM(sub) AS DOUBLE) AS submitted, CAST(SUM(acc) AS DOUBLE) AS accepted,
  CAST(SUM(el) AS DOUBLE) AS eligible, CAST(SUM(acc) - SUM(el) AS DOUBLE) AS exercise, count(*) AS operation_count,
  count(*) FILTER (WHERE ex) AS exercise_operation_count, count(*) FILTER (WHERE ex) > 0 AS has_exercise,
  count(*) FILTER (WHERE ex) > 0 AND count(*) FILTER (WHERE ex) = count(*) AS exercise_only,
  CASE WHEN MIN(r0) = MAX(r1) THEN MIN(r0) END AS single_rate FROM op GROUP BY 1""")
def conditional_totals(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.to_date("l_shipdate").alias("op_date"), F.col("l_orderkey").alias("op_id"), "l_returnflag",
        F.col("l_extendedprice").alias("accepted"), F.col("l_quantity").alias("submitted"),
        F.col("l_tax").alias("rate"),
    )
    return agg.conditional_daily_totals(li, exercise=F.col("l_returnflag") == "R")


@query("category_breakdown", """SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS op_date, CAST(coalesce(SUM(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS DECIMAL(28,6)) END), 0) AS DOUBLE) AS a_quantity,
  CAST(coalesce(SUM(CASE WHEN l_returnflag = 'N' THEN CAST(l_extendedprice AS DECIMAL(28,6)) END), 0) AS DOUBLE) AS n_price FROM lineitem GROUP BY 1""")
def category_breakdown(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.to_date("l_shipdate").alias("op_date"), F.col("l_returnflag").alias("category"),
        "l_quantity", "l_extendedprice",
    )
    out = agg.category_breakdown(
        li, ["A", "N", "R"],
        measures={"quantity": F.col("l_quantity"), "price": F.col("l_extendedprice")},
    )
    return out.select(
        "op_date", F.col("breakdown")["A"]["quantity"].alias("a_quantity"),
        F.col("breakdown")["N"]["price"].alias("n_price"),
    )


@query("daily_totals_with_breakdown", """WITH li AS (SELECT CAST(l_shipdate AS DATE) AS d, l_orderkey, l_linestatus = 'F' AS ex, l_returnflag AS c, CAST(l_extendedprice AS DECIMAL(28,6)) AS acc,
    CAST(l_quantity AS DECIMAL(28,6)) AS sub, l_tax FROM lineitem), o AS (SELECT d, l_orderkey, bool_or(ex) AS ex FROM li GROUP BY 1, 2),
  p AS (SELECT d, count(*) AS n, bool_or(ex) AS h, bool_and(ex) AS e FROM o GROUP BY 1)
  SELECT CAST(li.d AS VARCHAR) AS op_date, CAST(SUM(sub) AS DOUBLE) AS submitted, CAST(SUM(acc) AS DOUBLE) AS accepted, MAX(l_tax) AS max_rate, MAX(n) AS operation_count,
  bool_or(h) AS has_exercise, bool_or(e) AS exercise_only, CAST(SUM(acc) FILTER (WHERE c = 'A') AS DOUBLE) AS a_accepted, MAX(l_tax) FILTER (WHERE c = 'N') AS n_rate
  FROM li JOIN p ON li.d = p.d GROUP BY 1""")
def daily_totals_with_breakdown(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.to_date("l_shipdate").alias("op_date"), F.col("l_orderkey").alias("op_id"), "l_linestatus",
        F.col("l_returnflag").alias("category"), F.col("l_extendedprice").alias("accepted"),
        F.col("l_quantity").alias("submitted"), F.col("l_tax").alias("rate"),
        F.col("l_shipdate").alias("released_at"),
    )
    out = agg.daily_totals_with_breakdown(li, exercise=F.col("l_linestatus") == "F")
    return out.select(
        "op_date", "submitted", "accepted", "max_rate", "operation_count", "has_exercise", "exercise_only",
        F.try_element_at("breakdown", F.lit("A"))["accepted"].alias("a_accepted"),
        F.try_element_at("breakdown", F.lit("N"))["rate"].alias("n_rate"),
    )


@query("header_detail_check", """WITH h AS (SELECT l_orderkey, SUM(l_quantity) AS s, count(*) AS n FROM lineitem GROUP BY 1)
  SELECT l_orderkey AS op_id FROM h JOIN orders ON l_orderkey = o_orderkey WHERE abs(s - (CASE WHEN o_orderstatus = 'P' THEN -1 ELSE s END)) > 0.000001""")
def header_detail_check(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    totals = li.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("_s"))
    headers = o.join(totals, o.o_orderkey == totals.l_orderkey).select(
        "l_orderkey", F.when(F.col("o_orderstatus") == "P", -1.0).otherwise(F.col("_s")).alias("header")
    )
    details = li.select("l_orderkey", "l_quantity").join(headers, "l_orderkey").withColumnRenamed("l_orderkey", "op_id")
    return agg.header_detail_check(details, by=["op_id"], header={"l_quantity": "header"})


@query("settlement_totals", f"""WITH {AUCTIONS_SQL}, g AS (SELECT security_id, auction_date, issue_date, MIN(amount) AS amount, MIN(amount) <> MAX(amount) AS c FROM au GROUP BY 1, 2, 3)
  SELECT CAST(issue_date AS VARCHAR) AS issue_date, CAST(SUM(CAST(amount AS DECIMAL(28,6))) AS DOUBLE) AS value, count(*) AS security_count,
  count(*) FILTER (WHERE c) AS conflicts, sha256(CAST(count(*) AS VARCHAR) || ':' || {LIMBS}) AS keys_fingerprint
  FROM (SELECT *, sha256(concat_ws('|', security_id, CAST(auction_date AS VARCHAR), CAST(issue_date AS VARCHAR))) AS h FROM g) GROUP BY issue_date""")
def settlement_totals(spark, sf):
    return agg.settlement_totals(_auctions_raw(spark, sf))


def _auctions_raw(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_partkey").cast("string").alias("security_id"),
        F.date_sub(F.to_date("l_shipdate"), 7).alias("auction_date"),
        F.to_date("l_shipdate").alias("issue_date"), F.round(F.col("l_extendedprice") / 1000, 6).alias("amount"),
    )


BUCKET_SQL = """tx AS (SELECT l_orderkey AS accession, CASE l_linestatus WHEN 'F' THEN 'FALSE' ELSE 'TRUE' END AS flag, l_returnflag AS code,
    CAST(l_quantity AS DECIMAL(38,6)) AS shares, CASE WHEN l_tax > 0 THEN CAST(l_extendedprice AS DECIMAL(38,6)) END AS dollars FROM lineitem WHERE l_returnflag IN ('A', 'R')),
  bk AS (SELECT accession, CASE WHEN GROUPING(flag) = 1 THEN 'ALL' ELSE flag END AS bucket, count(*) AS eligible_count, count(dollars) AS priced_count,
    count(*) FILTER (WHERE code = 'A') AS buy_count, count(*) FILTER (WHERE code = 'R') AS sell_count,
    count(dollars) FILTER (WHERE code = 'A') AS buy_priced, count(dollars) FILTER (WHERE code = 'R') AS sell_priced,
    CAST(coalesce(SUM(shares) FILTER (WHERE code = 'A'), 0) AS DOUBLE) AS buy_shares, CAST(coalesce(SUM(shares) FILTER (WHERE code = 'R'), 0) AS DOUBLE) AS sell_shares,
    CAST(coalesce(SUM(dollars) FILTER (WHERE code = 'A'), 0) AS DOUBLE) AS buy_dollars, CAST(coalesce(SUM(dollars) FILTER (WHERE code = 'R'), 0) AS DOUBLE) AS sell_dollars
    FROM tx GROUP BY GROUPING SETS ((accession, flag), (accession)))"""


def line_transactions(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("accession"),
        F.when(F.col("l_linestatus") == "F", "FALSE").otherwise("TRUE").alias("flag"),
        F.col("l_returnflag").alias("code"), F.col("l_quantity").cast("decimal(28,6)").alias("shares"),
        F.when(F.col("l_tax") > 0, F.col("l_extendedprice").cast("decimal(28,6)")).alias("dollars"),
        F.to_date("l_shipdate").alias("index_date"), F.col("l_suppkey").alias("issuer"),
    )


@query("bucket_totals", f"WITH {BUCKET_SQL} SELECT * FROM bk")
def bucket_totals(spark, sf):
    return agg.bucketed_totals(line_transactions(spark, sf), buy="A", sell="R")


ENTRY_SQL = """en AS (SELECT l_returnflag IN ('A', 'R') AS elig, CAST(l_linenumber AS VARCHAR) AS g, CAST(l_shipdate AS DATE) AS d, l_suppkey AS issuer, l_returnflag AS code,
    l_linestatus AS st, l_tax, CASE WHEN l_tax > 0 THEN CAST(l_extendedprice AS DECIMAL(38,6)) END AS dollars FROM lineitem),
  dy AS (SELECT g, d, row_number() OVER (PARTITION BY g ORDER BY d DESC) AS rn FROM (SELECT DISTINCT g, d FROM en)),
  wn AS (SELECT g, d, w FROM dy, (VALUES (5), (20)) v(w) WHERE rn <= w),
  sm AS (SELECT en.g, w, count(*) AS filings, count(DISTINCT issuer) AS issuers, count(*) FILTER (WHERE code = 'A') AS b, count(*) FILTER (WHERE code = 'R') AS s,
    count(*) FILTER (WHERE elig) AS el, count(dollars) FILTER (WHERE elig) AS pr, SUM(dollars) FILTER (WHERE code = 'A') AS bd, SUM(dollars) FILTER (WHERE code = 'R') AS sd,
    count(*) FILTER (WHERE elig AND st = 'F') AS fe, count(*) FILTER (WHERE code = 'A' AND st = 'F') AS fb, count(*) FILTER (WHERE code = 'R' AND st = 'F') AS fs,
    MIN(en.d) AS d0, MAX(en.d) AS d1, count(DISTINCT en.d) AS nd FROM en JOIN wn ON en.d = wn.d AND en.g = wn.g GROUP BY 1, 2)"""


def line_entries(spark, sf):
    """One ledger row per order line."""
    li = table(spark, sf, "lineitem")
    buy, sell = F.col("l_returnflag") == "A", F.col("l_returnflag") == "R"
    false = F.col("l_linestatus") == "F"
    priced = F.when(F.col("l_tax") > 0, F.col("l_extendedprice").cast("decimal(28,6)"))
    zero = F.lit(0).cast("decimal(28,6)")
    one = lambda c: F.when(c, 1).otherwise(0)
    return li.select(
        F.col("l_linenumber").cast("string").alias("group_id"), F.to_date("l_shipdate").alias("index_date"),
        F.col("l_suppkey").alias("issuer"), F.lit(False).alias("is_amendment"),
        F.when(false, "FALSE").otherwise("TRUE").alias("flag"),
        F.lit("ORIGINAL_EFFECTIVE").alias("amendment_status"), F.lit("PARSED").alias("parse_status"),
        F.lit(None).cast("string").alias("linked_original"),
        one(buy).alias("buy_count"), one(sell).alias("sell_count"), one(buy | sell).alias("eligible_count"),
        one((buy | sell) & priced.isNotNull()).alias("priced_count"),
        one(buy & false).alias("false_buy_count"), one(sell & false).alias("false_sell_count"),
        one((buy | sell) & false).alias("false_eligible_count"),
        F.when(buy, F.coalesce(priced, zero)).otherwise(zero).alias("buy_dollars"),
        F.when(sell, F.coalesce(priced, zero)).otherwise(zero).alias("sell_dollars"),
    )


WINDOW_SQL = f"""{ENTRY_SQL}, o AS (SELECT g AS group_id, CAST(w AS BIGINT) AS window_days, nd AS completed_day_count, CAST(d0 AS VARCHAR) AS window_start, CAST(d1 AS VARCHAR) AS window_end,
    CASE WHEN el > 0 THEN round(CAST(b + 1 AS DOUBLE) / (s + 1), 6) END AS count_ratio, CASE WHEN el > 0 AND pr / el >= 0.8 AND sd <> 0 THEN round(CAST(bd AS DOUBLE) / CAST(sd AS DOUBLE), 6) END AS dollar_ratio,
    round(pr / nullif(el, 0), 6) AS dollar_coverage, CASE WHEN el = 0 THEN 'NO_ELIGIBLE_ROWS' WHEN pr / el < 0.8 THEN 'INSUFFICIENT_PRICE_COVERAGE' WHEN coalesce(sd, 0) = 0 THEN 'NO_SALES_DOLLAR_DENOMINATOR' ELSE 'PUBLISHED' END AS dollar_status,
    CASE WHEN fe > 0 THEN round((fb + 1) / (fs + 1), 6) END AS false_count_ratio, round(fe / nullif(el, 0), 6) AS false_coverage, b AS buy_count, s AS sell_count, pr AS priced_count, el AS eligible_count,
    issuers AS unique_issuers, filings AS filings_processed FROM sm)"""


@query("smoothed_ratio_last_n", f"WITH {WINDOW_SQL} SELECT * FROM o")
def smoothed_ratio_last_n(spark, sf):
    entries = line_entries(spark, sf)
    days = entries.select("group_id", "index_date")
    return agg.window_summary(entries, days, by=["group_id"]).select(
        "group_id", "window_days", "completed_day_count", "window_start", "window_end", "count_ratio",
        "dollar_ratio", "dollar_coverage", "dollar_status", "false_count_ratio", "false_coverage",
        "buy_count", "sell_count", "priced_count", "eligible_count", "unique_issuers", "filings_processed",
    )


@query("filing_statistics", f"""WITH {WINDOW_SQL} SELECT group_id, MAX(CASE WHEN window_days = 5 THEN count_ratio END) AS count_ratio_5d,
  MAX(CASE WHEN window_days = 20 THEN count_ratio END) AS count_ratio_20d, MAX(CASE WHEN window_days = 5 THEN dollar_status END) AS dollar_status_5d,
  MAX(CASE WHEN window_days = 20 THEN filings_processed END) AS filings_processed_20d FROM o GROUP BY 1""")
def filing_statistics(spark, sf):
    entries = line_entries(spark, sf)
    summary = agg.window_summary(entries, entries.select("group_id", "index_date"), by=["group_id"])
    return agg.filing_statistics(summary, by=["group_id"]).select(
        "group_id", "count_ratio_5d", "count_ratio_20d", "dollar_status_5d", "filings_processed_20d"
    )


@query("ledger_from_documents", f"""WITH {FILED_SQL} SELECT accession, CAST(d AS VARCHAR) AS index_date, form, flag, CAST(2 AS BIGINT) AS eligible_count,
  CAST(1 AS BIGINT) AS buy_count, CAST(1 AS BIGINT) AS sell_count, CAST(1 AS BIGINT) AS priced_count, round(o_totalprice * 10, 4) AS buy_dollars,
  CASE WHEN flag = 'FALSE' THEN CAST(2 AS BIGINT) ELSE 0 END AS false_eligible_count FROM fd""")
def ledger_from_documents(spark, sf):
    """The filing path from submission text to ledger rows."""
    ledger = filing_path.ledger_entries(parse_ownership_docs(ownership_docs(spark, sf)))
    return ledger.select(
        "accession", "index_date", "form", "flag", "eligible_count", "buy_count", "sell_count", "priced_count",
        F.round("buy_dollars", 4).alias("buy_dollars"), "false_eligible_count",
    )


@query("audit_counts", f"""WITH {FILED_SQL} SELECT stage, count(*) AS rows FROM (SELECT 'TRANSACTION_QUARANTINE' AS stage FROM fd
  UNION ALL SELECT 'METADATA_DATE_ANOMALY' FROM fd WHERE o_orderpriority = '3-MEDIUM') GROUP BY 1""")
def audit_counts(spark, sf):
    docs = ownership_docs(spark, sf)
    audits = filing_path.audit_rows(parse_ownership_docs(docs))
    return agg.audit_counts(audits, docs.select("index_date"))


@query("day_completeness", """WITH f AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'P') AS bad FROM orders GROUP BY 1),
  x AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem)
  SELECT CAST(x.d AS VARCHAR) AS index_date, coalesce(n, 0) AS filings, coalesce(bad, 0) AS failed, dayofmonth(x.d) <> 1 AND coalesce(bad, 0) = 0 AS is_complete
  FROM x LEFT JOIN f ON x.d = f.d""")
def day_completeness(spark, sf):
    days = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("index_date")).distinct()
    filings = table(spark, sf, "orders").select(
        F.to_date("o_orderdate").alias("index_date"),
        F.when(F.col("o_orderstatus") == "P", "FAILED").when(F.col("o_orderstatus") == "O", "REUSED")
        .otherwise("PARSED").alias("status"),
    )
    return agg.day_completeness(
        days.withColumn("index_read", F.dayofmonth("index_date") != 1), filings
    )


VENUE_SQL = """vn AS (SELECT event_type AS asset, CAST(user_id AS VARCHAR) AS venue, ts, MAX(value) / 1000 AS rate, CASE WHEN user_id < 50 THEN 8 ELSE 12 END AS hrs FROM events GROUP BY event_type, user_id, ts),
  en AS (SELECT *, rate * 24 / hrs AS dr FROM vn WHERE ts <= TIMESTAMP '2024-01-25 12:00:00' AND ts >= TIMESTAMP '2024-01-18 12:00:00'),
  lt AS (SELECT asset, venue, MAX(ts) AS ts, arg_max(rate, ts) AS rate, arg_max(dr, ts) AS dr, count(*) AS n, CAST(SUM(CAST(dr AS DECIMAL(28,12))) AS DOUBLE) / count(*) AS mean7,
    coalesce(CAST(SUM(CASE WHEN ts > TIMESTAMP '2024-01-24 12:00:00' THEN CAST(rate AS DECIMAL(28,12)) END) AS DOUBLE), 0) AS s24 FROM en GROUP BY 1, 2),
  vs AS (SELECT lt.*, (SELECT (count(*) FILTER (WHERE en.dr < lt.dr) + 0.5 * count(*) FILTER (WHERE en.dr = lt.dr)) / count(*) FROM en WHERE en.asset = lt.asset AND en.venue = lt.venue) AS pr FROM lt)"""


def _venues(spark, sf):
    ev = table(spark, sf, "events").groupBy("event_type", "user_id", "ts").agg(F.max("value").alias("value"))
    rows = ev.select(
        F.col("event_type").alias("asset"), F.col("user_id").cast("string").alias("venue"),
        F.col("ts").cast("timestamp").alias("settled_at"), (F.col("value") / 1000).alias("rate"),
        F.when(F.col("user_id") < 50, 8).otherwise(12).cast("double").alias("interval_hours"),
    )
    return agg.venue_summary(rows, as_of="2024-01-25 12:00:00")


@query("venue_summary", f"""WITH {VENUE_SQL} SELECT asset, venue, strftime(ts, '%Y-%m-%d %H:%M:%S') AS latest_settled_at, rate AS latest_rate,
  round(dr, 9) AS latest_daily_rate, round(s24, 9) AS settled_sum_24h, round(mean7, 9) AS mean_daily_7d, n AS sample_size_7d, round(pr, 9) AS percentile_7d FROM vs""")
def venue_summary(spark, sf):
    out = _venues(spark, sf).drop("latest_interval_hours")
    for c in ("latest_daily_rate", "settled_sum_24h", "mean_daily_7d", "percentile_7d"):
        out = out.withColumn(c, F.round(c, 9))
    return out


@query("refused_settlements", """SELECT event_id, concat_ws(',', CASE WHEN user_id % 10 = 2 THEN 'NO_VENUE' END, CASE WHEN value > 100 THEN 'NOT_NUMERIC' END,
    CASE WHEN user_id % 10 IN (0, 1) THEN 'INTERVAL' END) AS violations FROM events WHERE user_id % 10 IN (0, 1, 2) OR value > 100""")
def refused_settlements(spark, sf):
    """Settlements without a venue, a number or a positive interval; none is left out silently."""
    digit = F.col("user_id") % 10
    rows = table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("asset"), F.when(digit != 2, F.col("user_id").cast("string")).otherwise(" ").alias("venue"),
        F.col("ts").cast("timestamp").alias("settled_at"), F.when(F.col("value") <= 100, F.col("value")).otherwise(float("nan")).alias("rate"),
        F.when(digit == 0, 0.0).when(digit != 1, 8.0).alias("interval_hours"),
    )
    return clean.refused(rows, agg.settlement_rules()).select("event_id", "violations")


@query("median_across_groups", f"""WITH {VENUE_SQL} SELECT asset, count(*) AS venue_count, CASE WHEN count(*) = 1 THEN min(venue) ELSE 'MULTI_VENUE_MEDIAN' END AS venue,
  CASE count(*) WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence, round(median(dr), 8) AS latest_daily_rate, round(median(s24), 8) AS settled_sum_24h,
  round(median(mean7), 8) AS mean_daily_7d, round(median(pr), 8) AS percentile_7d FROM vs GROUP BY 1""")
def median_across_groups(spark, sf):
    measures = ["latest_daily_rate", "settled_sum_24h", "mean_daily_7d", "percentile_7d"]
    out = agg.median_across(_venues(spark, sf), measures)
    for c in measures:
        out = out.withColumn(c, F.round(c, 8))
    return out


DIRECTION_SQL = f"""{EVENTS_CTE}, dr AS (SELECT series_id, obs_date, CASE WHEN ch IS NULL THEN 'UNKNOWN' WHEN ch > 0 THEN 'UP' WHEN ch < 0 THEN 'DOWN' ELSE 'FLAT' END AS direction, ch
    FROM (SELECT *, value - lag(value) OVER (PARTITION BY series_id ORDER BY obs_date) AS ch FROM ev))"""


def _directions(spark, sf):
    return windows.k_obs_changes(event_obs(spark, sf), [1]).withColumn(
        "direction", sign_label("change_1", "UP", "DOWN")
    )


@query("consensus_direction", f"""WITH {DIRECTION_SQL} SELECT CAST(obs_date AS VARCHAR) AS obs_date, CASE WHEN count(*) FILTER (WHERE direction = 'UNKNOWN') > 0 THEN 'UNKNOWN'
  WHEN MIN(direction) = MAX(direction) THEN MIN(direction) ELSE 'MIXED' END AS direction, count(*) AS members FROM dr GROUP BY 1""")
def consensus_direction(spark, sf):
    return agg.consensus_direction(_directions(spark, sf), by=["obs_date"])


@query("breadth", f"""WITH {DIRECTION_SQL} SELECT CAST(obs_date AS VARCHAR) AS obs_date, CASE WHEN count(ch) = count(*) AND count(*) = 5 THEN count(*) FILTER (WHERE ch > 0) END AS agreeing,
  count(*) AS members, count(ch) AS known, round(count(*) FILTER (WHERE ch > 0) / nullif(count(ch), 0), 6) AS agree_ratio FROM dr GROUP BY 1""")
def breadth(spark, sf):
    rows = _directions(spark, sf)
    return agg.breadth(rows, by=["obs_date"], agrees=F.col("change_1") > 0, members=5)


STATE_SQL = "CASE o_orderstatus WHEN 'F' THEN 'OK' WHEN 'O' THEN 'NOT_RELEASED_YET' ELSE 'STALE' END"


@query("worst_of_rank", f"""SELECT o_custkey, CASE MAX(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END) WHEN 0 THEN 'OK' WHEN 1 THEN 'NOT_RELEASED_YET' ELSE 'STALE' END AS status
  FROM orders GROUP BY 1""")
def worst_of_rank(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", _health().alias("status"))
    return agg.worst_of(rows, by=["o_custkey"])


def _health():
    return F.when(F.col("o_orderstatus") == "F", "OK").when(F.col("o_orderstatus") == "O", "NOT_RELEASED_YET").otherwise("STALE")


def input_states(spark, sf):
    """One input state per order: its customer is the derived series, its priority
    the source."""
    o = table(spark, sf, "orders")
    day = F.to_date("o_orderdate")
    return o.select(
        F.col("o_custkey").alias("derived_id"), F.col("o_orderpriority").alias("source_id"),
        _health().alias("health"),
        F.when(F.col("o_totalprice") > 300000, "LATE").otherwise("FRESH").alias("freshness"),
        day.alias("obs_date"), day.cast("timestamp").alias("last_success_at"),
        F.date_add(day, 1).cast("timestamp").alias("released_at"),
        F.date_add(day, 7).alias("expected_next_update"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("late "), "o_orderpriority")).alias("failure_reason"),
    )


INPUT_SQL = """st AS (SELECT o_custkey AS derived_id, o_orderpriority AS source_id, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS h,
    CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END AS f, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderstatus = 'P' THEN 'late ' || o_orderpriority END AS r FROM orders)"""
H_SQL = "CASE MAX(h) WHEN 0 THEN 'OK' WHEN 1 THEN 'NOT_RELEASED_YET' ELSE 'STALE' END"
F_SQL = "CASE MAX(f) WHEN 0 THEN 'FRESH' ELSE 'LATE' END"


@query("derived_state", f"""WITH {INPUT_SQL} SELECT derived_id, {H_SQL} AS health, {F_SQL} AS freshness,
  CAST(CASE WHEN MAX(h) = 0 THEN MIN(d) ELSE MAX(d) END AS VARCHAR) || ' 00:00:00' AS last_success_at,
  CAST(MAX(d) + 1 AS VARCHAR) || ' 00:00:00' AS released_at, string_agg(DISTINCT r, '; ' ORDER BY r) AS failure_reason FROM st GROUP BY 1""")
def derived_state(spark, sf):
    return agg.derived_state(
        input_states(spark, sf), attempted_at=F.lit("2002-01-01").cast("timestamp")
    ).select("derived_id", "health", "freshness", "last_success_at", "released_at", "failure_reason")


@query("source_rollup", f"""WITH {INPUT_SQL} SELECT source_id, {H_SQL} AS status, {F_SQL} AS freshness, CAST(MAX(d) AS VARCHAR) AS obs_date,
  CAST(MAX(d) + 1 AS VARCHAR) || ' 00:00:00' AS released_at, CAST(CASE WHEN MAX(h) = 0 THEN MIN(d) ELSE MAX(d) END AS VARCHAR) || ' 00:00:00' AS last_success_at,
  CAST(MAX(d) + 7 AS VARCHAR) AS expected_next_update, string_agg(DISTINCT r, '; ' ORDER BY r) AS failure_reason FROM st GROUP BY 1""")
def source_rollup(spark, sf):
    return agg.source_rollup(input_states(spark, sf))


@query("category_counts", f"""WITH {INPUT_SQL} SELECT source_id, count(*) FILTER (WHERE h = 0) AS ok_count, count(*) FILTER (WHERE h = 2) AS stale_count FROM st GROUP BY 1""")
def category_counts(spark, sf):
    return agg.category_counts(
        input_states(spark, sf),
        {"ok_count": F.col("health") == "OK", "stale_count": F.col("health") == "STALE"}, by=["source_id"],
    )


@query("global_latest", f"WITH {ORDERS_CTE} SELECT CAST(MAX(obs_date) AS VARCHAR) AS latest FROM ob")
def global_latest(spark, sf):
    return agg.global_latest(order_obs(spark, sf))


@query("block_rollup", """SELECT o_custkey AS switch_id, count(*) FILTER (WHERE o_orderstatus = 'F') AS available_blocks, count(*) AS total_blocks,
  CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') = 0 THEN 'UNKNOWN' WHEN count(*) FILTER (WHERE o_orderstatus = 'F') <= 2 THEN 'LOW' ELSE 'MEDIUM' END AS confidence FROM orders GROUP BY 1""")
def block_rollup(spark, sf):
    blocks = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("switch_id"), (F.col("o_orderstatus") == "F").alias("available")
    )
    return agg.block_rollup(blocks)


@query("exact_quantiles", """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 6) AS q10, round(median(l_extendedprice), 6) AS q50,
  round(quantile_cont(l_extendedprice, 0.9), 6) AS q90, count(*) AS n, CAST(0 AS BIGINT) AS skipped FROM lineitem GROUP BY 1""")
def exact_quantiles(spark, sf):
    out = grouped_quantile(
        table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.1, 0.5, 0.9],
        names=["q10", "q50", "q90"],
    )
    for c in ("q10", "q50", "q90"):
        out = out.withColumn(c, F.round(c, 6))
    return out
