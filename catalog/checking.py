"""Table checks. Each published table is a copy with some rows altered; the check
must report exactly those."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.aggregating import BUCKET_SQL, input_states, line_entries, line_transactions
from catalog.common import ORACLES, ORDERS_CTE, QUERIES, order_obs, quarter_obs, query, table
from catalog.joining import TIE
from catalog.ruling import CLAUSE_SQL, _clauses, _metrics, metric_reads, metric_routing
from catalog.sources import reviewed_text, typed_reviewed
from catalog.windows import _positions, _ratios
from seriesloom.checks import checks, publication
from seriesloom.operators import aggregates, growth, joins, windows
from seriesloom.rules import evidence, interpretation, model
from seriesloom.session import new_table_path
from seriesloom.sources import reviewed

LOW = "series_id = '5-LOW'"


@query("schema_values_check", """SELECT 'SCHEMA' AS check_id, CAST(c_custkey AS VARCHAR) AS key, unnest(list_filter([CASE WHEN c_acctbal < 0 THEN 'REQUIRED:balance' END,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'ENUM:segment' END, CASE WHEN c_name LIKE '%7' THEN 'PATTERN:name' END], lambda x: x IS NOT NULL)) AS detail FROM customer""")
def schema_values_check(spark, sf):
    rows = table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"),
    )
    return checks.check_values(
        rows, ["c_custkey"], required=["balance"],
        enums={"segment": ["MACHINERY", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD"]}, finite=["balance"],
        patterns={"name": r"^Customer#\d*[0-689]$"},
    )


@query("domain_check", """WITH d AS (SELECT CAST(l_shipdate AS DATE) AS day, SUM(l_quantity) AS acc, SUM(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS el FROM lineitem GROUP BY 1)
  SELECT 'DOMAIN' AS check_id, CAST(day AS VARCHAR) AS key, 'PARTS_ADD_UP' AS detail FROM d WHERE abs(el - acc) > 0.000000001""")
def domain_check(spark, sf):
    """Days on which some quantity is in neither part."""
    daily = table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("op_date")).agg(
        F.sum("l_quantity").alias("accepted"), F.sum("l_quantity").alias("submitted"),
        F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(0.0)).alias("eligible"),
    ).select(
        "*", F.lit(0.0).alias("exercise"), F.lit(False).alias("exercise_only"), F.lit(False).alias("has_exercise")
    )
    return checks.check_domain(daily, ["op_date"], checks.operation_domain())


@query("increasing_check", """WITH o AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS d, lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders)
  SELECT 'STRICTLY_INCREASING' AS check_id, CAST(o_custkey AS VARCHAR) || '/' || CAST(o_orderkey AS VARCHAR) AS key, CAST(d AS VARCHAR) AS detail FROM o WHERE d <= p""")
def increasing_check(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("obs_date")
    )
    return checks.check_strictly_increasing(rows, by=["o_custkey"], order="o_orderkey", block_rows=1000)


@query("same_attributes_check", """SELECT 'SAME_ATTRIBUTES' AS check_id, CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_nationkey = 3 THEN 'ONLY_LEFT' ELSE 'c_mktsegment' END AS detail
  FROM customer WHERE c_nationkey = 3 OR c_nationkey = 4 AND c_mktsegment <> 'X'""")
def same_attributes_check(spark, sf):
    left = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    right = left.where("c_nationkey <> 3").withColumn(
        "c_mktsegment", F.when(F.col("c_nationkey") == 4, "X").otherwise(F.col("c_mktsegment"))
    )
    return checks.check_same_attributes(left, right, ["c_custkey"], ["c_mktsegment"])


@query("endpoint_checks", f"""WITH {ORDERS_CTE} SELECT DISTINCT 'ENDPOINT_AND_TAIL' AS check_id, series_id AS key, 'value' AS detail FROM ob WHERE series_id = '5-LOW'""")
def endpoint_checks(spark, sf):
    obs = order_obs(spark, sf)
    latest = windows.latest_per_series(obs).join(windows.tail_array(obs), "series_id").withColumn(
        "value", F.when(F.expr(LOW), F.col("value") + 1).otherwise(F.col("value"))
    )
    return checks.check_endpoint_and_tail(latest, obs)


@query("position_stats_check", """SELECT 'POSITION_STATS' AS check_id, 'R/' || c AS key, 'z_score_3_year' AS detail FROM (SELECT DISTINCT l_returnflag FROM lineitem WHERE l_returnflag = 'R') t, (VALUES ('a'), ('b')) v(c)""")
def position_stats_check(spark, sf):
    positions = _positions(spark, sf)
    published = windows.position_stats(positions).withColumn(
        "z_score_3_year",
        F.when(F.col("contract") == "R", F.lit(99.0)).otherwise(F.col("z_score_3_year")),
    )
    return checks.recompute_position_stats(published, positions)


@query("position_rows_check", """WITH d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_returnflag = 'N' AND dayofmonth(l_shipdate) = 1)
  SELECT 'DOMAIN' AS check_id, 'N/' || c || '/' || CAST(day AS VARCHAR) AS key, k AS detail FROM d, (VALUES ('a'), ('b')) v(c), (VALUES ('NET_PERCENT'), ('NET_POSITION'), ('VALUE')) w(k)""")
def position_rows_check(spark, sf):
    hit = (F.col("contract") == "N") & (F.dayofmonth("obs_date") == 1)
    altered = _positions(spark, sf).withColumn(
        "net_position", F.when(hit, F.col("net_position") + 1000000).otherwise(F.col("net_position"))
    )
    return checks.check_position_rows(altered)


@query("ordinal_stats_check", """SELECT DISTINCT 'ORDINAL_STATS' AS check_id, '5-LOW/' || CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS VARCHAR) AS key, 'midrank' AS detail
  FROM orders WHERE o_orderpriority = '5-LOW' AND year(o_orderdate) = 1996""")
def ordinal_stats_check(spark, sf):
    # Ratios large enough that six stored decimals carry the growth figures.
    stats = growth.ordinal_window_stats(_ratios(spark, sf, scale=0.001))
    hit = (F.col("pair") == "5-LOW") & (F.year("numerator_source_date") == 1996)
    return checks.recompute_ordinal_stats(
        stats.withColumn("midrank", F.when(hit, F.lit(-1.0)).otherwise(F.col("midrank")))
    )


@query("growth_check", """SELECT 'GROWTH' AS check_id, series_id || '/' || CAST(d AS VARCHAR) AS key, unnest(['direction', 'yoy_pct']) AS detail FROM
  (SELECT o_orderpriority AS series_id, MAX(CAST(o_orderdate AS DATE)) AS d FROM orders WHERE year(o_orderdate) = 2000 AND quarter(o_orderdate) = 2 GROUP BY 1)""")
def growth_check(spark, sf):
    published = growth.growth_acceleration(quarter_obs(spark, sf).drop("ordinal"))
    hit = (F.year("obs_date") == 2000) & (F.quarter("obs_date") == 2)
    altered = published.withColumn("yoy_pct", F.when(hit, F.lit(1e6)).otherwise(F.col("yoy_pct"))).withColumn(
        "direction", F.when(hit, "SIDEWAYS").otherwise(F.col("direction"))
    )
    return checks.recompute_growth(altered, by=["series_id"])


@query("consecutive_check", """WITH q AS (SELECT DISTINCT o_custkey, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS n FROM orders), l AS (SELECT *, lag(n) OVER (PARTITION BY o_custkey ORDER BY n) AS p FROM q)
  SELECT 'CONSECUTIVE' AS check_id, CAST(o_custkey AS VARCHAR) || '/' || CAST(n AS VARCHAR) AS key, '' AS detail FROM l WHERE n <> p + 1""")
def consecutive_check(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_custkey", (F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1).alias("ordinal")
    ).distinct()
    return checks.check_consecutive(rows, by=["o_custkey"])


@query("twin_series_check", f"""WITH {ORDERS_CTE} SELECT 'TWIN_SERIES' AS check_id, series_id || '/' || CAST(obs_date AS VARCHAR) AS key, 'value' AS detail FROM ob WHERE dayofmonth(obs_date) = 31""")
def twin_series_check(spark, sf):
    obs = order_obs(spark, sf)
    twin = obs.withColumn(
        "value", F.when(F.dayofmonth("obs_date") == 31, F.col("value") * 2).otherwise(F.col("value"))
    )
    return checks.check_twin_series(obs, twin, ["series_id", "obs_date"], ["value"])


@query("clauses_check", f"""WITH {CLAUSE_SQL} SELECT 'CLAUSES' AS check_id, CAST(entity AS VARCHAR) || '/' || clause_id AS key, 'DIFFERENT' AS detail FROM mm WHERE clause_id = 'high' AND met IS NULL""")
def clauses_check(spark, sf):
    again = model.evaluate_clauses(_metrics(spark, sf), _clauses(spark), entity=["entity"])
    hit = (F.col("clause_id") == "high") & F.col("met").isNull()
    published = again.withColumn("met", F.when(hit, F.lit(True)).otherwise(F.col("met")))
    return checks.recompute_clauses(published, again, key=["entity", "clause_id"])


@query("interpretation_check", """SELECT DISTINCT 'INTERPRETATION' AS check_id, o_orderpriority AS key, 'DIFFERENT' AS detail FROM orders WHERE o_orderpriority = '2-HIGH'""")
def interpretation_check(spark, sf):
    good, _ = interpretation.interpretation_router(metric_reads(spark, sf), metric_routing(spark, sf))
    published = good.withColumn(
        "severity", F.when(F.col("metric_id") == "2-HIGH", "EXTREME").otherwise(F.col("severity"))
    )
    return checks.recompute_interpretation(published, good)


@query("ledger_check", """WITH g AS (SELECT DISTINCT CAST(l_linenumber AS VARCHAR) AS g FROM lineitem)
  SELECT 'LEDGER' AS check_id, g || '/5' AS key, 'DIFFERENT' AS detail FROM g UNION ALL SELECT 'LEDGER_FUTURE', g || '/' || w, '' FROM g, (VALUES ('5'), ('20')) t(w)""")
def ledger_check(spark, sf):
    entries = line_entries(spark, sf)
    summary = aggregates.window_summary(entries, entries.select("group_id", "index_date"), by=["group_id"])
    published = summary.withColumn(
        "count_ratio", F.when(F.col("window_days") == 5, F.lit(-1.0)).otherwise(F.col("count_ratio"))
    )
    return checks.recompute_from_ledger(
        published, summary, by=["group_id", "window_days"], as_of="2001-12-02", today="2001-12-01"
    )


@query("bucket_partition_check", f"""WITH {BUCKET_SQL} SELECT 'BUCKET_PARTITION' AS check_id, CAST(accession AS VARCHAR) AS key, unnest(['SUM:sell_count', 'ELIGIBLE']) AS detail FROM bk
  WHERE bucket = 'ALL' AND buy_count > 5""")
def bucket_partition_check(spark, sf):
    totals = aggregates.bucketed_totals(line_transactions(spark, sf), buy="A", sell="R")
    hit = (F.col("bucket") == "ALL") & (F.col("buy_count") > 5)
    altered = totals.withColumn(
        "sell_count", F.when(hit, F.col("sell_count") + 1).otherwise(F.col("sell_count"))
    )
    return checks.check_bucket_partition(altered)


@query("bucket_flag_check", f"""WITH {BUCKET_SQL} SELECT 'BUCKET_FLAG' AS check_id, CAST(accession AS VARCHAR) AS key, bucket AS detail FROM bk JOIN orders ON accession = o_orderkey
  WHERE bucket <> 'ALL' AND bucket <> CASE o_orderstatus WHEN 'F' THEN 'FALSE' ELSE 'TRUE' END""")
def bucket_flag_check(spark, sf):
    totals = aggregates.bucketed_totals(line_transactions(spark, sf), buy="A", sell="R")
    filings = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("accession"),
        F.when(F.col("o_orderstatus") == "F", "FALSE").otherwise("TRUE").alias("flag"),
    )
    return checks.check_flag_matches(totals, filings)


@query("source_consistency_check", """SELECT DISTINCT 'SOURCE_CONSISTENCY' AS check_id, o_orderpriority AS key, 'status' AS detail FROM orders WHERE o_orderpriority = '1-URGENT'""")
def source_consistency_check(spark, sf):
    rollup = aggregates.source_rollup(input_states(spark, sf))
    published = rollup.withColumn(
        "status", F.when(F.col("source_id") == "1-URGENT", "OK").otherwise(F.col("status"))
    )
    return checks.check_source_consistency(published, rollup)


@query("switch_rules_check", """SELECT 'SWITCH_RULES' AS check_id, 'switch-' || o_orderstatus AS key, unnest(['AVAILABLE_BLOCKS', 'BLOCK_IDS', 'EVIDENCE_ONLY_ASSESSMENT', 'TOTAL_BLOCKS']) AS detail FROM (SELECT DISTINCT o_orderstatus FROM orders)""")
def switch_rules_check(spark, sf):
    """A switch per order state, with the blocks of all its orders."""
    ids = table(spark, sf, "orders").select(F.concat(F.lit("switch-"), "o_orderstatus").alias("state"))
    blocks = evidence.default_blocks(ids, "liquidity", keep=["state"]).withColumn(
        "switch_id", F.col("state")
    )
    switches = blocks.groupBy("switch_id").agg(F.count(F.lit(1)).alias("_n")).select(
        "switch_id", F.lit("EVIDENCE_ONLY").alias("mode"), F.lit("WATCH").alias("assessment"),
        F.lit(1).cast("bigint").alias("available_blocks"), (F.col("_n") - 1).alias("total_blocks"),
    )
    return checks.check_switch_rules(switches, blocks, evidence.SWITCH_BLOCKS)


@query("held_series_check", f"""WITH {ORDERS_CTE} SELECT DISTINCT 'HELD_SERIES' AS check_id, series_id AS key, '' AS detail FROM ob WHERE series_id IN ('1-URGENT', '2-HIGH')""")
def held_series_check(spark, sf):
    latest = windows.latest_per_series(order_obs(spark, sf))
    held = latest.where(F.col("series_id").isin("1-URGENT", "2-HIGH"))
    return checks.check_held_series_null(latest, held)


@query("reviewed_recheck", """WITH t AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'alpha' WHEN 'O' THEN 'beta' ELSE 'gamma' END AS co, lpad(CAST(o_custkey AS VARCHAR), 10, '0') || '-' || strftime(o_orderdate, '%y') || '-' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') AS acc FROM orders)
  SELECT 'REVIEWED_ROW' AS check_id, co || '/' || CASE WHEN o_orderpriority = '1-URGENT' THEN 'orders' ELSE 'commitments' END || '/' || acc AS key, 'CHRONOLOGY' AS detail FROM t WHERE o_orderpriority = '5-LOW'
  UNION ALL SELECT 'REVIEWED_ROW', co || '/commitments/' || acc, 'UNIT' FROM t WHERE o_orderpriority = '2-HIGH'
  UNION ALL SELECT 'REVIEWED_ROW', co || '/commitments/' || acc, 'YOY_NOT_COMPARABLE' FROM t WHERE o_orderpriority = '3-MEDIUM'
  UNION ALL SELECT 'REVIEWED_POINT', o_orderpriority || '/' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 'record_count' FROM orders WHERE dayofmonth(o_orderdate) = 10 GROUP BY o_orderpriority, o_orderdate""")
def reviewed_recheck(spark, sf):
    # Both sets of points and the age limit read the spans, so these are stored once, without the columns of the tie alone.
    path = new_table_path(spark, "reviewed-spans")
    joins.entity_spans(typed_reviewed(spark, sf), tie=TIE).drop("period_end", "accession").write.parquet(path)
    spans = spark.read.parquet(path)
    points = aggregates.reviewed_observations(spans)
    published = points.withColumn(
        "record_count",
        F.when(F.dayofmonth("asof_date") == 10, F.col("record_count") + 1).otherwise(F.col("record_count")),
    )
    validated = reviewed.validate_reviewed(
        reviewed_text(spark, sf), entity_ids={"alpha": "11", "beta": "22", "gamma": "33"},
        metrics=["orders", "commitments"], host="www.example.gov", prefix="/Archives/data",
    ).withColumn("violations", F.array_remove("violations", "SOURCE_URL"))
    return checks.recheck_reviewed_records(published, spans, recomputed=points, validated=validated)


CHECKS = (
    "schema_values_check", "domain_check", "increasing_check", "same_attributes_check", "endpoint_checks",
    "position_stats_check", "position_rows_check", "ordinal_stats_check", "growth_check", "consecutive_check",
    "twin_series_check", "clauses_check", "interpretation_check", "ledger_check", "bucket_partition_check",
    "bucket_flag_check", "source_consistency_check", "switch_rules_check", "held_series_check", "reviewed_recheck",
)


@query("publication_check", " UNION ALL ".join(f"SELECT check_id, key, detail FROM ({ORACLES[name]})" for name in CHECKS))
def publication_check(spark, sf):
    """All checks over one publication, as one table of violations."""
    return checks.all_violations([QUERIES[name](spark, sf) for name in CHECKS])


@query("published_when_clean", f"""WITH {ORDERS_CTE} SELECT series_id, CAST(MAX(obs_date) AS VARCHAR) AS obs_date, arg_max(value, obs_date) AS value FROM ob GROUP BY 1""")
def published_when_clean(spark, sf):
    obs = order_obs(spark, sf)
    latest = windows.latest_per_series(obs).join(windows.tail_array(obs), "series_id")
    found = checks.check_endpoint_and_tail(latest, obs)
    root = new_table_path(spark, "publication")
    publication.publish(found, latest.select("series_id", "obs_date", "value"), root)
    return publication.read_published(spark, root)


def publication_tables(spark, sf):
    """One publication: series with their latest rows, positions, ratios, growth, buckets, sources, clauses and reads."""
    obs, positions = order_obs(spark, sf), _positions(spark, sf)
    rollup = aggregates.source_rollup(input_states(spark, sf))
    stored_order = F.row_number().over(Window.partitionBy("series_id").orderBy("obs_date"))
    return {
        "series": obs.withColumn("row_number", stored_order),
        "latest": windows.latest_per_series(obs).join(windows.tail_array(obs), "series_id"),
        "twin": obs, "positions": positions, "position_stats": windows.position_stats(positions),
        "ordinal_stats": growth.ordinal_window_stats(_ratios(spark, sf, scale=0.001)),
        "growth": growth.growth_acceleration(quarter_obs(spark, sf).drop("ordinal")),
        "buckets": aggregates.bucketed_totals(line_transactions(spark, sf), buy="A", sell="R"),
        "sources": rollup, "source_inputs": rollup,
        "clauses": model.evaluate_clauses(_metrics(spark, sf), _clauses(spark), entity=["entity"]),
        "metrics": _metrics(spark, sf), "clause_rules": _clauses(spark),
    }


def publication_checks(t):
    """All checks over the stored tables of one publication."""
    return checks.all_violations([
        checks.check_strictly_increasing(t["series"], by=["series_id"], order="row_number", block_rows=1000),
        checks.check_endpoint_and_tail(t["latest"], t["series"]),
        checks.check_twin_series(t["series"], t["twin"], ["series_id", "obs_date"], ["value"]),
        checks.check_position_rows(t["positions"]),
        checks.recompute_position_stats(t["position_stats"], t["positions"]),
        checks.recompute_ordinal_stats(t["ordinal_stats"]),
        checks.recompute_growth(t["growth"], by=["series_id"]),
        checks.check_bucket_partition(t["buckets"]),
        checks.check_source_consistency(t["sources"], t["source_inputs"]),
        checks.recompute_clauses(
            t["clauses"], model.evaluate_clauses(t["metrics"], t["clause_rules"], entity=["entity"]), key=["entity", "clause_id"]
        ),
    ])


def altered_tables(tables):
    """The same publication with the faults of the single checks, in five of its tables."""
    low, red = F.expr(LOW), F.col("contract") == "R"
    faults = {
        "latest": ("value", low, F.col("value") + 1), "position_stats": ("z_score_3_year", red, F.lit(99.0)),
        "twin": ("value", F.dayofmonth("obs_date") == 31, F.col("value") * 2),
        "buckets": ("sell_count", (F.col("bucket") == "ALL") & (F.col("buy_count") > 5), F.col("sell_count") + 1),
        "sources": ("status", F.col("source_id") == "1-URGENT", F.lit("OK")),
    }
    return {
        name: df.withColumn(faults[name][0], F.when(faults[name][1], faults[name][2]).otherwise(F.col(faults[name][0])))
        if name in faults else df
        for name, df in tables.items()
    }


def publish_twice(spark, sf):
    """A clean publication, then one with faults, which is blocked."""
    root, tables = new_table_path(spark, "snapshots"), publication_tables(spark, sf)
    publication.publish_snapshot(spark, root, tables, publication_checks)
    try:
        # The faults go into what was stored, so no table is worked out again.
        publication.publish_snapshot(spark, root, altered_tables(publication.read_snapshot(spark, root)), publication_checks)
    except publication.PublicationBlocked as blocked:
        return root, blocked
    raise AssertionError("the faults were published")


@query("publication_blocked", " UNION ALL ".join(
    f"SELECT check_id, key, detail FROM ({ORACLES[name]})"
    for name in ("endpoint_checks", "twin_series_check", "position_stats_check", "bucket_partition_check", "source_consistency_check")))
def publication_blocked(spark, sf):
    """What blocked the second publication, over its own stored tables."""
    return publication.blocked_violations(spark, publish_twice(spark, sf)[1])


@query("publication_current", f"""WITH {ORDERS_CTE} SELECT series_id, CAST(MAX(obs_date) AS VARCHAR) AS obs_date, arg_max(value, obs_date) AS value, CAST(1 AS BIGINT) AS snapshot FROM ob GROUP BY 1""")
def publication_current(spark, sf):
    """The latest rows that readers see after it: those of the first."""
    root, _ = publish_twice(spark, sf)
    current = publication.snapshots(spark, root)[-1].number
    return publication.read_snapshot(spark, root)["latest"].select("series_id", "obs_date", "value", F.lit(current).cast("bigint").alias("snapshot"))
