"""Filter, duplicate, merge and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import EVENTS_CTE, ORDERS_CTE, USERS_CTE, event_obs, order_obs, query, table, user_obs
from seriesloom.functions import scalars
from seriesloom.functions.hashing import array_fingerprint, group_fingerprint
from seriesloom.operators import clean, windows
from catalog.common import spread


@query("dedupe_conflicts", """WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS copies,
    min(l_partkey) AS p0, max(l_partkey) AS p1, min(l_quantity) AS q0, max(l_quantity) AS q1,
    min(l_extendedprice) AS e0, max(l_extendedprice) AS e1 FROM lineitem GROUP BY 1, 2)
  SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, p0 AS l_partkey, q0 AS l_quantity,
  e0 AS l_extendedprice, copies, p0 <> p1 OR q0 <> q1 OR e0 <> e1 AS is_conflict FROM k""")
def dedupe_conflicts(spark, sf):
    return clean.fold_duplicates(
        table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"],
        ["l_partkey", "l_quantity", "l_extendedprice"],
    )


@query("conflict_ignoring", """WITH k AS (SELECT user_id, event_type, CAST(ts AS DATE) AS d, count(*) AS copies,
    min(value) AS v0, max(value) AS v1 FROM events GROUP BY 1, 2, 3)
  SELECT user_id, event_type, CAST(d AS VARCHAR) AS obs_date, copies FROM k WHERE v0 <> v1""")
def conflict_ignoring(spark, sf):
    """The event id and the properties are volatile and do not make a conflict."""
    ev = table(spark, sf, "events").withColumn("obs_date", F.to_date("ts"))
    key = ["user_id", "event_type", "obs_date"]
    payload = [c for c in ev.columns if c not in (*key, "event_id", "props", "ts")]
    return clean.conflict_rows(clean.fold_duplicates(ev, key, payload), key)


@query("null_skipped_dedupe", """WITH v AS (SELECT user_id, CAST(ts AS DATE) AS d, CASE WHEN value > 20 THEN value END AS value FROM events)
  SELECT user_id, CAST(d AS VARCHAR) AS obs_date, MIN(value) AS value, count(*) AS copies, MIN(value) <> MAX(value) AS is_conflict
  FROM v WHERE value IS NOT NULL GROUP BY 1, 2""")
def null_skipped_dedupe(spark, sf):
    ev = table(spark, sf, "events").select(
        "user_id", F.to_date("ts").alias("obs_date"), F.when(F.col("value") > 20, F.col("value")).alias("value")
    )
    return clean.dedupe_observations(ev, key=["user_id", "obs_date"])


@query("identity_with_fallback", """WITH i AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'id:' || CAST(o_custkey AS VARCHAR)
    WHEN o_orderstatus = 'O' THEN 'fallback:' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || '|' || o_orderpriority || '|' ||
      strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS identity, o_totalprice FROM orders)
  SELECT identity, count(*) AS copies, MIN(o_totalprice) <> MAX(o_totalprice) AS is_conflict FROM i GROUP BY 1""")
def identity_with_fallback(spark, sf):
    o = table(spark, sf, "orders")
    status = F.col("o_orderstatus")
    stamp = F.when(status == "O", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    rows = o.withColumn(
        "identity",
        clean.operation_identity(
            F.when(status == "F", F.col("o_custkey").cast("string")), F.to_date("o_orderdate"),
            F.col("o_orderpriority"), stamp,
        ),
    )
    return clean.fold_duplicates(rows, ["identity"], ["o_totalprice"]).select(
        "identity", "copies", "is_conflict"
    )


@query("canonical_row_pick", """WITH a AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 10, '0') || '-00-' || lpad(CAST(l_partkey % 1000000 AS VARCHAR), 6, '0') AS accession,
    l_suppkey + l_linenumber - 3 AS cik, l_returnflag AS form FROM lineitem),
  r AS (SELECT accession, cik, form, row_number() OVER (PARTITION BY accession
      ORDER BY CASE WHEN cik <> CAST(substr(accession, 1, 10) AS BIGINT) THEN 1 ELSE 0 END, cik) AS rn,
    count(*) OVER (PARTITION BY accession) AS aliases, min(form) OVER (PARTITION BY accession) AS f0, max(form) OVER (PARTITION BY accession) AS f1 FROM a)
  SELECT accession, CAST(cik AS VARCHAR) AS cik, 'p' || CAST(cik AS VARCHAR) AS path, f0 AS form, aliases, f0 <> f1 AS is_conflict FROM r WHERE rn = 1""")
def canonical_row_pick(spark, sf):
    li = table(spark, sf, "lineitem")
    cik = F.col("l_suppkey") + F.col("l_linenumber") - 3
    rows = li.select(
        F.concat(
            F.lpad(F.col("l_suppkey").cast("string"), 10, "0"), F.lit("-00-"),
            F.lpad((F.col("l_partkey") % 1000000).cast("string"), 6, "0"),
        ).alias("accession"),
        cik.cast("string").alias("cik"), F.concat(F.lit("p"), cik.cast("string")).alias("path"),
        F.col("l_returnflag").alias("form"),
    )
    return clean.canonical_alias_row(rows, metadata=["form"])


@query("latest_restatement", """WITH f AS (SELECT o_custkey AS entity, CAST(o_orderdate AS DATE) AS filed, o_orderstatus, o_orderkey,
    o_totalprice AS value, CASE WHEN o_orderpriority = '1-URGENT' THEN '10-Q/A' ELSE '10-Q' END AS form FROM orders WHERE o_orderstatus <> 'P'),
  m AS (SELECT entity, MAX(filed) AS filed FROM f GROUP BY 1),
  t AS (SELECT f.*, row_number() OVER (PARTITION BY f.entity ORDER BY form DESC, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') DESC) AS rn,
    min(value) OVER (PARTITION BY f.entity) AS v0, max(value) OVER (PARTITION BY f.entity) AS v1 FROM f JOIN m ON f.entity = m.entity AND f.filed = m.filed)
  SELECT entity, CAST(filed AS VARCHAR) AS filed, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS accession, form, value, v0 <> v1 AS is_conflict FROM t WHERE rn = 1""")
def latest_restatement(spark, sf):
    o = table(spark, sf, "orders")
    facts = o.select(
        F.col("o_custkey").alias("entity"), F.col("o_totalprice").alias("value"),
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("accession"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "10-Q/A").otherwise("10-Q").alias("form"),
        F.to_date("o_orderdate").alias("filed"), F.col("o_orderdate").cast("timestamp").alias("accepted_at"),
        F.col("o_orderstatus").alias("status"),
    )
    return clean.latest_restatement(facts, ["entity"], usable=F.col("status") != "P").select(
        "entity", "filed", "accession", "form", "value", "is_conflict"
    )


@query("unique_identity", """WITH d AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, MIN(o_orderkey) AS first_row, count(*) AS n FROM orders GROUP BY 1, 2)
  SELECT o.o_custkey, CAST(d.d AS VARCHAR) AS day, o.o_orderkey AS row_no, d.first_row FROM orders o JOIN d
  ON o.o_custkey = d.o_custkey AND CAST(o.o_orderdate AS DATE) = d.d WHERE n > 1 AND o.o_orderkey <> d.first_row""")
def unique_identity(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_custkey", F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("row_no")
    )
    return clean.duplicate_identities(rows, ["o_custkey", "day"], "row_no")


@query("upsert_latest", f"""WITH {ORDERS_CTE}, c AS (SELECT series_id, obs_date, value * 2 AS value FROM ob WHERE obs_date >= DATE '2001-01-01'),
  u AS (SELECT *, 0 AS p FROM ob UNION ALL SELECT *, 1 FROM c)
  SELECT series_id, CAST(obs_date AS VARCHAR) AS obs_date, arg_max(value, p) AS value FROM u GROUP BY 1, 2""")
def upsert_latest(spark, sf):
    prior = order_obs(spark, sf)
    current = prior.where(F.col("obs_date") >= "2001-01-01").withColumn("value", F.col("value") * 2)
    return clean.upsert_latest(prior, current)


@query("valid_points", """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS d, event_id, CASE WHEN value > 5 THEN value END AS value FROM events)
  SELECT CAST(user_id AS VARCHAR) AS series_id, CAST(d AS VARCHAR) AS obs_date,
  (SELECT value FROM e x WHERE x.user_id = e.user_id AND x.d = e.d ORDER BY event_id DESC LIMIT 1) AS value, MAX(event_id) AS ingest_seq
  FROM e GROUP BY e.user_id, e.d""")
def valid_points(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("series_id"), F.to_date("ts").alias("obs_date"),
        F.when(F.col("value") > 5, F.col("value")).alias("value"), F.col("event_id").alias("ingest_seq"),
    )
    return clean.valid_points(rows)


@query("merge_events", """WITH e AS (SELECT CAST(ts AS DATE) AS d, event_type, event_id, value FROM events)
  SELECT CAST(d AS VARCHAR) AS obs_date, (SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT DISTINCT event_type AS t FROM e x WHERE x.d = e.d)) AS flags,
  arg_max(value, event_id) FILTER (WHERE value > 50) AS amount FROM e GROUP BY d""")
def merge_events(spark, sf):
    rows = table(spark, sf, "events").select(
        F.to_date("ts").alias("obs_date"), F.array("event_type").alias("flags"),
        F.col("event_id").alias("priority"), F.when(F.col("value") > 50, F.col("value")).alias("amount"),
    )
    return clean.merge_events(rows)


@query("merge_audit_rows", """SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS index_date, o_orderpriority AS stage, o_orderstatus AS reason
  FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '2001-08-01' - 44 AND DATE '2001-08-01'""")
def merge_audit_rows(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.to_date("o_orderdate").alias("index_date"), F.col("o_orderpriority").alias("stage"),
        F.col("o_orderstatus").alias("reason"),
    )
    return clean.merge_audit_rows(rows, rows.where("reason = 'F'"), as_of="2001-08-01")


@query("retention_prune", """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS index_date FROM orders
  WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '2001-01-31' - 44 AND DATE '2001-01-31'""")
def retention_prune(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("index_date"))
    return clean.retention_prune(rows, as_of="2001-01-31")


@query("merge_completed_partitions", """WITH p AS (SELECT CAST(o_orderdate AS DATE) AS d, o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS pr FROM orders)
  SELECT CAST(d AS VARCHAR) AS index_date, k AS accession, s AS status FROM p WHERE dayofmonth(d) > 15 AND s <> 'P'
  UNION ALL SELECT CAST(d AS VARCHAR), k, s FROM p WHERE dayofmonth(d) <= 15 AND (s = 'P' OR (s = 'O' AND pr <> '5-LOW'))""")
def merge_completed_partitions(spark, sf):
    """Days up to the 15th are complete. Their master list lacks some prior rows."""
    rows = table(spark, sf, "orders").select(
        F.to_date("o_orderdate").alias("index_date"), F.col("o_orderkey").alias("accession"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("pr"),
    )
    completed = rows.where(F.dayofmonth("index_date") <= 15).select("index_date").distinct()
    master = rows.where("(status = 'O' AND pr <> '5-LOW') OR status = 'P'")
    merged = clean.merge_completed_partitions(
        rows.where("status <> 'P'").drop("pr"), rows.where("status = 'P'").drop("pr"), completed,
        master, payload=["index_date", "status"],
    )
    return merged.select("index_date", "accession", "status")


@query("range_window", f"""WITH {ORDERS_CTE} SELECT series_id, CAST(obs_date AS VARCHAR) AS obs_date, value FROM ob
  WHERE obs_date >= (SELECT MAX(obs_date) FROM ob) - 93""")
def range_window(spark, sf):
    return clean.range_window_filter(order_obs(spark, sf), clean.RANGE_DAYS["3M"])


@query("asof_cutoff", f"""WITH {EVENTS_CTE} SELECT series_id, CAST(obs_date AS VARCHAR) AS obs_date, value FROM ev
  WHERE obs_date <= DATE '2024-01-15'""")
def asof_cutoff(spark, sf):
    return clean.asof_cutoff(event_obs(spark, sf), "2024-01-15")


@query("near_reference_lines", f"""WITH {USERS_CTE}, s AS (SELECT series_id, MIN(value) AS lo, MAX(value) AS hi FROM us GROUP BY 1),
  l AS (SELECT DISTINCT series_id, unnest([0.0::DOUBLE, 50.0, 150.0]) AS line_value FROM us),
  b AS (SELECT l.series_id, line_value, lo, hi, CASE WHEN hi - lo <> 0 THEN hi - lo ELSE greatest(abs(hi) * 0.05, 1.0) END AS band FROM l JOIN s ON l.series_id = s.series_id)
  SELECT series_id, line_value, lo, hi, line_value BETWEEN lo AND hi AS inside,
  line_value BETWEEN lo - band * 1.5 AND hi + band * 1.5 AS near FROM b""")
def near_reference_lines(spark, sf):
    obs = user_obs(spark, sf)
    lines = obs.select("series_id").distinct().select(
        "series_id", F.explode(F.array(F.lit(0.0), F.lit(50.0), F.lit(150.0))).alias("line_value")
    )
    return clean.near_reference_lines(obs, lines)


@query("eligibility_gate", """WITH m AS (SELECT c_name, c_nationkey, c_mktsegment, c_acctbal FROM customer),
  s AS (SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey <> 24)
  SELECT c_name AS metric_id, concat_ws(',', CASE WHEN n_nationkey IS NULL THEN 'unknown source' END,
    CASE WHEN c_acctbal < 0 THEN 'implemented=false' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'availability' END,
    CASE WHEN n_regionkey = 0 THEN 'disabled' END, CASE WHEN n_regionkey = 1 THEN 'rights' END,
    CASE WHEN n_regionkey = 2 AND c_mktsegment = 'MACHINERY' THEN 'series not allowlisted' END) AS blockers,
  CASE WHEN n_regionkey = 2 AND c_mktsegment = 'MACHINERY' THEN 'MACHINERY' ELSE '' END AS not_listed
  FROM m LEFT JOIN s ON c_nationkey = n_nationkey""")
def eligibility_gate(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_name").alias("metric_id"), F.col("c_nationkey").alias("source_id"),
        (F.col("c_acctbal") >= 0).alias("implemented"), F.lit(True).alias("network_enabled"),
        F.when(F.col("c_mktsegment") == "BUILDING", "MANUAL_READY").otherwise("ACTIVE_FREE").alias("availability"),
        F.array("c_mktsegment").alias("series_ids"),
    )
    n = table(spark, sf, "nation").where("n_nationkey <> 24")
    sources = n.select(
        F.col("n_nationkey").alias("source_id"), (F.col("n_regionkey") != 0).alias("enabled"),
        F.lit(True).alias("network_eligible"),
        F.when(F.col("n_regionkey") == 1, "HELD").otherwise("CLEARED").alias("rights_status"),
        F.lit(True).alias("automated_fetch"), F.lit(True).alias("public_redistribution"),
        F.when(
            F.col("n_regionkey") == 2,
            F.array(*[F.lit(x) for x in ("BUILDING", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD")]),
        ).alias("series_allowlist"),
    )
    return clean.eligibility_gate(c, sources).select("metric_id", "blockers", "not_listed")


@query("effective_state", """SELECT c_name AS metric_id, CASE WHEN c_acctbal >= 0 THEN CASE WHEN c_mktsegment = 'BUILDING' THEN 'MANUAL_READY' ELSE 'ACTIVE_FREE' END
    ELSE 'UNAVAILABLE_FREE' END AS effective_availability,
  CASE WHEN c_acctbal < 0 OR c_mktsegment = 'BUILDING' THEN 'NOT_APPLICABLE' END AS effective_health,
  CASE WHEN c_acctbal < 0 OR c_mktsegment = 'BUILDING' THEN 'UNKNOWN' END AS effective_freshness,
  CASE WHEN c_acctbal < 0 THEN 'NOT_IMPLEMENTED' WHEN c_mktsegment = 'BUILDING' THEN 'by hand' END AS effective_reason FROM customer""")
def effective_state(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_name").alias("metric_id"), (F.col("c_acctbal") >= 0).alias("implemented"),
        F.when(F.col("c_mktsegment") == "BUILDING", "MANUAL_READY").otherwise("ACTIVE_FREE").alias("availability"),
        F.lit("by hand").alias("reason"),
    )
    return clean.effective_state(c).select(
        "metric_id", "effective_availability", "effective_health", "effective_freshness", "effective_reason"
    )


@query("privacy_markup_rows", """SELECT page_id FROM pages WHERE lower(html) LIKE '%<script>%' OR lower(url) LIKE '%<script>%'""")
def privacy_markup_rows(spark, sf):
    pages = table(spark, sf, "pages")
    return clean.privacy_projection(
        clean.raw_markup_rows(pages, ["html", "url"], ["<script>"]), ["page_id"]
    )


@query("redacted_text", """SELECT page_id, regexp_replace(url || '?api_key=' || CAST(page_id AS VARCHAR) || '&z=1', '(api_key=)[^&\\s]+', '\\1<redacted>', 'gi') AS masked FROM pages""")
def redacted_text(spark, sf):
    pages = table(spark, sf, "pages")
    dirty = F.concat(F.col("url"), F.lit("?api_key="), F.col("page_id").cast("string"), F.lit("&z=1"))
    return pages.select("page_id", scalars.redact(dirty).alias("masked"))


@query("parsed_numbers", """SELECT doc_id, CASE WHEN lang = 'en' THEN CAST(n_chars AS DOUBLE) WHEN lang = 'de' THEN NULL ELSE n_chars / 1000.0 END AS value,
  CASE WHEN n_chars > 2000 THEN 'TRUE' WHEN n_chars > 1000 THEN 'FALSE' ELSE 'UNKNOWN' END AS flag FROM documents""")
def parsed_numbers(spark, sf):
    """Number text with separators, missing tokens and malformed tokens."""
    d = table(spark, sf, "documents")
    text = (
        F.when(F.col("lang") == "en", F.format_number("n_chars", 0))
        .when(F.col("lang") == "de", F.when(F.col("n_chars") > 500, ".").otherwise("NaN"))
        .otherwise((F.col("n_chars") / 1000.0).cast("string"))
    )
    flag = F.when(F.col("n_chars") > 2000, " True ").when(F.col("n_chars") > 1000, "0").otherwise("")
    return d.select("doc_id", scalars.parse_number(text).alias("value"), scalars.tri_state(flag).alias("flag"))


@query("parsed_dates", """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS xs, CASE WHEN o_orderstatus = 'F' THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS strict,
  CASE WHEN o_orderstatus = 'P' THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS midnight,
  CASE WHEN o_orderstatus = 'O' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS release FROM orders""")
def parsed_dates(spark, sf):
    o = table(spark, sf, "orders")
    day = F.to_date("o_orderdate").cast("string")
    zoned = F.concat(day, F.when(F.col("o_orderstatus") == "F", "").otherwise("+05:30"))
    stamp = F.concat(day, F.when(F.col("o_orderstatus") == "P", "T00:00:00").otherwise("T09:00:00"))
    lag = F.when(F.col("o_orderstatus") == "O", 3).otherwise(9)
    released = F.col("o_orderdate").cast("timestamp")
    return o.select(
        "o_orderkey", scalars.xs_date(zoned).alias("xs"), scalars.strict_date(zoned).alias("strict"),
        scalars.midnight_date(stamp).alias("midnight"),
        scalars.plausible_release(released, F.date_sub(F.to_date("o_orderdate"), lag)).alias("release"),
    )


@query("canonical_alias", """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'treasury' WHEN 'SMALL' THEN 'agency_debt' END AS category FROM part""")
def canonical_alias(spark, sf):
    p = table(spark, sf, "part")
    spelled = F.concat(F.lit(" "), F.initcap("p_type"), F.lit("-x "))
    return p.select(
        "p_partkey", scalars.canonical_alias(spelled, {"economy_x": "treasury", "small_x": "agency_debt"}).alias("category")
    )


@query("document_links", """SELECT o_orderkey, 'https://www.example.gov/Archives/data/' || CAST(o_custkey AS VARCHAR) || '/' || lpad(CAST(o_orderkey AS VARCHAR), 18, '0') || '/doc.htm' AS url,
  concat_ws(',', CASE WHEN o_orderstatus = 'P' THEN 'SCHEME' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'QUERY' END,
    CASE WHEN o_orderpriority = '2-HIGH' THEN 'DOCUMENT' END) AS problems FROM orders""")
def document_links(spark, sf):
    o = table(spark, sf, "orders")
    filing = F.lpad(F.col("o_orderkey").cast("string"), 18, "0")
    good = scalars.document_url(
        "https://www.example.gov/Archives/data", F.col("o_custkey"), filing, F.lit("doc.htm")
    )
    bad = F.when(F.col("o_orderstatus") == "P", F.regexp_replace(good, "^https", "http")).otherwise(good)
    bad = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(bad, F.lit("?a=1"))).otherwise(bad)
    bad = F.when(F.col("o_orderpriority") == "2-HIGH", F.concat(bad, F.lit("/x.pdf"))).otherwise(bad)
    return o.select(
        "o_orderkey", good.alias("url"),
        scalars.document_url_problems(
            bad, host="www.example.gov", prefix="/Archives/data", entity=F.col("o_custkey").cast("string"),
            filing=filing,
        ).alias("problems"),
    )


@query("discovered_minus_completed", """SELECT DISTINCT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day FROM lineitem
  WHERE CAST(l_shipdate AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)""")
def discovered_minus_completed(spark, sf):
    seen = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day"))
    done = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"))
    return clean.set_difference(seen, done, ["day"])


@query("id_set_mismatch", """SELECT DISTINCT o_custkey AS id, 'left' AS only_in FROM orders WHERE o_custkey NOT IN (SELECT c_custkey + 30 FROM customer)
  UNION ALL SELECT c_custkey + 30, 'right' FROM customer WHERE c_custkey + 30 NOT IN (SELECT o_custkey FROM orders)""")
def id_set_mismatch(spark, sf):
    """Customer keys moved on, so that both sides have keys of their own."""
    left = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    right = table(spark, sf, "customer").select((F.col("c_custkey") + 30).alias("id"))
    return clean.set_mismatch(left, right, ["id"])


@query("set_fingerprint", """SELECT doc_id, sha256(array_to_string(list_sort(list_distinct(list_transform(string_split(text, ' '), lambda x: sha256(x)))), chr(10))) AS fingerprint FROM documents""")
def set_fingerprint(spark, sf):
    """Fingerprint over the distinct words of each document, in its own row."""
    words = F.array_distinct(F.transform(F.split("text", " "), lambda w: F.sha2(w, 256)))
    return spread(table(spark, sf, "documents")).select("doc_id", array_fingerprint(words).alias("fingerprint"))


GROUP_LIMBS = " || ':' || ".join(
    f"CAST(sum(CAST(CAST('0x' || substr(h, {1 + 16 * i}, 16) AS UBIGINT) AS HUGEINT)) AS VARCHAR)" for i in range(4)
)


@query("group_fingerprint", f"""WITH h AS (SELECT l_returnflag, sha256(CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR)) AS h FROM lineitem)
  SELECT l_returnflag, sha256(CAST(count(*) AS VARCHAR) || ':' || {GROUP_LIMBS}) AS fingerprint FROM h GROUP BY 1""")
def group_fingerprint_query(spark, sf):
    li = table(spark, sf, "lineitem")
    digest = F.sha2(F.concat_ws("|", "l_orderkey", "l_linenumber"), 256)
    return li.groupBy("l_returnflag").agg(group_fingerprint(digest).alias("fingerprint"))


@query("deterministic_order", f"""WITH {EVENTS_CTE} SELECT series_id, CAST(obs_date AS VARCHAR) AS obs_date, value FROM ev""")
def deterministic_order(spark, sf):
    """A complete sort key at the sink, so that equal inputs give equal files."""
    return event_obs(spark, sf).orderBy("obs_date", F.desc("value"), "series_id")


@query("calendar_flags_by_day", f"""WITH {ORDERS_CTE} SELECT series_id, CAST(obs_date AS VARCHAR) AS obs_date, concat_ws(',',
  CASE WHEN month(obs_date) <> month(obs_date + 1) THEN 'MONTH_END' END,
  CASE WHEN quarter(obs_date) <> quarter(obs_date + 1) THEN 'QUARTER_END' END,
  CASE WHEN year(obs_date) <> year(obs_date + 1) THEN 'YEAR_END' END) AS flags FROM ob""")
def calendar_flags_by_day(spark, sf):
    return order_obs(spark, sf).select(
        "series_id", "obs_date", windows.calendar_end_flags(F.col("obs_date")).alias("flags")
    )


@query("formatted_numbers", """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN '+' ELSE '' END || format('{:,.2f}', c_acctbal) || ' USD' AS label FROM customer""")
def formatted_numbers(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", scalars.signed_number("c_acctbal", 2, "USD").alias("label")
    )
