"""Parser queries. The landed documents are built by Spark from the given tables,
one document per row, so a parser's work grows with them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalog.common import ORDERS_CTE, order_obs, query, spread, table
from seriesloom import schemas
from seriesloom.session import new_table_path
from seriesloom.sources import (
    balances, facts, filings, observations, operations, positions, reviewed, sinks, state,
)


def js(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def obj(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


# Documents without data: nothing, no text, other fields, an error page, empty lists.
EMPTY = (None, "", '{"x": 1}', "<html>busy</html>", '{"observations": [], "seriess": [], "refRates": [], "data": [], "repo": {"operations": []}}')


def and_empty(docs, *keys):
    """The documents, and for every key one of each kind that holds no data."""
    empty = F.explode(F.array(*[F.lit(p).cast("string") for p in EMPTY])).alias("payload")
    owners = docs.select(*keys).distinct() if keys else docs.sparkSession.range(1)
    return docs.unionByName(owners.select(*keys, empty))


@query("read_observation_json", """SELECT CAST(user_id AS VARCHAR) || '-' || event_type AS series_id,
  CAST(CAST(ts AS DATE) AS VARCHAR) AS obs_date, round(MIN(value) / 1000, 6) AS value, count(*) AS copies,
  MIN(round(value / 1000, 6)) <> MAX(round(value / 1000, 6)) AS is_conflict,
  CASE WHEN MIN(round(value / 1000, 6)) <> MAX(round(value / 1000, 6)) THEN 'CONFLICT' ELSE '' END AS violations, CAST(NULL AS VARCHAR) AS fault FROM events GROUP BY 1, 2
  UNION ALL SELECT CAST(user_id AS VARCHAR) || '-' || event_type, NULL, NULL, count(*), false, 'INVALID_DATE', '2024-13-40' FROM events GROUP BY 1
  UNION ALL SELECT CAST(user_id AS VARCHAR) || '-' || event_type, CAST(CAST(ts AS DATE) AS VARCHAR), NULL, count(*), false, 'NOT_NUMERIC', 'n/a' FROM events GROUP BY 1, 2
  UNION ALL SELECT DISTINCT CAST(user_id AS VARCHAR) || '-' || event_type, NULL, NULL, 5, false, 'NO_DATA', NULL FROM events""")
def read_observation_json(spark, sf):
    ev = table(spark, sf, "events")
    day = F.to_date("ts").cast("string")
    docs = ev.select(
        F.concat_ws("-", "user_id", "event_type").alias("series_id"),
        js(
            observations=F.array(
                obj(date=day, value=F.col("value").cast("string")),
                obj(date=day, value=F.lit(".")),
                obj(date=F.lit("2024-13-40"), value=F.lit("1")),
                obj(date=day, value=F.lit("n/a")),
            )
        ).alias("payload"),
    )
    return observations.parse_observations(and_empty(docs, "series_id"), scale=1000)


@query("read_vintage_json", """WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS series_id,
    CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS value,
    CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) - 1 ELSE DATE '9999-12-31' END AS rend FROM orders),
  g AS (SELECT series_id, d, MIN(value) AS value, MIN(rend) AS rend, count(*) AS copies,
    coalesce(MIN(value) <> MAX(value), false) OR (count(value) > 0 AND count(value) < count(*)) OR MIN(rend) <> MAX(rend) AS is_conflict
    FROM o GROUP BY 1, 2)
  SELECT series_id, CAST(d AS VARCHAR) AS obs_date, value, CAST(d AS VARCHAR) AS realtime_start,
  CAST(rend AS VARCHAR) AS realtime_end, copies, is_conflict, concat_ws(',',
    CASE WHEN is_conflict THEN 'CONFLICT' END, CASE WHEN rend < d THEN 'REALTIME_INVERTED' END) AS violations FROM g
  UNION ALL SELECT DISTINCT series_id, NULL, NULL, NULL, NULL, 5, false, 'NO_DATA' FROM o""")
def read_vintage_json(spark, sf):
    o = table(spark, sf, "orders")
    day = F.to_date("o_orderdate")
    docs = o.select(
        F.col("o_custkey").cast("string").alias("series_id"),
        js(
            observations=F.array(
                obj(
                    date=day.cast("string"),
                    value=F.when(F.col("o_orderstatus") == "P", ".")
                    .otherwise(F.col("o_totalprice").cast("string")),
                    realtime_start=day.cast("string"),
                    realtime_end=F.when(F.col("o_orderstatus") == "F", F.date_sub(day, 1))
                    .otherwise(F.lit("9999-12-31").cast("date")).cast("string"),
                )
            )
        ).alias("payload"),
    )
    return observations.parse_vintages(and_empty(docs, "series_id"))


@query("read_series_metadata", """SELECT c_name AS series_title, c_mktsegment AS series_id, concat_ws(',',
    CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'SERIES_NOT_LISTED' END,
    CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal < 0 THEN 'MISMATCH_UNITS' END,
    CASE WHEN c_nationkey < 5 THEN 'RANGE_INVERTED' END) AS violations FROM customer
  UNION ALL SELECT NULL, NULL, 'NOT_EXACTLY_ONE,NO_DATA' FROM range(5)""")
def read_series_metadata(spark, sf):
    c = table(spark, sf, "customer")
    docs = c.select(
        js(
            seriess=F.array(
                obj(
                    id=F.col("c_mktsegment"), title=F.col("c_name"),
                    units=F.when(F.col("c_acctbal") < 0, "Other").otherwise("Millions"),
                    last_updated=F.lit("2026-07-01T07:31:02-05:00"),
                    observation_start=F.lit("2001-01-01"),
                    observation_end=F.when(F.col("c_nationkey") < 5, "2000-01-01")
                    .otherwise("2026-01-01"),
                )
            )
        ).alias("payload")
    )
    expected = {"BUILDING": {"units": "Millions"}, "MACHINERY": {"units": "Millions"}}
    return observations.parse_series_metadata(and_empty(docs), expected).select(
        F.col("title").alias("series_title"), "series_id", "violations"
    )


@query("vintage_range_check", """WITH m AS (SELECT c_custkey, DATE '1997-01-01' + CAST(c_nationkey AS INTEGER) AS s,
    DATE '2000-01-01' AS e FROM customer)
  SELECT CAST(o_custkey AS VARCHAR) AS series_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS obs_date
  FROM orders JOIN m ON o_custkey = c_custkey WHERE CAST(o_orderdate AS DATE) NOT BETWEEN s AND e""")
def vintage_range_check(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("series_id"), F.to_date("o_orderdate").alias("obs_date")
    )
    meta = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("series_id"),
        F.date_add(F.lit("1997-01-01").cast("date"), "c_nationkey").alias("observation_start"),
        F.lit("2000-01-01").cast("date").alias("observation_end"),
    )
    return observations.outside_metadata_range(rows, meta)


@query("read_rate_json", """WITH r AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS d, value, value > 100 AS off FROM events)
  SELECT series_id, CAST(d AS VARCHAR) AS obs_date, MIN(value) AS value, MIN(off) AS type_mismatch, count(*) AS copies,
  MIN(value) <> MAX(value) OR MIN(off) <> MAX(off) AS is_conflict, concat_ws(',', CASE WHEN MIN(value) <> MAX(value) OR MIN(off) <> MAX(off) THEN 'CONFLICT' END,
    CASE WHEN MIN(off) THEN 'TYPE_MISMATCH' END) AS violations FROM r GROUP BY 1, 2
  UNION ALL SELECT DISTINCT series_id, NULL, NULL, false, 5, false, 'NO_DATA' FROM r""")
def read_rate_json(spark, sf):
    ev = table(spark, sf, "events")
    docs = ev.select(
        F.col("event_type").alias("series_id"),
        js(
            refRates=F.array(
                obj(
                    type=F.when(F.col("value") > 100, "OTHER").otherwise(F.upper("event_type")),
                    effectiveDate=F.to_date("ts").cast("string"),
                    percentRate=F.col("value").cast("string"),
                )
            )
        ).alias("payload"),
    )
    return observations.parse_rates(and_empty(docs, "series_id"))


def _operation_docs(spark, sf):
    o = table(spark, sf, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    a, b = F.floor(cents / 2).cast("bigint"), F.floor(cents / 3).cast("bigint")
    day = F.to_date("o_orderdate").cast("string")

    def detail(name: str, amount: Column) -> Column:
        return obj(
            securityType=F.lit(name), amtSubmitted=amount.cast("string"),
            amtAccepted=amount.cast("string"), percentOfferingRate=F.lit("4.5"),
        )

    header = F.when(F.col("o_orderstatus") == "P", cents - 1).otherwise(cents)
    return o.select(
        js(
            repo=obj(
                operations=F.array(
                    obj(
                        operationId=F.when(
                            F.col("o_orderstatus") != "O", F.col("o_orderkey").cast("string")
                        ),
                        operationDate=day, operationType=F.col("o_orderpriority"),
                        lastUpdated=F.concat(day, F.lit(" 13:15:00")),
                        totalAmtSubmitted=cents.cast("string"),
                        totalAmtAccepted=header.cast("string"),
                        details=F.array(
                            detail("Treasury", a), detail("Agency", b),
                            detail("Mortgage-Backed", cents - a - b),
                        ),
                    )
                )
            )
        ).alias("payload")
    )


RELEASE_SQL = """strftime(timezone('UTC', timezone('America/New_York',
    CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL '13 hours 15 minutes')), '%Y-%m-%d %H:%M:%S')"""
CENTS_SQL = "CAST(round(o_totalprice * 100) AS BIGINT)"


@query("read_operations_json", f"""SELECT CASE WHEN o_orderstatus <> 'O' THEN 'id:' || CAST(o_orderkey AS VARCHAR)
    ELSE 'fallback:' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || '|' || o_orderpriority || '|' || {RELEASE_SQL} END AS identity,
  CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderkey AS VARCHAR) END AS op_id,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS op_date, o_orderpriority AS op_type, {RELEASE_SQL} AS released_at,
  CAST({CENTS_SQL} AS DOUBLE) AS submitted,
  CAST(CASE WHEN o_orderstatus = 'P' THEN {CENTS_SQL} - 1 ELSE {CENTS_SQL} END AS DOUBLE) AS accepted, '' AS violations FROM orders
  UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'NO_DATA' FROM range(5)""")
def read_operations_json(spark, sf):
    return operations.parse_operations(and_empty(_operation_docs(spark, sf)))


@query("flatten_operation_details", f"""WITH c AS (SELECT *, {CENTS_SQL} AS cents FROM orders),
  d AS (SELECT o_orderkey, o_orderstatus, unnest(['treasury', 'agency_debt', 'agency_mbs']) AS category,
    unnest([cents // 2, cents // 3, cents - cents // 2 - cents // 3]) AS amount FROM c)
  SELECT CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderkey AS VARCHAR) END AS op_id, category,
  round(amount / 1000, 6) AS submitted, round(amount / 1000, 6) AS accepted,
  4.5::DOUBLE AS rate, CASE WHEN o_orderstatus = 'P' THEN 'HEADER_TOTAL' ELSE '' END AS problems FROM d
  UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, 'NO_DATA' FROM range(5)""")
def flatten_operation_details(spark, sf):
    rows = operations.flatten_details(and_empty(_operation_docs(spark, sf)), divisor=1e3)
    return rows.select("op_id", "category", "submitted", "accepted", "rate", "problems")


@query("read_balance_rows", """SELECT CAST(c_custkey AS VARCHAR) AS series_id,
  CAST(DATE '2024-01-01' + CAST(c_nationkey AS INTEGER) AS VARCHAR) AS obs_date,
  round(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 1 ELSE c_acctbal END / 1000, 6) AS value,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'open_today_bal' ELSE 'close_today_bal' END AS source_field,
  c_acctbal < 0 AS wrong_account, CAST(1 AS BIGINT) AS copies, false AS is_conflict,
  CASE WHEN c_acctbal < 0 THEN 'WRONG_ACCOUNT' ELSE '' END AS violations FROM customer
  UNION ALL SELECT CAST(c_custkey AS VARCHAR), NULL, NULL, 'close_today_bal', false, 1, false, 'INVALID_DATE,NOT_NUMERIC' FROM customer
  UNION ALL SELECT CAST(c_custkey AS VARCHAR), NULL, NULL, NULL, false, 5, false, 'NO_DATA' FROM customer""")
def read_balance_rows(spark, sf):
    c = table(spark, sf, "customer")
    building = F.col("c_mktsegment") == "BUILDING"
    docs = c.select(
        F.col("c_custkey").cast("string").alias("series_id"),
        js(
            data=F.array(
                obj(
                    record_date=F.date_add(F.lit("2024-01-01").cast("date"), "c_nationkey").cast("string"),
                    account_type=F.when(F.col("c_acctbal") < 0, "Opening").otherwise("Closing"),
                    close_today_bal=F.when(building, "null").otherwise(F.col("c_acctbal").cast("string")),
                    open_today_bal=(F.col("c_acctbal") + 1).cast("string"),
                ),
                obj(
                    record_date=F.lit("2024-02-31"), account_type=F.lit("Closing"),
                    close_today_bal=F.lit("twelve"), open_today_bal=F.lit("1"),
                ),
            )
        ).alias("payload"),
    )
    return balances.parse_balances(and_empty(docs, "series_id"), account="Closing")


AUCTIONS_SQL = """au AS (SELECT CAST(l_partkey AS VARCHAR) AS security_id, CAST(l_shipdate AS DATE) - 7 AS auction_date,
    CAST(l_shipdate AS DATE) AS issue_date, round(l_extendedprice / 1000, 6) AS amount, l_returnflag AS kind,
    l_linestatus AS term FROM lineitem)"""


def _auctions(spark, sf):
    li = table(spark, sf, "lineitem")
    docs = li.select(
        js(
            data=F.array(
                obj(
                    cusip=F.col("l_partkey").cast("string"),
                    auction_date=F.date_sub(F.to_date("l_shipdate"), 7).cast("string"),
                    issue_date=F.to_date("l_shipdate").cast("string"),
                    offering_amt=F.col("l_extendedprice").cast("string"),
                    security_type=F.col("l_returnflag"), security_term=F.col("l_linestatus"),
                )
            )
        ).alias("payload")
    )
    return balances.parse_auctions(and_empty(docs), divisor=1e3)


@query("read_auction_rows", f"""WITH {AUCTIONS_SQL} SELECT security_id, CAST(auction_date AS VARCHAR) AS auction_date,
  CAST(issue_date AS VARCHAR) AS issue_date, MIN(amount) AS amount, MIN(kind) AS kind, MIN(term) AS term,
  count(*) AS copies, MIN(amount) <> MAX(amount) OR MIN(kind) <> MAX(kind) OR MIN(term) <> MAX(term) AS is_conflict,
  CASE WHEN MIN(amount) <> MAX(amount) OR MIN(kind) <> MAX(kind) OR MIN(term) <> MAX(term) THEN 'CONFLICT' ELSE '' END AS violations
  FROM au GROUP BY au.security_id, au.auction_date, au.issue_date
  UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, 5, false, 'NO_DATA'""")
def read_auction_rows(spark, sf):
    return _auctions(spark, sf)


@query("read_position_reports", """WITH r AS (SELECT l_returnflag AS contract, CAST(l_shipdate AS DATE) AS d,
    CAST(floor(l_extendedprice) AS BIGINT) AS oi, CAST(l_quantity AS BIGINT) AS q, l_linenumber AS n, l_tax, l_linestatus, l_discount, l_orderkey FROM lineitem)
  SELECT contract, CAST(d AS VARCHAR) AS obs_date, oi AS open_interest, q AS a_long, CAST(n AS BIGINT) AS a_short,
  CASE WHEN l_discount > 0.05 THEN strftime(CAST(d AS TIMESTAMP) + INTERVAL 3 DAY + INTERVAL '19 hours 30 minutes', '%Y-%m-%d %H:%M:%S') END AS released_at,
  CAST(l_orderkey AS VARCHAR) AS row_id, concat_ws(',',
    CASE WHEN contract = 'R' THEN 'UNLISTED_CONTRACT' END, CASE WHEN contract = 'R' THEN 'CONTRACT_NAME' END,
    CASE WHEN contract = 'R' THEN 'MARKET_NAME' END, CASE WHEN l_linestatus = 'F' THEN 'NOT_FUTURES_ONLY' END,
    CASE WHEN l_tax > 0.06 THEN 'PERCENT_RECONCILIATION' END) AS violations FROM r""")
def read_position_reports(spark, sf):
    li = table(spark, sf, "lineitem")
    oi = F.floor("l_extendedprice").cast("bigint")
    q, n = F.col("l_quantity").cast("bigint"), F.col("l_linenumber").cast("bigint")
    off = F.when(F.col("l_tax") > 0.06, 1.0).otherwise(0.0)
    day = F.to_date("l_shipdate")

    def pct(count: Column, add=None) -> Column:
        value = F.lit(100.0) * count / oi
        return (value if add is None else value + add).cast("string")

    raw = li.select(
        F.lit("r1").alias("id"), F.col("l_orderkey").cast("string").alias(":id"),
        F.when(
            F.col("l_discount") > 0.05,
            F.concat(F.date_add(day, 3).cast("string"), F.lit("T19:30:00Z")),
        ).otherwise(F.concat(F.date_add(day, 30).cast("string"), F.lit("T19:30:00Z"))).alias(":updated_at"),
        F.concat("l_returnflag", F.lit(" MARKET")).alias("market_and_exchange_names"),
        F.concat("l_returnflag", F.lit(" NAME")).alias("contract_market_name"),
        F.col("l_returnflag").alias("cftc_contract_market_code"),
        F.concat(day.cast("string"), F.lit("T00:00:00.000")).alias("report_date_as_yyyy_mm_dd"),
        oi.cast("string").alias("open_interest_all"),
        q.cast("string").alias("asset_mgr_positions_long"), n.cast("string").alias("asset_mgr_positions_short"),
        F.lit("0").alias("asset_mgr_positions_spread"),
        pct(q).alias("pct_of_oi_asset_mgr_long"), pct(n, off).alias("pct_of_oi_asset_mgr_short"),
        n.cast("string").alias("lev_money_positions_long"), q.cast("string").alias("lev_money_positions_short"),
        F.lit("0").alias("lev_money_positions_spread"),
        pct(n).alias("pct_of_oi_lev_money_long"), pct(q).alias("pct_of_oi_lev_money_short"),
        F.when(F.col("l_linestatus") == "F", "Combined").otherwise("FutOnly").alias("futonly_or_combined"),
    )
    contracts = {"A": ("A NAME", "A MARKET"), "N": ("N NAME", "N MARKET")}
    return positions.parse_position_reports(raw, contracts).select(
        "contract", "obs_date", "open_interest", "a_long", "a_short", "released_at", "row_id", "violations"
    )


@query("latest_report_date_check", """WITH r AS (SELECT o_orderpriority AS contract,
    CASE WHEN o_orderpriority = '5-LOW' THEN CAST(o_orderdate AS DATE) - 900 ELSE CAST(o_orderdate AS DATE) END AS d FROM orders)
  SELECT contract, CAST(MAX(d) AS VARCHAR) AS end_date FROM r GROUP BY 1 HAVING MAX(d) < (SELECT MAX(d) FROM r)
  UNION ALL SELECT '9-NONE', NULL""")
def latest_report_date_check(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("contract"),
        F.date_sub(F.to_date("o_orderdate"), F.when(F.col("o_orderpriority") == "5-LOW", 900).otherwise(0)).alias("obs_date"),
    )
    listed = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "9-NONE"]
    return positions.latest_date_mismatch(rows, listed)


# --- filings ---------------------------------------------------------------


def _accession() -> Column:
    return F.concat(
        F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.lit("-"),
        F.date_format("o_orderdate", "yy"), F.lit("-"),
        F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0"),
    )


ACC_SQL = """lpad(CAST(o_custkey AS VARCHAR), 10, '0') || '-' || strftime(o_orderdate, '%y') || '-' ||
    lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0')"""
FORM_SQL = "CASE o_orderstatus WHEN 'F' THEN '4' WHEN 'O' THEN '4/A' ELSE '10-Q' END"


def _form() -> Column:
    return F.when(F.col("o_orderstatus") == "F", "4").when(
        F.col("o_orderstatus") == "O", "4/A"
    ).otherwise("10-Q")


def _index_docs(spark, sf):
    """One index file per order: prologue, header, rule, the filing under two aliases."""
    o = spread(table(spark, sf, "orders"))
    day = F.to_date("o_orderdate")

    def line(cik: Column) -> Column:
        return F.concat_ws(
            "|", cik, F.lit("Name"), _form(), F.date_format(day, "yyyyMMdd"),
            F.concat(F.lit("edgar/data/"), cik, F.lit("/"), _accession(), F.lit(".txt")),
        )

    text = F.concat_ws(
        "\n", F.lit("Description: daily index"), F.lit(""), F.lit(filings.INDEX_HEADER),
        F.lit("-" * 40), line((F.col("o_custkey") + 7).cast("string")),
        line(F.col("o_custkey").cast("string")), F.lit("broken|line"),
    )
    return o.select(
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("file"),
        day.alias("index_date"), text.alias("payload"),
    )


@query("read_pipe_index", f"""WITH o AS (SELECT *, {ACC_SQL} AS acc, {FORM_SQL} AS form FROM orders),
  l AS (SELECT 'f' || CAST(o_orderkey AS VARCHAR) AS file, CAST(o_orderdate AS DATE) AS d, acc, form,
    unnest([o_custkey + 7, o_custkey]) AS cik FROM o WHERE form <> '10-Q')
  SELECT file, CAST(d AS VARCHAR) AS index_date, acc AS accession, CAST(cik AS VARCHAR) AS cik, form, CAST(d AS VARCHAR) AS filed,
  'edgar/data/' || CAST(cik AS VARCHAR) || '/' || acc || '.txt' AS path, CASE WHEN cik = 0 THEN 'ENTITY' END AS problem FROM l
  UNION ALL SELECT 'f' || CAST(o_orderkey AS VARCHAR), CAST(CAST(o_orderdate AS DATE) AS VARCHAR), NULL, NULL, NULL, NULL, NULL, 'FIELD_COUNT' FROM o""")
def read_pipe_index(spark, sf):
    return filings.parse_pipe_index(_index_docs(spark, sf))


@query("discover_daily_files", """WITH n AS (SELECT CAST(ts AS DATE) AS d FROM events WHERE event_type = 'click')
  SELECT CAST(d AS VARCHAR) AS index_date, 'master.' || strftime(d, '%Y%m%d') || '.idx' AS name, count(*) AS listings,
  CASE WHEN count(*) > 1 THEN 'DUPLICATE_LISTING' END AS problem FROM n
  WHERE d BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY d""")
def discover_daily_files(spark, sf):
    kind = F.when(F.col("event_type") == "click", "master").otherwise("form")
    listing = table(spark, sf, "events").select(
        F.concat(kind, F.lit("."), F.date_format("ts", "yyyyMMdd"), F.lit(".idx")).alias("name")
    )
    return filings.discover_daily_files(listing, start="2024-01-05", end="2024-01-20")


def ownership_docs(spark, sf):
    """One submission per order. Its transactions come from the order's own row:
    a purchase, a sale without price, a row with a wrong side and an other code."""
    o = spread(table(spark, sf, "orders"))
    day = F.to_date("o_orderdate").cast("string")
    price = F.col("o_totalprice").cast("string")

    def transaction(code: str, shares: str, side: str, cost: Column | None) -> Column:
        paid = F.lit("") if cost is None else F.concat(
            F.lit("<transactionPricePerShare><value>"), cost,
            F.lit("</value></transactionPricePerShare>"),
        )
        return F.concat(
            F.lit("<nonDerivativeTransaction><transactionDate><value>"), day,
            F.lit(f"</value></transactionDate><transactionCoding><transactionCode>{code}"
                  "</transactionCode></transactionCoding><transactionAmounts><transactionShares>"
                  f"<value>{shares}</value></transactionShares>"), paid,
            F.lit(f"<transactionAcquiredDisposedCode><value>{side}</value>"
                  "</transactionAcquiredDisposedCode></transactionAmounts></nonDerivativeTransaction>"),
        )

    flag = F.when(F.col("o_orderpriority") == "1-URGENT", "<aff10b5One>1</aff10b5One>").when(
        F.col("o_orderpriority") == "2-HIGH", "<aff10b5One>0</aff10b5One>"
    ).otherwise("")
    period = F.when(F.col("o_orderpriority") == "3-MEDIUM", "2026-99-01").otherwise(
        F.concat(day, F.lit("-05:00"))
    )
    original = F.when(
        F.col("o_orderstatus") == "O",
        F.concat(F.lit("<dateOfOriginalSubmission>"), day, F.lit("</dateOfOriginalSubmission>")),
    ).otherwise("")
    xml = F.concat(
        F.lit('<?xml version="1.0"?>\n<ownershipDocument><documentType>'), _form(),
        F.lit("</documentType><periodOfReport>"), period, F.lit("</periodOfReport>"), original, flag,
        F.lit("<issuer><issuerCik>"), F.lpad((F.col("o_custkey") + 1).cast("string"), 10, "0"),
        F.lit("</issuerCik></issuer><reportingOwner><reportingOwnerId><rptOwnerCik>0000000012"
              "</rptOwnerCik></reportingOwnerId></reportingOwner><reportingOwner><reportingOwnerId>"
              "<rptOwnerCik>0000000007</rptOwnerCik></reportingOwnerId></reportingOwner>"
              "<nonDerivativeTable>"),
        transaction("P", "10", "A", price), transaction("S", "2.50", "D", None),
        transaction("P", "3", "D", price), transaction("M", "100", "A", F.lit("1")),
        F.lit("</nonDerivativeTable></ownershipDocument>"),
    )
    text = F.concat(
        F.lit("<SEC-DOCUMENT>x.txt\n<SEC-HEADER>\nACCESSION NUMBER: "), _accession(),
        F.lit("\n<ACCEPTANCE-DATETIME>"), F.date_format("o_orderdate", "yyyyMMdd"),
        F.lit("215501\n</SEC-HEADER>\n<DOCUMENT>\n<TYPE>4\n<XML>\n"), xml,
        F.lit("\n</XML>\n</DOCUMENT>\n</SEC-DOCUMENT>\n"),
    )
    return o.select(
        _accession().alias("accession"), _form().alias("form"), F.to_date("o_orderdate").alias("filed"),
        F.to_date("o_orderdate").alias("index_date"), text.alias("payload"),
    )


FILED_SQL = f"""fd AS (SELECT *, {ACC_SQL} AS accession, {FORM_SQL} AS form, CAST(o_orderdate AS DATE) AS d,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'TRUE' WHEN '2-HIGH' THEN 'FALSE' ELSE 'UNKNOWN' END AS flag
    FROM orders)"""


@query("parse_ownership_docs", f"""WITH {FILED_SQL} SELECT accession, form, CAST(NULL AS VARCHAR) AS problem,
  strftime(timezone('UTC', timezone('America/New_York', CAST(d AS TIMESTAMP) + INTERVAL '21 hours 55 minutes 1 second')), '%Y-%m-%d %H:%M:%S') AS accepted_at,
  CAST(o_custkey + 1 AS VARCHAR) AS issuer, '12,7' AS owners, sha256('12' || chr(10) || '7') AS owner_hash,
  CASE WHEN o_orderpriority <> '3-MEDIUM' THEN CAST(d AS VARCHAR) END AS period,
  CASE WHEN form = '4/A' THEN CAST(d AS VARCHAR) END AS original_date, flag,
  CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'PERIOD_OF_REPORT_INVALID' ELSE '' END AS metadata_anomalies FROM fd""")
def parse_ownership_docs(spark, sf):
    parsed = filings.parse_ownership_docs(ownership_docs(spark, sf))
    return parsed.select(
        "accession", "form", "problem", "accepted_at", "issuer", "owners", "owner_hash", "period",
        "original_date", "flag", "metadata_anomalies",
    )


@query("explode_transactions", f"""WITH {FILED_SQL}, p AS (SELECT accession, d, o_totalprice, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS t FROM fd),
  f AS (SELECT *, rtrim(rtrim(t, '0'), '.') AS pt FROM p)
  SELECT accession, CAST(1 AS BIGINT) AS ordinal, CAST(d AS VARCHAR) AS transaction_date, 'P' AS code, 'A' AS side,
  10.0::DOUBLE AS shares, o_totalprice AS price, round(o_totalprice * 10, 6) AS dollars,
  sha256(CAST(d AS VARCHAR) || '|P|A|10|' || pt) AS fingerprint FROM f
  UNION ALL SELECT accession, 2, CAST(d AS VARCHAR), 'S', 'D', 2.5, NULL, NULL,
  sha256(CAST(d AS VARCHAR) || '|S|D|2.5|MISSING') FROM f""")
def explode_transactions(spark, sf):
    parsed = filings.parse_ownership_docs(ownership_docs(spark, sf))
    return filings.explode_transactions(parsed)[0].select(
        "accession", "ordinal", "transaction_date", "code", "side", "shares", "price", "dollars",
        "fingerprint",
    )


@query("quarantined_transactions", f"""WITH {FILED_SQL} SELECT accession, CAST(3 AS BIGINT) AS ordinal, 'P' AS code,
  'D' AS side, 'NONDERIVATIVE_ROW_3_QUARANTINED' AS anomaly FROM fd""")
def quarantined_transactions(spark, sf):
    parsed = filings.parse_ownership_docs(ownership_docs(spark, sf))
    return filings.explode_transactions(parsed)[1].select(
        "accession", "ordinal", "code", "side", "anomaly"
    )


@query("filing_summary", f"""WITH {FILED_SQL}, p AS (SELECT *, rtrim(rtrim(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '0'), '.') AS pt FROM fd),
  h AS (SELECT accession, list_sort([sha256(CAST(d AS VARCHAR) || '|P|A|10|' || pt), sha256(CAST(d AS VARCHAR) || '|S|D|2.5|MISSING')]) AS prints FROM p)
  SELECT accession, CAST(2 AS BIGINT) AS eligible_count, CAST(1 AS BIGINT) AS excluded_count,
  CAST(1 AS BIGINT) AS missing_price_count, CAST(1 AS BIGINT) AS quarantined_count,
  sha256(array_to_string(prints, chr(10))) AS transactions_hash, 'PARSED_WITH_QUARANTINED_ROWS' AS parse_status FROM h""")
def filing_summary(spark, sf):
    parsed = filings.parse_ownership_docs(ownership_docs(spark, sf))
    return filings.filing_summary(parsed).select(
        "accession", "eligible_count", "excluded_count", "missing_price_count", "quarantined_count",
        "transactions_hash", "parse_status",
    )


# --- facts -----------------------------------------------------------------


@query("read_nested_facts", f"""WITH f AS (SELECT *, {ACC_SQL} AS accn, CAST(o_orderdate AS DATE) AS d FROM orders)
  SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, 'core' AS namespace, tag,
  CAST(d - 90 AS VARCHAR) AS ctx_start, CAST(d AS VARCHAR) AS ctx_end,
  CASE WHEN tag = 'Outflow' THEN o_totalprice ELSE -1.0::DOUBLE END AS value, accn AS accession, '10-Q' AS form,
  CASE WHEN o_orderstatus = 'P' THEN CAST(d - 1 AS VARCHAR) ELSE CAST(d + 30 AS VARCHAR) END AS filed,
  concat_ws(',', CASE WHEN o_orderstatus = 'P' THEN 'FILED_BEFORE_END' END, CASE WHEN tag = 'Additions' THEN 'VALUE' END) AS problems
  FROM f, (VALUES ('Outflow'), ('Additions')) t(tag)""")
def read_nested_facts(spark, sf):
    o = spread(table(spark, sf, "orders"))
    day = F.to_date("o_orderdate")

    def fact(value: Column, form: str) -> Column:
        return obj(
            start=F.date_sub(day, 90).cast("string"), end=day.cast("string"), val=value,
            accn=_accession(), fy=F.year(day), fp=F.lit("Q1"), form=F.lit(form),
            filed=F.when(F.col("o_orderstatus") == "P", F.date_sub(day, 1))
            .otherwise(F.date_add(day, 30)).cast("string"),
        )

    def concept(value: Column) -> Column:
        return obj(
            label=F.lit("l"), description=F.lit("d"),
            units=F.create_map(F.lit("USD"), F.array(fact(value, "10-Q"), fact(value, "8-K"))),
        )

    docs = o.select(
        js(
            cik=F.col("o_custkey").cast("string"), entityName=F.lit("e"),
            facts=F.create_map(
                F.lit("core"),
                F.create_map(
                    F.lit("Outflow"), concept(F.col("o_totalprice")),
                    F.lit("Additions"), concept(F.lit(-1.0)),
                    F.lit("Other"), concept(F.lit(5.0)),
                ),
                F.lit("dei"), F.create_map(F.lit("Outflow"), concept(F.lit(1.0))),
            ),
        ).alias("payload")
    )
    return facts.parse_nested_facts(docs, namespaces=["core"], tags=["Outflow", "Additions"]).select(
        "cik", "namespace", "tag", "ctx_start", "ctx_end", "value", "accession", "form", "filed",
        "problems",
    )


@query("zip_parallel_arrays", f"""WITH f AS (SELECT *, {ACC_SQL} AS accn, CAST(o_orderdate AS DATE) AS d FROM orders)
  SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, CASE WHEN o_orderstatus <> 'P' THEN accn END AS accession,
  CASE WHEN o_orderstatus <> 'P' THEN '10-K' END AS form, CASE WHEN o_orderstatus <> 'P' THEN CAST(d AS VARCHAR) END AS filed,
  CAST(NULL AS VARCHAR) AS report_date, CASE WHEN o_orderstatus <> 'P' THEN strftime(CAST(d AS TIMESTAMP) + INTERVAL 20 HOUR, '%Y-%m-%d %H:%M:%S') END AS accepted_at,
  CASE WHEN o_orderstatus <> 'P' THEN 'a' || CAST(o_orderkey AS VARCHAR) || '.htm' END AS document,
  CASE WHEN o_orderstatus = 'P' THEN 'ARRAY_LENGTHS' ELSE '' END AS problems FROM f""")
def zip_parallel_arrays(spark, sf):
    o = table(spark, sf, "orders")
    day = F.to_date("o_orderdate").cast("string")
    forms = F.when(F.col("o_orderstatus") == "P", F.array(F.lit("10-K"))).otherwise(
        F.array(F.lit("10-K"), F.lit("8-K"))
    )
    recent = obj(
        accessionNumber=F.array(_accession(), F.lit("0000000001-26-000001")),
        filingDate=F.array(day, day), reportDate=F.array(F.lit(""), day),
        acceptanceDateTime=F.array(
            F.concat(day, F.lit("T20:00:00.000Z")), F.concat(day, F.lit("T20:00:00.000Z"))
        ),
        form=forms,
        primaryDocument=F.array(
            F.concat(F.lit("a"), F.col("o_orderkey").cast("string"), F.lit(".htm")), F.lit("b.htm")
        ),
        isXBRL=F.array(F.lit(1), F.lit(1)),
    )
    docs = o.select(
        js(cik=F.col("o_custkey").cast("string"), name=F.lit("n"), filings=obj(recent=recent))
        .alias("payload")
    )
    return facts.zip_parallel_arrays(docs)


# --- reviewed records ------------------------------------------------------


def reviewed_text(spark, sf):
    """Seventeen text columns from the orders, some rows breaking one rule each."""
    o = spread(table(spark, sf, "orders"))
    day = F.to_date("o_orderdate")
    pr = F.col("o_orderpriority")
    company = F.when(F.col("o_orderstatus") == "F", "alpha").when(
        F.col("o_orderstatus") == "O", "beta"
    ).otherwise("gamma")
    number = F.when(company == "alpha", "11").when(company == "beta", "22").otherwise("33")
    url = F.concat(
        F.lit("https://www.example.gov/Archives/data/"), number, F.lit("/"),
        F.regexp_replace(_accession(), "-", ""), F.lit("/doc.htm"),
    )
    return o.select(
        company.alias("company_id"), F.date_sub(day, 30).cast("string").alias("period_end"),
        F.when(pr == "1-URGENT", "orders").otherwise("commitments").alias("metric_id"),
        F.when(F.col("o_totalprice") > 400000, "UP").when(F.col("o_totalprice") > 200000, "DOWN")
        .otherwise("FLAT").alias("direction"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("value"),
        F.when(pr == "2-HIGH", "").otherwise("USD").alias("unit"),
        F.when(pr == "3-MEDIUM", "12.5").otherwise("").alias("yoy_pct"),
        F.when(pr == "3-MEDIUM", "false").otherwise("true").alias("comparable"),
        F.lit("10-Q").alias("source_type"),
        F.when(pr == "4-NOT SPECIFIED", F.concat(url, F.lit("?x=1"))).otherwise(url).alias("source_url"),
        _accession().alias("filing_accession"),
        F.concat(day.cast("string"), F.lit("T12:00:00Z")).alias("filing_accepted_at"),
        F.when(pr == "5-LOW", F.date_sub(day, 3)).otherwise(F.date_add(day, 1)).cast("string").alias("as_of"),
        F.lit("r").alias("reviewer"), F.concat(F.date_add(day, 2).cast("string"), F.lit("T12:00:00Z")).alias("reviewed_at"),
        F.lit("p").alias("paraphrase"), F.lit("n").alias("review_note"), F.col("o_orderkey").alias("row_no"),
    )


@query("validate_reviewed", f"""SELECT CASE o_orderstatus WHEN 'F' THEN 'alpha' WHEN 'O' THEN 'beta' ELSE 'gamma' END AS company_id,
  {ACC_SQL} AS accession, o_totalprice AS value, concat_ws(',', CASE WHEN o_orderstatus = 'P' THEN 'COMPANY' END,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'CHRONOLOGY' END,
    CASE WHEN o_orderstatus = 'P' OR o_orderpriority = '4-NOT SPECIFIED' THEN 'SOURCE_URL' END,
    CASE WHEN o_orderpriority = '2-HIGH' THEN 'UNIT' END,
    CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'YOY_NOT_COMPARABLE' END) AS violations FROM orders""")
def validate_reviewed(spark, sf):
    out = reviewed.validate_reviewed(
        reviewed_text(spark, sf), entity_ids={"alpha": "11", "beta": "22"},
        metrics=["orders", "commitments"], host="www.example.gov", prefix="/Archives/data",
    )
    return out.select("company_id", "accession", "value", "violations")


@query("read_reviewed_csv", f"""SELECT {ACC_SQL} AS accession, CASE o_orderstatus WHEN 'F' THEN 'alpha' WHEN 'O' THEN 'beta' ELSE 'gamma' END AS company_id,
  CASE WHEN o_totalprice > 400000 THEN 'UP' WHEN o_totalprice > 200000 THEN 'DOWN' ELSE 'FLAT' END AS direction,
  CASE WHEN o_orderpriority = '3-MEDIUM' THEN '12.5' END AS yoy_pct, 'n' AS review_note, o_orderpriority = '5-LOW' AS ragged FROM orders""")
def read_reviewed_csv(spark, sf):
    """Records written as CSV without quotes, so that a note with a comma makes its row ragged, and read back."""
    path = new_table_path(spark, "reviewed-csv")
    rows = reviewed_text(spark, sf)
    late = F.col("as_of") < F.substring("filing_accepted_at", 1, 10)
    noted = rows.withColumn("review_note", F.when(late, "n,b").otherwise(F.col("review_note"))).drop("row_no")
    # One column whose name is the header: the writer leaves commas as they are.
    lines = noted.select(F.concat_ws(",", *schemas.REVIEWED_COLUMNS).alias(",".join(schemas.REVIEWED_COLUMNS)))
    lines.write.csv(path, header=True, sep="\u0001")
    return reviewed.read_reviewed_csv(spark, path).select(
        F.col("filing_accession").alias("accession"), "company_id", "direction", "yoy_pct", "review_note",
        F.col("_corrupt_record").isNotNull().alias("ragged"),
    )


def typed_reviewed(spark, sf):
    """The same rows typed, without the deliberate faults."""
    o = table(spark, sf, "orders")
    day = F.to_date("o_orderdate")
    return o.select(
        F.floor(F.col("o_custkey") / 50).cast("string").alias("company_id"), F.col("o_orderpriority").alias("metric_id"),
        F.when(F.col("o_totalprice") > 400000, "UP").when(F.col("o_totalprice") > 200000, "DOWN")
        .when(F.col("o_totalprice") > 20000, "FLAT").otherwise("UNKNOWN").alias("direction"),
        F.date_sub(day, 30).alias("period_end"), (F.col("o_orderstatus") != "P").alias("comparable"),
        F.col("o_orderkey").cast("string").alias("accession"),
        F.date_sub(day, F.when(F.col("o_orderstatus") == "F", -1).otherwise(1)).cast("timestamp").alias("accepted_at"),
        day.alias("as_of"), F.date_add(day, 2).cast("timestamp").alias("reviewed_at"),
    )


TYPED_SQL = """tr AS (SELECT CAST(o_custkey // 50 AS VARCHAR) AS company_id, o_orderpriority AS metric_id,
    CASE WHEN o_totalprice > 400000 THEN 'UP' WHEN o_totalprice > 200000 THEN 'DOWN' WHEN o_totalprice > 20000 THEN 'FLAT'
      ELSE 'UNKNOWN' END AS direction, CAST(o_orderdate AS DATE) - 30 AS period_end, o_orderstatus <> 'P' AS comparable,
    o_orderkey AS ok, CAST(o_orderkey AS VARCHAR) AS accession,
    CAST(o_orderdate AS DATE) + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END AS accepted,
    CAST(o_orderdate AS DATE) AS as_of, CAST(o_orderdate AS DATE) + 2 AS reviewed FROM orders)"""


@query("chronology_check", f"""WITH {TYPED_SQL} SELECT accession, CAST(as_of AS VARCHAR) AS as_of FROM tr
  WHERE NOT (period_end <= accepted AND accepted <= as_of AND as_of <= reviewed)""")
def chronology_check(spark, sf):
    return reviewed.chronology_violations(typed_reviewed(spark, sf)).select("accession", "as_of")


@query("not_future", f"""WITH {TYPED_SQL} SELECT accession FROM tr WHERE reviewed > DATE '2001-01-01'""")
def not_future(spark, sf):
    return reviewed.not_future(typed_reviewed(spark, sf), "2001-01-01 00:00:00").select("accession")


# --- stored state and outputs ----------------------------------------------


@query("read_last_good", f"""WITH {ORDERS_CTE}, st AS (SELECT CASE WHEN series_id = '1-URGENT' THEN 'old-urgent' ELSE series_id END AS stored_id,
    obs_date, value FROM ob WHERE series_id <> '2-HIGH')
  SELECT CASE WHEN stored_id = 'old-urgent' THEN '1-URGENT' ELSE stored_id END AS series_id,
  CAST(obs_date AS VARCHAR) AS obs_date, value, stored_id FROM st""")
def read_last_good(spark, sf):
    obs = order_obs(spark, sf)
    prior = obs.where("series_id <> '2-HIGH'").withColumn(
        "series_id", F.when(F.col("series_id") == "1-URGENT", "old-urgent").otherwise(F.col("series_id"))
    )
    ids = obs.select("series_id").distinct()
    aliases = ids.select("series_id", F.col("series_id").alias("stored_id"), F.lit(0).alias("priority")).unionByName(
        ids.select(
            "series_id",
            F.concat(F.lit("old-"), F.lower(F.split("series_id", "-")[1])).alias("stored_id"),
            F.lit(1).alias("priority"),
        )
    )
    return state.read_last_good(prior, aliases)


@query("reference_table_problems", """SELECT p_brand, CAST(p_size AS BIGINT) AS p_size, count(*) AS rows,
  'DUPLICATE_KEY' AS problem FROM part GROUP BY 1, 2 HAVING count(*) > 1""")
def reference_table_problems(spark, sf):
    return state.reference_table_problems(table(spark, sf, "part"), ["p_brand", "p_size"])


@query("write_latest_rows", f"""WITH {ORDERS_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY obs_date DESC) AS rn FROM ob)
  SELECT series_id, CAST(MAX(obs_date) AS VARCHAR) AS obs_date, MAX(CASE WHEN rn = 1 THEN value END) AS value,
  count(*) FILTER (WHERE rn <= 22) AS tail_points FROM r GROUP BY 1""")
def write_latest_rows(spark, sf):
    return sinks.latest_table(order_obs(spark, sf)).select(
        "series_id", "obs_date", "value", F.size("tail").alias("tail_points")
    )


@query("catalog_rows", """SELECT p_name AS label, CAST(p_partkey AS VARCHAR) AS series_id,
  'series/series_id=' || CAST(p_partkey AS VARCHAR) AS series_path FROM part""")
def catalog_rows(spark, sf):
    registry = table(spark, sf, "part").select(
        F.col("p_name").alias("label"), F.col("p_partkey").cast("string").alias("series_id")
    )
    return sinks.catalog_table(registry)


def _entries(spark, sf):
    return table(spark, sf, "orders").select(
        F.to_date("o_orderdate").alias("index_date"), F.col("o_orderkey").alias("accession"),
        F.col("o_orderstatus").alias("status"),
    )


LIMBS = " || ':' || ".join(
    f"CAST(sum(CAST(CAST('0x' || substr(h, {1 + 16 * i}, 16) AS UBIGINT) AS HUGEINT)) AS VARCHAR)" for i in range(4)
)
ROW_JSON_SQL = """sha256('{"accession":' || CAST(o_orderkey AS VARCHAR) || ',"index_date":"' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR)
    || '","status":"' || o_orderstatus || '"}')"""


@query("shard_manifest", f"""WITH e AS (SELECT CAST(o_orderdate AS DATE) AS d, {ROW_JSON_SQL} AS h FROM orders)
  SELECT CAST(d AS VARCHAR) AS index_date, count(*) AS entries,
  sha256(CAST(count(*) AS VARCHAR) || ':' || {LIMBS}) AS shard_sha256 FROM e GROUP BY d""")
def shard_manifest(spark, sf):
    return sinks.shard_manifest(_entries(spark, sf))


@query("ledger_fingerprint", f"""WITH e AS (SELECT CAST(o_orderdate AS DATE) AS d, {ROW_JSON_SQL} AS h FROM orders),
  m AS (SELECT CAST(d AS VARCHAR) AS d, count(*) AS n, sha256(CAST(count(*) AS VARCHAR) || ':' || {LIMBS}) AS s FROM e GROUP BY e.d),
  l AS (SELECT n, sha256('{{"entries":' || CAST(n AS VARCHAR) || ',"index_date":"' || d || '","shard_sha256":"' || s || '"}}') AS h FROM m)
  SELECT CAST(sum(n) AS BIGINT) AS entry_count, sha256(CAST(count(*) AS VARCHAR) || ':' || {LIMBS}) AS ledger_sha256 FROM l""")
def ledger_fingerprint(spark, sf):
    return sinks.ledger_fingerprint(sinks.shard_manifest(_entries(spark, sf)))


@query("verify_day_shards", """WITH e AS (SELECT CAST(o_orderdate AS DATE) AS d, * FROM orders),
  t AS (SELECT MIN(d) AS first, MAX(d) AS last FROM e)
  SELECT 'SHARD_HASH' AS check_id, CAST(d AS VARCHAR) AS key FROM e WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'P'
    AND d NOT IN (SELECT last FROM t) GROUP BY d
  UNION ALL SELECT 'SHARD_MISSING', CAST(last AS VARCHAR) FROM t""")
def verify_day_shards(spark, sf):
    """A declared manifest against rows of which some changed and one day is gone."""
    entries = _entries(spark, sf)
    declared = sinks.shard_manifest(entries)
    changed = table(spark, sf, "orders").select(
        F.to_date("o_orderdate").alias("index_date"), F.col("o_orderkey").alias("accession"),
        F.when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P"), "X")
        .otherwise(F.col("o_orderstatus")).alias("status"),
    ).withColumn("shard_day", F.col("index_date"))
    last = entries.agg(F.max("index_date")).scalar()
    return sinks.shard_violations(
        changed.where(F.col("index_date") < last), declared,
        columns=["index_date", "accession", "status"],
    )


@query("nested_json_props", """SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n
  FROM events GROUP BY 1, 2""")
def nested_json_props(spark, sf):
    ev = table(spark, sf, "events")
    k = F.try_variant_get(F.parse_json("props"), "$.k", "bigint")
    return ev.groupBy("event_type", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))



MONTH_JSON_SQL = ROW_JSON_SQL.replace("CAST(o_orderdate AS DATE)", "CAST(date_trunc('month', o_orderdate) AS DATE)")


@query("ledger_roundtrip", f"""WITH e AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS d, {MONTH_JSON_SQL} AS h FROM orders)
  SELECT CAST(d AS VARCHAR) AS index_date, count(*) AS entries,
  sha256(CAST(count(*) AS VARCHAR) || ':' || {LIMBS}) AS shard_sha256, CAST(0 AS BIGINT) AS violations FROM e GROUP BY d""")
def ledger_roundtrip(spark, sf):
    """Monthly shards are written, the later ones once more when complete, verified from what is stored, and their manifest read back."""
    path = new_table_path(spark, "ledger")
    rows = _entries(spark, sf).withColumn("index_date", F.trunc("index_date", "month"))
    later = F.col("index_date") >= "1996-01-01"
    sinks.write_day_shards(rows.where(~later | (F.col("accession") % 2 == 0)), path)
    sinks.write_day_shards(rows.where(later), path)
    found = sinks.verify_day_shards(spark, path, columns=["accession", "index_date", "status"])
    per_day = found.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("_n"))
    manifest = sinks.read_manifest(spark, path)
    return manifest.join(per_day, manifest["index_date"].cast("string") == per_day["_key"], "left").select(
        "index_date", "entries", "shard_sha256", F.coalesce("_n", F.lit(0)).alias("violations")
    )


TREE_SQL = f"""e AS (SELECT CAST(o_orderdate AS DATE) AS d, {ROW_JSON_SQL} AS h FROM orders),
  n0 AS (SELECT CAST(d AS VARCHAR) AS node, count(*) AS entries, sha256(CAST(count(*) AS VARCHAR) || ':' || {LIMBS}) AS s FROM e GROUP BY d),
  n1 AS (SELECT node[:7] AS node, sum(entries) AS entries, sha256(string_agg(l, chr(10) ORDER BY l)) AS s FROM (SELECT *, node || ':' || entries || ':' || s AS l FROM n0) GROUP BY 1),
  n2 AS (SELECT node[:4] AS node, sum(entries) AS entries, sha256(string_agg(l, chr(10) ORDER BY l)) AS s FROM (SELECT *, node || ':' || entries || ':' || s AS l FROM n1) GROUP BY 1),
  n3 AS (SELECT '' AS node, sum(entries) AS entries, sha256(string_agg(l, chr(10) ORDER BY l)) AS s FROM (SELECT *, node || ':' || entries || ':' || s AS l FROM n2))"""


@query("hash_tree", f"""WITH {TREE_SQL} SELECT 'days' AS level, node, CAST(entries AS BIGINT) AS entries, s AS shard_sha256 FROM n0
  UNION ALL SELECT 'months', node, CAST(entries AS BIGINT), s FROM n1 UNION ALL SELECT 'years', node, CAST(entries AS BIGINT), s FROM n2
  UNION ALL SELECT 'root', node, CAST(entries AS BIGINT), s FROM n3""")
def hash_tree(spark, sf):
    leaves = sinks.shard_manifest(_entries(spark, sf)).withColumn("index_date", F.col("index_date").cast("string"))
    return sinks.hash_tree(leaves.withColumnRenamed("index_date", "node"))


@query("changed_ledger_days", """SELECT CAST(d AS VARCHAR) AS node, CASE WHEN dayofmonth(d) = 3 THEN 'REMOVED' ELSE 'CHANGED' END AS change
  FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) WHERE dayofmonth(d) = 3 OR month(d) = 2 AND dayofmonth(d) = 14""")
def changed_ledger_days(spark, sf):
    """Days that differ between two ledgers, found from their roots down."""
    def tree(rows):
        leaves = sinks.shard_manifest(rows).withColumn("index_date", F.col("index_date").cast("string"))
        return sinks.hash_tree(leaves.withColumnRenamed("index_date", "node"))

    entries = _entries(spark, sf)
    hit = (F.month("index_date") == 2) & (F.dayofmonth("index_date") == 14)
    other = entries.where(F.dayofmonth("index_date") != 3).withColumn(
        "status", F.when(hit, F.concat("status", F.lit("?"))).otherwise(F.col("status"))
    )
    return sinks.changed_days(tree(entries), tree(other))


@query("series_roundtrip", f"""WITH {ORDERS_CTE} SELECT series_id, CAST(obs_date AS VARCHAR) AS obs_date, value,
  'series/series_id=' || series_id AS series_path FROM ob""")
def series_roundtrip(spark, sf):
    """Every series is written, then read back with the path that the catalogue names for it."""
    base = new_table_path(spark, "published")
    obs = order_obs(spark, sf)
    sinks.write_series(obs, f"{base}/series")
    paths = sinks.catalog_table(obs.select("series_id").distinct())
    return spark.read.parquet(f"{base}/series").join(paths, "series_id").select("series_id", "obs_date", "value", "series_path")
