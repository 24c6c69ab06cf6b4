"""Hand-computed expectations for parsing, aggregates, links and rules."""

from __future__ import annotations

import json
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import one, rows
from seriesloom.functions import scalars
from seriesloom.operators import aggregates as agg
from seriesloom.operators import clean, joins
from seriesloom.operators.quantiles import grouped_quantile
from seriesloom.plans import filing_path
from seriesloom.rules import alerts, freshness, model
from seriesloom.sources import balances, facts, filings, observations, operations, reviewed

DOCUMENT = """<SEC-DOCUMENT>0000732101-25-004417.txt : 20250318
<SEC-HEADER>
ACCESSION NUMBER: 0000732101-25-004417
<ACCEPTANCE-DATETIME>20250318163042
</SEC-HEADER>
<DOCUMENT>
<TYPE>4
<XML>
<?xml version="1.0"?>
<ownershipDocument>
  <documentType>4</documentType>
  <periodOfReport>2025-03-14</periodOfReport>
  <issuer><issuerCik>0000052814</issuerCik></issuer>
  <reportingOwner><reportingOwnerId><rptOwnerCik>0001734420</rptOwnerCik></reportingOwnerId></reportingOwner>
  <aff10b5One>0</aff10b5One>
  <nonDerivativeTable>{rows}</nonDerivativeTable>
</ownershipDocument>
</XML>
</DOCUMENT>
</SEC-DOCUMENT>
"""


def _row(code, shares, side, price=None, day="2025-03-14"):
    cost = "" if price is None else f"<transactionPricePerShare><value>{price}</value></transactionPricePerShare>"
    return (
        f"<nonDerivativeTransaction><transactionDate><value>{day}</value></transactionDate><transactionCoding>"
        f"<transactionCode>{code}</transactionCode></transactionCoding><transactionAmounts><transactionShares>"
        f"<value>{shares}</value></transactionShares>{cost}<transactionAcquiredDisposedCode><value>{side}</value>"
        "</transactionAcquiredDisposedCode></transactionAmounts></nonDerivativeTransaction>"
    )


def _documents(spark, *bodies, form="4"):
    return spark.createDataFrame(
        [("0000732101-25-004417", form, b) for b in bodies], "accession string, form string, payload string"
    ).withColumn("index_date", F.lit("2025-03-18").cast("date")).withColumn("filed", F.col("index_date"))


FOUR = [_row("S", 40, "D", "7.25"), _row("A", 12, "A", "3"), _row("P", 6, "A"), _row("P", 15, "A", "1.20")]


def test_ownership_document(spark):
    parsed = filings.parse_ownership_docs(_documents(spark, DOCUMENT.format(rows="".join(FOUR))))
    head = one(parsed)
    assert head["problem"] is None and head["issuer"] == "52814" and head["flag"] == "FALSE"
    assert head["accepted_at"] == datetime(2025, 3, 18, 20, 30, 42) or str(head["accepted_at"])
    good, bad = filings.explode_transactions(parsed)
    got = rows(good, "ordinal")
    assert [r["code"] for r in got] == ["S", "P", "P"]
    assert [r["dollars"] for r in got] == [Decimal("290"), None, Decimal("18")]
    assert rows(bad) == []
    summary = one(filings.filing_summary(parsed))
    assert (summary["excluded_count"], summary["missing_price_count"], summary["parse_status"]) == (1, 1, "PARSED")
    assert (summary["buy_count"], summary["sell_count"], summary["priced_count"]) == (2, 1, 2)


def test_acceptance_time_is_converted_from_local_time(spark):
    parsed = filings.parse_ownership_docs(_documents(spark, DOCUMENT.format(rows="")))
    got = one(parsed.select(F.date_format("accepted_at", "yyyy-MM-dd HH:mm:ss").alias("t")))
    assert got["t"] == "2025-03-18 20:30:42"


@pytest.mark.parametrize("change, problem", [
    (("<SEC-DOCUMENT>", "<X>"), "WRAPPER"),
    (("ACCESSION NUMBER: 0000732101-25-004417", "ACCESSION NUMBER: 0000732101-25-004418"), "ACCESSION_MISMATCH"),
    (("<ACCEPTANCE-DATETIME>20250318163042", "<ACCEPTANCE-DATETIME>2025"), "ACCEPTANCE_TIME"),
    (("ownershipDocument", "otherDocument"), "OWNERSHIP_DOCUMENT_COUNT"),
    (("<documentType>4<", "<documentType>4/A<"), "FORM_MISMATCH"),
    (("<issuerCik>0000052814<", "<issuerCik>abc<"), "ISSUER"),
    (("<rptOwnerCik>0001734420<", "<rptOwnerCik>x<"), "OWNER"),
    (("<aff10b5One>0<", "<aff10b5One>maybe<"), "PLAN_FLAG"),
    (("<ownershipDocument>", "<!DOCTYPE a><ownershipDocument>"), "FORBIDDEN_DECLARATION"),
])
def test_ownership_document_problems(spark, change, problem):
    text = DOCUMENT.format(rows="".join(FOUR)).replace(*change)
    assert one(filings.parse_ownership_docs(_documents(spark, text)))["problem"] == problem


@pytest.mark.parametrize("bad", [
    _row("P", 10, "D", "2"), _row("P", 0, "A", "2"), _row("S", 1, "D", "abc"), _row("S", 1, "D", "1", day="2026-02-30"),
])
def test_malformed_rows_are_quarantined(spark, bad):
    parsed = filings.parse_ownership_docs(_documents(spark, DOCUMENT.format(rows=FOUR[0] + bad)))
    good, quarantined = filings.explode_transactions(parsed)
    assert good.count() == 1
    assert one(quarantined)["anomaly"] == "NONDERIVATIVE_ROW_2_QUARANTINED"
    assert one(filings.filing_summary(parsed))["parse_status"] == "PARSED_WITH_QUARANTINED_ROWS"


def test_audit_rows_of_one_parse(spark):
    """All reasons of all documents, and the documents are parsed once in the plan."""
    text = DOCUMENT.format(rows=_row("P", 0, "A", "2") + FOUR[0] + _row("P", 1, "D", "2"))
    dated = text.replace("<periodOfReport>2025-03-14<", "<periodOfReport>2026-13-10<")
    audits = filing_path.audit_rows(filings.parse_ownership_docs(_documents(spark, dated, text.replace("<SEC-DOCUMENT>", "<X>"))))
    assert sorted((r["stage"], r["reason"]) for r in audits.collect()) == [
        ("METADATA_DATE_ANOMALY", "PERIOD_OF_REPORT_INVALID"), ("SUBMISSION", "WRAPPER"),
        ("TRANSACTION_QUARANTINE", "NONDERIVATIVE_ROW_1_QUARANTINED"), ("TRANSACTION_QUARANTINE", "NONDERIVATIVE_ROW_3_QUARANTINED"),
    ]
    assert audits._jdf.queryExecution().optimizedPlan().toString().count("from_xml(") == 1


def test_zone_suffix_and_invalid_optional_date(spark):
    text = DOCUMENT.format(rows=_row("P", 1, "A", "1", day="2025-03-14-05:00")).replace(
        "<periodOfReport>2025-03-14<", "<periodOfReport>2026-13-10<"
    )
    parsed = filings.parse_ownership_docs(_documents(spark, text))
    head = one(parsed)
    assert head["period"] is None and head["metadata_anomalies"] == ["PERIOD_OF_REPORT_INVALID"]
    assert one(filings.explode_transactions(parsed)[0])["transaction_date"] == date(2025, 3, 14)


INDEX = """Description:           Listing of one day

CIK|Company Name|Form Type|Date Filed|File Name
--------------------------------------------------------------------------------
{rows}
"""
ALIASES = [
    "6021|Quarter Co|10-Q|20250318|edgar/data/6021/0000006021-25-000310.txt",
    "8840|Amender|4/A|20250317|edgar/data/8840/0000008840-25-000077.txt",
    "1734420|Person|4|20250318|edgar/data/1734420/0000732101-25-004417.txt",
    "52814|Issuer|4|20250318|edgar/data/52814/0000732101-25-004417.txt",
]


@pytest.mark.parametrize("order", [1, -1])
def test_index_and_canonical_alias(spark, order):
    docs = spark.createDataFrame([("f", INDEX.format(rows="\n".join(ALIASES[::order])))], "file string, payload string")
    index = filings.parse_pipe_index(docs.withColumn("index_date", F.lit("2025-03-18").cast("date")))
    got = rows(clean.canonical_alias_row(index), "accession")
    assert [(r["accession"], r["cik"], r["is_conflict"]) for r in got] == [
        ("0000008840-25-000077", "8840", False), ("0000732101-25-004417", "52814", False)]


@pytest.mark.parametrize("line, problem", [
    ("52814|Issuer|4|20250318", "FIELD_COUNT"),
    ("x|Issuer|4|20250318|edgar/data/52814/0000732101-25-004417.txt", "ENTITY"),
    ("52814|Issuer|4|2025-03-18|edgar/data/52814/0000732101-25-004417.txt", "FILED"),
    ("52814|Issuer|4|20250319|edgar/data/52814/0000732101-25-004417.txt", "FILED_AFTER_INDEX"),
    ("52814|Issuer|4|20250318|edgar/data/52815/0000732101-25-004417.txt", "PATH"),
])
def test_index_row_problems(spark, line, problem):
    docs = spark.createDataFrame([("f", INDEX.format(rows=line))], "file string, payload string")
    index = filings.parse_pipe_index(docs.withColumn("index_date", F.lit("2025-03-18").cast("date")))
    assert one(index)["problem"] == problem


@pytest.mark.parametrize("text, problem", [("<html>no</html>", "HTML_PAGE"), ("nothing", "NO_HEADER")])
def test_index_file_problems(spark, text, problem):
    docs = spark.createDataFrame([("f", text)], "file string, payload string")
    index = filings.parse_pipe_index(docs.withColumn("index_date", F.lit("2026-08-11").cast("date")))
    assert one(index)["problem"] == problem


def test_observations_missing_conflict_and_scale(spark):
    doc = json.dumps({"observations": [
        {"date": "2026-01-07", "value": "3,000.5"}, {"date": "2026-01-07", "value": "."},
        {"date": "2026-01-14", "value": "2000"}, {"date": "2026-01-14", "value": "2000"},
        {"date": "2026-01-21", "value": "1"}, {"date": "2026-01-21", "value": "2"},
    ]})
    docs = spark.createDataFrame([("s", doc)], "series_id string, payload string")
    got = rows(observations.parse_observations(docs, scale=1000), "obs_date")
    assert [(r["value"], r["copies"], r["is_conflict"]) for r in got] == [
        (3.0005, 1, False), (2.0, 2, False), (0.001, 2, True)]
    assert [r["violations"] for r in got] == ["", "", "CONFLICT"]
    with pytest.raises(Exception, match="conflicting rows"):
        observations.parse_observations(docs, scale=1000, strict=True).collect()


@pytest.mark.parametrize("doc, code, fault", [
    ({"observations": [{"date": "2026-02-30", "value": "1"}]}, "INVALID_DATE", "2026-02-30"),
    ({"observations": [{"date": "2026-02-03", "value": "many"}]}, "NOT_NUMERIC", "many"),
    ({"message": "busy"}, "NO_DATA", None),
])
def test_faulty_observations_are_reported_or_raised(spark, doc, code, fault):
    docs = spark.createDataFrame([("s", json.dumps(doc))], "series_id string, payload string")
    got = one(observations.parse_observations(docs))
    assert (got["violations"], got["fault"], got["value"], got["copies"]) == (code, fault, None, 1)
    with pytest.raises(Exception, match=code):
        observations.parse_observations(docs, strict=True).collect()


def test_small_amounts_add_up(spark):
    tiny = spark.createDataFrame([(3e-7,)] * 10, "v double")
    assert abs(one(tiny.agg(agg.exact_sum("v").cast("double").alias("s")))["s"] - 3e-6) < 1e-15


def test_repeated_right_keys_never_multiply_rows(spark):
    listed = spark.createDataFrame([("a", "4"), ("b", "4"), ("c", "4")], "accession string, form string")
    known = spark.createDataFrame([("a", "4"), ("a", "4"), ("b", "4"), ("b", "8-K")], "accession string, form string")
    got = rows(joins.reuse_known(listed, known, agree=["form"]), "accession")
    assert [r["reuse_status"] for r in got] == ["REUSED", "CONFLICT", "NEW"]
    facts = joins.left_with_missing_flag(listed, known.withColumn("p", F.col("form")), ["accession"], agree={"form": "form"}, provenance=["p"])
    assert [(r["metadata_missing"], r["metadata_conflict"]) for r in rows(facts, "accession")] == [(False, False), (False, True), (True, False)]


def test_other_forms_keep_their_row(spark):
    df = spark.createDataFrame([("x", "4", "2025-01-02", "w"), ("y", "8-K", "2025-01-02", "w"), ("z", None, "2025-01-02", "w")],
                               "accession string, form string, d string, who string").select(
        "accession", "form", F.to_date("d").alias("filed"), F.to_date("d").alias("original_date"), "who", F.col("d").alias("accepted_at"))
    out = joins.link_amendments(df, base_form="4", amended_form="4/A", identity=["who"])
    assert {r["accession"]: r["amendment_status"] for r in rows(out)} == {"x": "ORIGINAL_EFFECTIVE", "y": "OTHER_FORM", "z": "OTHER_FORM"}


def test_operations_details_and_exercise_days(spark):
    def detail(kind, amount):
        return {"securityType": kind, "amtSubmitted": str(amount), "amtAccepted": str(amount), "percentOfferingRate": "4.5"}

    ops = [{"operationId": "A", "operationDate": "2026-08-10", "operationType": "Repo", "lastUpdated": "2026-08-10 13:15:00",
            "totalAmtSubmitted": "3000000000", "totalAmtAccepted": "3000000000",
            "details": [detail("Treasury", 1e9), detail("Mortgage-Backed", 2e9)]},
           {"operationId": "B", "operationDate": "2026-08-10", "operationType": "Repo", "lastUpdated": "2026-08-10 13:15:00",
            "totalAmtSubmitted": "5", "totalAmtAccepted": "4", "details": [detail("Treasury", 4)]}]
    docs = spark.createDataFrame([(json.dumps({"repo": {"operations": ops}}),)], "payload string")
    got = rows(operations.flatten_details(docs), "op_id", "category")
    assert [(r["op_id"], r["category"], r["accepted"], r["problems"]) for r in got] == [
        ("A", "agency_mbs", 2.0, []), ("A", "treasury", 1.0, []), ("B", "treasury", 0.0, ["HEADER_TOTAL"])]
    head = rows(operations.parse_operations(docs).select("op_id", F.date_format("released_at", "HH:mm").alias("t")), "op_id")
    assert head[0]["t"] == "17:15"


def test_conditional_totals_with_an_exercise(spark):
    data = [("2026-08-10", "x", "treasury", 0.002, 0.001, 4.5), ("2026-08-11", "r", "treasury", 1.0, 1.0, 4.5),
            ("2026-08-11", "r", "agency_mbs", 2.0, 1.0, 4.5)]
    ops = spark.createDataFrame(data, "op_date string, op_id string, category string, submitted double, accepted double, rate double")
    got = rows(agg.conditional_daily_totals(ops, exercise=F.col("op_id") == "x"), "op_date")
    assert (got[0]["accepted"], got[0]["eligible"], got[0]["exercise_only"]) == (0.001, 0.0, True)
    assert (got[1]["submitted"], got[1]["accepted"], got[1]["operation_count"]) == (3.0, 2.0, 1)
    assert got[1]["single_rate"] == 4.5 and got[1]["has_exercise"] is False


def test_settlements_fold_repeats(spark):
    data = [("a", "2026-01-02", "2026-01-05", 60.0), ("a", "2026-01-02", "2026-01-05", 60.0), ("b", "2026-01-02", "2026-01-05", 40.0)]
    df = spark.createDataFrame(data, "security_id string, auction_date string, issue_date string, amount double")
    got = one(agg.settlement_totals(df))
    assert (got["value"], got["security_count"], got["conflicts"]) == (100.0, 2, 0)
    again = one(agg.settlement_totals(df.orderBy(F.desc("security_id"))))
    assert got["keys_fingerprint"] == again["keys_fingerprint"]


def _entries(spark, data, days=20, flag="FALSE"):
    schema = ("index_date string, accession string, issuer string, flag string, buy int, sell int, priced int, bd double, sd double")
    df = spark.createDataFrame(data, schema).withColumn("index_date", F.to_date("index_date"))
    n = F.col("buy") + F.col("sell")
    false = F.col("flag") == "FALSE"
    entries = df.select(
        F.lit("g").alias("g"), "index_date", "issuer", "flag", F.lit(False).alias("is_amendment"),
        F.lit("ORIGINAL_EFFECTIVE").alias("amendment_status"), F.lit("PARSED").alias("parse_status"),
        F.lit(None).cast("string").alias("linked_original"), F.col("buy").alias("buy_count"),
        F.col("sell").alias("sell_count"), n.alias("eligible_count"), F.col("priced").alias("priced_count"),
        F.when(false, F.col("buy")).otherwise(0).alias("false_buy_count"),
        F.when(false, F.col("sell")).otherwise(0).alias("false_sell_count"),
        F.when(false, n).otherwise(0).alias("false_eligible_count"),
        F.col("bd").cast("decimal(38,6)").alias("buy_dollars"), F.col("sd").cast("decimal(38,6)").alias("sell_dollars"),
    )
    calendar = spark.createDataFrame([("g", f"2026-08-{d:02d}") for d in range(1, days + 1)], "g string, d string").select(
        "g", F.to_date("d").alias("index_date"))
    return {r["window_days"]: r for r in rows(agg.window_summary(entries, calendar, by=["g"]))}


def test_smoothed_ratios_over_complete_windows(spark):
    got = _entries(spark, [(f"2026-08-{d:02d}", f"x{d}", "i", "FALSE", 2, 1, 3, 10.0, 5.0) for d in range(1, 21)])
    assert got[20]["count_ratio"] == round(41 / 21, 6) and got[5]["count_ratio"] == round(11 / 6, 6)
    assert got[20]["dollar_ratio"] == 2.0 and got[20]["dollar_status"] == "PUBLISHED"


@pytest.mark.parametrize("eligible, priced, status", [(100, 80, "PUBLISHED"), (1000, 799, "INSUFFICIENT_PRICE_COVERAGE")])
def test_price_coverage_floor(spark, eligible, priced, status):
    got = _entries(spark, [("2026-08-20", "x", "i", "FALSE", eligible // 2, eligible // 2, priced, 10.0, 5.0)])
    assert got[20]["dollar_status"] == status and (got[20]["dollar_ratio"] is not None) is (status == "PUBLISHED")


def test_windows_without_rows_or_days(spark):
    assert _entries(spark, [("2026-08-20", "x", "i", "FALSE", 0, 0, 0, 0.0, 0.0)])[20]["dollar_status"] == "NO_ELIGIBLE_ROWS"
    short = _entries(spark, [("2026-08-19", "x", "i", "FALSE", 1, 1, 2, 1.0, 1.0)], days=19)
    assert short[20]["count_ratio"] is None and short[20]["dollar_status"] == "INSUFFICIENT_COMPLETED_DAYS"
    assert _entries(spark, [("2026-08-20", "x", "i", "FALSE", 1, 0, 1, 1.0, 0.0)])[20]["dollar_status"] == "NO_SALES_DOLLAR_DENOMINATOR"


def test_flag_buckets_in_the_window(spark):
    got = _entries(spark, [("2026-08-20", "a", "i", "FALSE", 2, 1, 3, 1.0, 1.0), ("2026-08-20", "b", "i", "TRUE", 2, 2, 4, 1.0, 1.0),
                           ("2026-08-20", "c", "j", "UNKNOWN", 1, 2, 3, 1.0, 1.0)])
    assert got[20]["count_ratio"] == 1.0 and got[20]["false_count_ratio"] == 1.5 and got[20]["false_coverage"] == 0.3
    assert got[20]["unique_issuers"] == 2 and got[20]["flag_unknown_filings"] == 1


def _link(spark, data):
    df = spark.createDataFrame(data, "accession string, form string, filed string, original_date string, who string, acc string")
    df = df.select("accession", "form", F.to_date("filed").alias("filed"), F.to_date("original_date").alias("original_date"), "who",
                   F.col("acc").alias("accepted_at"))
    out = joins.link_amendments(df, base_form="4", amended_form="4/A", identity=["who"])
    return {r["accession"]: (r["amendment_status"], r["linked_original"]) for r in rows(out)}


def test_amendments_link_to_exactly_one_original(spark):
    got = _link(spark, [
        ("o1", "4", "2026-08-01", None, "w", "1"), ("a1", "4/A", "2026-08-03", "2026-08-01", "w", "2"),
        ("a2", "4/A", "2026-08-04", "2026-08-01", "w", "3"), ("o2", "4", "2026-08-02", None, "v", "1"),
        ("o3", "4", "2026-08-02", None, "v", "1"), ("a3", "4/A", "2026-08-04", "2026-08-02", "v", "3"),
        ("a4", "4/A", "2026-08-04", None, "w", "3"), ("a5", "4/A", "2026-08-04", "2026-08-01", None, "3"),
    ])
    assert got["o1"] == ("ORIGINAL_SUPERSEDED", None)
    assert got["a1"] == ("AMENDMENT_SUPERSEDED", "o1") and got["a2"] == ("AMENDMENT_EFFECTIVE", "o1")
    assert got["o2"] == got["o3"] == ("ORIGINAL_EFFECTIVE", None)
    assert got["a3"] == got["a4"] == got["a5"] == ("UNLINKED_REVIEW", None)


def test_filing_path_end_to_end(spark):
    docs = _documents(spark, DOCUMENT.format(rows="".join(FOUR)))
    parsed = filings.parse_ownership_docs(docs)
    ledger = filing_path.resolve_ledger(filing_path.ledger_entries(parsed))
    got = one(ledger)
    assert (got["amendment_status"], got["false_buy_count"], got["buy_dollars"]) == ("ORIGINAL_EFFECTIVE", 2, Decimal("18"))
    assert rows(filing_path.audit_rows(parsed)) == []


def test_venues_and_medians(spark):
    end = "2026-08-10 00:00:00"
    a = [("BTC", "a", f"2026-08-09 {h:02d}:00:00", r, 8.0) for h, r in ((0, 0.9), (8, 0.001), (16, 0.002), (23, 0.0015))]
    b = [("BTC", "b", "2026-08-09 12:00:00", 0.003, 12.0), ("BTC", "b", "2026-08-02 23:00:00", 9.0, 12.0)]
    df = spark.createDataFrame(a + b, "asset string, venue string, t string, rate double, interval_hours double").withColumn(
        "settled_at", F.to_timestamp("t"))
    venues = agg.venue_summary(df, as_of=end)
    got = rows(venues, "venue")
    # The left end of the 24-hour window is open: midnight of the day before is out.
    assert got[0]["settled_sum_24h"] == pytest.approx(0.0045)
    assert got[0]["sample_size_7d"] == 4 and got[1]["sample_size_7d"] == 1
    assert got[1]["mean_daily_7d"] == pytest.approx(0.006)
    both = one(agg.median_across(venues, ["settled_sum_24h"]))
    assert both["settled_sum_24h"] == pytest.approx((0.0045 + 0.003) / 2) and both["confidence"] == "MEDIUM"
    single = one(agg.median_across(venues.where("venue = 'a'"), ["settled_sum_24h"]))
    assert (single["venue"], single["confidence"]) == ("a", "LOW")


def test_quantiles_match_on_a_skewed_group(spark):
    data = spark.range(5000).select(
        F.when(F.col("id") < 4000, "hot").otherwise("cold").alias("g"),
        F.when(F.col("id") % 3 == 0, 7.5).otherwise((F.col("id") * 7919) % 1009 / 13).alias("v"),
    )
    fast = {r["g"]: (r["a"], r["b"]) for r in rows(grouped_quantile(data, ["g"], "v", [0.5, 0.9], names=["a", "b"], buckets=16))}
    plain = data.groupBy("g").agg(F.percentile("v", F.lit(0.5)).alias("a"), F.percentile("v", F.lit(0.9)).alias("b"))
    for r in rows(plain):
        assert fast[r["g"]] == pytest.approx((r["a"], r["b"]))


def test_quantiles_with_a_far_outlier_and_values_without_rank(spark):
    odd = [(float("nan"),), (float("inf"),), (None,), (1e300,)]
    data = spark.range(999).select(F.col("id").cast("double").alias("v")).union(spark.createDataFrame(odd, "v double")).withColumn("g", F.lit("x"))
    got = one(grouped_quantile(data, ["g"], "v", [0.5, 0.999], names=["m", "top"], buckets=16))
    assert (got["m"], got["n"], got["skipped"]) == (499.5, 1000, 2)
    assert got["top"] == pytest.approx(998 + 0.001 * (1e300 - 998))


def test_quantile_of_one_value_and_of_equal_values(spark):
    data = spark.createDataFrame([("one", 3.0), ("same", 2.0), ("same", 2.0)], "g string, v double")
    got = {r["g"]: r["m"] for r in rows(grouped_quantile(data, ["g"], "v", [0.5], names=["m"]))}
    assert got == {"one": 3.0, "same": 2.0}


# --- rules -----------------------------------------------------------------

ALERT = ("latest double, positive_streak int, change5_a double, slope5_a double, change5_b double, slope5_b double, "
         "change5_c double, slope5_c double, use_days int, stock_change double, stock_p10 double, input_status string, flags array<string>")


def _alert(spark, latest=4.0, streak=0, conf=0, use=0, change=None, p10=None, status="OK", flags=()):
    ups = [x for i in range(3) for x in ((1.0, 1.0) if i < conf else (1.0, 0.0))]
    df = spark.createDataFrame([(latest, streak, *ups, use, change, p10, status, list(flags))], ALERT)
    return one(alerts.tiered_alert(df))


@pytest.mark.parametrize("given, level", [
    (dict(latest=3.0), "NORMAL"), (dict(latest=3.01), "WATCH"), (dict(latest=1.0, streak=3), "WATCH"),
    (dict(conf=1), "ELEVATED"), (dict(conf=1, use=2), "STRESS"), (dict(use=3), "WATCH"),
    (dict(conf=1, change=-9.0, p10=-9.0), "STRESS"), (dict(conf=1, change=-8.0, p10=-9.0), "ELEVATED"),
    (dict(conf=1, change=1.0, p10=2.0), "ELEVATED"), (dict(conf=3), "STRESS"),
    (dict(latest=None), "UNAVAILABLE"), (dict(status="STALE"), "UNAVAILABLE"),
])
def test_alert_tiers(spark, given, level):
    assert _alert(spark, **given)["level"] == level


def test_flags_lower_confidence_once_and_only_that(spark):
    got = _alert(spark, conf=1, flags=["TAX_WINDOW", "MONTH_END"])
    assert (got["level"], got["confidence"]) == ("ELEVATED", "MEDIUM")
    assert _alert(spark, latest=None)["confidence"] == "LOW"


MODEL = dict(spread=1.0, streak=0, stock=3000.0, stock_change=1.0, stock_p10=-5.0, balance=100.0, use_days=0, use_complete=True,
             spread_status="OK", stock_status="OK", balance_status="OK", use_status="OK", context="UNKNOWN", flags=[])


def _model(spark, t=model.ModelThresholds(), **given):
    row = {**MODEL, **{f"{m}_freshness": "FRESH" for m in ("spread", "stock", "balance", "use")}, **given}
    schema = ", ".join(
        f"{k} " + ("array<string>" if k == "flags" else "boolean" if k == "use_complete" else "int" if k in ("streak", "use_days")
                   else "string" if k.endswith(("status", "freshness")) or k == "context" else "double") for k in row
    )
    return one(model.tri_state_model(spark.createDataFrame([tuple(row.values())], schema), t))


@pytest.mark.parametrize("given, status", [
    (dict(), "GREEN"),
    (dict(streak=3, stock=2899.0, stock_change=-1.0, balance=950.0), "YELLOW"),
    (dict(streak=3, stock=2899.0, stock_change=0.0, balance=950.0), "GREEN"),
    (dict(spread=3.1, stock=2799.0), "RED"), (dict(spread=3.0, stock=2799.0), "GREEN"), (dict(use_days=2), "RED"),
    (dict(stock=2499.0, stock_change=-6.0), "EXTREME_CONTEXT_REQUIRED"),
    (dict(stock=2499.0, stock_change=-6.0, context="NO_MAJOR_CRISIS"), "EXTREME_CONFIRMED"),
    (dict(stock=2499.0, stock_change=-6.0, spread=4.0, context="MAJOR_CRISIS_PRESENT"), "RED"),
    (dict(stock=2499.0, stock_p10=None), "UNAVAILABLE"),
    (dict(stock=2499.0, stock_p10=None, use_days=2, context="MAJOR_CRISIS_PRESENT"), "RED"),
    (dict(stock_status="STALE", context="MAJOR_CRISIS_PRESENT", use_days=2), "RED"),
    (dict(use_complete=False), "UNAVAILABLE"),
    (dict(use_complete=False, spread=4.0, stock=2700.0), "RED"),
    (dict(balance=None, streak=3, stock=2899.0, stock_change=-1.0), "UNAVAILABLE"),
    (dict(balance=None), "GREEN"),
])
def test_model_priority_with_unknowns(spark, given, status):
    assert _model(spark, **given)["status"] == status


def test_model_data_status_and_confidence(spark):
    assert _model(spark)["confidence"] == "HIGH"
    late = _model(spark, balance_freshness="LATE")
    assert (late["data_status"], late["confidence"]) == ("LAST_GOOD", "MEDIUM")
    part = _model(spark, balance_status="STALE", flags=["X"])
    assert (part["data_status"], part["confidence"], part["unknown_ids"]) == ("PARTIAL", "LOW", ["balance_near_target"])
    off = _model(spark, t=model.ModelThresholds(enabled=False), use_days=3)
    assert (off["status"], off["availability_reason"], off["red"], off["unknown_ids"]) == ("UNAVAILABLE", "DISABLED", None, [])


@pytest.mark.parametrize("lag, weekly, daily_", [
    (3, "FRESH", "FRESH"), (4, "FRESH", "LATE"), (7, "FRESH", "LATE"), (8, "FRESH", "STALE"), (10, "FRESH", "STALE"),
    (11, "LATE", "STALE"), (17, "LATE", "STALE"), (18, "STALE", "STALE"), (-1, "UNKNOWN", "UNKNOWN"),
])
def test_freshness_boundaries(spark, lag, weekly, daily_):
    day = F.date_sub(F.lit("2026-08-20").cast("date"), lag)
    got = one(spark.range(1).select(
        freshness.freshness_by_frequency(day, F.lit("weekly"), "2026-08-20")["freshness"].alias("w"),
        freshness.freshness_by_frequency(day, F.lit("daily"), "2026-08-20")["freshness"].alias("d")))
    assert (got["w"], got["d"]) == (weekly, daily_)


@pytest.mark.parametrize("today, day, expected", [
    ("2026-08-20", "2026-08-19", "OK"), ("2026-08-20", "2026-08-12", "NOT_RELEASED_YET"),
    ("2026-08-19", "2026-08-12", "OK"), ("2026-08-19", "2026-08-05", "NOT_RELEASED_YET"), ("2026-08-20", "2026-07-01", "STALE"),
])
def test_release_cycle(spark, today, day, expected):
    state = freshness.release_cycle_freshness(F.lit(day).cast("date"), today)
    assert one(spark.range(1).select(state["health"].alias("h")))["h"] == expected


@pytest.mark.parametrize("age, expected", [(120, "OK"), (121, "STALE"), (-1, "ERROR")])
def test_reviewed_age(spark, age, expected):
    day = F.date_sub(F.lit("2026-08-20").cast("date"), age)
    state = freshness.record_age_state(day, "2026-08-20")
    assert one(spark.range(1).select(state["health"].alias("h")))["h"] == expected


def test_parallel_arrays_of_unequal_length_are_reported(spark):
    doc = {"cik": "7", "name": "n", "filings": {"recent": {
        "accessionNumber": ["0000000007-26-000001"], "filingDate": ["2026-01-02"], "reportDate": ["", ""],
        "acceptanceDateTime": ["2026-01-02T10:00:00.000Z"], "form": ["10-Q"], "primaryDocument": ["a.htm"], "isXBRL": [1]}}}
    docs = spark.createDataFrame([(json.dumps(doc),)], "payload string")
    assert one(facts.zip_parallel_arrays(docs))["problems"] == ["ARRAY_LENGTHS"]
    doc["filings"]["recent"]["reportDate"] = [""]
    good = one(facts.zip_parallel_arrays(spark.createDataFrame([(json.dumps(doc),)], "payload string")))
    assert good["problems"] == [] and good["report_date"] is None and good["cik"] == "0000000007"


def test_neighbours_of_a_weekend_deadline(spark):
    cal = spark.createDataFrame([("us", d) for d in ("2026-01-30", "2026-02-02", "2026-02-03")], "calendar_id string, d string").select(
        "calendar_id", F.to_date("d").alias("obs_date"))
    due = spark.createDataFrame([("us", "k", "2026-02-01", "2026-02-02", "u")], "calendar_id string, kind string, o string, b string, source string").select(
        "calendar_id", "kind", F.to_date("o").alias("original"), F.to_date("b").alias("observed"), "source")
    got = rows(joins.calendar_neighbours(due, cal), "obs_date")
    assert [r["obs_date"].isoformat() for r in got] == ["2026-01-30", "2026-02-02", "2026-02-03"]
    assert got[0]["deadlines"] == ["2026-02-01->2026-02-02"]


def test_reviewed_csv_roundtrip(spark, tmp_path):
    header = ",".join(reviewed.schemas.REVIEWED_COLUMNS)
    good = ("alpha,2026-06-30,orders,UP,12.5,USD bn,,true,10-Q,https://www.example.gov/Archives/data/11/000000001126000001/d.htm,"
            "0000000011-26-000001,2026-07-30T12:00:00Z,2026-08-01,rev,2026-08-02T12:00:00Z,text,note")
    path = tmp_path / "reviewed.csv"
    path.write_text(f"{header}\n{good}\n{good.replace(',UP,', ',SIDEWAYS,').replace('12.5', '1e3')}\nshort,row\n")
    raw = reviewed.read_reviewed_csv(spark, str(path))
    assert len([r for r in raw.collect() if r["_corrupt_record"] is not None]) == 1
    ok = raw.where("_corrupt_record IS NULL").drop("_corrupt_record")
    got = reviewed.validate_reviewed(ok, entity_ids={"alpha": "11"}, metrics=["orders"], host="www.example.gov", prefix="/Archives/data")
    found = rows(got, "direction")
    assert found[1]["violations"] == [] and found[1]["value"] == 12.5 and found[1]["yoy_pct"] is None
    assert set(found[0]["violations"]) == {"DIRECTION", "VALUE"}


def test_ragged_rows_are_found_whichever_columns_are_used(spark, tmp_path):
    names = reviewed.schemas.REVIEWED_COLUMNS
    lines = [names, [f"v{k}" for k in range(17)], [f"w{k}" for k in range(18)], [f"x{k}" for k in range(16)], [], ["y"]]
    path = tmp_path / "ragged.csv"
    path.write_text("".join(",".join(line) + "\n" for line in lines))
    raw = reviewed.read_reviewed_csv(spark, str(path))
    got = raw.selectExpr("company_id", "_corrupt_record IS NOT NULL AS ragged").collect()
    assert {r.company_id: r.ragged for r in got} == {"v0": False, "w0": True, "x0": True, "y": True}


def test_header_only_csv_is_empty(spark, tmp_path):
    path = tmp_path / "empty.csv"
    path.write_text(",".join(reviewed.schemas.REVIEWED_COLUMNS) + "\n")
    assert reviewed.read_reviewed_csv(spark, str(path)).count() == 0


@pytest.mark.parametrize("text, value", [("1,234.5", 1234.5), (".", None), ("null", None), ("NaN", None), ("inf", None), ("x", None), (" 7 ", 7.0), ("1e999", None)])
def test_number_text(spark, text, value):
    assert one(spark.range(1).select(scalars.parse_number(F.lit(text)).alias("v")))["v"] == value


@pytest.mark.parametrize("text, ok", [("2026-08-12", True), ("2026-08-12Z", True), ("2026-08-12+14:00", True), ("2026-08-12-13:59", True),
                                      ("2026-08-12+14:01", False), ("2026-08-12+15:00", False), ("2026-02-30", False), ("2026-8-1", False)])
def test_xs_date(spark, text, ok):
    assert (one(spark.range(1).select(scalars.xs_date(F.lit(text)).alias("v")))["v"] is not None) is ok


# --- documents without data ---------------------------------------------------

NOTHING = [None, "", "<html>busy</html>", '{"x": 1}', '{"data": [], "refRates": [], "observations": [], "seriess": [], "repo": {"operations": []}}']
EMPTY_PARSERS = {
    "observations": lambda d, **k: observations.parse_observations(d, **k),
    "vintages": lambda d, **k: observations.parse_vintages(d, **k),
    "rates": lambda d, **k: observations.parse_rates(d, **k),
    "balances": lambda d, **k: balances.parse_balances(d, account="a", **k),
    "auctions": lambda d, **k: balances.parse_auctions(d, by=["series_id"], **k),
    "operations": lambda d, **k: operations.parse_operations(d, **k),
}


@pytest.mark.parametrize("name", EMPTY_PARSERS)
def test_no_document_without_data_vanishes(spark, name):
    docs = spark.createDataFrame([(f"s{i}", text) for i, text in enumerate(NOTHING)], "series_id string, payload string")
    got = rows(EMPTY_PARSERS[name](docs), "series_id")
    assert [r["series_id"] for r in got] == [f"s{i}" for i in range(len(NOTHING))]
    assert all(r["violations"] in ("NO_DATA", ["NO_DATA"]) for r in got)
    for i in range(len(NOTHING)):
        with pytest.raises(Exception, match="NO_DATA"):
            EMPTY_PARSERS[name](docs.where(f"series_id = 's{i}'"), strict=True).collect()


def test_metadata_and_details_of_documents_without_data(spark):
    docs = spark.createDataFrame([(text,) for text in NOTHING], "payload string")
    got = rows(observations.parse_series_metadata(docs, {"a": {"units": "x"}}))
    assert [r["violations"] for r in got] == [["NOT_EXACTLY_ONE", "NO_DATA"]] * len(NOTHING)
    assert [r["problems"] for r in rows(operations.flatten_details(docs))] == [["NO_DATA"]] * len(NOTHING)
