"""Costly columns are computed once per row, and by compiled code."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from catalog import ruling
from seriesloom.checks import checks
from seriesloom.functions import scalars
from seriesloom.operators import aggregates
from seriesloom.plans import filing_path
from seriesloom.sources import filings, positions, reviewed
from seriesloom.sources.landing import computed_once

PROBLEMS = {"SCHEME", "HOST", "CREDENTIALS", "QUERY", "FRAGMENT", "TRAVERSAL", "DOCUMENT"}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_generator_only_passes_finished_columns_on(spark):
    rows = computed_once(spark.range(5).select("id", F.col("id").alias("a b")), root=F.sqrt("id"), twice=F.col("id") * 2)
    kept = rows.where("root > 1").withColumn("again", F.col("root") + 1)
    assert _plan(kept).count("SQRT(") == 1
    assert not [line for line in _plan(kept).splitlines() if "Generate" in line and "SQRT(" in line]
    assert rows.columns == ["id", "a b", "root", "twice"]
    assert [tuple(r) for r in rows.where("id = 4").collect()] == [(4, 4, 2.0, 8)]


def test_position_fields_are_parsed_in_methods_the_jvm_compiles(spark):
    names = [*positions.COUNT_FIELDS.values(), *positions.PERCENT_FIELDS.values()]
    texts = spark.range(3).select(
        *[F.concat(F.col("id").cast("string"), F.lit(",000")).alias(n) for n in names],
        *[F.col("id").cast("string").alias(n) for n in (
            "id", ":id", ":updated_at", "market_and_exchange_names", "contract_market_name",
            "cftc_contract_market_code", "report_date_as_yyyy_mm_dd", "futonly_or_combined",
        )],
    )
    parsed = positions.parse_position_reports(texts, {"1": ("n", "m")})
    stages = parsed._jdf.queryExecution().debug().codegenToSeq()
    assert all(stages.apply(i)._3().maxMethodCodeSize() < 8000 for i in range(stages.size()))
    assert not [line for line in _plan(parsed).splitlines() if "Generate" in line and "replace(" in line]
    assert sorted(r["open_interest"] for r in parsed.collect()) == [0, 1000, 2000]


def test_fingerprints_are_hashed_only_where_asked_for(spark):
    text = "<SEC-DOCUMENT>\nACCESSION NUMBER: 0000732101-25-004417\n<ACCEPTANCE-DATETIME>20250318163042\n<XML>\n \t<ownershipDocument></ownershipDocument>\r\n</XML>"
    docs = spark.createDataFrame([("0000732101-25-004417", "4", text)], "accession string, form string, payload string")
    parsed = filings.parse_ownership_docs(docs.withColumn("index_date", F.lit("2025-03-18").cast("date")))
    assert _plan(filing_path.audit_rows(parsed)).count("sha2(") == 0
    good, bad = filings.explode_transactions(parsed)
    assert _plan(bad.select("ordinal")).count("sha2(") == 0 and "fingerprint" in good.columns
    # Blanks around the document are no part of it.
    assert parsed.first()["document_sha256"] == hashlib.sha256(b"<ownershipDocument></ownershipDocument>").hexdigest()


def _reviewed(spark, texts):
    names = reviewed.schemas.REVIEWED_COLUMNS
    rows = spark.createDataFrame([tuple(t.get(n, "x") for n in names) for t in texts], ", ".join(f"{n} string" for n in names))
    return reviewed.validate_reviewed(rows, entity_ids={"alpha": "11"}, metrics=["orders"], host="www.example.gov", prefix="/Archives/data")


def test_rules_of_reviewed_rows_are_compiled_and_computed_once(spark):
    validated = _reviewed(spark, [{}, {"reviewer": ""}])
    points = spark.createDataFrame([], "metric_id string, asof_date date, direction string, record_count long, company_count long, comparable_count long")
    spans = spark.createDataFrame([], "metric_id string, company_id string, as_of date, until date")
    plan = _plan(checks.recheck_reviewed_records(points, spans, recomputed=points, validated=validated))
    assert plan.count("CHRONOLOGY") == plan.count("UNIT_WITHOUT_VALUE") == 1 and "lambda" not in plan
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stages = _reviewed(spark, [{}])._jdf.queryExecution().debug().codegenToSeq()
        sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes and max(sizes) < 8000, sizes
    assert "REVIEWER_LENGTH" in validated.collect()[1]["violations"]


def test_blanks_and_line_breaks_of_any_column_are_found(spark):
    values = [None, "", "x", "a b", "a\tb", " a", "a ", " ", "a\n", "\na", "a\rb", "a \nb", "\ta"]
    places = [reviewed.schemas.REVIEWED_COLUMNS[i] for i in (0, 5, -1)]
    got = _reviewed(spark, [{c: v} for c in places for v in values]).collect()
    want = [(v or "") != (v or "").strip(" ") or "\n" in (v or "") or "\r" in (v or "") for _ in places for v in values]
    assert ["WHITESPACE" in r["violations"] for r in got] == want


def test_plain_links_have_the_problems_that_a_parser_finds(spark, monkeypatch):
    good, folder = "https://www.example.gov/Archives/data/11/a1b2/doc.htm", "https://www.example.gov/Archives/data/11/a1b2/"
    links = [
        good, folder + "Doc_1-a.HTML", good + "\n", good + "?x=1", good + "#a", good + "/", good.replace("https", "http"),
        good.replace("www.", "WWW."), good.replace("https://", "https://me@"), good.replace(".gov", ".gov:8"), good.replace("11", "12"),
        folder + ".htm", folder + "a.b.htm", folder + "x/doc.htm", folder + "../doc.htm", folder + "a%20b.htm", folder + "a b.htm", folder, "x", "", None,
    ]
    rows = spark.createDataFrame([(u, e, f) for u in links for e, f in (("11", "a1-b2"), (None, "a1-b2"), ("11", None), ("11", "a1?b2"))], "u string, e string, f string")

    def found(host, prefix):
        got = scalars.document_url_problems("u", host=host, prefix=prefix, entity=F.col("e"), filing=F.col("f"))
        return [r[0] for r in rows.select(got).collect()]

    places = [("www.example.gov", "/Archives/data"), ("www.example.gov", "/Archives/./data"), ("WWW.example.gov", "/Archives/data"), ("", "")]
    quick = [found(*p) for p in places]
    monkeypatch.setattr(scalars, "PLAIN_HOST", r"(?!)")
    assert quick == [found(*p) for p in places]
    assert quick[0][0] == quick[0][4] == [] and PROBLEMS == {c for q in quick for r in q for c in r}


def test_days_of_one_form_only_and_without_a_pattern(spark):
    texts = ["2024-02-29", "2023-02-29", "2024-02-29\n", " 2024-02-29", "2024-2-29", "2024-02-29T00", "", None, "0001-01-01", "9999-12-31"]
    days = spark.createDataFrame([(t,) for t in texts], "t string").select(scalars.strict_date("t").cast("string"))
    assert [r[0] for r in days.collect()] == ["2024-02-29", *[None] * 7, "0001-01-01", "9999-12-31"]
    assert "gettimestamp" not in _plan(days)


def test_totals_are_moved_by_filing_once_and_checked_where_they_are(spark):
    rows = spark.range(40).selectExpr(
        "id % 7 AS accession", "IF(id % 5 = 0, 'UNKNOWN', IF(id % 2 = 0, 'TRUE', 'FALSE')) AS flag", "IF(id % 3 = 0, 'P', 'S') AS code",
        "CAST(id AS decimal(28,6)) AS shares", "CAST(id AS decimal(28,6)) AS dollars")
    totals = aggregates.bucketed_totals(rows)
    assert "Expand" not in _plan(totals) and checks.check_bucket_partition(totals).count() == 0
    whole = {r["accession"]: (r["eligible_count"], r["buy_shares"] + r["sell_shares"]) for r in totals.where("bucket = 'ALL'").collect()}
    assert whole == {a: (len(range(a, 40, 7)), sum(range(a, 40, 7))) for a in range(7)}
    assert totals.where("bucket = 'UNKNOWN'").agg(F.sum("eligible_count")).first()[0] == 8


def test_entries_before_every_window_are_not_joined(spark):
    entries = spark.range(100).selectExpr(
        "CAST(id % 2 AS string) AS g", "date_add(date'2024-01-01', CAST(id AS int)) AS index_date", "id AS issuer", "false AS is_amendment", "'TRUE' AS flag",
        "'ORIGINAL_EFFECTIVE' AS amendment_status", "'PARSED' AS parse_status", "CAST(NULL AS string) AS linked_original",
        *[f"1 AS {s}{n}_count" for s in ("", "false_") for n in ("buy", "sell", "eligible")], "1 AS priced_count",
        *[f"CAST(1 AS decimal(28,6)) AS {n}_dollars" for n in ("buy", "sell")])
    summary = aggregates.window_summary(entries, entries.select("g", "index_date"), by=["g"])
    assert "scalar-subquery" in _plan(summary)
    assert sorted((r["g"], r["window_days"], r["filings_processed"]) for r in summary.collect()) == [("0", 5, 5), ("0", 20, 20), ("1", 5, 5), ("1", 20, 20)]
    assert aggregates.window_summary(entries.limit(0), entries.limit(0).select("g", "index_date"), by=["g"]).count() == 0


def test_records_meet_their_clauses_where_they_are(spark):
    rows = spark.range(9).selectExpr("id AS entity", "IF(id % 2 = 0, '5-LOW', '2-HIGH') AS metric_id", "1D AS value", "'OK' AS status", "'FRESH' AS freshness")
    plan = ruling.model.evaluate_clauses(rows, ruling._clauses(spark), entity=["entity"])._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
