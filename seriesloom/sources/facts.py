"""Nested fact documents and filing lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom import schemas
from seriesloom.functions.scalars import FILING_ID, any_of, codes, strict_date, utc_timestamp
from seriesloom.operators.clean import fold_duplicates
from seriesloom.sources.landing import parse_json

# Forms whose facts and documents count.
REPORT_FORMS = ("10-K", "10-K/A", "10-Q", "10-Q/A")
SAFE_DOCUMENT = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"


def parse_nested_facts(
    docs: DataFrame, *, namespaces: Sequence[str], tags: Sequence[str], unit: str = "USD",
    forms: Sequence[str] = REPORT_FORMS, payload: str = "payload",
) -> DataFrame:
    """namespace → tag → unit → fact array, as rows with the rules each breaks.

    The maps are filtered before they are exploded, so only the wanted tags
    become rows. Facts on other forms are left out.
    """
    doc = parse_json(docs, schemas.FACTS_DOC, payload)
    keep = [c for c in docs.columns if c != payload]
    wanted_ns = F.map_filter("doc.facts", lambda k, _: k.isin(*namespaces))
    spaces = doc.select(
        *keep, F.lpad(F.col("doc.cik"), 10, "0").alias("cik"), F.explode(wanted_ns)
    ).withColumnRenamed("key", "namespace")
    concepts = spaces.select(
        *keep, "cik", "namespace",
        F.explode(F.map_filter("value", lambda k, _: k.isin(*tags))),
    ).withColumnRenamed("key", "tag")
    facts = concepts.select(
        *keep, "cik", "namespace", "tag",
        (
            (F.size("value.units") != 1) | ~F.map_contains_key("value.units", F.lit(unit))
        ).alias("_units"),
        F.explode(F.try_element_at("value.units", F.lit(unit))).alias("f"),
    ).where(F.col("f.form").isin(*forms))
    start, end, filed = (strict_date(f"f.{n}") for n in ("start", "end", "filed"))
    typed = facts.select(
        *keep, "cik", "namespace", "tag", F.lit(unit).alias("unit"),
        start.alias("ctx_start"), end.alias("ctx_end"), F.col("f.val").alias("value"),
        F.col("f.accn").alias("accession"), F.col("f.fy").alias("fy_filed"),
        F.col("f.fp").alias("fp_filed"), F.col("f.form").alias("form"), filed.alias("filed"),
        F.col("f.frame").alias("frame"), "_units",
    )
    problem = codes(
        [
            (F.col("_units"), "UNITS"),
            (
                any_of([F.col(c).isNull() for c in ("ctx_start", "ctx_end", "filed")]), "DATE",
            ),
            (F.col("ctx_end") < F.col("ctx_start"), "CONTEXT_INVERTED"),
            (F.col("filed") < F.col("ctx_end"), "FILED_BEFORE_END"),
            (~F.coalesce(F.col("accession").rlike(FILING_ID), F.lit(False)), "ACCESSION"),
            (
                F.col("value").isNull() | F.isnan("value") | (F.col("value") < 0), "VALUE",
            ),
            (F.col("fy_filed").isNull(), "FISCAL_YEAR"),
            (
                ~F.coalesce(F.col("fp_filed").isin("Q1", "Q2", "Q3", "FY"), F.lit(False)),
                "FISCAL_PERIOD",
            ),
        ]
    )
    return typed.withColumn("problems", problem).drop("_units")


def fold_facts(facts: DataFrame, *, by: Sequence[str], strict: bool = False) -> DataFrame:
    """One row per (by, context, filing); differing repeats conflict."""
    key = [*by, "ctx_start", "ctx_end", "accession"]
    payload = [c for c in facts.columns if c not in (*key, "problems")]
    return fold_duplicates(facts, key, payload, strict=strict)


def zip_parallel_arrays(
    docs: DataFrame, *, forms: Sequence[str] = REPORT_FORMS, payload: str = "payload",
    structured_only: bool = True,
) -> DataFrame:
    """A struct of equal-length arrays → one row per filing.

    A document whose arrays differ in length yields one row with that problem
    and no filing, rather than rows padded with nulls.
    """
    fields = (
        "accessionNumber", "filingDate", "reportDate", "acceptanceDateTime", "form",
        "primaryDocument",
    ) + (("isXBRL",) if structured_only else ())
    keep = [c for c in docs.columns if c != payload]
    doc = parse_json(docs, schemas.FILING_LIST_DOC, payload).select(
        *keep, F.lpad(F.col("doc.cik"), 10, "0").alias("cik"),
        *[F.col(f"doc.filings.recent.{f}").alias(f) for f in fields],
    )
    first = F.size(fields[0])
    ragged = any_of([F.coalesce(F.size(f) != first, F.lit(True)) for f in fields])
    rows = doc.select(
        *keep, "cik", ragged.alias("_ragged"),
        F.explode_outer(F.when(~ragged, F.arrays_zip(*fields))).alias("f"),
    )
    eligible = F.col("f.form").isin(*forms)
    if structured_only:
        eligible = eligible & (F.col("f.isXBRL") == 1)
    rows = rows.where(F.col("_ragged") | F.coalesce(eligible, F.lit(False)))
    report = F.nullif("f.reportDate", F.lit(""))
    typed = rows.select(
        *keep, "cik", "_ragged",
        F.col("f.accessionNumber").alias("accession"), F.col("f.form").alias("form"),
        strict_date("f.filingDate").alias("filed"), strict_date(report).alias("report_date"),
        utc_timestamp("f.acceptanceDateTime").alias("accepted_at"),
        F.col("f.primaryDocument").alias("document"),
        (report.isNotNull() & strict_date(report).isNull()).alias("_report"),
    )
    good_id = F.coalesce(F.col("accession").rlike(FILING_ID), F.lit(False))
    good_doc = F.coalesce(F.col("document").rlike(SAFE_DOCUMENT), F.lit(False))
    problem = F.when(F.col("_ragged"), F.array(F.lit("ARRAY_LENGTHS"))).otherwise(
        codes(
            [
                (~good_id, "ACCESSION"), (F.col("filed").isNull(), "FILED"),
                (F.col("_report"), "REPORT_DATE"), (F.col("accepted_at").isNull(), "ACCEPTED"),
                (~good_doc, "DOCUMENT_NAME"),
            ]
        )
    )
    return typed.withColumn("problems", problem).drop("_ragged", "_report")
