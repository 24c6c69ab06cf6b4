"""Filing path: daily index files, ownership documents, transactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom import schemas
from seriesloom.functions.hashing import array_fingerprint
from seriesloom.functions.scalars import (
    codes, local_to_utc, optional_date, parse_decimal, tri_state, xs_date,
)
from seriesloom.sources.landing import computed_once, is_html_page

# The header line, file names and paths of a daily index.
INDEX_HEADER = "CIK|Company Name|Form Type|Date Filed|File Name"
INDEX_NAME = r"^master\.(\d{8})\.idx$"
ARCHIVE_PATH = r"^edgar/data/(\d+)/(\d{10}-\d{2}-\d{6})\.txt$"
OWNERSHIP_FORMS = ("4", "4/A")


def quarters_between(start, end) -> Column:
    """The (year, quarter) pairs from start to end, as an array column."""
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    months = F.sequence(
        F.date_trunc("quarter", a).cast("date"), F.date_trunc("quarter", b).cast("date"),
        F.expr("interval 3 months"),
    )
    return F.transform(
        months, lambda d: F.struct(F.year(d).alias("year"), F.quarter(d).alias("quarter"))
    )


def discover_daily_files(listing: DataFrame, *, start, end, name: str = "name") -> DataFrame:
    """Exact daily file names in a date range; other names are ignored. A day
    listed twice is counted, and a name with an impossible date is reported."""
    day_text = F.regexp_extract(name, INDEX_NAME, 1)
    found = listing.where(F.col(name).rlike(INDEX_NAME)).select(
        F.try_to_date(day_text, "yyyyMMdd").alias("index_date"), F.col(name).alias("name")
    )
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    return found.where(
        F.col("index_date").isNull() | F.col("index_date").between(lo, hi)
    ).groupBy("index_date").agg(
        F.min("name").alias("name"), F.count(F.lit(1)).alias("listings")
    ).withColumn(
        "problem",
        F.when(F.col("index_date").isNull(), "INVALID_DATE")
        .when(F.col("listings") > 1, "DUPLICATE_LISTING"),
    )


def parse_pipe_index(
    documents: DataFrame, *, forms: Sequence[str] = OWNERSHIP_FORMS, file: str = "file",
    payload: str = "payload", index_date: str = "index_date",
) -> DataFrame:
    """Rows after the header line of each index file, five fields split on ``|``.

    ``documents`` has one row per index file. The prologue is cut off by the
    header text, so no line needs to know its position in the file. Lines of
    other forms are dropped; every kept or malformed line carries its problems.
    """
    body = F.regexp_replace(F.col(payload), "\r", "")
    after = F.when(
        F.concat(F.lit("\n"), body).contains("\n" + INDEX_HEADER + "\n"),
        F.substring_index(
            F.concat(F.lit("\n"), body), "\n" + INDEX_HEADER + "\n", -1
        ),
    )
    lines = documents.select(
        file, F.col(index_date).alias("index_date"),
        F.when(is_html_page(F.col(payload)), "HTML_PAGE").when(after.isNull(), "NO_HEADER")
        .alias("_file_problem"),
        F.explode_outer(F.split(after, "\n")).alias("line"),
    ).where(
        F.col("_file_problem").isNotNull()
        | ((F.trim("line") != "") & ~F.trim("line").rlike("^-+$"))
    )
    parts = lines.withColumn("_p", F.transform(F.split("line", r"\|"), lambda x: F.trim(x)))
    cik, form, filed, path = (F.col("_p")[i] for i in (0, 2, 3, 4))
    five = F.size("_p") == 5
    safe = parts.select(
        file, "index_date", "_file_problem", "line", five.alias("_five"),
        F.when(five, cik).alias("_cik"), F.when(five, form).alias("form"),
        F.when(five, F.try_to_date(F.when(filed.rlike(r"^\d{8}$"), filed), "yyyyMMdd"))
        .alias("filed"),
        F.when(five, path).alias("path"),
    ).where(F.col("_file_problem").isNotNull() | ~F.col("_five") | F.col("form").isin(*forms))
    number = F.col("_cik").try_cast("bigint")
    path_cik = F.regexp_extract("path", ARCHIVE_PATH, 1).try_cast("bigint")
    problem = (
        F.when(F.col("_file_problem").isNotNull(), F.col("_file_problem"))
        .when(~F.col("_five"), "FIELD_COUNT")
        .when(number.isNull() | (number <= 0), "ENTITY")
        .when(F.col("filed").isNull(), "FILED")
        .when(F.col("filed") > F.col("index_date"), "FILED_AFTER_INDEX")
        .when(path_cik.isNull() | (path_cik != number), "PATH")
    )
    return safe.select(
        file, "index_date",
        F.regexp_extract("path", ARCHIVE_PATH, 2).alias("accession"),
        number.cast("string").alias("cik"), "form", "filed", "path", problem.alias("problem"),
    )


def _tag(text: Column, lower: Column, name: str) -> Column:
    """An SGML value: ``<NAME>value`` or a ``NAME: value`` header line.

    A text whose lower-case form lacks the tag isn't searched for it by pattern.
    """
    tagged = F.when(
        lower.contains(f"<{name.lower()}>"), F.regexp_extract(text, rf"(?i)<{name}>\s*([^\r\n<]+)", 1)
    ).otherwise("")
    loose = name.replace(" ", r"[\s_-]").replace("-", r"[\s_-]")
    header = F.regexp_extract(text, rf"(?im)^\s*{loose}\s*:\s*(.+?)\s*$", 1)
    return F.nullif(F.trim(F.when(tagged != "", tagged).otherwise(header)), F.lit(""))


def parse_ownership_docs(
    documents: DataFrame, *, payload: str = "payload", accession: str = "accession",
    form: str = "form",
) -> DataFrame:
    """SGML wrapper with exactly one embedded ownership document → filing columns.

    Each document is one row and is parsed inside it; the transactions stay an
    array here (see :func:`explode_transactions`). ``problem`` names what makes a
    document unusable; odd optional dates only add an anomaly code.
    """
    text = F.col(payload)
    # Text between XML tags sits at the odd places of a split at those tags.
    parts = F.split(text, r"(?i)</?XML>")
    bodies = F.filter(
        parts,
        lambda x, i: (i % 2 == 1) & x.rlike(r"(?i)<\s*(\w+:)?ownershipDocument(\s|>)"),
    )
    lower = F.col("_lower")
    wrapped = documents.withColumn("_lower", F.lower(text)).withColumns(
        {
            "_bodies": bodies, "_stamp": _tag(text, lower, "ACCEPTANCE-DATETIME"),
            "_accession": _tag(text, lower, "ACCESSION NUMBER"), "_wrapped": lower.contains("<sec-document"),
            "_declares": lower.contains("<!doctype") | lower.contains("<!entity"),
        }
    ).drop("_lower")
    # Blanks at both ends; trim with a list of characters looks up every character of the text.
    inner = F.regexp_extract(F.col("_bodies")[0], r"(?s)^[ \t\r\n]*+(.*[^ \t\r\n])", 1)
    xml = F.when(F.size("_bodies") == 1, inner)
    stamp = F.when(F.col("_stamp").rlike(r"^\d{14}$"), F.col("_stamp"))
    # What the text alone says stands before the XML is parsed: no later step carries the text, and what isn't asked for isn't computed.
    judged = wrapped.withColumns(
        {"_xml": xml, "accepted_at": local_to_utc(F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss")))}
    ).withColumns(
        {
            "submission_sha256": F.sha2(text, 256), "document_sha256": F.sha2(F.col("_xml"), 256),
            "_unusable": F.when(is_html_page(text) | (F.trim(text) == ""), "EMPTY_OR_HTML")
            .when(~F.col("_wrapped"), "WRAPPER")
            .when(
                F.col("_accession").isNotNull() & (F.col("_accession") != F.col(accession)),
                "ACCESSION_MISMATCH",
            )
            .when(F.col("accepted_at").isNull(), "ACCEPTANCE_TIME")
            .when(F.coalesce(F.size("_bodies"), F.lit(0)) != 1, "OWNERSHIP_DOCUMENT_COUNT")
            .when(F.col("_declares") & F.col("_xml").rlike("(?i)<!(DOCTYPE|ENTITY)"), "FORBIDDEN_DECLARATION"),
        }
    )
    parsed = computed_once(
        judged,
        x=F.from_xml(
            F.col("_xml"), schemas.OWNERSHIP_XML, {"mode": "PERMISSIVE", "ignoreNamespace": "true"}
        ),
    )
    period, period_code = optional_date(F.nullif(F.trim("x.periodOfReport"), F.lit("")),
                                        "PERIOD_OF_REPORT_INVALID")
    original, original_code = optional_date(
        F.nullif(F.trim("x.dateOfOriginalSubmission"), F.lit("")),
        "DATE_OF_ORIGINAL_SUBMISSION_INVALID",
    )
    owners = F.transform(
        "x.reportingOwner", lambda o: F.trim(o["reportingOwnerId"]["rptOwnerCik"])
    )
    owner_ids = F.array_distinct(
        F.transform(owners, lambda o: o.try_cast("bigint").cast("string"))
    )
    issuer = F.trim("x.issuer.issuerCik")
    flag = tri_state("x.aff10b5One")
    problem = (
        F.when(F.col("_unusable").isNotNull(), F.col("_unusable"))
        .when(F.col("x.documentType").isNull(), "INVALID_XML")
        .when(F.trim("x.documentType") != F.col(form), "FORM_MISMATCH")
        .when(~F.coalesce(issuer.rlike(r"^\d+$"), F.lit(False)), "ISSUER")
        .when(F.coalesce(F.size(owners), F.lit(0)) <= 0, "NO_OWNER")
        .when(
            F.exists(owners, lambda o: ~F.coalesce(o.rlike(r"^\d+$"), F.lit(False))), "OWNER"
        )
        .when(flag.isNull(), "PLAN_FLAG")
    )
    keep = [c for c in documents.columns if c != payload]
    return parsed.select(
        *keep, problem.alias("problem"), "accepted_at",
        issuer.try_cast("bigint").cast("string").alias("issuer"),
        F.array_sort(owner_ids).alias("owners"),
        array_fingerprint(owner_ids).alias("owner_hash"),
        period.alias("period"), original.alias("original_date"), flag.alias("flag"),
        "submission_sha256", "document_sha256",
        F.array_compact(F.array(period_code, original_code)).alias("metadata_anomalies"),
        F.col("x.nonDerivativeTable.nonDerivativeTransaction").alias("transactions"),
    )


def _plain_decimal(value: Column) -> Column:
    """Text of a decimal with a scale, without trailing zeros: ``10``, ``2.5``."""
    return F.rtrim(F.rtrim(value.cast("string"), F.lit("0")), F.lit("."))


def _typed(filings: DataFrame) -> DataFrame:
    """The filings with their transactions as an array ``_t`` of typed structs.

    Three passes over the array, so that no field is parsed twice.
    """
    raw = F.transform("transactions", _raw_fields)
    typed = F.transform(raw, _typed_fields)
    return computed_once(filings, _t=F.transform(typed, _judged)).drop("transactions")


def _raw_fields(t: Column) -> Column:
    amounts = t["transactionAmounts"]

    def text(c: Column) -> Column:
        return F.nullif(F.trim(c), F.lit(""))

    return F.struct(
        text(t["transactionCoding"]["transactionCode"]).alias("code"),
        text(amounts["transactionAcquiredDisposedCode"]["value"]).alias("side"),
        text(amounts["transactionShares"]["value"]).alias("shares"),
        text(amounts["transactionPricePerShare"]["value"]).alias("price"),
        text(t["transactionDate"]["value"]).alias("day"),
    )


def _typed_fields(t: Column) -> Column:
    return F.struct(
        t["code"].alias("code"), t["side"].alias("side"), t["price"].isNull().alias("unpriced"),
        xs_date(t["day"]).alias("transaction_date"),
        parse_decimal(t["shares"], allow_zero=False).alias("shares"),
        parse_decimal(t["price"]).alias("price"),
    )


def _fingerprint(t: Column) -> Column:
    """The hash of an eligible or quarantined row, for those who ask for it."""
    return F.sha2(
        F.concat_ws(
            "|", t["transaction_date"].cast("string"), t["code"], t["side"],
            _plain_decimal(t["shares"]), F.coalesce(_plain_decimal(t["price"]), F.lit("MISSING")),
        ), 256,
    )


def _dollars(t: Column) -> Column:
    return F.try_multiply(t["shares"], t["price"]).cast("decimal(38,6)")


def _judged(t: Column) -> Column:
    known = F.coalesce(t["code"].isin("P", "S"), F.lit(False))
    good = F.coalesce(
        (t["side"] == F.when(t["code"] == "P", "A").otherwise("D")) & t["shares"].isNotNull()
        & t["transaction_date"].isNotNull() & (t["unpriced"] | t["price"].isNotNull()),
        F.lit(False),
    )
    return F.struct(
        F.when(~known, "EXCLUDED").when(good, "ELIGIBLE").otherwise("QUARANTINED").alias("status"),
        t["unpriced"].alias("unpriced"),
        t["transaction_date"].alias("transaction_date"), t["code"].alias("code"),
        t["side"].alias("side"), t["shares"].alias("shares"), t["price"].alias("price"),
    )


def type_transactions(filings: DataFrame) -> DataFrame:
    """Typed transaction rows of every filing, each with its ``status``.

    ELIGIBLE: code P or S with its matching side and positive shares (the price
    may be absent). QUARANTINED: such a code in a malformed row. EXCLUDED: other
    codes. Dollars are rounded to a millionth.
    """
    rows = _typed(filings)
    keep = [c for c in rows.columns if c != "_t"]
    t = F.col("t")
    return rows.select(*keep, F.posexplode("_t").alias("_pos", "t")).select(
        *keep, (F.col("_pos") + 1).alias("ordinal"), t["status"].alias("status"), t["unpriced"].alias("unpriced"),
        _fingerprint(t).alias("fingerprint"),
        *[t[c].alias(c) for c in ("transaction_date", "code", "side", "shares", "price")], _dollars(t).alias("dollars"),
    )


def explode_transactions(filings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(eligible rows, quarantined rows with their anomaly code)."""
    typed = type_transactions(filings)
    quarantine = typed.where("status = 'QUARANTINED'").withColumn(
        "anomaly", F.format_string("NONDERIVATIVE_ROW_%d_QUARANTINED", F.col("ordinal"))
    )
    return typed.where("status = 'ELIGIBLE'").drop("status"), quarantine.drop("status")


# Side of each eligible code.
SIDES = {"buy": "P", "sell": "S"}


def filing_summary(filings: DataFrame) -> DataFrame:
    """Per filing: counts of eligible, excluded, unpriced and quarantined rows,
    counts, shares and dollars per side, the sorted fingerprints with their hash,
    and the parse status.

    All from the transaction array that the filing's own row already holds: no
    shuffle, and the document is read once.
    """
    rows = _typed(filings)
    keep = [c for c in rows.columns if c != "_t"]
    judged = computed_once(
        rows, _good=F.filter("_t", lambda t: t["status"] == "ELIGIBLE"),
        _excluded=F.size(F.filter("_t", lambda t: t["status"] == "EXCLUDED")),
        _quarantined=F.size(F.filter("_t", lambda t: t["status"] == "QUARANTINED")),
    )

    def count(c: Column) -> Column:
        return F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("bigint")

    zero = F.lit(0).cast("decimal(38,6)")

    def total(rows: Column, measure) -> Column:
        summed = F.aggregate(
            rows, zero,
            lambda acc, t: F.try_add(acc, F.coalesce(measure(t), zero)).cast("decimal(38,6)"),
        )
        return F.coalesce(summed, zero)

    def side_totals(name: str, code: str) -> list[Column]:
        mine = F.filter("_good", lambda t: t["code"] == code)
        return [
            count(F.size(mine)).alias(f"{name}_count"),
            count(F.size(F.filter(mine, lambda t: ~t["unpriced"]))).alias(f"{name}_priced"),
            total(mine, lambda t: t["shares"]).alias(f"{name}_shares"),
            total(mine, _dollars).alias(f"{name}_dollars"),
        ]

    totals = [c for name, code in SIDES.items() for c in side_totals(name, code)]
    prints = F.coalesce(
        F.array_sort(F.transform("_good", _fingerprint)),
        F.array().cast("array<string>"),
    )
    out = judged.select(
        *keep, count(F.size("_good")).alias("eligible_count"),
        count(F.col("_excluded")).alias("excluded_count"),
        count(F.size(F.filter("_good", lambda t: t["unpriced"]))).alias("missing_price_count"),
        count(F.col("_quarantined")).alias("quarantined_count"), *totals,
        prints.alias("fingerprints"),
    )
    return out.select(
        "*", (F.col("eligible_count") - F.col("missing_price_count")).alias("priced_count"),
        array_fingerprint(F.col("fingerprints")).alias("transactions_hash"),
        F.when(F.col("quarantined_count") > 0, "PARSED_WITH_QUARANTINED_ROWS").otherwise("PARSED")
        .alias("parse_status"),
    )
