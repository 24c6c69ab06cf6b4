"""Operation feeds: header rows, and details flattened to categories."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom import schemas
from seriesloom.functions.scalars import (
    any_of, codes, local_to_utc, parse_number, strict_date,
)
from seriesloom.operators.clean import operation_identity
from seriesloom.sources.landing import coded, elements, no_data_or, parse_json

# How the feed names a security type, and our category for it.
CATEGORY_ALIASES = {
    "Treasury": "treasury",
    "Agency": "agency_debt",
    "Mortgage-Backed": "agency_mbs",
}
# Other spellings of the same categories.
CATEGORY_SPELLINGS = {
    "treasury": "treasury",
    "agency": "agency_debt",
    "agency_debt": "agency_debt",
    "mbs": "agency_mbs",
    "agency_mbs": "agency_mbs",
}


def _operations(docs: DataFrame, payload: str) -> DataFrame:
    keep = [c for c in docs.columns if c != payload]
    stamp = F.try_to_timestamp(F.trim("o.lastUpdated"), F.lit("yyyy-MM-dd HH:mm:ss"))
    return elements(parse_json(docs, schemas.OPERATIONS_DOC, payload), "doc.repo.operations", "o", *keep).select(
        *keep, "_none", F.trim("o.operationId").alias("op_id"),
        strict_date("o.operationDate").alias("op_date"), F.col("o.operationType").alias("op_type"),
        local_to_utc(stamp).alias("released_at"),
        parse_number("o.totalAmtSubmitted").alias("submitted"),
        parse_number("o.totalAmtAccepted").alias("accepted"),
        F.col("o.details").alias("details"),
    ).withColumn(
        "identity",
        operation_identity(F.col("op_id"), F.col("op_date"), F.col("op_type"), F.col("released_at")),
    )


def parse_operations(docs: DataFrame, *, strict: bool = False, payload: str = "payload") -> DataFrame:
    """One header row per identity. The release stamp is local wall time and
    becomes an instant. Repeats of one identity fold in the job that follows
    (:func:`seriesloom.operators.clean.fold_duplicates` on ``identity``). A
    document without operations is a row with ``NO_DATA``; ``strict`` raises on
    the first row with a violation."""
    rules = [
        (F.col("identity").isNull(), "NO_IDENTITY"), (F.col("op_date").isNull(), "INVALID_DATE"),
        (F.col("submitted").isNull() | F.col("accepted").isNull(), "NOT_NUMERIC"),
    ]
    return coded(_operations(docs, payload).drop("details"), no_data_or(rules), strict).drop("_none")


def flatten_details(
    docs: DataFrame, *, aliases: Mapping[str, str] = CATEGORY_ALIASES, divisor: float = 1e9,
    tolerance: float = 1e-6, payload: str = "payload",
) -> DataFrame:
    """Header × details → category rows, each with its operation's problems.

    Details sit in one row's array, so their repeats, their sums and the match
    with the header are decided inside that row, without a shuffle.
    """
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    ops = _operations(docs, payload)
    parsed = F.transform(
        F.array_distinct("details"),
        lambda d: F.struct(
            d["securityType"].alias("security"),
            F.try_element_at(table, d["securityType"]).alias("category"),
            parse_number(d["amtSubmitted"]).alias("submitted"),
            parse_number(d["amtAccepted"]).alias("accepted"),
            parse_number(d["percentOfferingRate"]).alias("rate"),
        ),
    )
    ops = ops.withColumn("_d", parsed)

    def total(field: str):
        return F.aggregate(
            "_d", F.lit(0.0), lambda acc, d: acc + F.coalesce(d[field], F.lit(float("nan")))
        )

    names = F.transform("_d", lambda d: d["security"])
    problems = codes(
        no_data_or([
            (F.col("identity").isNull(), "NO_IDENTITY"),
            (F.col("op_date").isNull(), "NO_DATE"),
            (F.coalesce(F.size("_d"), F.lit(0)) <= 0, "NO_DETAILS"),
            (F.size(F.array_distinct(names)) < F.size("_d"), "CONFLICTING_DETAIL"),
            (F.exists("_d", lambda d: d["category"].isNull()), "UNSUPPORTED_CATEGORY"),
            (
                ~F.coalesce(F.abs(total("accepted") - F.col("accepted")) <= tolerance, F.lit(False))
                | ~F.coalesce(
                    F.abs(total("submitted") - F.col("submitted")) <= tolerance, F.lit(False)
                ),
                "HEADER_TOTAL",
            ),
            (
                F.exists(
                    "_d",
                    lambda d: any_of(
                        [d["submitted"] < 0, d["accepted"] < 0, d["accepted"] > d["submitted"]]
                    ),
                ),
                "AMOUNT_DOMAIN",
            ),
        ])
    )
    keep = [c for c in docs.columns if c != payload]
    return ops.withColumn("problems", problems).select(
        *keep, "op_id", "identity", "op_date", "op_type", "released_at", "problems",
        F.explode_outer("_d").alias("d"),
    ).select(
        *keep, "op_id", "identity", "op_date", "op_type", "released_at", "problems",
        F.col("d.category").alias("category"),
        F.round(F.col("d.submitted") / divisor, 6).alias("submitted"),
        F.round(F.col("d.accepted") / divisor, 6).alias("accepted"),
        F.col("d.rate").alias("rate"),
    )
