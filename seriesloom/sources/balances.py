"""Balance and auction feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom import schemas
from seriesloom.functions.scalars import parse_number, strict_date
from seriesloom.operators.clean import fold_duplicates
from seriesloom.sources.landing import coded, elements, no_data_or, parse_json


def parse_balances(
    docs: DataFrame, *, account: str, by: Sequence[str] = ("series_id",),
    divisor: float = 1e3, strict: bool = False, payload: str = "payload",
) -> DataFrame:
    """Closing balances: the primary column, else the fallback one, and which of
    the two was used. Rows of another account carry ``wrong_account``. A document
    without rows is a row with ``NO_DATA``."""
    def text(name: str):
        return F.nullif(F.nullif(F.trim(f"r.{name}"), F.lit("null")), F.lit(""))

    primary, fallback = text("close_today_bal"), text("open_today_bal")
    rows = elements(parse_json(docs, schemas.BALANCE_DOC, payload), "doc.data", "r", *by).select(
        *by, "_none", strict_date("r.record_date").alias("obs_date"),
        F.round(parse_number(F.coalesce(primary, fallback)) / divisor, 6).alias("value"),
        F.when(primary.isNotNull(), "close_today_bal").when(~F.col("_none"), "open_today_bal")
        .alias("source_field"),
        (~F.col("_none") & ~F.col("r.account_type").eqNullSafe(F.lit(account))).alias("wrong_account"),
    )
    folded = fold_duplicates(
        rows, [*by, "obs_date", "_none"], ["value", "source_field", "wrong_account"], strict=strict
    )
    return coded(
        folded,
        no_data_or([
            (F.col("is_conflict"), "CONFLICT"), (F.col("obs_date").isNull(), "INVALID_DATE"),
            (F.col("value").isNull(), "NOT_NUMERIC"), (F.col("wrong_account"), "WRONG_ACCOUNT"),
        ]),
        strict,
    ).drop("_none")


def parse_auctions(
    docs: DataFrame, *, by: Sequence[str] = (), divisor: float = 1e9, strict: bool = False,
    payload: str = "payload",
) -> DataFrame:
    """Auctions by (security, auction date, issue date), amounts in billions. A
    document without rows is a row with ``NO_DATA``."""
    rows = elements(parse_json(docs, schemas.AUCTION_DOC, payload), "doc.data", "r", *by).select(
        *by, "_none", F.nullif(F.nullif("r.cusip", F.lit("")), F.lit("null")).alias("security_id"),
        strict_date("r.auction_date").alias("auction_date"),
        strict_date("r.issue_date").alias("issue_date"),
        F.round(parse_number("r.offering_amt") / divisor, 6).alias("amount"),
        F.col("r.security_type").alias("kind"), F.col("r.security_term").alias("term"),
    )
    folded = fold_duplicates(
        rows, [*by, "security_id", "auction_date", "issue_date", "_none"], ["amount", "kind", "term"],
        strict=strict,
    )
    return coded(
        folded,
        no_data_or([
            (F.col("is_conflict"), "CONFLICT"), (F.col("security_id").isNull(), "NO_SECURITY"),
            (F.col("auction_date").isNull() | F.col("issue_date").isNull(), "INVALID_DATE"),
            (F.col("amount").isNull(), "NOT_NUMERIC"),
        ]),
        strict,
    ).drop("_none")
