"""Weekly position reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.scalars import (
    bounded_pct, codes, midnight_date, nonneg_int, parse_number, plausible_release,
    utc_timestamp,
)
from seriesloom.operators.clean import fold_duplicates
from seriesloom.sources.landing import computed_once

# Report fields and the names they get here.
COUNT_FIELDS = {
    "open_interest": "open_interest_all",
    "a_long": "asset_mgr_positions_long",
    "a_short": "asset_mgr_positions_short",
    "a_spread": "asset_mgr_positions_spread",
    "b_long": "lev_money_positions_long",
    "b_short": "lev_money_positions_short",
    "b_spread": "lev_money_positions_spread",
}
FIELDS_AT_ONCE = 4
PERCENT_FIELDS = {
    "a_pct_long": "pct_of_oi_asset_mgr_long",
    "a_pct_short": "pct_of_oi_asset_mgr_short",
    "b_pct_long": "pct_of_oi_lev_money_long",
    "b_pct_short": "pct_of_oi_lev_money_short",
}


def parse_position_reports(
    raw: DataFrame, contracts: Mapping[str, tuple[str, str]], *, tolerance: float = 0.11
) -> DataFrame:
    """Typed weekly rows with the codes of every rule a row breaks.

    ``contracts``: code → (contract name, market name). Official percentages must
    match the recomputed ones within 0.11. A release stamp is kept only when it
    follows the report by two to seven days.
    """
    code = F.col("cftc_contract_market_code")

    def listed(i: int) -> Column:
        return F.try_element_at(
            F.create_map(*[F.lit(x) for k, v in contracts.items() for x in (k, v[i])]), code
        )

    # Parsed first, judged second: no text is converted twice. A few fields at a time: the JVM doesn't compile a method of
    # over 8,000 bytes of code, which all fields together make.
    parsed = computed_once(
        raw, obs_date=midnight_date("report_date_as_yyyy_mm_dd"), _updated=utc_timestamp(F.col("`:updated_at`")),
    )
    fields = list((COUNT_FIELDS | PERCENT_FIELDS).items())
    for i in range(0, len(fields), FIELDS_AT_ONCE):
        parsed = computed_once(parsed, **{f"_{n}": parse_number(src) for n, src in fields[i:i + FIELDS_AT_ONCE]})
    typed = parsed.select(
        code.alias("contract"), "obs_date",
        *[nonneg_int(f"_{n}").alias(n) for n in COUNT_FIELDS],
        *[bounded_pct(f"_{n}").alias(n) for n in PERCENT_FIELDS],
        plausible_release(F.col("_updated"), F.col("obs_date")).alias("released_at"),
        F.col("`:id`").alias("row_id"), F.col("id").alias("report_id"),
        (~F.col("contract_market_name").eqNullSafe(listed(0))).alias("_name"),
        (~F.col("market_and_exchange_names").eqNullSafe(listed(1))).alias("_market"),
        (~F.col("futonly_or_combined").eqNullSafe(F.lit("FutOnly"))).alias("_combined"),
        listed(0).isNull().alias("_unlisted"),
    )
    off = F.lit(False)
    for pct in PERCENT_FIELDS:
        count = pct.replace("_pct", "")
        calc = F.lit(100.0) * F.col(count) / F.nullif(
            F.col("open_interest").cast("double"), F.lit(0.0)
        )
        off = off | (F.abs(F.col(pct) - calc) > tolerance)
    blank = F.lit(False)
    for n in (*COUNT_FIELDS, *PERCENT_FIELDS):
        blank = blank | F.col(n).isNull()
    violations = codes(
        [
            (F.col("_unlisted"), "UNLISTED_CONTRACT"),
            (F.col("_name"), "CONTRACT_NAME"),
            (F.col("_market"), "MARKET_NAME"),
            (F.col("_combined"), "NOT_FUTURES_ONLY"),
            (F.col("obs_date").isNull(), "REPORT_DATE"),
            (F.col("open_interest") == 0, "OPEN_INTEREST"),
            (blank, "NUMBER"),
            (F.coalesce(off, F.lit(False)), "PERCENT_RECONCILIATION"),
            (F.coalesce(F.col("row_id"), F.lit("")) == "", "ROW_ID"),
        ]
    )
    return typed.withColumn("violations", violations).drop(
        "_name", "_market", "_combined", "_unlisted"
    )


def fold_reports(reports: DataFrame, *, strict: bool = False) -> DataFrame:
    """One row per (contract, date); repeats may differ only in their row id."""
    payload = [
        c for c in reports.columns if c not in ("contract", "obs_date", "row_id", "violations")
    ]
    return fold_duplicates(reports, ["contract", "obs_date"], payload, strict=strict)


def latest_date_mismatch(reports: DataFrame, contracts: list[str]) -> DataFrame:
    """Listed contracts that are absent or do not share the latest report date."""
    ends = reports.groupBy("contract").agg(F.max("obs_date").alias("end_date"))
    latest = reports.agg(F.max("obs_date")).scalar()
    spark = reports.sparkSession
    listed = spark.createDataFrame([(c,) for c in contracts], "contract string")
    return listed.join(ends, "contract", "left").where(
        F.col("end_date").isNull() | (F.col("end_date") < latest)
    )
