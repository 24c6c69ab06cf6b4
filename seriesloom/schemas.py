"""Explicit schemas of landed inputs and of the core tables."""

from pyspark.sql import types as T

_S, _D, _B = T.StringType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


OBSERVATIONS = _struct(series_id=_S, obs_date=T.DateType(), value=_D)

# Landed JSON documents; numbers arrive as text.
OBSERVATION_DOC = _struct(
    observations=T.ArrayType(
        _struct(date=_S, value=_S, realtime_start=_S, realtime_end=_S)
    )
)
SERIES_METADATA_DOC = _struct(
    seriess=T.ArrayType(
        _struct(
            id=_S, title=_S, units=_S, units_short=_S, frequency=_S, frequency_short=_S,
            seasonal_adjustment=_S, seasonal_adjustment_short=_S, last_updated=_S,
            observation_start=_S, observation_end=_S, notes=_S,
        )
    )
)
RATE_DOC = _struct(
    refRates=T.ArrayType(_struct(type=_S, effectiveDate=_S, percentRate=_S))
)
OPERATION_DETAIL = _struct(
    securityType=_S, amtSubmitted=_S, amtAccepted=_S, percentOfferingRate=_S
)
OPERATIONS_DOC = _struct(
    repo=_struct(
        operations=T.ArrayType(
            _struct(
                operationId=_S, operationDate=_S, operationType=_S, lastUpdated=_S,
                totalAmtSubmitted=_S, totalAmtAccepted=_S,
                details=T.ArrayType(OPERATION_DETAIL),
            )
        )
    )
)
BALANCE_DOC = _struct(
    data=T.ArrayType(
        _struct(record_date=_S, account_type=_S, close_today_bal=_S, open_today_bal=_S)
    )
)
AUCTION_DOC = _struct(
    data=T.ArrayType(
        _struct(
            cusip=_S, auction_date=_S, issue_date=_S, offering_amt=_S,
            security_type=_S, security_term=_S,
        )
    )
)
POSITION_REPORT = T.StructType(
    [
        T.StructField(name, _S, True)
        for name in (
            "id", ":id", ":updated_at", "market_and_exchange_names",
            "contract_market_name", "cftc_contract_market_code", "cftc_market_code",
            "cftc_commodity_code", "commodity_name", "report_date_as_yyyy_mm_dd",
            "open_interest_all", "asset_mgr_positions_long",
            "asset_mgr_positions_short", "asset_mgr_positions_spread",
            "pct_of_oi_asset_mgr_long", "pct_of_oi_asset_mgr_short",
            "lev_money_positions_long", "lev_money_positions_short",
            "lev_money_positions_spread", "pct_of_oi_lev_money_long",
            "pct_of_oi_lev_money_short", "contract_units", "futonly_or_combined",
        )
    ]
)
FACT = _struct(
    start=_S, end=_S, val=_D, accn=_S, fy=T.LongType(), fp=_S, form=_S, filed=_S, frame=_S
)
FACTS_DOC = _struct(
    cik=_S,
    entityName=_S,
    facts=T.MapType(
        _S,
        T.MapType(
            _S,
            _struct(label=_S, description=_S, units=T.MapType(_S, T.ArrayType(FACT))),
        ),
    ),
)
_A = T.ArrayType(_S)
FILING_LIST_DOC = _struct(
    cik=_S, name=_S,
    filings=_struct(
        recent=_struct(
            accessionNumber=_A, filingDate=_A, reportDate=_A, acceptanceDateTime=_A,
            form=_A, primaryDocument=_A, isXBRL=T.ArrayType(T.LongType()),
        )
    ),
)
OWNERSHIP_XML = (
    "documentType STRING, periodOfReport STRING, dateOfOriginalSubmission STRING, "
    "aff10b5One STRING, issuer STRUCT<issuerCik: STRING>, "
    "reportingOwner ARRAY<STRUCT<reportingOwnerId: STRUCT<rptOwnerCik: STRING>>>, "
    "nonDerivativeTable STRUCT<nonDerivativeTransaction: ARRAY<STRUCT<"
    "transactionDate: STRUCT<value: STRING>, "
    "transactionCoding: STRUCT<transactionCode: STRING>, "
    "transactionAmounts: STRUCT<"
    "transactionShares: STRUCT<value: STRING>, "
    "transactionPricePerShare: STRUCT<value: STRING>, "
    "transactionAcquiredDisposedCode: STRUCT<value: STRING>>>>>"
)
REVIEWED_COLUMNS = (
    "company_id", "period_end", "metric_id", "direction", "value", "unit", "yoy_pct",
    "comparable", "source_type", "source_url", "filing_accession",
    "filing_accepted_at", "as_of", "reviewer", "reviewed_at", "paraphrase",
    "review_note",
)
REVIEWED_CSV = T.StructType([T.StructField(c, _S, True) for c in REVIEWED_COLUMNS])
