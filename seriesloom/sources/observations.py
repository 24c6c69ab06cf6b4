"""Observation feeds: plain, vintage and rate documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom import schemas
from seriesloom.functions.scalars import (
    MISSING_TOKENS, codes, parse_number, strict_date, utc_timestamp,
)
from seriesloom.operators.clean import fold_duplicates
from seriesloom.sources.landing import coded, elements, no_data_or, parse_json


def parse_observations(
    docs: DataFrame, *, by: Sequence[str] = ("series_id",), scale: float = 1.0,
    end=None, strict: bool = False, payload: str = "payload",
) -> DataFrame:
    """``observations[]`` exploded: missing tokens drop, values are scaled, an
    optional cut-off date applies, repeats fold and conflicts are marked.

    A document without an observation, a row without a date and a value that is no
    number are kept, folded by what they say, with a code in ``violations`` and
    the text in ``fault``; ``strict`` raises on the first of them.
    """
    told = F.trim("o.value")
    missing = F.coalesce(told, F.lit("")).isin(*MISSING_TOKENS)
    rows = elements(parse_json(docs, schemas.OBSERVATION_DOC, payload), "doc.observations", "o", *by).select(
        *by, strict_date("o.date").alias("obs_date"),
        F.round(parse_number("o.value") / F.lit(float(scale)), 6).alias("value"),
        F.when(F.col("_none"), "NO_DATA")
        .when(F.col("o").isNotNull() & strict_date("o.date").isNull(), "INVALID_DATE")
        .when(~missing & parse_number("o.value").isNull(), "NOT_NUMERIC").alias("_code"),
        F.when(strict_date("o.date").isNull(), F.col("o.date")).otherwise(told).alias("_text"),
    )
    good = rows.where("_code IS NULL")
    if end is not None:
        good = good.where(F.col("obs_date") <= F.lit(end).cast("date"))
    folded = fold_duplicates(
        good.drop("_code", "_text"), [*by, "obs_date"], ["value"], skip_null="value", strict=strict
    ).withColumn("violations", F.when(F.col("is_conflict"), "CONFLICT").otherwise("")).withColumn(
        "fault", F.lit(None).cast("string")
    )
    bad = rows.where("_code IS NOT NULL").groupBy(*by, "obs_date", "_code", "_text").agg(
        F.count(F.lit(1)).alias("copies")
    )
    faulty = bad.select(
        *by, "obs_date", F.lit(None).cast("double").alias("value"), "copies",
        F.lit(False).alias("is_conflict"), F.col("_code").alias("violations"), F.col("_text").alias("fault"),
    )
    if strict:
        message = F.concat_ws(" ", F.col("violations"), F.col("fault"))
        faulty = faulty.where(F.raise_error(message).cast("boolean"))
    return folded.unionByName(faulty)


def parse_vintages(
    docs: DataFrame, *, by: Sequence[str] = ("series_id",), strict: bool = False,
    payload: str = "payload",
) -> DataFrame:
    """Vintage observations: a missing marker is kept as null and the realtime
    range travels along. A row with an inverted range is a violation, and so is
    a document without an observation; ``strict`` raises on the first conflict
    or such document."""
    rows = elements(parse_json(docs, schemas.OBSERVATION_DOC, payload), "doc.observations", "o", *by).select(
        *by, "_none", strict_date("o.date").alias("obs_date"), parse_number("o.value").alias("value"),
        strict_date("o.realtime_start").alias("realtime_start"),
        strict_date("o.realtime_end").alias("realtime_end"),
        (
            ~F.coalesce(F.trim("o.value"), F.lit("")).isin(*MISSING_TOKENS)
            & parse_number("o.value").isNull()
        ).alias("not_numeric"),
    )
    folded = fold_duplicates(
        rows, [*by, "obs_date", "_none"], ["value", "realtime_start", "realtime_end", "not_numeric"],
        strict=strict,
    )
    if strict:
        missing = F.raise_error(F.lit("NO_DATA")).cast("boolean")
        folded = folded.where(F.when(F.col("_none"), missing).otherwise(F.lit(True)))
    return folded.withColumn(
        "violations",
        codes(
            no_data_or([
                (F.col("is_conflict"), "CONFLICT"),
                (F.col("obs_date").isNull(), "INVALID_DATE"),
                (F.col("not_numeric"), "NOT_NUMERIC"),
                (
                    F.col("realtime_start").isNull() | F.col("realtime_end").isNull(),
                    "REALTIME_MISSING",
                ),
                (F.col("realtime_end") < F.col("realtime_start"), "REALTIME_INVERTED"),
            ])
        ),
    ).drop("not_numeric", "_none")


def parse_series_metadata(
    docs: DataFrame, expected: Mapping[str, Mapping[str, str]], *, payload: str = "payload"
) -> DataFrame:
    """One metadata row per series with the fields that differ from the reviewed
    contract (``expected``: series id → field → value). A document without a
    series is a row of its own."""
    row = elements(
        parse_json(docs, schemas.SERIES_METADATA_DOC, payload), "doc.seriess", "m", F.size("doc.seriess").alias("_n")
    )
    fields = sorted({f for spec in expected.values() for f in spec})
    rules: list[tuple[Column, str]] = [
        (F.col("_n") != 1, "NOT_EXACTLY_ONE"),
        (~F.col("m.id").isin(*expected), "SERIES_NOT_LISTED"),
    ]
    for field in fields:
        table = F.create_map(
            *[F.lit(x) for sid, spec in expected.items() if field in spec
              for x in (sid, spec[field])]
        )
        wanted = F.try_element_at(table, F.col("m.id"))
        rules.append(
            (wanted.isNotNull() & ~wanted.eqNullSafe(F.col(f"m.{field}")), f"MISMATCH_{field.upper()}")
        )
    start, end = strict_date("m.observation_start"), strict_date("m.observation_end")
    rules += [
        (start.isNull() | end.isNull(), "RANGE_MISSING"),
        (end < start, "RANGE_INVERTED"),
        (utc_timestamp("m.last_updated").isNull(), "LAST_UPDATED"),
        (F.coalesce(F.trim("m.title"), F.lit("")) == "", "TITLE"),
    ]
    return row.select(
        F.col("m.id").alias("series_id"), F.col("m.title").alias("title"),
        F.col("m.units").alias("units"), F.col("m.frequency").alias("frequency"),
        F.col("m.seasonal_adjustment").alias("seasonal_adjustment"),
        utc_timestamp("m.last_updated").alias("last_updated"),
        start.alias("observation_start"), end.alias("observation_end"),
        F.col("m.notes").alias("notes"),
        codes([(F.col("_none"), "NOT_EXACTLY_ONE"), *no_data_or(rules)]).alias("violations"),
    )


def outside_metadata_range(
    vintages: DataFrame, metadata: DataFrame, *, by: Sequence[str] = ("series_id",)
) -> DataFrame:
    """Vintage rows that lie outside their series' declared range."""
    span = metadata.select(*by, "observation_start", "observation_end")
    return vintages.join(span, list(by)).where(
        ~F.col("obs_date").between(F.col("observation_start"), F.col("observation_end"))
    ).select(*by, "obs_date")


def parse_rates(
    docs: DataFrame, *, expected: str = "series_id", strict: bool = False,
    payload: str = "payload",
) -> DataFrame:
    """Rate rows whose declared type must equal the expected one (a column of
    ``docs``); rows of another type carry ``type_mismatch``. ``violations`` names
    what is wrong with a row or a document without rows; ``strict`` raises on it."""
    rows = elements(
        parse_json(docs, schemas.RATE_DOC, payload), "doc.refRates", "r", F.col(expected).alias("series_id")
    ).select(
        "series_id", "_none", strict_date("r.effectiveDate").alias("obs_date"),
        parse_number("r.percentRate").alias("value"),
        (~F.col("_none") & ~F.col("r.type").eqNullSafe(F.upper(F.trim("series_id")))).alias("type_mismatch"),
    )
    folded = fold_duplicates(
        rows, ["series_id", "obs_date", "_none"], ["value", "type_mismatch"], strict=strict
    )
    rules = [
        (F.col("is_conflict"), "CONFLICT"), (F.col("obs_date").isNull(), "INVALID_DATE"),
        (F.col("value").isNull(), "NOT_NUMERIC"), (F.col("type_mismatch"), "TYPE_MISMATCH"),
    ]
    return coded(folded, no_data_or(rules), strict).drop("_none")
