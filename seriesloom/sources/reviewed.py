"""Human-reviewed CSV records: reading, row rules and typed columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom import schemas
from seriesloom.functions.scalars import (
    FILING_ID, PLAIN_NUMBER, UTC_STAMP, codes, document_url_problems, strict_date,
)
from seriesloom.sources.landing import computed_once

# What the reviewed columns may hold.
DIRECTIONS = ("UP", "FLAT", "DOWN", "UNKNOWN")
SOURCE_TYPES = ("10-Q", "10-Q/A", "10-K", "10-K/A", "8-K", "8-K/A", "DEF 14A")
VALUE_UNITS = (
    "USD", "USD mn", "USD bn", "count", "units", "percent", "percentage_points",
    "ratio", "MW", "GW",
)
# Rules of one compiled step.
RULES_AT_ONCE = 12
MAX_LENGTHS = {"reviewer": 80, "paraphrase": 280, "review_note": 500}


def read_reviewed_csv(spark: SparkSession, path: str) -> DataFrame:
    """The 17 text columns; the header must match exactly, and rows with too few
    or too many fields come back in ``_corrupt_record``, whichever columns are
    used later; a field without text is null, and empty lines are no rows."""
    corrupt = T.StructField("_corrupt_record", T.StringType(), True)
    schema = T.StructType([*schemas.REVIEWED_CSV.fields, corrupt])
    # Every field is parsed: a reader of some columns wouldn't count the fields of a row.
    return spark.read.option("columnPruning", False).csv(
        path, schema=schema, header=True, enforceSchema=False, mode="PERMISSIVE",
        columnNameOfCorruptRecord="_corrupt_record", nullValue="\u0000", emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def _text(name: str) -> Column:
    return F.coalesce(name, F.lit(""))


def validate_reviewed(
    rows: DataFrame, *, entity_ids: Mapping[str, str], metrics: Sequence[str],
    host: str, prefix: str,
) -> DataFrame:
    """Typed records with the codes of every rule that a row breaks.

    ``entity_ids``: company id → registry number used in document links.
    """
    number_of = F.try_element_at(
        F.create_map(*[F.lit(x) for pair in entity_ids.items() for x in pair]), F.col("company_id")
    )

    def stamp(name: str) -> Column:
        return F.when(F.col(name).rlike(UTC_STAMP), F.col(name).try_cast("timestamp"))

    def number(name: str) -> Column:
        return F.when(_text(name).rlike(PLAIN_NUMBER), F.col(name).try_cast("double"))

    # A line break lies in the texts as they follow each other, a blank at an end beside a break between them.
    texts = [F.col(c) for c in schemas.REVIEWED_COLUMNS]
    # Fields, links and rules are separate steps: each is computed once per row, in methods that the JVM compiles.
    typed = computed_once(
        rows, _number=number_of, _period=strict_date("period_end"), _as_of=strict_date("as_of"),
        _accepted=stamp("filing_accepted_at"), _reviewed=stamp("reviewed_at"), _value=number("value"), _yoy=number("yoy_pct"),
        _comparable=F.when(F.col("comparable") == "true", True).when(F.col("comparable") == "false", False),
        _flat=F.concat_ws("", *texts), _lines=F.concat_ws("\n", *texts),
    )
    flat, lines = F.col("_flat"), F.col("_lines")
    linked = computed_once(
        typed,
        _padded=flat.contains("\r") | flat.contains("\n") | lines.startswith(" ") | lines.endswith(" ")
        | lines.contains(" \n") | lines.contains("\n "),
        _link=F.size(
            document_url_problems(
                "source_url", host=host, prefix=prefix, entity=F.col("_number"), filing=F.col("filing_accession")
            )
        ) > 0,
    )
    value_ok, yoy_ok = F.col("_value").isNotNull(), F.col("_yoy").isNotNull()
    day = F.col("_accepted").cast("date")
    ordered = (
        (F.col("_period") <= day) & (day <= F.col("_as_of"))
        & (F.col("_as_of") <= F.col("_reviewed").cast("date")) & (F.col("_accepted") <= F.col("_reviewed"))
    )
    no = F.lit(False)
    rules: list[tuple[Column, str]] = [
        (F.col("_padded"), "WHITESPACE"),
        (F.col("_number").isNull(), "COMPANY"),
        (~F.coalesce(F.col("metric_id").isin(*metrics), no), "METRIC"),
        (~F.coalesce(F.col("direction").isin(*DIRECTIONS), no), "DIRECTION"),
        (F.col("_period").isNull(), "PERIOD_END"), (F.col("_as_of").isNull(), "AS_OF"),
        (F.col("_accepted").isNull(), "ACCEPTED_AT"), (F.col("_reviewed").isNull(), "REVIEWED_AT"),
        (~F.coalesce(ordered, F.lit(True)), "CHRONOLOGY"),
        (~F.coalesce(F.col("filing_accession").rlike(FILING_ID), no), "ACCESSION"),
        (~F.coalesce(F.col("source_type").isin(*SOURCE_TYPES), no), "SOURCE_TYPE"),
        (F.col("_link"), "SOURCE_URL"),
        ((_text("value") != "") & (~value_ok | (F.col("_value") < 0)), "VALUE"),
        ((_text("value") == "") & (_text("unit") != ""), "UNIT_WITHOUT_VALUE"),
        ((_text("value") != "") & ~F.coalesce(F.col("unit").isin(*VALUE_UNITS), no), "UNIT"),
        ((_text("yoy_pct") != "") & ~yoy_ok, "YOY"),
        (F.col("_comparable").isNull(), "COMPARABLE"),
        ((_text("yoy_pct") != "") & ~F.coalesce("_comparable", no), "YOY_NOT_COMPARABLE"),
    ]
    for name, limit in MAX_LENGTHS.items():
        rules.append(
            ((_text(name) == "") | (F.length(_text(name)) > limit), f"{name.upper()}_LENGTH")
        )
    judged = linked
    at = range(0, len(rules), RULES_AT_ONCE)
    for i in at:
        judged = computed_once(judged, **{f"_codes_{i}": codes(rules[i:i + RULES_AT_ONCE])})
    return judged.select(
        "company_id", "metric_id", "direction", F.col("_period").alias("period_end"), F.col("_value").alias("value"),
        F.nullif(_text("unit"), F.lit("")).alias("unit"), F.col("_yoy").alias("yoy_pct"),
        F.col("_comparable").alias("comparable"), "source_type", "source_url",
        F.col("filing_accession").alias("accession"), F.col("_accepted").alias("accepted_at"),
        F.col("_as_of").alias("as_of"), "reviewer", F.col("_reviewed").alias("reviewed_at"), "paraphrase",
        "review_note", F.concat(*[f"_codes_{i}" for i in at]).alias("violations"),
    )


def not_future(records: DataFrame, now) -> DataFrame:
    """Records accepted, reviewed or dated after now."""
    t = F.lit(now).cast("timestamp")
    return records.where(
        (F.col("accepted_at") > t) | (F.col("reviewed_at") > t)
        | (F.col("as_of") > t.cast("date"))
    )


def chronology_violations(records: DataFrame) -> DataFrame:
    """Typed records outside period_end ≤ accepted ≤ as_of ≤ reviewed."""
    ordered = (
        (F.col("period_end") <= F.col("accepted_at").cast("date"))
        & (F.col("accepted_at").cast("date") <= F.col("as_of"))
        & (F.col("as_of") <= F.col("reviewed_at").cast("date"))
        & (F.col("accepted_at") <= F.col("reviewed_at"))
    )
    return records.where(~F.coalesce(ordered, F.lit(False)))
