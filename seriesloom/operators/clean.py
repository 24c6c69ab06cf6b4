"""Filters, duplicate folding, conflict detection and incremental merges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.scalars import any_of, codes, finite

# --- filters ---------------------------------------------------------------


def asof_cutoff(obs: DataFrame, end, date: str = "obs_date") -> DataFrame:
    """Drop rows after a market date."""
    return obs.where(F.col(date) <= F.lit(end).cast("date"))


def valid_points(
    obs: DataFrame, *, key: Sequence[str] = ("series_id", "obs_date"),
    value: str = "value", ingest: str = "ingest_seq",
) -> DataFrame:
    """Well-formed rows, the last ingested per key; a null value is kept as null."""
    well_formed = F.col(value).isNull() | finite(value).isNotNull()
    rows = obs.where(well_formed & ~any_of([F.col(k).isNull() for k in key]))
    return latest_by(rows, key, [ingest])


def latest_by(df: DataFrame, key: Sequence[str], ordering: Sequence[str]) -> DataFrame:
    """The row with the greatest ordering per key, as one combining aggregate."""
    payload = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*payload), F.struct(*ordering))
    return df.groupBy(*key).agg(best.alias("_row")).select(
        *key, *[F.col(f"_row.`{c}`").alias(c) for c in payload]
    ).select(*df.columns)


def range_window_filter(
    obs: DataFrame, days: int | None, *, date: str = "obs_date"
) -> DataFrame:
    """Rows within n days before the latest date over all series.

    The latest date is a scalar subquery: no join, and nothing reaches the driver.
    """
    if days is None:
        return obs
    latest = obs.agg(F.max(date)).scalar()
    return obs.where(F.col(date).between(F.date_sub(latest, days), latest))


# Days covered by each named range.
RANGE_DAYS = {"1M": 31, "8W": 56, "12W": 84, "3M": 93, "1Y": 366, "MAX": None}


def near_reference_lines(
    obs: DataFrame, lines: DataFrame, *, spans: float = 1.5,
    by: Sequence[str] = ("series_id",), value: str = "value", line: str = "line_value",
) -> DataFrame:
    """Reference lines with a flag for lying within 1.5 data spans of the window."""
    stats = obs.where(finite(value).isNotNull()).groupBy(*by).agg(
        F.min(value).alias("lo"), F.max(value).alias("hi")
    )
    span = F.col("hi") - F.col("lo")
    band = F.when(span != 0, span).otherwise(
        F.greatest(F.abs("hi") * 0.05, F.lit(1.0))
    )
    joined = lines.join(stats, list(by))
    return joined.select(
        *lines.columns, "lo", "hi",
        F.col(line).between(F.col("lo"), F.col("hi")).alias("inside"),
        F.col(line).between(
            F.col("lo") - band * spans, F.col("hi") + band * spans
        ).alias("near"),
    )


# --- eligibility -----------------------------------------------------------


def eligibility_gate(metrics: DataFrame, sources: DataFrame) -> DataFrame:
    """Every (metric, source) pair with the reasons that keep it closed.

    ``metrics``: metric_id, source_id, implemented, network_enabled, availability,
    series_ids. ``sources``: source_id, enabled, network_eligible, rights_status,
    automated_fetch, public_redistribution, series_allowlist (null = no list).
    """
    joined = metrics.join(
        sources.withColumn("_known", F.lit(True)), "source_id", "left"
    )
    not_listed = F.array_except("series_ids", "series_allowlist")
    blockers = codes(
        [
            (F.col("_known").isNull(), "unknown source"),
            (~F.coalesce("implemented", F.lit(False)), "implemented=false"),
            (~F.coalesce("network_enabled", F.lit(False)), "network_enabled=false"),
            (
                ~F.coalesce(F.col("availability").isin("ACTIVE_FREE", "ACTIVE_PROXY"), F.lit(False)),
                "availability",
            ),
            (F.col("_known") & ~F.coalesce("enabled", F.lit(False)), "disabled"),
            (
                F.col("_known") & ~F.coalesce("network_eligible", F.lit(False)),
                "network_eligible=false",
            ),
            (
                F.col("_known") & ~F.coalesce(F.col("rights_status") == "CLEARED", F.lit(False)),
                "rights",
            ),
            (
                F.col("_known") & ~F.coalesce("automated_fetch", F.lit(False)),
                "automated_fetch=false",
            ),
            (
                F.col("_known") & ~F.coalesce("public_redistribution", F.lit(False)),
                "public_redistribution=false",
            ),
            (
                F.col("series_allowlist").isNotNull()
                & (F.coalesce(F.size("series_ids"), F.lit(0)) <= 0),
                "no declared series",
            ),
            (
                F.col("series_allowlist").isNotNull() & (F.size(not_listed) > 0),
                "series not allowlisted",
            ),
        ]
    )
    return joined.select(
        "metric_id", "source_id", blockers.alias("blockers"),
        F.array_sort(F.coalesce(not_listed, F.array().cast("array<string>"))).alias("not_listed"),
    ).withColumn("eligible", F.size("blockers") == 0)


def effective_state(metrics: DataFrame) -> DataFrame:
    """Publication defaults: only implemented, active metrics keep a live state."""
    live = F.coalesce("implemented", F.lit(False))
    parked = F.col("availability").isin("MANUAL_READY", "UNAVAILABLE_FREE")
    closed = ~live | parked
    return metrics.select(
        "*",
        F.when(live, F.col("availability")).otherwise("UNAVAILABLE_FREE")
        .alias("effective_availability"),
        F.when(closed, "NOT_APPLICABLE").alias("effective_health"),
        F.when(closed, "UNKNOWN").alias("effective_freshness"),
        F.when(~live, "NOT_IMPLEMENTED").when(parked, F.col("reason"))
        .alias("effective_reason"),
    )


def privacy_projection(df: DataFrame, allow: Sequence[str]) -> DataFrame:
    """Only the allowlisted columns, in that order."""
    return df.select(*allow)


def forbidden_columns(df: DataFrame, markers: Sequence[str]) -> list[str]:
    """Schema paths whose name carries a forbidden marker (schema only, no data)."""
    found: list[str] = []

    def walk(schema, path: str) -> None:
        for field in getattr(schema, "fields", []):
            here = f"{path}{field.name}"
            if any(marker in field.name.lower() for marker in markers):
                found.append(here)
            inner = field.dataType
            while hasattr(inner, "elementType"):
                inner = inner.elementType
            if hasattr(inner, "valueType"):
                inner = inner.valueType
            walk(inner, here + ".")

    walk(df.schema, "")
    return found


def raw_markup_rows(df: DataFrame, columns: Sequence[str], tags: Sequence[str]) -> DataFrame:
    """Rows in which any text column carries raw document markup."""
    hit = any_of([F.lower(F.col(c)).contains(tag) for c in columns for tag in tags])
    return df.where(F.coalesce(hit, F.lit(False)))


# --- duplicates and conflicts ----------------------------------------------


def refused(df: DataFrame, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """The rows for which some rule holds, with its codes in ``violations``."""
    return df.withColumn("violations", codes([(F.coalesce(c, F.lit(True)), code) for c, code in rules])).where(F.size("violations") > 0)


def raise_refused(df: DataFrame, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """The rows unchanged; the job fails on the first for which some rule holds, or can't be decided.

    Every column carries the rule, as a filter could be put behind a later one
    that removes the row first.
    """
    found = F.concat_ws(",", codes([(F.coalesce(c, F.lit(True)), code) for c, code in rules]))
    return df.select(*[F.when(found != "", F.raise_error(found)).otherwise(F.col(f"`{c}`")).alias(c) for c in df.columns])


def fold_duplicates(
    df: DataFrame, key: Sequence[str], payload: Sequence[str], *,
    skip_null: str | None = None, strict: bool = False,
) -> DataFrame:
    """One row per key, with ``copies`` and ``is_conflict``.

    Exact repeats collapse. A key whose rows differ in any payload column is a
    conflict. Per column only min, max and a count travel, so the fold combines
    on the map side and a key of any size costs one row per task. ``skip_null``
    drops null rows first. ``strict`` makes the job fail on the first conflict.
    """
    rows = df if skip_null is None else df.where(F.col(skip_null).isNotNull())
    aggs: list[Column] = [F.count(F.lit(1)).alias("copies")]
    for c in payload:
        aggs += [
            F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}"),
            F.count(c).alias(f"_n_{c}"),
        ]
    folded = rows.groupBy(*key).agg(*aggs)
    differs = any_of(
        [
            F.coalesce(F.col(f"_lo_{c}") != F.col(f"_hi_{c}"), F.lit(False))
            | ((F.col(f"_n_{c}") > 0) & (F.col(f"_n_{c}") < F.col("copies")))
            for c in payload
        ]
    )
    out = folded.select(
        *key, *[F.col(f"_lo_{c}").alias(c) for c in payload], "copies",
        differs.alias("is_conflict"),
    )
    return fail_on_conflict(out, key) if strict else out


def fail_on_conflict(folded: DataFrame, key: Sequence[str]) -> DataFrame:
    """Raise while the job runs as soon as a conflicting key is met."""
    message = F.concat(
        F.lit("conflicting rows for "),
        F.concat_ws("/", *[F.col(k).cast("string") for k in key]),
    )
    return folded.where(
        F.when(F.col("is_conflict"), F.raise_error(message).cast("boolean"))
        .otherwise(F.lit(True))
    )


def clean_rows(folded: DataFrame) -> DataFrame:
    return folded.where(~F.col("is_conflict")).drop("is_conflict", "copies")


def conflict_rows(folded: DataFrame, key: Sequence[str]) -> DataFrame:
    return folded.where("is_conflict").select(*key, "copies")


def dedupe_observations(
    obs: DataFrame, *, key: Sequence[str] = ("series_id", "obs_date"),
    value: str = "value", strict: bool = False,
) -> DataFrame:
    """Null values are skipped first, then repeats fold and conflicts are marked."""
    return fold_duplicates(obs, key, [value], skip_null=value, strict=strict)


def operation_identity(op_id: Column, day: Column, kind: Column, released: Column) -> Column:
    """The id, else (date, type, release stamp). Amounts are not in the key, so a
    corrected repeat cannot pass as a second operation. Null means no identity."""
    given = F.trim(op_id)
    fallback = F.when(
        released.isNotNull(), F.concat_ws("|", day.cast("string"), kind, released.cast("string"))
    )
    return F.when(given != "", F.concat(F.lit("id:"), given)).otherwise(
        F.concat(F.lit("fallback:"), fallback)
    )


def duplicate_identities(df: DataFrame, key: Sequence[str], row_no: str) -> DataFrame:
    """Every repeat of an identity, with the number of its first row."""
    first = df.groupBy(*key).agg(
        F.min(row_no).alias("first_row"), F.count(F.lit(1)).alias("_n")
    ).where("_n > 1").drop("_n")
    return df.join(first, list(key)).where(F.col(row_no) != F.col("first_row")).select(
        *key, row_no, "first_row"
    )


# --- merges ----------------------------------------------------------------


def upsert_latest(
    prior: DataFrame, current: DataFrame, *, key: Sequence[str] = ("series_id", "obs_date"),
    mode: str = "incremental",
) -> DataFrame:
    """Incremental: current rows override by key. Backfill: current replaces all."""
    if mode == "backfill":
        return current
    tagged = prior.withColumn("_priority", F.lit(0)).unionByName(
        current.withColumn("_priority", F.lit(1))
    )
    return latest_by(tagged, key, ["_priority"]).drop("_priority")


def merge_events(
    events: DataFrame, *, day: str = "obs_date", flags: str = "flags",
    priority: str = "priority",
) -> DataFrame:
    """One row per day: union of all flags, later non-flag fields win."""
    others = [c for c in events.columns if c not in (day, flags, priority)]
    exploded = events.withColumn("_flag", F.explode_outer(flags))
    wins = [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col(priority))).alias(c) for c in others
    ]
    return exploded.groupBy(day).agg(
        F.array_sort(F.collect_set("_flag")).alias(flags), *wins
    )


# Text added to a merged event for each flag.
FLAG_NOTES: Mapping[str, str] = {
    "MONTH_END": "Month-end balance-sheet effects can move overnight rates.",
    "QUARTER_END": "Quarter-end balance-sheet effects can move overnight rates.",
    "YEAR_END": "Year-end balance-sheet effects can move overnight rates.",
    "TREASURY_SETTLEMENT": "Settlement can draw cash for a short time.",
    "LARGE_TREASURY_SETTLEMENT": "Settlement is above its trailing p90.",
    "TAX_WINDOW": "Within one business day of a reviewed deadline.",
}


def event_note(flags: str = "flags") -> Column:
    table = F.create_map(*[F.lit(x) for pair in FLAG_NOTES.items() for x in pair])
    return F.array_join(
        F.array_compact(F.transform(flags, lambda f: F.try_element_at(table, f))), " "
    )


def merge_audit_rows(
    prior: DataFrame, current: DataFrame, *, as_of, day: str = "index_date",
    retention_days: int = 45,
) -> DataFrame:
    """Distinct full rows within the retention window; a future row fails the job."""
    today = F.lit(as_of).cast("date")
    rows = prior.unionByName(current).where(
        F.col(day) >= F.date_sub(today, retention_days - 1)
    )
    return rows.distinct().where(
        F.when(F.col(day) > today, F.raise_error(F.lit("future-dated audit row")).cast("boolean"))
        .otherwise(F.lit(True))
    )


def retention_prune(
    df: DataFrame, *, as_of, day: str = "index_date", retention_days: int = 45
) -> DataFrame:
    """An inclusive window of n calendar days that ends at the as-of date."""
    today = F.lit(as_of).cast("date")
    return df.where(F.col(day).between(F.date_sub(today, retention_days - 1), today))


def merge_completed_partitions(
    prior: DataFrame, current: DataFrame, completed: DataFrame, master: DataFrame, *,
    key: str = "accession", day: str = "index_date", payload: Sequence[str],
    strict: bool = True,
) -> DataFrame:
    """Completed days come from ``current`` plus prior rows still in the day's
    master list; days that are not complete keep their last good rows."""
    untouched = prior.join(completed, day, "left_anti")
    retained = prior.join(completed, day, "left_semi").join(
        master.select(day, key), [day, key], "left_semi"
    )
    fresh = current.join(completed, day, "left_semi")
    merged = untouched.unionByName(retained).unionByName(fresh)
    folded = fold_duplicates(merged, [key], payload, strict=strict)
    return clean_rows(folded) if strict else folded


def latest_restatement(
    facts: DataFrame, key: Sequence[str], *, value: str = "value",
    accepted: str = "accepted_at", filed: str = "filed", form: str = "form",
    filing: str = "accession", usable: Column | None = None, strict: bool = False,
) -> DataFrame:
    """The latest accepted fact per key, with ``is_conflict`` for an unclear tie.

    Two combining aggregates: first within (key, accepted, filed), where a tie
    with different values shows, then the greatest such pair per key.
    """
    rows = facts if usable is None else facts.where(usable)
    rows = rows.where(F.col(accepted).isNotNull())
    payload = [c for c in facts.columns if c not in (*key, accepted, filed)]
    per_stamp = rows.groupBy(*key, accepted, filed).agg(
        F.max_by(
            F.struct(*payload),
            F.struct(F.col(form).endswith("/A"), F.col(filing)),
        ).alias("_row"),
        F.min(value).alias("_lo"), F.max(value).alias("_hi"),
    )
    latest = per_stamp.groupBy(*key).agg(
        F.max_by(
            F.struct(accepted, filed, "_row", "_lo", "_hi"), F.struct(accepted, filed)
        ).alias("_best")
    )
    out = latest.select(
        *key, F.col(f"_best.{accepted}").alias(accepted), F.col(f"_best.{filed}").alias(filed),
        *[F.col(f"_best._row.`{c}`").alias(c) for c in payload],
        (F.col("_best._lo") != F.col("_best._hi")).alias("is_conflict"),
    )
    return fail_on_conflict(out, key) if strict else out


def canonical_alias_row(
    index_rows: DataFrame, *, key: str = "accession", entity: str = "cik",
    path: str = "path", metadata: Sequence[str] = ("form", "filed", "index_date"),
) -> DataFrame:
    """Many index rows per filing: the filer's own alias, else the smallest id,
    else the path; the metadata of all aliases must agree."""
    filer = F.substring(key, 1, 10).cast("bigint")
    choice = F.struct(
        (F.col(entity).cast("bigint") != filer).alias("other"),
        F.col(entity).cast("bigint").alias("id"), F.col(path).alias("p"),
    )
    aggs = [F.min(choice).alias("_best"), F.count(F.lit(1)).alias("aliases")]
    for c in metadata:
        aggs += [F.min(c).alias(c), F.max(c).alias(f"_hi_{c}")]
    grouped = index_rows.groupBy(key).agg(*aggs)
    return grouped.select(
        key, F.col("_best.id").cast("string").alias(entity), F.col("_best.p").alias(path),
        *metadata, "aliases",
        any_of([F.col(c) != F.col(f"_hi_{c}") for c in metadata]).alias("is_conflict"),
    )


def set_difference(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys of ``left`` that ``right`` lacks."""
    return left.select(*key).distinct().join(right.select(*key), list(key), "left_anti")


def set_mismatch(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that only one of two outputs has; empty when the sets are equal."""
    sides = left.select(*key, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*key, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    seen = sides.groupBy(*key).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    return seen.where("_l <> _r").select(
        *key, F.when(F.col("_l") == 1, "left").otherwise("right").alias("only_in")
    )
