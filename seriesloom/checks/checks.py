"""Checks that re-derive published figures and report every difference."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.hashing import row_hash
from seriesloom.functions.scalars import codes, within
from seriesloom.operators.aggregates import bucketed_totals
from seriesloom.operators.growth import growth_acceleration, ordinal_window_stats
from seriesloom.operators.windows import latest_per_series, position_stats, tail_array

VIOLATION = "check_id string, key string, detail string"


def violations(df: DataFrame, check_id: str | Column, key: Sequence[str], detail: Column | str = "") -> DataFrame:
    check = F.lit(check_id) if isinstance(check_id, str) else check_id
    text = F.lit(detail) if isinstance(detail, str) else detail
    return df.select(
        check.alias("check_id"),
        F.concat_ws("/", *[F.col(k).cast("string") for k in key]).alias("key"),
        text.cast("string").alias("detail"),
    )


def all_violations(checks: Sequence[DataFrame]) -> DataFrame:
    """The publication check: the union of all checks."""
    return reduce(lambda a, b: a.unionByName(b), checks)


# --- K1–K5 -----------------------------------------------------------------


def check_schema_exact(df: DataFrame, expected: T.StructType) -> list[tuple[str, str]]:
    """Differences of column set and types; reads the schema only."""
    have = {f.name: f.dataType for f in df.schema.fields}
    want = {f.name: f.dataType for f in expected.fields}
    out = [("MISSING_COLUMN", n) for n in want if n not in have]
    out += [("EXTRA_COLUMN", n) for n in have if n not in want]
    out += [("COLUMN_TYPE", n) for n in want if n in have and have[n] != want[n]]
    return sorted(out)


def check_values(
    df: DataFrame, key: Sequence[str], *, required: Sequence[str] = (),
    enums: Mapping[str, Sequence[str]] = {}, finite: Sequence[str] = (),
    patterns: Mapping[str, str] = {},
) -> DataFrame:
    """Required, enumerated, finite and pattern columns, all in one pass."""
    rules: list[tuple[Column, str]] = [(F.col(c).isNull(), f"REQUIRED:{c}") for c in required]
    rules += [
        (F.col(c).isNotNull() & ~F.col(c).isin(*allowed), f"ENUM:{c}")
        for c, allowed in enums.items()
    ]
    rules += [
        (F.isnan(c) | (F.abs(F.col(c)) == float("inf")), f"FINITE:{c}") for c in finite
    ]
    rules += [
        (F.col(c).isNotNull() & ~F.col(c).rlike(p), f"PATTERN:{c}") for c, p in patterns.items()
    ]
    rows = df.select(*key, F.explode(codes(rules)).alias("_code"))
    return violations(rows, "SCHEMA", key, F.col("_code"))


def check_domain(df: DataFrame, key: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break a domain rule; an unknown outcome counts as broken."""
    found = codes([(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()])
    rows = df.select(*key, F.explode(found).alias("_code"))
    return violations(rows, "DOMAIN", key, F.col("_code"))


def operation_domain(tolerance: float = 1e-9) -> dict[str, Column]:
    """Domain rules of daily operation rows."""
    c = F.col
    return {
        "NON_NEGATIVE": (c("accepted") >= 0) & (c("eligible") >= 0) & (c("exercise") >= 0),
        "ACCEPTED_WITHIN_SUBMITTED": c("accepted") <= c("submitted"),
        "PARTS_ADD_UP": F.abs(c("eligible") + c("exercise") - c("accepted")) <= tolerance,
        "EXERCISE_ONLY": ~c("exercise_only") | (c("has_exercise") & (c("eligible") == 0)),
    }


def check_strictly_increasing(
    df: DataFrame, *, by: Sequence[str], order: str, date: str = "obs_date",
    block_rows: int = 1_000_000,
) -> DataFrame:
    """Rows whose date does not lie after the previous row's, in stored order.

    This runs before anything is folded, so one key may own most rows. It is cut
    into blocks of the numeric ``order`` column; the first row of a block is
    compared with the last one of the block before, from one row per block.
    """
    rows = df.select(*by, order, date).withColumn("_block", F.floor(F.col(order) / block_rows))
    ends = rows.groupBy(*by, "_block").agg(F.max_by(date, order).alias("_last"))
    blocks = ends.select(
        *by, "_block", F.lag("_last").over(Window.partitionBy(*by).orderBy("_block")).alias("_carry")
    )
    within = Window.partitionBy(*by, "_block").orderBy(order)
    seen = rows.withColumn("_prev", F.lag(date).over(within)).join(blocks, [*by, "_block"])
    late = seen.where(F.col(date) <= F.coalesce("_prev", "_carry"))
    return violations(late, "STRICTLY_INCREASING", [*by, order], F.col(date).cast("string"))


def check_same_attributes(
    left: DataFrame, right: DataFrame, key: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Attributes that differ between two outputs, and keys only one of them has."""
    r = right.select(*key, *[F.col(c).alias(f"_r_{c}") for c in columns], F.lit(1).alias("_in_r"))
    l = left.select(*key, *columns, F.lit(1).alias("_in_l"))
    joined = l.join(r, list(key), "full_outer")
    both = F.col("_in_l").isNotNull() & F.col("_in_r").isNotNull()
    found = codes(
        [
            (F.col("_in_l").isNull(), "ONLY_RIGHT"), (F.col("_in_r").isNull(), "ONLY_LEFT"),
            *[(both & ~F.col(c).eqNullSafe(F.col(f"_r_{c}")), c) for c in columns],
        ]
    )
    rows = joined.select(*key, F.explode(found).alias("_code"))
    return violations(rows, "SAME_ATTRIBUTES", key, F.col("_code"))


def check_endpoint_and_tail(
    latest: DataFrame, obs: DataFrame, *, by: Sequence[str] = ("series_id",), tail: int = 22,
    date: str = "obs_date", value: str = "value",
) -> DataFrame:
    """Published endpoint and last points against the series; a null endpoint of
    the series must be published as null.

    ``latest``: by, obs_date, value, tail.
    """
    ends = latest_per_series(obs, by=by, date=date, columns=[value]).join(
        tail_array(obs, tail, by=by, date=date, value=value), list(by), "left"
    )
    return check_same_attributes(latest, ends, by, [date, value, "tail"]).withColumn(
        "check_id", F.lit("ENDPOINT_AND_TAIL")
    )


# --- recomputation ---------------------------------------------------------


def compare_recomputed(
    published: DataFrame, recomputed: DataFrame, key: Sequence[str],
    tolerances: Mapping[str, float], check_id: str, exact: Sequence[str] = (),
) -> DataFrame:
    """Published against recomputed figures, per column, null-safe."""
    columns = [*tolerances, *exact]
    r = recomputed.select(
        *key, *[F.col(c).alias(f"_r_{c}") for c in columns], F.lit(1).alias("_in_r")
    )
    joined = published.select(*key, *columns, F.lit(1).alias("_in_p")).join(
        r, list(key), "full_outer"
    )
    both = F.col("_in_p").isNotNull() & F.col("_in_r").isNotNull()
    found = codes(
        [
            (F.col("_in_p").isNull(), "NOT_PUBLISHED"), (F.col("_in_r").isNull(), "NOT_DERIVABLE"),
            *[
                (both & ~within(F.col(c), F.col(f"_r_{c}"), tol), c)
                for c, tol in tolerances.items()
            ],
            *[(both & ~F.col(c).eqNullSafe(F.col(f"_r_{c}")), c) for c in exact],
        ]
    )
    rows = joined.select(*key, F.explode(found).alias("_code"))
    return violations(rows, check_id, key, F.col("_code"))


def recompute_position_stats(published: DataFrame, positions: DataFrame) -> DataFrame:
    key = ["contract", "category"]
    return compare_recomputed(
        published, position_stats(positions), key,
        {c: 1e-12 for c in ("net_pct", "change_8_weeks", "change_12_weeks", "z_score_3_year")},
        "POSITION_STATS", exact=["net_position", "open_interest", "sample_size"],
    )


def check_position_rows(positions: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Net position and percentages of every row against its own components."""
    c = F.col
    raw = F.lit(100.0) * c("net_position") / F.nullif(c("open_interest").cast("double"), F.lit(0.0))
    return check_domain(
        positions, ["contract", "category", "obs_date"],
        {
            "NON_NEGATIVE": (c("long_position") >= 0) & (c("short_position") >= 0)
            & (c("open_interest") > 0),
            "NET_POSITION": c("net_position") == c("long_position") - c("short_position"),
            "NET_PERCENT": F.abs(c("net_pct_raw") - raw) <= tolerance,
            "VALUE": F.abs(c("value") - F.round(raw, 6)) <= tolerance,
        },
    )


def recompute_ordinal_stats(published: DataFrame, *, by: Sequence[str] = ("pair",)) -> DataFrame:
    """Rebuild the quarterly figures from the published components alone."""
    base = published.select(
        *by, "ordinal",
        (
            F.col("numerator") / F.nullif(F.col("denominator"), F.lit(0.0)) * 100
        ).alias("ratio"),
    )
    fields = {"value": 1e-6, "change_1_quarter_pp": 2e-6, "qoq_pct": 2e-6, "yoy_pct": 2e-6,
              "midrank": 2e-6}
    from_published = ordinal_window_stats(
        base.withColumn("ratio", F.round("ratio", 6)), by=by
    )
    return compare_recomputed(
        published, from_published, [*by, "ordinal"], fields, "ORDINAL_STATS",
        exact=["midrank_sample_size"],
    )


def recompute_growth(
    published: DataFrame, *, by: Sequence[str], date: str = "obs_date", value: str = "value",
    tolerance: float = 2e-6,
) -> DataFrame:
    """Growth, acceleration and direction from the published levels."""
    again = growth_acceleration(published.select(*by, date, value), by=by, date=date, value=value)
    fields = ("qoq_pct", "yoy_pct", "qoq_acceleration_pp", "yoy_acceleration_pp")
    return compare_recomputed(
        published, again, [*by, date], {f: tolerance for f in fields}, "GROWTH",
        exact=["direction"],
    )


def check_consecutive(
    df: DataFrame, *, by: Sequence[str], ordinal: str = "ordinal"
) -> DataFrame:
    """Quarters that do not follow their predecessor directly."""
    w = Window.partitionBy(*by).orderBy(ordinal)
    rows = df.withColumn("_prev", F.lag(ordinal).over(w)).where(
        F.col("_prev").isNotNull() & (F.col(ordinal) != F.col("_prev") + 1)
    )
    return violations(rows, "CONSECUTIVE", [*by, ordinal])


def check_twin_series(
    left: DataFrame, right: DataFrame, key: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Two series built from one base must carry the same rows."""
    return check_same_attributes(left, right, key, columns).withColumn(
        "check_id", F.lit("TWIN_SERIES")
    )


def recompute_by_hash(
    published: DataFrame, recomputed: DataFrame, key: Sequence[str], check_id: str
) -> DataFrame:
    """Whole rows against rebuilt rows, by hash: for clauses and interpretations."""
    columns = [c for c in published.columns if c not in key]

    def hashed(df: DataFrame, name: str) -> DataFrame:
        return df.select(*key, row_hash(columns).alias(name))

    joined = hashed(published, "_p").join(hashed(recomputed, "_r"), list(key), "full_outer")
    rows = joined.where(~F.col("_p").eqNullSafe(F.col("_r")))
    detail = (
        F.when(F.col("_p").isNull(), "NOT_PUBLISHED").when(F.col("_r").isNull(), "NOT_DERIVABLE")
        .otherwise("DIFFERENT")
    )
    return violations(rows, check_id, key, detail)


def recompute_clauses(
    published: DataFrame, recomputed: DataFrame, *, key: Sequence[str]
) -> DataFrame:
    return recompute_by_hash(published, recomputed, key, "CLAUSES")


def recompute_interpretation(published: DataFrame, recomputed: DataFrame) -> DataFrame:
    return recompute_by_hash(published, recomputed, ["metric_id"], "INTERPRETATION")


def recompute_from_ledger(
    published: DataFrame, recomputed: DataFrame, *, by: Sequence[str], as_of=None, today=None
) -> DataFrame:
    """Published filing statistics against those of the ledger; a ledger dated
    after today is a violation of its own."""
    found = recompute_by_hash(published, recomputed, by, "LEDGER")
    if as_of is not None and today is not None:
        late = published.where(F.lit(as_of).cast("date") > F.lit(today).cast("date"))
        found = found.unionByName(violations(late, "LEDGER_FUTURE", by))
    return found


def check_bucket_partition(
    totals: DataFrame, *, by: Sequence[str] = ("accession",), bucket: str = "bucket"
) -> DataFrame:
    """ALL equals the sum of the flag buckets; priced never exceeds its count."""
    measures = [c for c in totals.columns if c not in (*by, bucket)]
    is_all = F.col(bucket) == "ALL"
    sums = totals.groupBy(*by).agg(
        *[
            F.coalesce(F.sum(F.when(is_all, F.col(m))), F.lit(0)).alias(f"_a_{m}") for m in measures
        ],
        *[
            F.coalesce(F.sum(F.when(~is_all, F.col(m))), F.lit(0)).alias(f"_p_{m}")
            for m in measures
        ],
        F.count_if(~is_all & (F.col("eligible_count") > 0)).alias("_flags"),
    )
    rules = [(F.col(f"_a_{m}") != F.col(f"_p_{m}"), f"SUM:{m}") for m in measures]
    rules += [
        (F.col("_a_eligible_count") != F.col("_a_buy_count") + F.col("_a_sell_count"), "ELIGIBLE"),
        (F.col("_a_priced_count") != F.col("_a_buy_priced") + F.col("_a_sell_priced"), "PRICED"),
        (
            (F.col("_a_buy_priced") > F.col("_a_buy_count"))
            | (F.col("_a_sell_priced") > F.col("_a_sell_count")), "PRICED_EXCEEDS",
        ),
    ]
    rows = sums.select(*by, F.explode(codes(rules)).alias("_code"))
    return violations(rows, "BUCKET_PARTITION", by, F.col("_code"))


def check_flag_matches(
    totals: DataFrame, filings: DataFrame, *, key: str = "accession", bucket: str = "bucket"
) -> DataFrame:
    """A filing's transactions must all lie in the bucket of its own flag."""
    used = totals.where((F.col(bucket) != "ALL") & (F.col("eligible_count") > 0))
    rows = used.join(filings.select(key, "flag"), key).where(F.col(bucket) != F.col("flag"))
    return violations(rows, "BUCKET_FLAG", [key], F.col(bucket))


def recompute_buckets(published: DataFrame, transactions: DataFrame) -> DataFrame:
    again = bucketed_totals(transactions)
    measures = [c for c in again.columns if c not in ("accession", "bucket")]
    return compare_recomputed(
        published, again, ["accession", "bucket"], {}, "BUCKETS", exact=measures
    )


def check_source_consistency(
    sources: DataFrame, rollup: DataFrame, *, by: Sequence[str] = ("source_id",)
) -> DataFrame:
    """Published source rows against the roll-up of their series' states."""
    columns = ["status", "freshness", "obs_date", "released_at", "last_success_at"]
    return check_same_attributes(sources, rollup, by, columns).withColumn(
        "check_id", F.lit("SOURCE_CONSISTENCY")
    )


def check_switch_rules(
    switches: DataFrame, blocks: DataFrame, expected: Mapping[str, Sequence[str]]
) -> DataFrame:
    """Evidence-only switches carry no assessment, block ids are fixed, and an
    unavailable block shows no trigger and no direction.

    ``switches``: switch_id, mode, assessment, available_blocks, total_blocks.
    """
    table = F.create_map(
        *[
            x for s, ids in expected.items()
            for x in (F.lit(s), F.array_sort(F.array(*[F.lit(i) for i in ids])))
        ]
    )
    per = blocks.groupBy("switch_id").agg(
        F.array_sort(F.collect_set("block_id")).alias("_ids"),
        F.count(F.lit(1)).alias("_n"), F.count_if("available").alias("_open"),
        F.count_if(
            ~F.col("available")
            & (F.col("triggered").isNotNull() | (F.col("direction") != "UNKNOWN"))
        ).alias("_leaks"),
    )
    joined = switches.join(per, "switch_id", "left")
    found = codes(
        [
            (
                (F.col("mode") == "EVIDENCE_ONLY") & F.col("assessment").isNotNull(),
                "EVIDENCE_ONLY_ASSESSMENT",
            ),
            (
                ~F.coalesce(F.col("_ids") == F.try_element_at(table, F.col("switch_id")), F.lit(False)),
                "BLOCK_IDS",
            ),
            (~F.col("total_blocks").eqNullSafe(F.col("_n")), "TOTAL_BLOCKS"),
            (~F.col("available_blocks").eqNullSafe(F.col("_open")), "AVAILABLE_BLOCKS"),
            (F.col("_leaks") > 0, "UNAVAILABLE_BLOCK_SHOWS_VALUE"),
        ]
    )
    rows = joined.select("switch_id", F.explode(found).alias("_code"))
    return violations(rows, "SWITCH_RULES", ["switch_id"], F.col("_code"))


def check_held_series_null(
    latest: DataFrame, held: DataFrame, *, by: Sequence[str] = ("series_id",)
) -> DataFrame:
    """A series without rights to publish must be null throughout."""
    rows = latest.join(held.select(*by), list(by), "left_semi").where(
        F.col("value").isNotNull() | F.col("obs_date").isNotNull()
    )
    return violations(rows, "HELD_SERIES", by)


def recheck_reviewed_records(
    points: DataFrame, spans: DataFrame, *, recomputed: DataFrame, validated: DataFrame,
    by: Sequence[str] = ("metric_id", "asof_date"), max_age_days: int = 120,
) -> DataFrame:
    """Stored reviewed points against their detail records: the row rules hold,
    the age limit holds, counts and direction are derived again.

    ``spans`` are the rows of `joins.entity_spans`, one per record with the last
    day it stands for. Only days of a span beyond the limit are unrolled, and of
    these the as-of dates of ``recomputed`` are violations.
    """
    # Rows without a code leave no row of their own.
    rules = validated.select(
        F.lit("REVIEWED_ROW").alias("check_id"),
        F.concat_ws("/", "company_id", "metric_id", "accession").alias("key"),
        F.explode("violations").alias("detail"),
    )
    late = F.date_add("as_of", max_age_days + 1)
    old = spans.where(F.col("until") >= late).select(
        *[c for c in by if c != "asof_date"], "company_id", F.explode(F.sequence(late, F.col("until"))).alias("asof_date")
    )
    age = violations(old.join(recomputed.select(*by).distinct(), list(by), "left_semi"), "REVIEWED_AGE", [*by, "company_id"])
    fields = ["direction", "record_count", "company_count", "comparable_count"]
    again = check_same_attributes(points, recomputed, by, fields).withColumn(
        "check_id", F.lit("REVIEWED_POINT")
    )
    return all_violations([rules, age, again])
