"""Invariances: order, repeats, future rows, cuts along the time axis."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows
from seriesloom.checks import checks
from seriesloom.functions.hashing import group_fingerprint
from seriesloom.operators import bands, clean, joins, windows


@pytest.fixture(scope="module")
def many(spark):
    """40 series of 300 days with gaps, one of them ten times longer."""
    base = spark.range(0, 15000).select(
        F.when(F.col("id") < 3000, F.lit("s00"))
        .otherwise(F.format_string("s%02d", F.pmod(F.xxhash64("id"), F.lit(40)))).alias("series_id"),
        F.date_add(
            F.lit("2010-01-01").cast("date"),
            F.when(F.col("id") < 3000, F.col("id")).otherwise(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(300))).cast("int"),
        ).alias("obs_date"),
        (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1000)) / 10.0).alias("value"),
    )
    return base.groupBy("series_id", "obs_date").agg(F.min("value").alias("value"))


OPERATORS = {
    "midrank": lambda d: bands.midrank_trailing(d, window=50, minimum=5),
    "calendar": lambda d: bands.calendar_year_percentile(d, minimum=5),
    "z": lambda d: windows.population_z(d, 30),
    "streak": lambda d: windows.trailing_streak(d, F.col("value") > 30),
    "slope": lambda d: windows.trailing_slope(d, 10),
    "momentum": lambda d: windows.momentum_regime(d),
    "changes": lambda d: windows.k_obs_changes(d, [1, 5, 20]),
}


def _norm(df):
    out = []
    for r in rows(df, "series_id", "obs_date"):
        out.append({k: round(v, 9) if isinstance(v, float) else v for k, v in r.items()})
    return out


@pytest.mark.parametrize("name", OPERATORS)
def test_later_rows_never_change_earlier_ones(many, name):
    cut = F.col("obs_date") < "2010-07-01"
    whole = OPERATORS[name](many).where(cut)
    prefix = OPERATORS[name](many.where(cut))
    assert _norm(whole) == _norm(prefix)


@pytest.mark.parametrize("name", OPERATORS)
def test_row_order_does_not_matter(many, name):
    shuffled = many.repartition(7, F.rand(3)).sortWithinPartitions(F.rand(5))
    assert _norm(OPERATORS[name](many)) == _norm(OPERATORS[name](shuffled))


def test_exact_repeats_fold_away(many):
    twice = many.unionByName(many).unionByName(many.limit(100))
    assert _norm(clean.clean_rows(clean.dedupe_observations(twice))) == _norm(many)


def test_midrank_against_brute_force(many):
    got = {(r["series_id"], r["obs_date"]): (r["midrank"], r["sample_size"])
           for r in rows(bands.midrank_trailing(many, window=50, minimum=5))}
    series: dict = {}
    for r in rows(many, "series_id", "obs_date"):
        past = series.setdefault(r["series_id"], [])
        past.append(r["value"])
        window = past[-50:]
        below = sum(v < r["value"] for v in window)
        equal = sum(v == r["value"] for v in window)
        expected = (below + equal / 2) / len(window) if len(window) >= 5 else None
        mid, size = got[(r["series_id"], r["obs_date"])]
        assert size == len(window)
        assert (mid is None) == (expected is None) and (mid is None or abs(mid - expected) < 1e-12)


def test_batches_smaller_than_a_series_give_the_same_ranks(spark, many):
    expected = _norm(bands.midrank_trailing(many, window=50, minimum=5)), _norm(bands.calendar_year_percentile(many, minimum=5))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = _norm(bands.midrank_trailing(many, window=50, minimum=5)), _norm(bands.calendar_year_percentile(many, minimum=5))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == expected


@pytest.mark.parametrize("block", ["day", "week", "month", "year"])
def test_as_of_join_does_not_depend_on_the_cut(many, block):
    right = many.where("value > 90").withColumnRenamed("value", "rate")
    args = dict(by=["series_id"], right_columns=["rate"])
    assert _norm(joins.asof_join_backward(many, right, **args)) == _norm(
        joins.asof_join_backward(many, right, block=block, **args))


def test_increasing_check_does_not_depend_on_the_block(spark):
    data = spark.range(500).select(
        F.lit("k").alias("k"), F.col("id").alias("seq"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.when(F.col("id") % 50 == 49, 0).otherwise(F.col("id")).cast("int")).alias("obs_date"),
    )
    run = lambda n: rows(checks.check_strictly_increasing(data, by=["k"], order="seq", block_rows=n), "key")
    assert run(1) == run(7) == run(50) == run(10**6) and len(run(7)) == 10


def test_group_fingerprint_is_order_free_and_content_bound(many):
    def prints(df):
        digest = F.sha2(F.concat_ws("|", "series_id", "obs_date", "value"), 256)
        return {r["series_id"]: r["f"] for r in rows(df.groupBy("series_id").agg(group_fingerprint(digest).alias("f")))}

    first = prints(many)
    assert first == prints(many.repartition(9, F.rand(1)))
    changed = prints(many.withColumn("value", F.when(F.col("series_id") == "s01", F.col("value") + 1).otherwise(F.col("value"))))
    assert {k for k in first if first[k] != changed[k]} == {"s01"}
    assert prints(many.where("series_id = 's02'").unionByName(many.where("series_id = 's02'"))) != {"s02": first["s02"]}


def test_upsert_is_idempotent(many):
    current = many.where("obs_date >= DATE'2010-06-01'").withColumn("value", F.col("value") + 1)
    once = clean.upsert_latest(many, current)
    assert _norm(once) == _norm(clean.upsert_latest(once, current))


def test_schema_differences_are_named(spark):
    expected = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType()), T.StructField("c", T.DoubleType())])
    df = spark.createDataFrame([(1, "x", "y")], "a bigint, c string, d string")
    assert checks.check_schema_exact(df, expected) == [("COLUMN_TYPE", "c"), ("EXTRA_COLUMN", "d"), ("MISSING_COLUMN", "b")]


def test_forbidden_columns_are_found_at_any_depth(spark):
    df = spark.createDataFrame([], "a string, n struct<owner_name: string, x: array<struct<raw_text: string>>>")
    assert clean.forbidden_columns(df, ["owner_name", "raw"]) == ["n.owner_name", "n.x.raw_text"]


def test_future_audit_row_fails_the_job(spark):
    rows_ = spark.createDataFrame([("2026-08-10", "S", "r"), ("2026-06-01", "S", "r"), ("2026-08-10", "S", "r")],
                                  "index_date string, stage string, reason string").withColumn("index_date", F.to_date("index_date"))
    assert clean.merge_audit_rows(rows_, rows_, as_of="2026-08-20").count() == 1
    with pytest.raises(Exception, match="future-dated"):
        clean.merge_audit_rows(rows_, rows_, as_of="2026-08-09").collect()


@pytest.mark.parametrize("days, kept", [(44, True), (45, False)])
def test_retention_is_inclusive(spark, days, kept):
    df = spark.range(1).select(F.date_sub(F.lit("2026-08-20").cast("date"), days).alias("index_date"))
    assert (clean.retention_prune(df, as_of="2026-08-20").count() == 1) is kept
