"""Written tables and stored ledgers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import rows
from seriesloom.session import new_table_path
from seriesloom.sources import landing, sinks

COLUMNS = ["index_date", "accession", "value"]


@pytest.fixture
def ledger(spark):
    path = new_table_path(spark, "ledger")
    entries = spark.range(300).select(
        F.date_add(F.lit("2026-08-01").cast("date"), (F.col("id") % 3).cast("int")).alias("index_date"),
        F.col("id").alias("accession"), (F.col("id") * 2).alias("value"),
    )
    sinks.write_day_shards(entries, path)
    return path, entries


def test_stored_shards_verify(spark, ledger):
    path, _ = ledger
    assert rows(sinks.verify_day_shards(spark, path, columns=COLUMNS, as_of="2026-08-05", retention_days=45)) == []
    late = rows(sinks.verify_day_shards(spark, path, columns=COLUMNS, as_of="2026-08-02", retention_days=45))
    assert [(r["check_id"], r["key"]) for r in late] == [("OUT_OF_WINDOW", "2026-08-03")]


def test_rewriting_one_day_keeps_the_others(spark, ledger):
    path, entries = ledger
    day = entries.where("index_date = DATE'2026-08-02'").withColumn("value", F.lit(0).cast("bigint"))
    sinks.write_day_shards(day, path)
    stored = spark.read.parquet(f"{path}/shards")
    assert stored.count() == 300 and stored.where("value = 0").count() == 101
    assert rows(sinks.verify_day_shards(spark, path, columns=COLUMNS)) == []


def test_altered_misplaced_and_repeated_rows_are_found(spark, ledger):
    path, _ = ledger
    stored = spark.read.parquet(f"{path}/shards")
    declared = sinks.read_manifest(spark, path)
    check = lambda df: {(r["check_id"], r["key"]) for r in rows(sinks.shard_violations(df, declared, columns=COLUMNS))}
    altered = stored.withColumn("value", F.when(F.col("accession") == 4, -1).otherwise(F.col("value")))
    assert check(altered) == {("SHARD_HASH", "2026-08-02")}
    moved = stored.withColumn("shard_day", F.when(F.col("accession") == 4, F.lit("2026-08-03").cast("date")).otherwise(F.col("shard_day")))
    assert ("WRONG_SHARD", "4") in check(moved)
    assert ("DUPLICATE_KEY", "4") in check(stored.unionByName(stored.where("accession = 4")))
    assert check(stored.where("shard_day <> DATE'2026-08-03'")) == {("SHARD_MISSING", "2026-08-03")}


def test_series_latest_and_catalog_outputs(spark, daily):
    base = new_table_path(spark, "out")
    data = daily(range(30)).unionByName(daily([1, None], series="t"))
    sinks.write_series(data, f"{base}/series")
    sinks.write_latest(data, f"{base}/latest")
    sinks.write_catalog(data.select("series_id").distinct(), f"{base}/catalog")
    assert spark.read.parquet(f"{base}/series").count() == 32
    latest = {r["series_id"]: r for r in rows(spark.read.parquet(f"{base}/latest"))}
    assert latest["t"]["value"] is None and len(latest["s"]["tail"]) == 22
    assert {r["series_path"] for r in rows(spark.read.json(f"{base}/catalog"))} == {"series/series_id=s", "series/series_id=t"}


def test_landed_files_are_read_whole_or_by_line(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.skip").write_text("x\n")
    assert landing.read_documents(spark, str(tmp_path), "*.txt").first()["payload"] == "one\ntwo\n"
    assert landing.read_lines(spark, str(tmp_path), "*.txt").count() == 2

