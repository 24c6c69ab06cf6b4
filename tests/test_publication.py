"""Snapshots behind one pointer, and the hash tree of a ledger."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from seriesloom.checks import checks, publication
from seriesloom.files import Files
from seriesloom.session import new_table_path
from seriesloom.sources import sinks


def _none(spark):
    return spark.createDataFrame([], checks.VIOLATION)


def _odd(tables):
    return checks.violations(tables["a"].where("id % 2 = 1"), "ODD", ["id"])


def test_a_fault_in_one_table_keeps_all_tables_back(spark):
    root = new_table_path(spark, "snap")
    even = spark.range(0, 10, 2)
    publication.publish_snapshot(spark, root, {"a": even, "b": spark.range(3)}, _odd)
    with pytest.raises(publication.PublicationBlocked, match="violations: 5") as blocked:
        publication.publish_snapshot(spark, root, {"a": spark.range(10), "b": spark.range(99)}, _odd)
    found = rows(publication.blocked_violations(spark, blocked.value), "key")
    assert [r["key"] for r in found] == ["1", "3", "5", "7", "9"]
    now = publication.read_snapshot(spark, root)
    assert now["a"].count() == 5 and now["b"].count() == 3
    second = publication.publish_snapshot(spark, root, {"a": even, "b": spark.range(7)}, _odd)
    assert second.number == 2 and publication.read_snapshot(spark, root)["b"].count() == 7
    assert publication.read_snapshot(spark, root, 1)["b"].count() == 3
    history = rows(publication.published_history(spark, root), "snapshot", "table_name")
    assert [(r["snapshot"], r["table_name"], r["n_rows"], r["current"]) for r in history] == [
        (1, "a", 5, False), (1, "b", 3, False), (2, "a", 5, True), (2, "b", 7, True)]


def test_checks_read_what_was_stored(spark):
    seen = {}

    def look(tables):
        seen.update({name: df.inputFiles() for name, df in tables.items()})
        return _none(spark)

    snapshot = publication.publish_snapshot(spark, new_table_path(spark, "snap"), {"a": spark.range(3)}, look)
    assert seen["a"] and all(snapshot.folder in f for f in seen["a"])


def test_an_empty_table_blocks_unless_it_may_be_empty(spark):
    root, tables = new_table_path(spark, "snap"), {"a": spark.range(2), "b": spark.range(0)}
    with pytest.raises(publication.PublicationBlocked):
        publication.publish_snapshot(spark, root, tables, lambda t: _none(spark))
    with pytest.raises(LookupError):
        publication.read_snapshot(spark, root)
    publication.publish_snapshot(spark, root, tables, lambda t: _none(spark), may_be_empty=("b",))
    assert publication.read_snapshot(spark, root)["b"].columns == ["id"]


def test_of_two_writers_one_wins_and_half_a_pointer_is_not_read(spark):
    root = new_table_path(spark, "snap")

    def race(tables):
        publication.publish_snapshot(spark, root, {"a": spark.range(4)}, lambda t: _none(spark))
        return _none(spark)

    with pytest.raises(Exception, match="(?i)exist"):
        publication.publish_snapshot(spark, root, {"a": spark.range(5)}, race)
    assert publication.read_snapshot(spark, root)["a"].count() == 4
    Files(spark, root).create("pointers/9", json.dumps({"folder": "x"})[:5])
    assert publication.read_snapshot(spark, root)["a"].count() == 4


def test_publish_of_one_table(spark):
    root, bad = new_table_path(spark, "one"), spark.createDataFrame([("C", "k", "d")], checks.VIOLATION)
    publication.publish(_none(spark), spark.range(3), root)
    publication.publish(_none(spark), spark.range(5), root)
    for found, output in ((bad, spark.range(9)), (bad, spark.range(0)), (_none(spark), spark.range(0))):
        with pytest.raises(ValueError):
            publication.publish(found, output, root)
    assert publication.read_published(spark, root).count() == 5


# --- the hash tree -----------------------------------------------------------


def _entries(spark, n=400):
    return spark.range(n).select(
        F.date_add(F.lit("2025-11-01").cast("date"), (F.col("id") % 100).cast("int")).alias("index_date"),
        F.col("id").alias("accession"), F.lit("x").alias("status"),
    )


def test_an_incremental_run_equals_a_full_one_and_reads_its_days_only(spark, monkeypatch):
    entries, paths = _entries(spark), [new_table_path(spark, "ledger") for _ in range(2)]
    sinks.write_day_shards(entries, paths[0])
    sinks.write_day_shards(entries.where("accession % 3 = 0 OR index_date < '2026-01-20'"), paths[1])
    read = []
    inner = sinks.stored_days
    monkeypatch.setattr(sinks, "stored_days", lambda *a: read.append(inner(*a)) or read[-1])
    sinks.write_day_shards(entries.where("index_date >= '2026-01-20'"), paths[1])
    days = {f.split("shard_day=")[1][:10] for f in read[0].inputFiles()}
    assert len(days) == 20 and min(days) == "2026-01-20"
    trees = [{(r["level"], r["node"]): (r["entries"], r["shard_sha256"]) for r in sinks.read_tree(spark, p).collect()} for p in paths]
    assert trees[0] == trees[1] and trees[0]["root", ""][0] == 400
    assert {k[0] for k in trees[0]} == {"days", "months", "years", "root"} and len(trees[0]) == 100 + 4 + 2 + 1
    assert rows(sinks.verify_day_shards(spark, paths[1], columns=["index_date", "accession", "status"])) == []


def test_the_tree_tells_a_broken_parent_and_changed_days(spark):
    path, entries = new_table_path(spark, "ledger"), _entries(spark)
    sinks.write_day_shards(entries, path)
    before = sinks.read_tree(spark, path)
    leaves = sinks.shard_manifest(entries.where("accession <> 5 AND index_date <> '2026-01-01'"))
    after = sinks.hash_tree(leaves.select(F.col("index_date").cast("string").alias("node"), "entries", "shard_sha256"))
    found = sorted(tuple(r) for r in sinks.changed_days(before, after).collect())
    assert found == [("2025-11-06", "CHANGED"), ("2026-01-01", "REMOVED")]
    spark.createDataFrame([("2025-11", 1, "no")], sinks.NODE).write.mode("overwrite").parquet(f"{path}/manifest/months/parent=2025")
    bad = {r["key"] for r in sinks.tree_violations(spark, path).collect()}
    assert bad == {"months/2025-11", "months/2025-12"}
