"""All published tables as one numbered snapshot behind one pointer.

    root/snapshots/N-<id>/<table>        the tables of an attempt
    root/snapshots/N-<id>/violations     what the checks found in them
    root/pointers/N                      the manifest: folder, tables, rows, schemas

An attempt writes its tables, reads them back and runs every check over what
was read. Only if nothing is found does its pointer appear. Readers follow the
highest number, so they see all tables of one attempt or none of it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.checks.checks import VIOLATION
from seriesloom.files import Files

Checks = Callable[[Mapping[str, DataFrame]], DataFrame]


class PublicationBlocked(ValueError):
    """The attempt's folder holds the tables and the violations found in them."""

    def __init__(self, message: str, folder: str) -> None:
        super().__init__(message)
        self.folder = folder


class Snapshot(NamedTuple):
    number: int
    folder: str
    tables: Mapping[str, Mapping]


def snapshots(spark: SparkSession, root: str) -> list[Snapshot]:
    """The published snapshots, oldest first. A pointer that is still being written doesn't count."""
    files, found = Files(spark, root), []
    for number in files.numbers("pointers"):
        text = files.read(f"pointers/{number}")
        if text.endswith("\n"):
            entry = json.loads(text)
            found.append(Snapshot(number, entry["folder"], entry["tables"]))
    return found


def read_snapshot(spark: SparkSession, root: str, number: int | None = None) -> dict[str, DataFrame]:
    """All tables of one snapshot, of the newest unless a number is given."""
    found = [s for s in snapshots(spark, root) if number is None or s.number == number]
    if not found:
        raise LookupError(f"no snapshot {'' if number is None else number} under {root}")
    return _tables(spark, found[-1].folder, found[-1].tables)


def _tables(spark: SparkSession, folder: str, tables: Mapping[str, Mapping]) -> dict[str, DataFrame]:
    return {
        name: spark.read.schema(T.StructType.fromJson(entry["schema"])).parquet(f"{folder}/{name}")
        for name, entry in tables.items()
    }


def publish_snapshot(
    spark: SparkSession, root: str, tables: Mapping[str, DataFrame], checks: Checks, *, may_be_empty: tuple[str, ...] = (),
) -> Snapshot:
    """Write the tables, check what was written, and publish them together; or raise and leave the last snapshot in place.

    The number is one above the highest. Of two writers with the same number
    the second to finish fails: its checks ran beside a snapshot that it hadn't
    seen. ``checks`` gets the stored tables, never the ones passed in.
    """
    files = Files(spark, root)
    number = max(files.numbers("pointers"), default=0) + 1
    folder = f"{root}/snapshots/{number}-{uuid.uuid4().hex}"
    entries = {}
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
        entries[name] = {"schema": df.schema.jsonValue()}
    stored = _tables(spark, folder, entries)
    for name, df in stored.items():
        entries[name]["rows"] = df.count()
    empty = [(n, "EMPTY_TABLE", "") for n, e in entries.items() if not e["rows"] and n not in may_be_empty]
    found = checks(stored).select("check_id", "key", "detail")
    found = found.unionByName(spark.createDataFrame(empty, "key string, check_id string, detail string").select(*found.columns))
    found.write.parquet(f"{folder}/violations")
    total = spark.read.schema(VIOLATION).parquet(f"{folder}/violations").count()
    if total:
        raise PublicationBlocked(f"publication blocked, violations: {total}", folder)
    files.create(f"pointers/{number}", json.dumps({"folder": folder, "tables": entries}) + "\n")
    return Snapshot(number, folder, entries)


def blocked_violations(spark: SparkSession, blocked: PublicationBlocked) -> DataFrame:
    return spark.read.schema(VIOLATION).parquet(f"{blocked.folder}/violations")


def publish(found: DataFrame, output: DataFrame, root: str) -> Snapshot:
    """One table whose violations are known already."""
    return publish_snapshot(output.sparkSession, root, {"data": output}, lambda _: found)


def read_published(spark: SparkSession, root: str) -> DataFrame:
    return read_snapshot(spark, root)["data"]


def published_history(spark: SparkSession, root: str) -> DataFrame:
    """A row per snapshot and table: number, table, rows."""
    rows = [(s.number, name, entry["rows"]) for s in snapshots(spark, root) for name, entry in sorted(s.tables.items())]
    return spark.createDataFrame(rows, "snapshot bigint, table_name string, n_rows bigint").withColumn(
        "current", F.col("snapshot") == max((r[0] for r in rows), default=0)
    )
