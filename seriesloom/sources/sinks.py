"""Output tables: series, latest rows, catalog, day shards with fingerprints."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.files import Files
from seriesloom.functions.hashing import array_fingerprint, group_fingerprint, row_hash
from seriesloom.operators.windows import latest_per_series, tail_array
from seriesloom.session import new_table_path


def write_series(obs: DataFrame, path: str) -> None:
    """Full series, one folder each, at the place that :func:`catalog_table` names.

    The range exchange splits a series that holds many rows over several files
    and keeps small ones together.
    """
    rows = obs.repartitionByRange("series_id", "obs_date").sortWithinPartitions(
        "series_id", "obs_date"
    )
    rows.write.mode("overwrite").partitionBy("series_id").parquet(path)


def latest_table(obs: DataFrame, *, tail: int = 22) -> DataFrame:
    """One row per series: endpoint date and value, row count and the last points."""
    ends = latest_per_series(obs, columns=["value"])
    return ends.join(tail_array(obs, tail), "series_id", "left")


def write_latest(obs: DataFrame, path: str, *, tail: int = 22) -> None:
    latest_table(obs, tail=tail).write.mode("overwrite").parquet(path)


def catalog_table(registry: DataFrame, *, root: str = "series") -> DataFrame:
    """Registry columns with the place where each series is stored."""
    return registry.withColumn(
        "series_path", F.concat(F.lit(f"{root}/series_id="), F.col("series_id"))
    )


def write_catalog(registry: DataFrame, path: str, *, root: str = "series") -> None:
    catalog_table(registry, root=root).write.mode("overwrite").json(path)


def shard_manifest(
    entries: DataFrame, *, day: str = "index_date", columns: Sequence[str] | None = None
) -> DataFrame:
    """One row per day: entry count and order-free fingerprint of its rows."""
    columns = columns or entries.columns
    return entries.select(day, row_hash(columns).alias("_h")).groupBy(day).agg(
        F.count(F.lit(1)).alias("entries"), group_fingerprint(F.col("_h")).alias("shard_sha256")
    )


def ledger_fingerprint(manifest: DataFrame) -> DataFrame:
    """The fingerprint over all shards, for the manifest itself."""
    line = F.sha2(F.to_json(F.struct(*sorted(manifest.columns))), 256)
    return manifest.agg(
        F.sum("entries").alias("entry_count"), group_fingerprint(line).alias("ledger_sha256")
    )


def write_day_shards(entries: DataFrame, path: str, *, day: str = "index_date") -> None:
    """One folder per day, and a tree of hashes over them.

    Only the days present are replaced, so an incremental run rewrites nothing
    else, and only their files are read back for their hashes. Rebalancing cuts
    a large day into several files of the advisory size and merges small ones.
    A day's rows also keep their own date, by which a misplaced row shows.
    """
    spark = entries.sparkSession
    rows = entries.withColumn("shard_day", F.col(day))
    (
        rows.hint("rebalance", day)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("shard_day").parquet(f"{path}/shards")
    )
    days = [r[0] for r in entries.select(F.col(day).cast("string")).distinct().collect()]  # calendar days
    if not days:
        return
    stored = stored_days(spark, path, entries.schema, days)
    leaves = shard_manifest(stored.select(*entries.columns), day=day).withColumnRenamed(day, "node")
    update_tree(spark, f"{path}/manifest", leaves.withColumn("node", F.col("node").cast("string")))


def stored_days(spark: SparkSession, path: str, schema, days: Sequence[str]) -> DataFrame:
    """The stored rows of the given days; no other day's folder is listed or read."""
    folders = [f"{path}/shards/shard_day={d}" for d in sorted(days)]
    return spark.read.schema(schema).option("basePath", f"{path}/shards").parquet(*folders)


# A node is a day, month, year or the root; its name is the first characters of the day.
TREE = (("days", 10), ("months", 7), ("years", 4), ("root", 0))
NODE = "node string, entries bigint, shard_sha256 string"


def parent_nodes(nodes: DataFrame, width: int) -> DataFrame:
    """Parents of the nodes: entries added up, and the SHA-256 of the children's lines, at most 31, 12 or one per year."""
    line = F.concat_ws(":", "node", F.col("entries").cast("string"), "shard_sha256")
    return nodes.groupBy(F.substring("node", 1, width).alias("node")).agg(
        F.sum("entries").alias("entries"), array_fingerprint(F.collect_list(line)).alias("shard_sha256")
    )


def hash_tree(leaves: DataFrame) -> DataFrame:
    """All nodes over the leaves (node, entries, shard_sha256) with their level."""
    levels, nodes = [leaves.withColumn("level", F.lit("days"))], leaves
    for name, width in TREE[1:]:
        nodes = parent_nodes(nodes, width)
        levels.append(nodes.withColumn("level", F.lit(name)))
    return reduce(DataFrame.unionByName, levels)


def update_tree(spark: SparkSession, path: str, leaves: DataFrame) -> None:
    """Put new leaves into the stored tree: per level only the siblings of changed nodes are read, and their folder replaced.

    A level is stored in one folder per parent. A run that fails halfway leaves
    parents that don't fit their children, which `tree_violations` shows; the
    same run again mends them.
    """
    files, changed = Files(spark, path), leaves
    for (level, _), (_, width) in zip(TREE, [*TREE[1:], ("", 0)]):
        changed = changed.withColumn("parent", F.substring("node", 1, width) if width else F.lit("all"))
        folder = new_table_path(spark, "changed-nodes")
        changed.write.parquet(folder)
        changed = spark.read.schema(changed.schema).parquet(folder)
        parents = [r[0] for r in changed.select("parent").distinct().collect()]  # months, years or one
        old = [f"{path}/{level}/parent={p}" for p in sorted(parents) if files.exists(f"{level}/parent={p}")]
        merged = changed
        if old:
            stored = spark.read.schema(f"{NODE}, parent string").option("basePath", f"{path}/{level}").parquet(*old)
            merged = stored.join(changed, "node", "left_anti").select(*changed.columns).unionByName(changed)
        merged_path = new_table_path(spark, "merged-nodes")  # a folder can't be read and replaced at once
        merged.write.parquet(merged_path)
        merged = spark.read.schema(merged.schema).parquet(merged_path)
        (
            merged.repartition("parent").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("parent").parquet(f"{path}/{level}")
        )
        if level == "root":
            return
        changed = parent_nodes(merged.drop("parent"), width)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """The stored nodes with their level."""
    return reduce(
        DataFrame.unionByName,
        [
            spark.read.schema(NODE).parquet(f"{path}/manifest/{level}")
            .select("node", "entries", "shard_sha256", F.lit(level).alias("level"))
            for level, _ in TREE
        ],
    )


def read_manifest(spark: SparkSession, path: str, *, day: str = "index_date") -> DataFrame:
    """The stored days: count and fingerprint of each."""
    leaves = spark.read.schema(NODE).parquet(f"{path}/manifest/days")
    return leaves.select(F.to_date("node").alias(day), "entries", "shard_sha256")


def tree_violations(spark: SparkSession, path: str) -> DataFrame:
    """Stored nodes that don't follow from the stored days."""
    tree = read_tree(spark, path)
    again = hash_tree(tree.where("level = 'days'").drop("level")).select(
        "level", "node", F.col("entries").alias("_n"), F.col("shard_sha256").alias("_hash")
    )
    same = F.col("entries").eqNullSafe(F.col("_n")) & F.col("shard_sha256").eqNullSafe(F.col("_hash"))
    return tree.join(again, ["level", "node"], "full_outer").where(~same).select(
        F.lit("TREE_NODE").alias("check_id"), F.concat_ws("/", "level", "node").alias("key")
    )


def changed_days(left: DataFrame, right: DataFrame) -> DataFrame:
    """Days that differ between two trees, found from the root down: below equal nodes nothing is compared."""
    def level(tree: DataFrame, name: str, side: str) -> DataFrame:
        return tree.where(F.col("level") == name).select("node", F.col("shard_sha256").alias(side))

    open_nodes = None
    for (name, _), (_, parent_width) in zip(reversed(TREE), [("", 0), *reversed(TREE)]):
        pair = level(left, name, "_l").join(level(right, name, "_r"), "node", "full_outer")
        if open_nodes is not None:
            up = F.substring("node", 1, parent_width)
            pair = pair.join(open_nodes, up == F.col("_open"), "left_semi")
        found = pair.where(~F.col("_l").eqNullSafe(F.col("_r")))
        open_nodes = found.select(F.col("node").alias("_open"))
    return found.select(
        "node", F.when(F.col("_l").isNull(), "ADDED").when(F.col("_r").isNull(), "REMOVED").otherwise("CHANGED").alias("change")
    )


def verify_day_shards(
    spark: SparkSession, path: str, *, columns: Sequence[str], key: str = "accession",
    day: str = "index_date", as_of=None, retention_days: int | None = None,
) -> DataFrame:
    """Violations of a stored ledger: wrong or undeclared shard, changed content,
    row in another day's shard, repeated key, shard outside the window, and a
    month, year or root that doesn't follow from its days."""
    rows = spark.read.parquet(f"{path}/shards")
    found = shard_violations(
        rows, read_manifest(spark, path, day=day), columns=columns, key=key, day=day, as_of=as_of,
        retention_days=retention_days,
    )
    return found.unionByName(tree_violations(spark, path))


def shard_violations(
    rows: DataFrame, declared: DataFrame, *, columns: Sequence[str], key: str = "accession",
    day: str = "index_date", shard: str = "shard_day", as_of=None,
    retention_days: int | None = None,
) -> DataFrame:
    actual = shard_manifest(
        rows.select(F.col(shard).alias("_shard"), *columns), day="_shard", columns=columns
    ).select(
        F.col("_shard").cast("date").alias(day), F.col("entries").alias("_n"),
        F.col("shard_sha256").alias("_hash"),
    )
    compared = declared.join(actual, day, "full_outer").select(
        F.col(day).cast("string").alias("key"),
        F.when(F.col("_hash").isNull(), "SHARD_MISSING")
        .when(F.col("shard_sha256").isNull(), "SHARD_UNDECLARED")
        .when(F.col("entries") != F.col("_n"), "ENTRY_COUNT")
        .when(F.col("shard_sha256") != F.col("_hash"), "SHARD_HASH").alias("check_id"),
    ).where("check_id IS NOT NULL")
    misplaced = rows.where(F.col(day) != F.col(shard).cast("date")).select(
        F.col(key).cast("string").alias("key"), F.lit("WRONG_SHARD").alias("check_id")
    )
    repeated = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(
        F.col(key).cast("string").alias("key"), F.lit("DUPLICATE_KEY").alias("check_id")
    )
    out = compared.unionByName(misplaced).unionByName(repeated)
    if as_of is not None and retention_days is not None:
        today = F.lit(as_of).cast("date")
        out = out.unionByName(
            declared.where(
                ~F.col(day).between(F.date_sub(today, retention_days - 1), today)
            ).select(F.col(day).cast("string").alias("key"), F.lit("OUT_OF_WINDOW").alias("check_id"))
        )
    return out.select("check_id", "key")
