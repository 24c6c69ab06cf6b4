"""Session defaults and the shared work folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Adaptive execution sizes and de-skews shuffles from measured bytes, and turns
# a join into a broadcast only when the finished side is below the threshold.
# That measured threshold is the size check for every small side in this
# library: no operator uses a broadcast hint.
ADAPTIVE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(
    app: str = "seriesloom", *, cores: str = "*", shuffle_partitions: int = 8,
    memory: str = "8g", **extra: str,
) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
    )
    for key, value in {**ADAPTIVE_CONF, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares between nodes (``spark.checkpoint.dir``).

    Only where that setting is absent and the session runs on one machine, as in
    tests, is a local folder made.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        configured = os.path.join(tempfile.mkdtemp(prefix="seriesloom-"), "shared")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def new_table_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
