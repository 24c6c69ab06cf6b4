"""Rows per second of the window operators on synthetic series.

usage: python tools/scale_run.py [SERIES [DAYS]]

The series come from ``spark.range`` with a fixed hash, one of them 20 times
longer than the rest.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from seriesloom.operators import bands, joins, windows  # noqa: E402
from seriesloom.session import local_session, new_table_path  # noqa: E402


def main() -> None:
    series = int(sys.argv[1]) if len(sys.argv) > 1 else 2000
    days = int(sys.argv[2]) if len(sys.argv) > 2 else 1250
    spark = local_session("scale", cores="8", shuffle_partitions=32, memory="16g")
    total = series * days + 20 * days
    sid = F.when(F.col("id") < series * days, F.floor(F.col("id") / days)).otherwise(series)
    day = F.when(F.col("id") < series * days, F.col("id") % days).otherwise(F.col("id") - series * days)
    path = new_table_path(spark, "scale")
    spark.range(0, total, 1, 32).select(
        F.format_string("s%06d", sid).alias("series_id"),
        F.date_add(F.lit("1950-01-01").cast("date"), day.cast("int")).alias("obs_date"),
        (F.pmod(F.xxhash64("id"), F.lit(100000)) / 1000.0).alias("value"),
    ).write.parquet(path)
    obs = spark.read.parquet(path)
    runs = {
        "k_obs_changes": lambda: windows.k_obs_changes(obs, [1, 5, 20]),
        "endpoint_changes": lambda: windows.endpoint_changes(obs, [1, 5, 20]),
        "spread_stats": lambda: windows.spread_stats(obs),
        "trailing_streak": lambda: windows.trailing_streak(obs, F.col("value") > 50),
        "trailing_slope_20": lambda: windows.trailing_slope(obs, 20),
        "population_z_156": lambda: windows.population_z(obs),
        "midrank_trailing_756": lambda: bands.midrank_trailing(obs),
        "midrank_endpoint_756": lambda: bands.midrank_endpoint(obs),
        "prior_only_band": lambda: bands.prior_only_band(obs, quantiles=[0.8, 0.95], minimum=60),
        "calendar_year_percentile": lambda: bands.calendar_year_percentile(obs),
        "asof_backward": lambda: joins.asof_join_backward(
            obs, obs.where("value > 90").withColumnRenamed("value", "rate"), by=["series_id"],
            right_columns=["rate"],
        ),
    }
    for name, run in runs.items():
        start = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - start
        print(f"{name:26s} {took:7.1f} s {total / took / 1e6:7.2f} M rows/s", flush=True)
    print("rows", total)


if __name__ == "__main__":
    main()
