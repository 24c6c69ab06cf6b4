"""Exact quantiles of groups of any size.

``percentile`` merges all distinct values of a group into one hash map in one
task. Here values are counted first and the counts are written once. Split
points of equal depth, from a mergeable sketch, cut each group into buckets that
hold about as many distinct values each, however far the values lie apart;
bucket counts tell in which bucket each wanted rank falls, and only that
bucket's distinct values are walked in order. The sketch only places the cuts,
so its error never reaches the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.session import new_table_path


def grouped_quantile(
    df: DataFrame, by: Sequence[str], value: str, quantiles: Sequence[float], *,
    names: Sequence[str], buckets: int = 256,
) -> DataFrame:
    """Linear-interpolated quantiles (0.5 = median) of ``value`` per group.

    Nulls, NaN and infinite values have no rank and are left out; ``skipped``
    counts those that are not null. A group without a finite value has no row.
    """
    spark, v = df.sparkSession, F.col(value).cast("double")
    counted = df.where(v.isNotNull()).groupBy(*by, v.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    path = new_table_path(spark, "value-counts")
    counted.write.parquet(path)
    every = spark.read.schema(counted.schema).parquet(path)
    finite = F.abs("_v") < F.lit(float("inf"))
    counts = every.where(finite)
    skipped = every.where(~finite).groupBy(*by).agg(F.sum("_c").alias("skipped"))
    cuts = [k / buckets for k in range(1, buckets)]
    bounds = counts.groupBy(*by).agg(
        F.sum("_c").alias("_total"), F.percentile_approx("_v", cuts, 20 * buckets).alias("_cuts")
    )
    placed = counts.join(bounds, list(by)).withColumn("_b", _cuts_below(F.col("_cuts"), F.col("_v"), buckets)).drop("_cuts")
    histogram = placed.groupBy(*by, "_b").agg(
        F.sum("_c").alias("_bc"), F.max("_total").alias("_total")
    )
    upto = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    reached = histogram.withColumn("_end", F.sum("_bc").over(upto)).withColumn(
        "_start", F.col("_end") - F.col("_bc")
    )
    ranks = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("name"), F.lit(side).alias("side"),
                    _rank(F.col("_total"), q, side).alias("rank"), F.lit(float(q)).alias("q"),
                )
                for q, name in zip(quantiles, names) for side in ("lo", "hi")
            ]
        )
    )
    wanted = reached.select(*by, "_b", "_start", "_end", "_total", ranks.alias("_w")).where(
        (F.col("_w.rank") >= F.col("_start")) & (F.col("_w.rank") < F.col("_end"))
    )
    needed = wanted.select(*by, "_b", "_start").distinct()
    inside = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    walked = placed.select(*by, "_b", "_v", "_c").join(needed, [*by, "_b"]).withColumn(
        "_to", F.sum("_c").over(inside) + F.col("_start")
    ).withColumn("_from", F.col("_to") - F.col("_c"))
    hit = wanted.select(*by, "_b", "_total", "_w").join(
        walked.drop("_start"), [*by, "_b"]
    ).where((F.col("_w.rank") >= F.col("_from")) & (F.col("_w.rank") < F.col("_to")))
    out = []
    for q, name in zip(quantiles, names):
        def at(side: str, name: str = name) -> Column:
            return F.max(
                F.when((F.col("_w.name") == name) & (F.col("_w.side") == side), F.col("_v"))
            )
        exact = (F.max("_total") - 1) * F.lit(float(q))
        weight = exact - F.floor(exact)
        out.append((at("lo") * (1 - weight) + at("hi") * weight).alias(name))
    done = hit.groupBy(*by).agg(*out, F.max("_total").alias("n"))
    return done.join(skipped, list(by), "left").withColumn("skipped", F.coalesce("skipped", F.lit(0)))


def _cuts_below(cuts: Column, v: Column, buckets: int) -> Column:
    """How many cuts are at or below the value, by binary search."""
    powers = F.array(*[F.lit(1 << s) for s in reversed(range(buckets.bit_length()))])

    def step(lo: Column, power: Column) -> Column:
        ahead = lo + power
        return F.when((ahead <= F.size(cuts)) & (F.get(cuts, ahead - 1) <= v), ahead).otherwise(lo)

    return F.aggregate(powers, F.lit(0), step)


def _rank(total: Column, q: float, side: str) -> Column:
    position = (total - 1) * F.lit(float(q))
    lower = F.floor(position)
    return (lower if side == "lo" else F.least(lower + 1, total - 1)).cast("bigint")
