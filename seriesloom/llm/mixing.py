"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its target share of the output over
its share of the input, in characters.  Each document draws its own number of
copies from a Poisson distribution of that mean, by inverting the distribution
at a number hashed from seed and id, is exploded by it, and the copies are put
into a hash-random global order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.tables import save, shuffle_partitions

PART = 8.0  # a larger mean is drawn as the sum of equal parts of at most this mean
TERMS = 64  # P(X > 64) at mean 8 is below 2^-52, the step of the hashed number


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 13 hexadecimal digits of an MD5."""
    text = F.concat_ws(":", *parts)
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def source_rates(
    docs: DataFrame, weights: DataFrame | None = None, *, source_col: str = "source", text_col: str = "text",
    power: float = 0.5, total_units: float | None = None,
) -> DataFrame:
    """Rows (mix_source, units, rate): mean repetitions of each source.

    ``weights`` has columns source and weight (relative); sources it lacks get
    none, sources without a character are left at rate 0.  Without it the
    weight of a source is its characters to the ``power``.  ``total_units`` is
    the expected output in characters; by default as much as the input.
    """
    sizes = save(
        docs.groupBy(F.col(source_col).alias("mix_source")).agg(
            F.sum(F.char_length(F.coalesce(F.col(text_col), F.lit("")))).alias("units")
        ),
        "mix-sizes",
    )
    if weights is None:
        rows = sizes.withColumn("w", F.pow(F.col("units").cast("double"), F.lit(power)))
    else:
        given = weights.groupBy(F.col("source").alias("g")).agg(F.sum("weight").cast("double").alias("w"))
        rows = sizes.join(given, F.col("mix_source").eqNullSafe(F.col("g")), "left").select(
            "mix_source", "units", F.coalesce("w", F.lit(0.0)).alias("w")
        )
    rows = rows.withColumn("w", F.when(F.col("units") > 0, F.col("w")).otherwise(0.0))
    whole = rows.agg(F.sum("w").alias("w"), F.sum("units").alias("units")).first()
    target = float(whole["units"] or 0) if total_units is None else float(total_units)
    scale = target / whole["w"] if whole["w"] else 0.0
    return rows.select(
        "mix_source", "units",
        F.when(F.col("units") > 0, F.col("w") * F.lit(scale) / F.col("units")).otherwise(0.0).alias("rate"),
    )


def poisson_replicate(
    docs: DataFrame, weights: DataFrame | None = None, *, id_col: str = "doc_id", source_col: str = "source",
    text_col: str = "text", seed: int = 17, power: float = 0.5, total_units: float | None = None,
    copy_col: str | None = "copy",
) -> DataFrame:
    """The documents' columns, each row as often as its draw says, with the copy's number from 1 in ``copy_col``.

    The order is global and random: rows are dealt to partitions and sorted
    within them by a hash of seed, id and copy.  Null sources are a source of
    their own; null ids draw by the text ``null``; null or empty texts are
    copied like others; repeated rows draw the same number; an empty table
    gives an empty one.  ``copy_col`` must not be a column of the documents, in
    whatever case; None leaves it out.  Other columns may have any names.  The source table is written before the join, so its
    real size decides whether it is broadcast.
    """
    if copy_col is not None and copy_col.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"the documents have a column {copy_col}")
    pieces = F.ceil(F.col("rate") / PART).cast("int")
    mean = F.col("rate") / F.greatest(pieces, F.lit(1))

    def add(acc: Column, j: Column) -> Column:
        p = acc["p"] * acc["m"] / j
        return F.struct(
            acc["m"].alias("m"), p.alias("p"), (acc["c"] + p).alias("c"), F.array_append(acc["all"], acc["c"] + p).alias("all")
        )

    start = F.struct(mean.alias("m"), F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all"))
    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)).cast("array<double>"), start, add, lambda acc: acc["all"])
    rates = save(
        source_rates(docs, weights, source_col=source_col, text_col=text_col, power=power, total_units=total_units)
        .select("mix_source", F.greatest(pieces, F.lit(1)).alias("mix_pieces"), cdf.alias("mix_cdf")),
        "mix-rates",
    )
    # The row travels as one column, so no column of its can meet a name used here.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_row"))
    name = F.coalesce(F.col("mix_row")[id_col].cast("string"), F.lit("null"))

    def drawn(i: Column) -> Column:
        u = uniform(F.lit(str(seed)), name, i.cast("string"))
        return F.size(F.filter("mix_cdf", lambda c: c <= u))

    joined = packed.join(rates, F.col("mix_row")[source_col].eqNullSafe(F.col("mix_source")))
    count = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.col("mix_pieces")), drawn), F.lit(0), lambda a, k: a + k
    )
    copies = joined.withColumn("mix_n", count).where("mix_n > 0").withColumn(
        "mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_n")))
    )
    place = F.xxhash64(F.lit(seed), F.col("mix_row")[id_col], F.col("mix_copy"))
    kept = [F.col("mix_row.*")] + ([F.col("mix_copy").cast("bigint").alias(copy_col)] if copy_col else [])
    return (
        copies.withColumn("mix_place", place)
        .repartition(shuffle_partitions(docs.sparkSession), "mix_place").sortWithinPartitions("mix_place")
        .select(*kept)
    )
