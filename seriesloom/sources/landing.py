"""Landed files as rows of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions.scalars import codes


def read_documents(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row per file: file, payload. For documents that must be read whole."""
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("payload")
    )


def read_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row per line: file, payload. Large files split over tasks."""
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("payload")
    )


def parse_json(docs: DataFrame, schema, payload: str = "payload") -> DataFrame:
    """The document as a struct column ``doc``; unreadable text gives a null."""
    return computed_once(docs, doc=F.from_json(payload, schema))


def elements(parsed: DataFrame, array: str, alias: str, *keep: str | Column) -> DataFrame:
    """A row per element of a document's array; one row marked ``_none`` for a document without elements, so none vanishes."""
    none = (F.coalesce(F.size(array), F.lit(0)) <= 0).alias("_none")
    return parsed.select(*keep, none, F.explode_outer(array).alias(alias))


def is_html_page(text: Column) -> Column:
    """An error page that landed in place of data."""
    head = F.lower(F.left(F.ltrim(text, F.lit(" \t\r\n")), F.lit(20)))
    return head.startswith("<html") | head.startswith("<!doctype html")


def no_data_or(rules):
    """The rules for rows of documents that have elements; ``NO_DATA`` for those that have none."""
    return [(F.col("_none"), "NO_DATA"), *[(~F.col("_none") & cond, code) for cond, code in rules]]


def coded(df: DataFrame, rules, strict: bool) -> DataFrame:
    """Add ``violations``; ``strict`` raises on the first row that has one."""
    out = df.withColumn("violations", codes(rules))
    if strict:
        found = F.concat_ws(",", "violations")
        out = out.where(F.when(found != "", F.raise_error(found).cast("boolean")).otherwise(F.lit(True)))
    return out


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later steps may use often but must not compute again.

    A filter or a projection on such a column would otherwise be merged with its
    definition, and a costly parse would run once per use. A generator output is
    never merged, so each value here is computed once per row. A generator
    doesn't compile what it holds, so it only passes on finished columns.
    """
    done = df.select("*", *[c.alias(f"_once_{n}") for n, c in columns.items()])
    row = F.struct(*[F.col(f"`_once_{n}`").alias(n) for n in columns])
    return done.select(*[F.col(f"`{c}`") for c in df.columns], F.inline(F.array(row)))

