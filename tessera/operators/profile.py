"""Profiles, distributions and statistics of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.values import number

from .quantiles import quantiles


def family(kind: T.DataType) -> str:
    """bool, number, datetime or string."""
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.NumericType):
        return "number"
    return "datetime" if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else "string"


def column_profile(df: DataFrame, distinct: bool = True) -> DataFrame:
    """(column, type, rows, nulls, null_pct, n_unique): all columns in one pass over the table."""
    names = df.columns
    per = [F.struct(F.lit(c).alias("column"), F.lit(family(df.schema[c].dataType)).alias("type"), F.count_if(F.col(f"`{c}`").isNull()).alias("nulls"), (F.count_distinct(F.col(f"`{c}`")) if distinct else F.lit(None).cast("long")).alias("n_unique")) for c in names]
    one = df.agg(F.count("*").alias("rows"), F.array(*per).alias("columns"))
    return one.select("rows", F.inline("columns")).select("column", "type", "rows", "nulls", (100 * F.col("nulls") / F.nullif("rows", F.lit(0))).alias("null_pct"), "n_unique")


def null_counts(df: DataFrame) -> DataFrame:
    """Columns that have nulls and how many."""
    return column_profile(df, distinct=False).where("nulls > 0").select("column", "nulls")


def distribution(df: DataFrame, value: str | Column, top: int | None = None) -> DataFrame:
    """Counts of the values that are there, most frequent first, then by value."""
    name = value if isinstance(value, str) else "value"
    col = F.col(value) if isinstance(value, str) else value
    counts = df.select(col.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)
    return counts.limit(top) if top else counts


def distribution_with_pct(df: DataFrame, value: str) -> DataFrame:
    """Counts and shares, nulls under MISSING."""
    counts = df.groupBy(F.coalesce(F.col(value).cast("string"), F.lit("MISSING")).alias(value)).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("_total"))
    return counts.join(F.broadcast(total)).select(value, "n", (F.col("n") / F.col("_total")).alias("pct"))  # one row


def exploded(df: DataFrame, cell: str, separator: str = ";", name: str = "value") -> DataFrame:
    """One row for each trimmed, non-empty part of a delimited cell."""
    return df.select(F.explode(F.split(cell, separator)).alias(name)).select(F.trim(name).alias(name)).where(F.col(name) != "")


def numeric_summary(df: DataFrame, value: str) -> DataFrame:
    """mean, median, min, max and total of the cells that are numbers; no row when none is. The median is selected beforehand."""
    x = df.select(number(F.col(value)).alias("x")).where("x is not null")
    median = F.lit(quantiles(x, F.col("x"), [0.5])[0]).cast("double").alias("median")
    return x.agg(F.count("*").alias("n"), F.avg("x").alias("mean"), median, F.min("x").cast("long").alias("min"), F.max("x").cast("long").alias("max"), F.sum("x").alias("total")).where("n > 0")


def substring_share(df: DataFrame, cell: str, word: str) -> DataFrame:
    """Rows that mention a word in any case, the others, and the percentage."""
    hit = F.contains(F.lower(F.coalesce(F.col(cell), F.lit(""))), F.lit(word.lower()))
    return df.agg(F.count_if(hit).alias("with_word"), F.count_if(~hit).alias("without"), F.try_divide(100.0 * F.count_if(hit), F.count("*")).alias("pct"))


def keyword_groups(df: DataFrame, cell: str, groups: dict[str, str]) -> DataFrame:
    """Rows that match each group's pattern in any case; groups may overlap."""
    text = F.coalesce(F.col(cell).cast("string"), F.lit("nan"))
    return df.agg(*(F.count_if(text.rlike(f"(?i){pattern}")).alias(name) for name, pattern in groups.items()))


def outliers(df: DataFrame, value: str, order: str, first: int | None = 5, spread: float = 1.5) -> DataFrame:
    """Values beyond `spread` interquartile ranges, the first ones in row order. Quartiles interpolate linearly and are selected beforehand."""
    x = df.select(order, number(F.col(value)).alias("value")).where("value is not null")
    q1, q3 = (F.lit(q).cast("double") for q in quantiles(x, F.col("value"), [0.25, 0.75]))
    width = (q3 - q1) * spread
    found = x.where((F.col("value") < q1 - width) | (F.col("value") > q3 + width))
    return found.orderBy(order).limit(first) if first else found


def has_duplicates(df: DataFrame, key: str) -> DataFrame:
    """One row: does any key, null included, occur twice?"""
    return df.groupBy(key).count().agg(F.coalesce(F.max("count") > 1, F.lit(False)).alias("duplicates"))


def statistics_report(df: DataFrame, distributions: Sequence[str], numeric: str | None = None, sponsor: str | None = None, countries: str | None = None, top: int = 10) -> DataFrame:
    """The statistics document as one row: totals, distributions, numeric summary, top sponsors and countries, US share."""
    as_map = lambda counts, name: counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(name), F.col("n"))))).alias("m"))
    report = df.agg(F.count("*").alias("total"), F.lit(len(df.columns)).alias("n_columns"))
    parts = [(f"{c}_distribution", as_map(distribution(df, c), c)) for c in distributions if c in df.columns]
    if sponsor and sponsor in df.columns:
        parts.append(("top_sponsors", as_map(distribution(df, sponsor, top), sponsor)))
    if countries and countries in df.columns:
        parts.append(("top_countries", as_map(distribution(exploded(df, countries), "value", top), "value")))
        parts.append(("us_trials", substring_share(df, countries, "united states").select(F.struct("*").alias("m"))))
    if numeric and numeric in df.columns:
        parts.append((numeric.lower().replace(" ", "_"), numeric_summary(df, numeric).agg(F.first(F.struct("*")).alias("m"))))
    for name, part in parts:
        report = report.join(F.broadcast(part.withColumnRenamed("m", name)))  # one row each
    return report
