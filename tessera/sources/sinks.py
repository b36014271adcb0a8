"""Writers: files, reports, keyed tables and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, rows_per_file: int | None = None) -> None:
    writer = df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).csv(path)


def write_records(df: DataFrame, path: str, condition: str, run_date: str) -> None:
    """Rows as JSON in condition= and run_date= folders, NaN as null; folders of other conditions and dates stay."""
    plain = df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if kind in ("double", "float") else F.col(f"`{c}`") for c, kind in df.dtypes))
    plain.withColumns({"condition": F.lit(condition), "run_date": F.lit(run_date)}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("condition", "run_date").json(path)


def upload_counts(df: DataFrame, *ids: str) -> DataFrame:
    """One row: how many records have an id in one of the columns, and how many are skipped for want of one."""
    known = F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in ids)).isNotNull()
    return df.agg(F.count_if(known).alias("uploaded"), F.count_if(~known).alias("skipped"))


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as one JSON document."""
    report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_results(df: DataFrame, path: str, run_column: str = "run_id") -> None:
    df.write.mode("append").partitionBy(run_column).json(path)


def to_metrics(report: DataFrame, metrics: Sequence[str], keys: Sequence[str] = (), time_col: str | None = None) -> DataFrame:
    """One (metric, value) row for each gauge of a report."""
    ids = [*keys, *([time_col] if time_col else [])]
    wide = report.select(*ids, *(F.col(m).cast("double").alias(m) for m in metrics))
    return wide.unpivot(ids, list(metrics), "metric", "value")


def alerts(breaches: DataFrame, run_id: str | Column) -> DataFrame:
    """Notification rows for breached thresholds."""
    return breaches.select((F.lit(run_id) if isinstance(run_id, str) else run_id).alias("run_id"), F.lit("CRITICAL").alias("level"), "metric", "severity", F.concat_ws(" ", F.col("metric"), F.lit("="), F.col("value").cast("string"), F.lit("breaches"), F.col("threshold").cast("string")).alias("message"))
