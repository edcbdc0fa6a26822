"""Sinks: split tables with their summary, and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ratio


def split_summary(df: DataFrame, split: str, commit: str, label: str) -> DataFrame:
    """Rows, commits, failures and failure rate per split."""
    failures = F.count_if(F.col(label) == 1)
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(commit).alias("n_commits"),
        failures.alias("n_failures"), ratio(failures, F.count(F.lit(1))).alias("failure_rate"))


def write_splits(df: DataFrame, path: str, split: str, commit: str, label: str) -> None:
    """Split tables as Parquet partitioned by split, and their summary as JSON."""
    df.write.mode("overwrite").partitionBy(split).parquet(f"{path}/rows")
    split_summary(df, split, commit, label).write.mode("overwrite").json(f"{path}/summary")


def write_outcomes(df: DataFrame, path: str, repo: str = "repo") -> None:
    """History per repository: one Parquet folder per repository, readable as one table."""
    df.write.mode("overwrite").partitionBy(repo).parquet(path)


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """A report table; NULL stays NULL in either format."""
    if fmt == "json":
        df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    elif fmt == "csv":
        df.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)
    else:
        raise ValueError(f"unknown report format {fmt!r}; use 'json' or 'csv'")
