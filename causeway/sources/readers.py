"""Scans: outcome histories, harvest logs, report tables and plain lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OUTCOME_SCHEMA = T.StructType([
    T.StructField("repo", T.StringType()), T.StructField("commit_sha", T.StringType()),
    T.StructField("run_id", T.LongType()), T.StructField("test_id", T.StringType()),
    T.StructField("test_path", T.StringType()), T.StructField("test_class", T.StringType()),
    T.StructField("test_function", T.StringType()), T.StructField("label_failed", T.IntegerType()),
    T.StructField("duration", T.DoubleType()), T.StructField("timestamp", T.TimestampType()),
])

HARVEST_SCHEMA = T.StructType([
    T.StructField("mutant_id", T.StringType()), T.StructField("repo", T.StringType()),
    T.StructField("file_path", T.StringType()), T.StructField("line", T.LongType()),
    T.StructField("operator", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("timed_out", T.BooleanType()), T.StructField("timeout_enforced", T.BooleanType()),
    T.StructField("exit_code", T.LongType()), T.StructField("suite_duration", T.DoubleType()),
    T.StructField("universe_size", T.LongType()), T.StructField("n_killed", T.LongType()),
    T.StructField("kill_ratio", T.DoubleType()),
    T.StructField("killed", T.ArrayType(T.StringType())),
    T.StructField("checkout_drifted", T.ArrayType(T.StringType())),
])

_CORRUPT = "_corrupt_record"


def read_outcomes(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType = OUTCOME_SCHEMA
) -> DataFrame:
    """One table from per-repository history CSVs, under an explicit schema."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.schema(schema).option("header", True).csv(paths)


def read_harvest_log(
    spark: SparkSession, path: str, usable: str = "harvested",
    schema: T.StructType = HARVEST_SCHEMA,
) -> tuple[DataFrame, DataFrame]:
    """Usable records of a JSON-lines log, and record counts of every other status.

    Blank lines are skipped.  A corrupt line fails the job and is named by file and line.
    """
    with_corrupt = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json(
        "value", with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    ).alias("r"), F.col("_metadata.file_path").alias("__file"), F.col("value").alias("__line"))
    bad = parsed.filter(F.col(f"r.{_CORRUPT}").isNotNull() | F.col("r").isNull()).select(
        "__file", "__line").first()
    if bad is not None:
        raise ValueError(f"corrupt harvest record at line {_line_number(spark, bad)} of {bad[0]}")
    records = parsed.select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields])
    records = records.withColumn("status", F.coalesce("status", F.lit("unknown")))
    others = records.filter(F.col("status") != usable).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"))
    return records.filter(F.col("status") == usable), others


def _line_number(spark: SparkSession, bad) -> int | None:
    # Only reached when a job is about to fail: look the line up in its own file.
    numbered = spark.read.text(bad[0], wholetext=True).select(
        F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    found = numbered.filter(F.col("line") == bad[1]).agg(F.min("pos")).first()[0]
    return None if found is None else found + 1


def compact_latest(df: DataFrame, key: str, seq: Column) -> DataFrame:
    """Last record per id of an append-only log, as a map-side combinable aggregate."""
    last = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), seq).alias("r"))
    return last.select("r.*")


def log_totals(df: DataFrame, key: str, seq: Column) -> DataFrame:
    """Totals over the latest record per id, next to the raw record count."""
    latest = compact_latest(df.withColumn("__seq", seq), key, F.col("__seq"))
    kills = F.coalesce(F.col("n_killed"), F.lit(0))
    drifted = F.coalesce(F.size("checkout_drifted"), F.lit(0)) > 0
    totals = latest.agg(
        F.count(F.lit(1)).alias("unique_ids"), F.sum(kills).alias("total_kills"),
        F.count_if(kills == 0).alias("killed_none"), F.count_if(drifted).alias("checkout_drifted"),
        *[F.count_if(F.col("status") == s).alias(s)
          for s in ("harvested", "broke_suite", "timed_out")])
    return totals.withColumn("records", F.lit(df.count()))


def percent(column: Column) -> Column:
    """A percentage cell as a number; anything unreadable, such as ``n/a``, is NULL."""
    return F.rtrim(F.trim(column), F.lit("%")).try_cast("double")


def read_percent_table(
    spark: SparkSession, path: str, names: Mapping[str, str], text: Sequence[str] = ()
) -> DataFrame:
    """Report CSV with percentage strings; ``names`` maps headings to column names."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[
        (F.col(f"`{heading}`") if name in text else percent(F.col(f"`{heading}`"))).alias(name)
        for heading, name in names.items()])


def read_slug_list(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """One id per line in file order; blanks and ``#`` comments are ignored."""
    lines = spark.read.text(path, wholetext=True).select(
        F.posexplode(F.split("value", r"\r?\n")).alias("position", "line"))
    slugs = lines.select("position", F.trim("line").alias("slug")).filter(
        (F.col("slug") != "") & ~F.col("slug").startswith("#"))
    return slugs if limit is None else slugs.orderBy("position").limit(limit)
