from __future__ import annotations

import sys
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import check  # noqa: E402

from causeway.operators import statistics  # noqa: E402
from causeway.plans import registry  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_calibration_job_draws_2000_replicates(spark, monkeypatch):
    seen, resampled = [], statistics.resampled_sums

    def watched(df, unit, keys, sums, replicates, *rest):
        seen.append(replicates)
        return resampled(df, unit, keys, sums, replicates, *rest)

    monkeypatch.setattr(statistics, "resampled_sums", watched)
    registry.queries()["calibration_job"](spark, DATA)
    assert seen == [2000]


def test_moments_match_their_sql_with_2000_replicates(spark):
    connection = duckdb.connect()
    for table in check.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    name = "user_bootstrap_moments"
    line, good = check.compare(spark, connection, DATA, name, registry.queries()[name],
                               registry.oracle_sql()[name])
    assert good, line


def test_moments_leave_nulls_out(spark):
    rows = spark.createDataFrame([(i, None if i % 3 else 1e6 + i % 2) for i in range(60)],
                                 "u long, v double")
    found = {r.statistic: r for r in statistics.bootstrap_moments(rows, ["u"], {"m": "v"}, {"s": "v"}).collect()}
    assert found["m"].point == 1e6 + 0.5 and found["s"].undefined_replicates == 0
    assert 0 < found["s"].ci_lower < found["s"].point < found["s"].ci_upper + 0.02 < 0.6
