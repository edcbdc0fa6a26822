"""Orders by structs that hold one name twice, as a stream does whose time is also its index."""

import random

from pyspark.sql import functions as F

from causeway.operators import ordering
from causeway.plans import registry
from causeway.streaming import drift


def test_a_struct_may_hold_a_name_twice(spark, hot):
    rng = random.Random(4)
    data = [(i, rng.choice([None, *range(40)]), rng.choice([None, *range(5)])) for i in range(300)]
    rows = spark.createDataFrame(data, "id int, a int, b int").withColumn("s", F.struct(
        F.col("a").alias("at"), F.struct(F.col("b").alias("AT"), F.col("b").alias("at")).alias("at")))

    def place(v):
        return (v is not None, v or 0)

    for order, sign in (([F.col("s"), F.col("id")], 1), ([ordering.desc("s"), ordering.desc("id")], -1)):
        found = ordering.row_rank(rows, [], order)
        wanted = sorted(data, key=lambda r: (place(r[1]), place(r[2]), r[0]))[::sign]
        assert {r.id: r["rank"] for r in found.collect()} == {r[0]: i + 1 for i, r in enumerate(wanted)}


def test_a_stream_is_ordered_by_one_column_as_time_and_index(spark, hot):
    errors = spark.createDataFrame([(i % 2, f"c{i}", (i * 7) % 50) for i in range(50)], "repo int, c string, at int")
    placed = drift.ordered_commit_stream(errors, "repo", "c", "at", "at").collect()
    for repo in (0, 1):
        assert [r.position for r in sorted((r for r in placed if r.repo == repo), key=lambda r: r["at"])] == list(range(1, 26))


def test_the_experiment_runs(spark):
    assert registry.queries()["drift_experiment"](spark, "/root/testdata/sf0.001").count() == 15


def test_the_stationary_part_runs(spark):
    assert registry.queries()["drift_stationary"](spark, "/root/testdata/sf0.001").count() == 15
