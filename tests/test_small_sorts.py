"""Jobs that once sorted, joined or compared more rows than their results need."""

import random
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from causeway.operators import features, joins, policy
from causeway.plans import registry


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def compared_on(df, name):
    """By how many columns the rows are distinct that a similarity is worked out for."""
    lines = plan_of(df).splitlines()
    at = next(i for i, line in enumerate(lines) if f" AS {name}#" in line and "transform(" in line)
    below = next(line for line in lines[at:] if "Aggregate [" in line or "Relation" in line or "RDD" in line)
    return len(re.search(r"Aggregate \[([^\]]*)\]", below)[1].split(", "))


def test_statuses_are_folded_as_numbers_without_a_join(spark):
    rng = random.Random(7)
    names = ["ERROR", "FAILED", "PASSED", "SKIPPED", "A", "EZ", "FZ", "Z", "", None]
    universe = [(g, i) for g in range(8) for i in range(9) if rng.random() < 0.9] + [(1, 1), (1, 1), (2, None)]
    seen = [(rng.randrange(9), rng.randrange(10), rng.choice(names)) for _ in range(150)] + [(2, None, "PASSED")]
    flags = spark.createDataFrame([(g, False, g != 4) for g in range(9)], "g int, timed_out boolean, timeout_enforced boolean")
    u, o = spark.createDataFrame(universe, "g int, i int"), spark.createDataFrame(seen, "g int, i int, s string")
    found = policy.run_status(u, o, "g", "i", "s", flags, 0.8)
    got = {r.g: (r.universe_size, r.n_killed, r.n_missing, r.n_skipped, r.status) for r in found.collect()}
    for g in range(8):
        items = {i for k, i in universe if k == g}
        top = {i: max((s for k, j, s in seen if k == g and j == i and i is not None and s is not None), default=None)
               for i in items}
        killed = [i for i in items if top[i] in (None, "ERROR", "FAILED")]
        status = ("timeout_broken" if g == 4 else "broke_suite" if len(killed) >= 0.8 * len(items) else "harvested")
        assert got[g] == (len(items), len(killed), sum(v is None for v in top.values()),
                          sum(v == "SKIPPED" for v in top.values()), status)
        listed = policy.killed_items(u, o, "g", "i", "s").filter(F.col("g") == g).collect()
        assert sorted(str(r.i) for r in listed) == sorted(str(i) for i in killed)
    assert set(got) == set(range(8))
    plan = plan_of(found)
    assert plan.count("Join ") == 1 and "max(s#" not in plan


def test_paths_are_compared_once_per_combination(spark):
    data = [(i, f"tests/test_{i % 3}x.py", f"src/m{i % 2}x.py" if i % 5 else None) for i in range(60)]
    rows = spark.createDataFrame(data, "id int, t string, c string").union(
        spark.createDataFrame([(1, None, "src/a.py"), (1, None, None)], "id int, t string, c string"))
    found = joins.nearest_source(rows, ["id"], "t", "c")
    assert compared_on(found, "__sim") == 2
    assert found.count() == 61 and found.filter("t IS NULL").first().similarity == 0
    assert found.filter("nearest IS NULL").count() == 13  # a null file comes first among equals

    wide = rows.withColumns({"fn": F.when(F.col("id") % 7 > 0, "test_m1x"), "ts": F.col("id"), "y": F.lit(1)})
    crossed = features.cross_features(wide, "c", "t", "fn", "ts", ["id"], "y")
    assert crossed.count() == 62 and set(wide.columns) <= set(crossed.columns)
    assert compared_on(crossed, "lexical_similarity") == 3
    assert crossed.filter("fn IS NULL AND lexical_similarity <> 0").count() == 0


def test_touches_are_counted_side_by_side_and_once(spark, hot, tmp_path):
    """Repeated commits, lines and files, files and commits without a name or a time."""
    rng = random.Random(30)
    days = [datetime(2024, 1, 1) + timedelta(days=d) for d in range(0, 40, 2)]
    orders = [(k, rng.choice([*days, None])) for k in range(90)]
    orders += [(1, days[3]), (1, days[3]), (2, days[5]), (None, days[6])]
    lines = [(rng.choice([*range(100), None]), rng.randrange(9)) for _ in range(500)] + [(1, 1)] * 5
    parts = [(k, None if k == 8 else f"n{k % 6}") for k in range(9)]  # 6 and 7 are files 0 and 1 again
    spark.createDataFrame(orders, "o_orderkey bigint, o_orderdate timestamp").selectExpr(
        "*", "1L o_custkey", "'F' o_orderstatus", "'1' o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint").selectExpr(
        "*", "1L l_suppkey", "1 l_linenumber", "1D l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey bigint, p_name string").selectExpr(
        "*", "'b' p_brand", "'t' p_type").write.parquet(f"{tmp_path}/part.parquet")

    names = dict(parts)
    touches = [(c, names[p], ts) for c, p in lines for k, ts in orders if c is not None and c == k and ts and names[p]]
    wanted = {}
    for c, p, ts in set(touches):
        wanted[c] = wanted.get(c, 0) + sum(q == p and earlier < ts for _, q, earlier in touches)
    found = registry.queries()["prior_modifications"](spark, str(tmp_path))
    assert {r.commit_sha: r.prior_mod_count for r in found.collect()} == wanted

    plan = plan_of(found)
    hashed = [line.split("[")[1].split("]")[0] for line in plan.splitlines() if "Aggregate [" in line]
    assert not any("commit_sha" in keys and "path" in keys for keys in hashed)
    assert "max(" not in plan  # no pass of its own over the touches for the ends of their times
