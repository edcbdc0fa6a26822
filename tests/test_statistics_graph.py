from __future__ import annotations

import math
import itertools
import random

import pytest
from pyspark.sql import functions as F

from causeway.operators import graph, joins, selection, split, statistics


def test_cliffs_delta_matches_pairs(spark):
    rng = random.Random(1)
    data = [(float(rng.randrange(6)), float(rng.randrange(7)) if i % 3 else None) for i in range(40)]
    xs, ys = [x for x, _ in data], [y for _, y in data if y is not None]
    want = sum((x > y) - (x < y) for x, y in itertools.product(xs, ys)) / (len(xs) * len(ys))
    got = statistics.cliffs_delta(spark.createDataFrame(data, "x double, y double"), "x", "y").first()
    assert got.cliffs_delta == pytest.approx(want, abs=1e-4)


def test_signed_rank_small_sample_is_exact(spark):
    # Six positive differences: the two-sided exact p-value is 2 / 2**6.
    df = spark.createDataFrame([(float(i + 1) * 1.5, 0.0) for i in range(6)], "x double, y double")
    row = statistics.wilcoxon_signed_rank(df, "x", "y").first()
    assert row.w_statistic == 0.0 and row.p_value == pytest.approx(2 / 64, abs=1e-5)
    few = spark.createDataFrame([(1.0, 0.0)] * 4, "x double, y double")
    assert tuple(statistics.wilcoxon_signed_rank(few, "x", "y").first())[1:] == (0.0, 1.0, False)


def commit_stats(spark):
    rng = random.Random(2)
    data = [(f"c{c}", i, s, int(rng.random() < 0.2), rng.random() < share, 1.0 + i, False)
            for c in range(25) for i in range(8) for s, share in (("a", 0.3), ("b", 0.8))]
    df = spark.createDataFrame(
        data, "commit_sha string, i int, strategy string, y int, sel boolean, secs double, abst boolean")
    return selection.strategy_commit_stats(df, "commit_sha", "strategy", "y", "sel", "secs", "abst")


def test_bootstrap_is_replicable_and_paired(spark):
    stats = commit_stats(spark)

    def run(df):
        table, diffs = statistics.cluster_bootstrap(df, replicates=60, reference="b")
        return (sorted(map(tuple, table.collect())), sorted(map(tuple, diffs.collect())))

    first, second = run(stats), run(stats.repartition(7, "strategy"))
    assert [[str(v)[:9] for v in row] for part in first for row in part] == [
        [str(v)[:9] for v in row] for part in second for row in part]
    table = {(r.strategy, r.metric): r for r in statistics.cluster_bootstrap(
        stats, replicates=60)[0].collect()}
    assert table["a", "trr"].ci_lower <= table["a", "trr"].point <= table["a", "trr"].ci_upper
    assert table["a", "trr"].ci_lower > table["b", "trr"].ci_upper


def test_user_statistic_and_empty_sample(spark):
    df = spark.createDataFrame([(i // 3, float(i)) for i in range(30)], "g int, v double")
    row = statistics.bootstrap(df, ["g"], {"m": F.avg("v")}, replicates=50).first()
    assert row.point == 14.5 and row.ci_lower < 14.5 < row.ci_upper
    empty = statistics.bootstrap_ci(df.filter("v < 0"), ["g"], "v", replicates=10).first()
    assert empty.n == 0 and empty["mean"] is None


def test_splits_are_disjoint_and_guarded(spark):
    df = spark.createDataFrame([(g, g * 10 + i, i, int(g % 4 == 0)) for g in range(20) for i in range(5)],
                               "g int, ts int, i int, y int").withColumn("repo", F.lit("r"))
    out = split.temporal_group_split(df, "g", "ts")
    assert out.groupBy("g").agg(F.count_distinct("split").alias("n")).filter("n > 1").isEmpty()
    assert {r["split"]: r.n for r in out.groupBy("split").agg(
        F.count_distinct("g").alias("n")).collect()} == {"train": 14, "val": 3, "test": 3}
    with pytest.raises(ValueError):
        split.temporal_group_split(df.filter("g < 2"), "g", "ts")
    with pytest.raises(ValueError):
        split.group_shuffle_split(df.withColumn("y", F.lit(0)), "repo", "g", "y")


def test_balanced_halves_follow_the_greedy_rule(spark):
    sizes = [5, 30, 2, 9, 1, 40, 3, 8]
    data = [(c, sum(sizes[:c]) + i) for c, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(data, "c int, at int")
    got = {r.c for r in split.balanced_cluster_halves(df, "c", F.col("at")).filter("fit").collect()}
    target, assigned, want = sum(sizes) * 0.5, 0, set()
    for i, n in enumerate(sizes[:-1]):
        if i == 0 or assigned + n / 2 <= target:
            want.add(i)
            assigned += n
    assert got == want


def test_larger_sample_contains_the_smaller(spark):
    df = spark.createDataFrame([(i, f"f{i % 3}") for i in range(60)], "id int, fam string")
    small = {r.id for r in split.stratified_round_robin(df, 10, "fam", "id").collect()}
    large = {r.id for r in split.stratified_round_robin(df, 25, "fam", "id").collect()}
    assert small < large and len(large) == 25


def brute_distance(edges, source, target):
    seen, frontier, depth = {source}, {source}, 0
    while frontier:
        if target in frontier:
            return depth
        frontier = {b for a, b in edges if a in frontier} - seen
        seen |= frontier
        depth += 1
    return None


def test_distances_match_breadth_first_search(spark):
    rng = random.Random(4)
    edges = {(f"n{rng.randrange(15)}", f"n{rng.randrange(15)}") for _ in range(22)}
    edges = {(a, b) for a, b in edges if a != b}
    frame = spark.createDataFrame(sorted(edges), "src string, dst string")
    targets = spark.createDataFrame([("n1",), ("n2",)], "target string")
    got = {(r.target, r.node): r.depth for r in graph.distances_to(frame, targets).collect()}
    for target, node in itertools.product(("n1", "n2"), {v for e in edges for v in e}):
        assert got.get((target, node)) == brute_distance(edges, node, target)


def test_import_matching_rules(spark):
    imports = spark.createDataFrame(
        [("t1", "src.auth.session"), ("t2", "session"), ("t3", "ession"), ("t4", "os")],
        "test string, module string")
    changed = spark.createDataFrame([("src/auth/session.py",)], "path string")
    got = {r.test for r in joins.direct_import(imports, changed, "test", "module", "path").collect()}
    assert got == {"t1", "t2", "t3"}


def test_duplicate_strategy_rows_are_refused(spark):
    stats = spark.createDataFrame([("c", "a", 1, 2), ("c", "a", 1, 2), ("c", "b", 1, 2)],
                                  "commit_sha string, strategy string, d int, f int")
    with pytest.raises(Exception, match="more than one row"):
        joins.pair_strategies(stats, "a", "b", "d", "f")[0].collect()


def test_resume_is_refused_for_orphans(spark):
    done = spark.createDataFrame([(1,), (9,)], "id int")
    sample = spark.createDataFrame([(1,), (2,)], "id int")
    with pytest.raises(ValueError):
        joins.verify_resumable(done, sample, ["id"])


@pytest.mark.parametrize("seed", range(6))
def test_exact_signed_rank_equals_enumeration_with_ties(spark, seed):
    """All sign patterns of the averaged ranks, ties included; and no other rule above any size."""
    rng = random.Random(seed)
    data = [(float(rng.randrange(-4, 6)), 0.0) for _ in range(rng.randrange(6, 13))]
    sizes = sorted(abs(x) for x, _ in data if x)
    ranks = [sum(1 for s in sizes if s < abs(x)) + (sum(1 for s in sizes if s == abs(x)) + 1) / 2 for x, _ in data if x]
    plus = sum(r for r, (x, _) in zip(ranks, [d for d in data if d[0]]) if x > 0)
    w = min(plus, sum(ranks) - plus)
    ways = [sum(r for r, up in zip(ranks, signs) if up) for signs in itertools.product((0, 1), repeat=len(ranks))]
    want = min(1.0, 2 * sum(v <= w for v in ways) / len(ways)) if len(ranks) >= 5 else 1.0
    df = spark.createDataFrame([(1, *d) for d in data] + [(2, *d) for d in data] + [(3, 1.0, 0.0)], "g int, x double, y double")
    found = {r.g: r for r in statistics.wilcoxon_signed_rank(df, "x", "y", ["g"], "exact").collect()}
    assert found[1].p_value == found[2].p_value == pytest.approx(want, abs=1e-5) and found[3].p_value == 1.0
    near = statistics.wilcoxon_signed_rank(df, "x", "y", ["g"], "normal").filter("g = 1").first()
    assert near.p_value == pytest.approx(want, abs=0.25)


def test_exact_signed_rank_has_no_switch_at_fifty():
    for n in (49, 50, 51, 120):
        ranks = [(float(i), 1) for i in range(1, n + 1)]
        w = n * (n + 1) / 4 - 2.0 * (n * (n + 1) * (2 * n + 1) / 24) ** 0.5
        exact = statistics.exact_signed_rank_p(math.floor(w), ranks)
        assert exact == pytest.approx(statistics.normal_signed_rank_p(math.floor(w), n, 0.0), rel=0.05)


def test_weighed_aggregates_equal_repeated_rows(spark):
    """The same aggregates, once as weighed sums and once over repeated rows (draws of another order)."""
    rng = random.Random(8)
    rows = [(i % 17, 1e6 + rng.random(), rng.random() if i % 9 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, v double, u double")
    split = statistics.bootstrap(df, ["g"], {
        "mean": statistics.mean_of("v"), "spread": statistics.spread_of("v"), "u": statistics.mean_of("u"),
        "corr": statistics.correlation_of("v", "u"), "ratio": statistics.ratio_of(F.col("u"), F.col("v"))}, 40)
    plain = statistics.bootstrap(df, ["g"], {
        "mean": F.avg("v"), "spread": F.stddev_samp("v"), "u": F.avg("u"), "corr": F.corr("v", "u"),
        "ratio": F.sum("u") / F.sum("v")}, 40)
    a, b = ({r.statistic: r for r in x.collect()} for x in (split, plain))
    for name in b:
        assert a[name].point == pytest.approx(b[name].point, rel=1e-9), name
        width = b[name].ci_upper - b[name].ci_lower
        assert a[name].ci_lower < a[name].point < a[name].ci_upper
        assert a[name].ci_upper - a[name].ci_lower == pytest.approx(width, rel=0.6), name
