from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from causeway.operators import metrics, policy, quality, selection, strategies


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_ranking_metrics_with_ties(spark):
    df = frame(spark, [(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)], "y int, p double")
    assert metrics.roc_auc(df, "y", "p").first()[0] == pytest.approx((0.5 + 1 + 0 + 1) / 4)
    assert metrics.average_precision(df, "y", "p").first()[0] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)


def test_single_class_is_undefined_or_the_given_value(spark):
    df = frame(spark, [(1, 0.9), (1, 0.2)], "y int, p double")
    assert metrics.roc_auc(df, "y", "p").first()[0] is None
    assert metrics.roc_auc(df, "y", "p", undefined=0.5).first()[0] == 0.5
    assert metrics.probability_losses(df, "y", "p").first().log_loss is None


@pytest.mark.parametrize("mode,zero,edge,one", [
    ("left", 0, 1, 9), ("right", 0, 0, 9), ("legacy_half_open", 0, 1, None), ("open_low", None, 0, 9)])
def test_bin_edges(spark, mode, zero, edge, one):
    df = frame(spark, [(0.0,), (0.1,), (1.0,)], "p double")
    got = [r[0] for r in df.select(metrics.bin_index(F.col("p"), 10, mode).alias("b")).collect()]
    assert got == [zero, edge, one]


def test_empty_denominators_stay_undefined(spark):
    df = frame(spark, [("a", "s", 0, True, 0.0, False)],
               "commit string, strategy string, y int, sel boolean, secs double, abst boolean")
    stats = selection.strategy_commit_stats(df, "commit", "strategy", "y", "sel", "secs", "abst")
    row = selection.fold_strategy_metrics(stats, "strategy").first()
    assert row.fr is None and row.etr is None and row.trr == 0.0


def test_budget_floor_and_cap(spark):
    df = frame(spark, [("a", i, i / 10, i >= 8) for i in range(10)] + [("b", 0, 0.1, False)],
               "g string, id int, p double, sel boolean")
    out = selection.apply_budget(df, ["g"], "sel", "p", ["id"], min_items=4)
    assert {r.id for r in out.collect() if r.final_selected and r.g == "a"} == {6, 7, 8, 9}
    assert [r.final_selected for r in out.collect() if r.g == "b"] == [True]
    capped = selection.apply_budget(df, ["g"], "sel", "p", ["id"], max_items=1)
    assert {r.id for r in capped.collect() if r.final_selected} == {9}


@pytest.mark.parametrize("rule,want", [("floor", 2), ("round", 2)])
def test_budget_size_rounds_half_to_even(spark, rule, want):
    df = frame(spark, [("a", i) for i in range(10)], "g string, id int")
    out = selection.topk_per_group(df, ["g"], [F.col("id")], 0.25, rule)
    assert out.filter("selected").count() == want


def test_untuned_policy_always_abstains(spark):
    df = frame(spark, [("c", "t1", 1, 1.0, 0.0), ("c", "t2", 0, 0.5, 0.0)],
               "commit string, test string, y int, p double, u double")
    stats = policy.commit_policy_stats(df, "commit", "test", "y", "p", "u", [], 0.25)
    row = policy.selective_policy(stats, policy.PolicyThresholds()).first()
    assert row.abstained and row.n_selected == 2 and "LOW_CONFIDENCE" in row.reasons


def test_frontier_ties_and_unsatisfiable(spark):
    grid = frame(spark, [(0.2, 0.5, 10.0, 90.0, 1), (0.1, 0.5, 10.0, 90.0, 1), (0.1, 0.4, 5.0, None, 0)],
                 "tau_abstain double, tau_conf double, trr_pct double, recall_pct double, escaped_commits int")
    assert policy.frontier_point(grid, "recall_floor", 80.0).first().tau_abstain == 0.1
    assert policy.frontier_point(grid, "zero_escape").first().trr_pct == 5.0
    with pytest.raises(PySparkException):
        policy.frontier_point(grid, "recall_floor", 95.0).collect()


def test_sweep_agrees_with_the_single_decision(spark):
    df = frame(spark, [(c, f"t{i}", (c + i) % 3 == 0, (i * 7 + c) % 10 / 10, c / 20)
                       for c in range(8) for i in range(6)],
               "commit int, test string, y boolean, p double, u double").withColumn("y", F.col("y").cast("int"))
    stats = policy.commit_policy_stats(df, "commit", "test", "y", "p", "u", [], 0.25)
    for row in policy.sweep_policy(stats, [0.1, 0.2], [0.5, 0.95]).collect():
        one = policy.selective_policy(
            stats, policy.PolicyThresholds(row.tau_abstain, row.tau_conf)).collect()
        assert row.abstentions == sum(r.abstained for r in one)
        assert row.tests_executed == sum(r.n_selected for r in one)


def test_name_correspondence_matches_brute_force(spark):
    tests = [(1, "tests/test_auth.py"), (1, "tests/deep/payment_test.py"), (1, "tests/test_x.py"),
             (2, "tests/test_auth.py"), (3, "tests/test_auth.py")]
    changed = [(1, "src/auth.py"), (1, "src/pay.py"), (2, "src/other.py"), (3, "")]
    out = strategies.name_correspondence(
        frame(spark, tests, "c int, path string"), frame(spark, changed, "c int, file string"),
        "c", "path", "file")
    got = {(r.c, r.path): r.matched for r in out.collect()}
    for c, path in tests:
        stems = [f.rsplit("/", 1)[-1].removesuffix(".py") for cc, f in changed if cc == c and f]
        assert got[(c, path)] == any(s in path for s in stems)


def test_missing_score_is_an_error(spark):
    df = frame(spark, [("c", "t", None)], "commit string, test string, p double")
    with pytest.raises(PySparkException):
        strategies.scored(df, "commit", "p", ["test"], 0.5).collect()


def test_guards_and_contamination(spark):
    df = frame(spark, [(["a.py"], True), (None, False), (None, None)],
               "drift array<string>, enforced boolean")
    clean, bad = quality.split_contaminated(df, "drift", "enforced", None)
    assert clean.count() == 1 and bad.count() == 2
    with pytest.raises(ValueError):
        quality.split_contaminated(df, "drift", "enforced", 0.02)
    with pytest.raises(ValueError):
        quality.guard_columns(df, ["nope"])
    with pytest.raises(ValueError):
        quality.select_features(df, ["nope"])


def test_evidence_is_capped_and_empty_runs_are_errors(spark):
    df = frame(spark, [("r", "a", "x" * 50), ("r", "b", "y" * 50), ("e", "a", "  ")],
               "run string, name string, context string")
    out = {r.run: r for r in quality.assemble_evidence(df, "run", "name", "context", 70).collect()}
    assert out["r"].evidence == ("--- a ---\n" + "x" * 50 + "\n\n--- b ---\n" + "y" * 50)[:70]
    assert out["e"].evidence is None and out["e"].error


def test_sample_digest_streams_over_any_group(spark):
    import hashlib

    digest = lambda ids: hashlib.sha256("\n".join(sorted(ids)).encode()).hexdigest()[:16]
    rows = [("a", f"x{i}") for i in range(50)] + [("b", "y"), ("b", "y"), (None, "z"), ("c", None)]
    df = spark.createDataFrame(rows, "g string, id string").repartition(5)
    found = {r.g: r.digest for r in metrics.sample_digest(df, ["g"], "id").collect()}
    assert found == {"a": digest([f"x{i}" for i in range(50)]), "b": digest(["y", "y"]), None: digest(["z"]),
                     "c": digest([])}
    large = spark.range(1_100_000).select(F.lit("all").alias("g"), F.col("id").cast("string").alias("id"))
    assert metrics.sample_digest(large, ["g"], "id").first().digest == digest([str(i) for i in range(1_100_000)])


def test_evidence_order_leaves_no_ties(spark):
    """Equal names go by their text, and white space of any kind is no evidence."""
    texts = [f"line {i:02d}" for i in range(30)]
    df = frame(spark, [("r", "a", t) for t in reversed(texts)] + [("e", "a", " \n\t ")],
               "run string, name string, context string").repartition(7)
    out = {r.run: r for r in quality.assemble_evidence(df, "run", "name", "context", 60).collect()}
    assert out["r"].evidence == "\n\n".join(f"--- a ---\n{t}" for t in texts)[:60]
    assert out["e"].evidence is None and out["e"].error
