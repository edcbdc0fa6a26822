"""Selective policy with abstention: decisions, threshold sweeps and gates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from . import ordering, selection


@dataclass(frozen=True)
class PolicyThresholds:
    """Thresholds of the selective policy; the default abstains on everything.

    Selecting a subset is only defensible at thresholds whose recall was measured, so without
    a tuned pair ``tau_conf`` is out of reach of any probability.
    """

    tau_abstain: float = 0.0
    tau_conf: float = 1.01
    budget: float = 0.25
    file_limit: int = 15
    churn_limit: int = 500


def commit_policy_stats(
    df: DataFrame, commit: str, item: str, label: str, confidence: str, uncertainty: str,
    ties: Sequence[str], budget: float, files: str | None = None, churn: str | None = None,
) -> DataFrame:
    """Everything a threshold pair needs, once per commit: one scan however large the grid."""
    flagged = selection.topk_per_group(
        df, [commit], [ordering.desc(confidence), F.col(item), *[F.col(t) for t in ties]],
        budget, "floor")
    failed = F.col(label) == 1
    return flagged.groupBy(commit).agg(
        F.max(uncertainty).alias("max_uncertainty"), F.max(confidence).alias("top_confidence"),
        F.count(F.lit(1)).alias("n_tests"), F.count_if("selected").alias("n_top"),
        F.count_if(failed).alias("n_failures"),
        F.count_if(failed & F.col("selected")).alias("top_failures"),
        (F.max(files) if files else F.lit(1)).alias("n_files"),
        (F.max(churn) if churn else F.lit(10)).alias("n_churn"),
    )


def _out_of_distribution(policy: PolicyThresholds) -> Column:
    return (F.col("n_files") > policy.file_limit) | (F.col("n_churn") > policy.churn_limit)


def selective_policy(stats: DataFrame, policy: PolicyThresholds) -> DataFrame:
    """Per commit: run the top share, or abstain and run everything, with reasons.

    ``stats`` comes from ``commit_policy_stats``; a commit without tests runs nothing and does
    not count as an abstention.
    """
    unsure = F.col("max_uncertainty") > policy.tau_abstain
    timid = F.col("top_confidence") < policy.tau_conf
    strange = _out_of_distribution(policy)
    empty = F.col("n_tests") == 0
    abstained = ~empty & (unsure | timid | strange)
    reasons = F.when(empty, F.array(F.lit("NO_CANDIDATES"))).otherwise(F.array_compact(F.array(
        F.when(unsure, F.lit("HIGH_UNCERTAINTY")), F.when(timid, F.lit("LOW_CONFIDENCE")),
        F.when(strange, F.lit("OUT_OF_DISTRIBUTION")),
        F.when(~(unsure | timid | strange), F.lit("WITHIN_THRESHOLDS")))))
    selected = F.when(empty, F.lit(0)).when(abstained, F.col("n_tests")).otherwise(F.col("n_top"))
    return stats.withColumns({
        "abstained": abstained,
        "mode": F.when(empty | abstained, F.lit("SAFE_FULL_SUITE"))
        .otherwise(F.lit("FAST_SELECTED")),
        "reasons": reasons, "n_selected": selected,
        "skipped_pct": F.coalesce(100.0 - ratio(selected, F.col("n_tests"), 100.0), F.lit(0.0)),
    })


def sweep_policy(
    stats: DataFrame, taus_abstain: Sequence[float], taus_conf: Sequence[float],
    policy: PolicyThresholds = PolicyThresholds(),
) -> DataFrame:
    """Pooled metrics of every threshold pair.

    The grid is a short list of literals exploded over per-commit statistics; rows are never
    rescored or multiplied.
    """
    if not taus_abstain or not taus_conf:
        raise ValueError("both grids need at least one value")
    grid = F.array(*[
        F.struct(F.lit(float(a)).alias("tau_abstain"), F.lit(float(c)).alias("tau_conf"))
        for a in sorted(taus_abstain) for c in sorted(taus_conf)])
    pairs = stats.withColumn("__g", F.explode(grid)).select("*", "__g.*").drop("__g")
    abstained = ((F.col("max_uncertainty") > F.col("tau_abstain"))
                 | (F.col("top_confidence") < F.col("tau_conf")) | _out_of_distribution(policy))
    executed = F.when(abstained, F.col("n_tests")).otherwise(F.col("n_top"))
    detected = F.when(abstained, F.col("n_failures")).otherwise(F.col("top_failures"))
    escaped = ~abstained & (F.col("top_failures") < F.col("n_failures"))
    totals = pairs.groupBy("tau_abstain", "tau_conf").agg(
        F.sum("n_tests").alias("tests_available"), F.sum(executed).alias("tests_executed"),
        F.sum("n_failures").alias("failures_available"),
        F.sum(detected).alias("failures_detected"),
        F.count_if(abstained).alias("abstentions"), F.count_if(escaped).alias("escaped_commits"),
        F.count(F.lit(1)).alias("commits"))
    return totals.withColumns({
        "trr_pct": 100.0 - ratio(F.col("tests_executed"), F.col("tests_available"), 100.0),
        "recall_pct": ratio(F.col("failures_detected"), F.col("failures_available"), 100.0),
        "abstention_pct": ratio(F.col("abstentions"), F.col("commits"), 100.0),
    })


def frontier_point(grid: DataFrame, objective: str, recall_floor: float = 90.0) -> DataFrame:
    """The admissible grid point with the largest reduction; none is an error, not a default."""
    if objective == "zero_escape":
        admissible = F.col("escaped_commits") == 0
    elif objective == "recall_floor":
        admissible = F.col("recall_pct") >= recall_floor
    else:
        raise ValueError(f"unknown objective {objective!r}")
    admissible = admissible & F.col("trr_pct").isNotNull()
    key = F.struct("trr_pct", (-F.col("escaped_commits")).alias("e"),
                   (-F.col("tau_abstain")).alias("a"), (-F.col("tau_conf")).alias("c"))
    best = grid.agg(
        F.count(F.lit(1)).alias("grid_points"), F.count_if(admissible).alias("eligible_points"),
        F.max_by(F.struct(*grid.columns), F.when(admissible, key)).alias("best"))
    checked = F.when(F.col("eligible_points") == 0, F.raise_error(
        F.lit(f"no threshold pair satisfies the {objective} objective"))).otherwise(
        F.col("eligible_points"))
    return best.select(F.lit(objective).alias("objective"), "grid_points",
                       checked.alias("eligible_points"), "best.*")


def recall_floor_gate(
    val_grid: DataFrame, test_grid: DataFrame, recall_floor: float,
    recall_lower: float | None = None,
) -> DataFrame:
    """Pick on validation, judge on the held-out sweep.

    The best qualifying held-out point is reported as a diagnostic only.  ``recall_lower`` is
    the lower end of the held-out recall interval when one was measured.
    """
    pick = frontier_point(val_grid, "recall_floor", recall_floor).select(
        "tau_abstain", "tau_conf", F.col("recall_pct").alias("val_recall_pct"),
        F.col("trr_pct").alias("val_trr_pct"), "eligible_points")
    held = test_grid.select(
        "tau_abstain", "tau_conf", F.col("recall_pct").alias("test_recall_pct"),
        F.col("trr_pct").alias("test_trr_pct"),
        F.col("escaped_commits").alias("test_escaped_commits"))
    qualifying = F.col("recall_pct") >= recall_floor
    diagnostic = test_grid.agg(
        F.count_if(qualifying).alias("test_qualifying_points"),
        F.max(F.when(qualifying, F.col("trr_pct"))).alias("best_test_trr_pct")).first()
    met = F.coalesce(F.col("test_recall_pct") >= recall_floor, F.lit(False))
    lower = F.lit(recall_lower).cast("double")
    return pick.join(held, ["tau_abstain", "tau_conf"]).withColumns({
        "gate_met": met,
        "gate_met_at_lower": met & F.coalesce(lower >= recall_floor, F.lit(False)),
        "generalization_gap_pct": F.col("val_recall_pct") - F.col("test_recall_pct"),
        "test_qualifying_points": F.lit(diagnostic["test_qualifying_points"]),
        "best_test_trr_pct": F.lit(diagnostic["best_test_trr_pct"]).cast("double"),
    })


def threshold_policy(
    df: DataFrame, commits: DataFrame, commit: str, item: str, p: str, uncertainty: str,
    direct: str, strange: str, ties: Sequence[str], tau: float, theta: float,
    sanity: int = 3,
) -> DataFrame:
    """The older rule: abstain on strangeness or uncertainty, else ``p >= theta`` or direct.

    If nothing qualifies the first few items run; a commit without items is a NO_OP.
    """
    chosen = (F.col(p) >= theta) | F.col(direct).cast("boolean")
    stats = df.groupBy(commit).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(chosen).alias("c"),
        F.max(uncertainty).alias("max_uncertainty"),
        F.max(F.col(strange).cast("int")).alias("strange"))
    joined = commits.select(commit).distinct().join(stats, commit, "left")
    abstain = (F.col("strange") == 1) | (F.col("max_uncertainty") > tau)
    n_selected = (F.when(F.col("n").isNull(), F.lit(0)).when(abstain, F.col("n"))
                  .when(F.col("c") == 0, F.least(F.col("n"), F.lit(sanity)))
                  .otherwise(F.col("c")))
    return joined.select(
        commit,
        F.when(F.col("n").isNull(), F.lit("NO_OP"))
        .when(abstain, F.lit("ABSTAIN_SAFE_FALLBACK")).otherwise(F.lit("SELECTIVE_RUN"))
        .alias("action"),
        n_selected.alias("n_selected"), F.coalesce("n", F.lit(0)).alias("n_total"),
        F.coalesce(1 - ratio(n_selected, F.col("n")), F.lit(0.0)).alias("reduction"),
        F.coalesce("max_uncertainty", F.lit(0.0)).alias("max_uncertainty"),
        (1 - F.coalesce("max_uncertainty", F.lit(0.0))).alias("confidence"))


def threshold_policy_rows(
    df: DataFrame, commit: str, item: str, p: str, uncertainty: str, direct: str, strange: str,
    ties: Sequence[str], tau: float, theta: float, sanity: int = 3,
) -> DataFrame:
    """The rows the older rule runs, flagged in ``selected``."""
    chosen = (F.col(p) >= theta) | F.col(direct).cast("boolean")
    sized = ordering.with_totals(
        df, [commit], __c=F.count_if(chosen), __u=F.max(uncertainty),
        __o=F.max(F.col(strange).cast("int")))
    ranked = ordering.row_rank(sized, [commit], [F.col(item), *[F.col(t) for t in ties]], "__r")
    abstain = (F.col("__o") == 1) | (F.col("__u") > tau)
    fallback = (F.col("__c") == 0) & (F.col("__r") <= sanity)
    return ranked.withColumn("selected", abstain | chosen | fallback).drop(
        "__c", "__u", "__o", "__r")


# The highest status of an item in text order, as a number: a number is summed up without sorting rows.
_ERROR, _FAILED, _SKIPPED = 1, 3, 5


def _level(status: Column) -> Column:
    level = F.when(status.isNull(), F.lit(None))
    for text, at in (("ERROR", _ERROR), ("FAILED", _FAILED), ("SKIPPED", _SKIPPED)):
        level = level.when(status < text, at - 1).when(status == text, at)
    return level.otherwise(_SKIPPED + 1)


def _outcomes(
    universe: DataFrame, observed: DataFrame, group: str, item: str, status: str
) -> DataFrame:
    """Every (group, item) of the universe once, with ``__vanished``, ``__killed`` and ``__skipped``.

    Both tables are added up together, in one exchange and without a join of the two.
    """
    level = F.lit(None).cast("int")
    expected = universe.select(group, item, F.lit(True).alias("__expected"), level.alias("__level"))
    seen = observed.filter(F.col(group).isNotNull() & F.col(item).isNotNull()).select(
        group, item, F.lit(False).alias("__expected"), _level(F.col(status)).cast("int").alias("__level"))
    folded = expected.unionByName(seen).groupBy(group, item).agg(
        F.max("__expected").alias("__expected"), F.max("__level").alias("__level"))
    vanished = F.col("__level").isNull()
    return folded.filter("__expected").select(
        group, item, vanished.alias("__vanished"),
        (vanished | F.col("__level").isin(_FAILED, _ERROR)).alias("__killed"),
        F.coalesce(F.col("__level") == _SKIPPED, F.lit(False)).alias("__skipped"))


def run_status(
    universe: DataFrame, observed: DataFrame, group: str, item: str, status: str,
    flags: DataFrame, broke_ratio: float,
) -> DataFrame:
    """Kill set of every group: universe items that fail, err or vanish (skipping is not one).

    ``universe`` has the expected (group, item) rows, which may repeat; ``flags`` has timed_out and
    timeout_enforced per group.
    """
    counts = _outcomes(universe, observed, group, item, status).groupBy(group).agg(
        F.count(F.lit(1)).alias("universe_size"), F.count_if("__killed").alias("n_killed"),
        F.count_if("__vanished").alias("n_missing"), F.count_if("__skipped").alias("n_skipped"))
    share = ratio(F.col("n_killed"), F.col("universe_size"))
    verdict = (
        F.when(~F.col("timeout_enforced").cast("boolean"), F.lit("timeout_broken"))
        .when(F.col("timed_out").cast("boolean"), F.lit("timed_out"))
        .when(share >= broke_ratio, F.lit("broke_suite")).otherwise(F.lit("harvested")))
    return flags.join(counts, group).select(
        group, "universe_size", "n_killed", "n_missing", "n_skipped", share.alias("kill_ratio"),
        verdict.alias("status"))


def killed_items(universe: DataFrame, observed: DataFrame, group: str, item: str, status: str):
    """The killed (group, item) rows themselves, each once; every other universe row is label 0."""
    return _outcomes(universe, observed, group, item, status).filter("__killed").select(group, item)


def defect_status(df: DataFrame) -> DataFrame:
    """Whether a measured defect may be used as a label; the first reason wins.

    Columns: timeout_enforced, timed_out, n_collected, n_documented, n_not_in_universe,
    n_not_failing.
    """
    status = (
        F.when(~F.col("timeout_enforced").cast("boolean"), F.lit("timeout_broken"))
        .when(F.col("timed_out").cast("boolean"), F.lit("timed_out"))
        .when(F.col("n_collected") == 0, F.lit("collection_failed"))
        .when(F.col("n_documented") == 0, F.lit("no_documented_tests"))
        .when(F.col("n_not_in_universe") > 0, F.lit("documented_mismatch"))
        .when(F.col("n_not_failing") > 0, F.lit("documented_mismatch"))
        .otherwise(F.lit("harvested")))
    reason = (
        F.when(F.col("status").isin("harvested"), F.lit(None))
        .when(F.col("status") == "timeout_broken", F.lit("the suite timeout did not hold"))
        .when(F.col("status") == "timed_out", F.lit("the defect run exceeded its time limit"))
        .when(F.col("status") == "collection_failed", F.lit("nothing was collected"))
        .when(F.col("status") == "no_documented_tests", F.lit("no readable documented test"))
        .when(F.col("n_not_in_universe") > 0,
              F.lit("documented test absent from the measured universe"))
        .otherwise(F.lit("documented test did not fail")))
    return df.withColumn("status", status).withColumn("reason", reason)


def screen_gates(
    df: DataFrame, min_tests: int = 50, max_tests: int = 1200, planned_runs: int = 250,
    max_hours: float = 1.0, min_varying: int = 3,
) -> DataFrame:
    """First failed stage gate per subject, or passed.

    Columns: exit_reason (NULL when clean), n_collected, suite_seconds, n_flaky, n_failing,
    n_varying.
    """
    hours = F.col("suite_seconds") * planned_runs / 3600.0
    stable = F.col("n_collected") - F.col("n_flaky") - F.col("n_failing")
    rejection = (
        F.when(F.col("exit_reason").isNotNull(), F.col("exit_reason"))
        .when(F.col("n_collected") == 0, F.lit("collected_zero_tests"))
        .when(F.col("n_collected") < min_tests, F.lit("too_few_tests"))
        .when(F.col("n_collected") > max_tests, F.lit("too_many_tests"))
        .when(hours > max_hours, F.lit("harvest_too_expensive"))
        .when(stable < min_tests, F.lit("too_few_stable_tests"))
        .when(F.col("n_varying") < min_varying, F.lit("too_few_varying_features")))
    return df.withColumns({
        "harvest_hours": hours, "n_stable": stable, "rejection": rejection,
    }).withColumn("passed", F.col("rejection").isNull())
