"""Aggregate metrics over scored rows, commits and outcomes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import binary_entropy, ratio
from . import ordering


def outcome_manifest(
    df: DataFrame, repo: str, group: Sequence[str], label: str, total_name: str = "ALL"
) -> DataFrame:
    """Row, failure and group counts per repository and in total.

    A group is detected when it has a failure; both failure rates (all rows, rows of detected
    groups) are reported.
    """
    per_group = df.groupBy(repo, *group).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("f"))
    found = F.col("f") > 0
    summed = per_group.rollup(repo).agg(
        F.sum("n").alias("n_rows"), F.sum("f").alias("n_failures"),
        F.count(F.lit(1)).alias("n_groups"), F.count_if(found).alias("n_detected"),
        F.sum(F.when(found, F.col("n")).otherwise(0)).alias("detected_rows"),
        F.grouping(repo).alias("is_total"),
    )
    name = F.when(F.col("is_total") == 1, F.lit(total_name)).otherwise(F.col(repo).cast("string"))
    return summed.select(
        name.alias("repo"), "n_rows", "n_failures", "n_groups", "n_detected",
        (F.col("n_groups") - F.col("n_detected")).alias("n_undetected"), "detected_rows",
        ratio(F.col("n_failures"), F.col("n_rows")).alias("failure_rate"),
        ratio(F.col("n_failures"), F.col("detected_rows")).alias("detected_failure_rate"),
    )


def gate_rates(
    df: DataFrame, repo: str, group: Sequence[str], label: str, low: float, high: float,
    min_rows: int,
) -> DataFrame:
    """Band check of the failure rate over rows of detected groups, per repository and pooled."""
    manifest = outcome_manifest(df, repo, group, label)
    rate = F.col("detected_failure_rate")
    return manifest.select(
        "repo", "n_rows", "failure_rate", "detected_failure_rate",
        F.coalesce(rate.between(low, high), F.lit(False)).alias("in_band"),
        (F.col("n_rows") >= min_rows).alias("enough_rows"),
    )


def selection_metrics(
    df: DataFrame, label: str, selected: str, by: Sequence[str] = ()
) -> DataFrame:
    """Coverage, selection rate, cost reduction and precision of a selection mask."""
    chosen, failed = F.col(selected).cast("boolean"), F.col(label) == 1
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(failed).alias("n_failures"),
        F.count_if(chosen).alias("n_selected"),
        F.count_if(failed & chosen).alias("failures_caught"),
    )
    rate = ratio(F.col("n_selected"), F.col("n_rows"))
    return counts.select(
        *by, "n_rows", "n_failures", "n_selected", "failures_caught",
        (F.col("n_failures") - F.col("failures_caught")).alias("failures_missed"),
        ratio(F.col("failures_caught"), F.col("n_failures")).alias("empirical_coverage"),
        rate.alias("selection_rate"), (1 - rate).alias("cost_reduction"),
        F.when(F.col("n_selected") > 0, F.col("failures_caught") / F.col("n_selected"))
        .when(F.col("n_rows") > 0, F.lit(0.0)).alias("precision"),
    )


def per_commit_metrics(
    df: DataFrame, commit: str, label: str, selected: str, by: Sequence[str] = ()
) -> DataFrame:
    """How many commits were fully or partly caught, and mean sizes per commit."""
    chosen, failed = F.col(selected).cast("boolean"), F.col(label) == 1
    commits = df.groupBy(*by, commit).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("f"),
        F.count_if(chosen).alias("s"), F.count_if(failed & chosen).alias("c"),
    )
    failing = F.col("f") > 0
    full = F.count_if(failing & (F.col("c") == F.col("f")))
    partly = F.count_if(failing & (F.col("c") > 0))
    return commits.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_commits"), F.count_if(failing).alias("n_failing_commits"),
        full.alias("commits_fully_caught"),
        ratio(full, F.count_if(failing)).alias("commit_full_catch_rate"),
        ratio(partly, F.count_if(failing)).alias("commit_any_catch_rate"),
        F.avg("s").alias("mean_selected_per_commit"), F.avg("n").alias("mean_available_per_commit"),
    )


def classification_report(
    df: DataFrame, label: str, score: str, threshold: float | Column = 0.5,
    by: Sequence[str] = (),
) -> DataFrame:
    """Accuracy, precision, recall, F1 and rates at a threshold; empty ratios are 0."""
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit, failed = F.col(score) >= cut, F.col(label) == 1
    counts = df.groupBy(*by).agg(
        F.count_if(hit & failed).alias("tp"), F.count_if(hit & ~failed).alias("fp"),
        F.count_if(~hit & failed).alias("fn"), F.count_if(~hit & ~failed).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn

    def share(top: Column, bottom: Column) -> Column:
        return F.coalesce(ratio(top, bottom), F.lit(0.0))

    return counts.select(
        *by, "tp", "fp", "fn", "tn",
        ratio(tp + tn, total).alias("accuracy"), share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(tp + fp, total).alias("positive_rate"), ratio(tp + fn, total).alias("base_rate"),
    )


def probability_losses(
    df: DataFrame, label: str, score: str, by: Sequence[str] = (), eps: float = 1e-7
) -> DataFrame:
    """Log-loss (NULL when only one class is present) and Brier score."""
    y, p = F.col(label).cast("double"), F.col(score)
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    loss = F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q)))
    return df.groupBy(*by).agg(
        F.when(F.min(label) < F.max(label), loss).alias("log_loss"),
        F.avg((y - p) * (y - p)).alias("brier"),
    )


def _score_counts(df: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by, score).agg(
        F.count_if(F.col(label) == 1).alias("__pos"), F.count_if(F.col(label) != 1).alias("__neg"))


def roc_auc(
    df: DataFrame, label: str, score: str, by: Sequence[str] = (),
    undefined: float | None = None,
) -> DataFrame:
    """Tie-aware area under the ROC curve; ``undefined`` is reported for a single class."""
    counts = _score_counts(df, label, score, by)
    placed = ordering.running(counts, by, [F.col(score)], sums={"__below": F.col("__neg")})
    wins = F.sum(F.col("__pos") * (F.col("__below") + F.col("__neg") / 2))
    pairs = F.sum("__pos").cast("double") * F.sum("__neg")
    return placed.groupBy(*by).agg(
        F.coalesce(ratio(wins, pairs), F.lit(undefined).cast("double")).alias("roc_auc"))


def average_precision(
    df: DataFrame, label: str, score: str, by: Sequence[str] = (),
    undefined: float | None = None,
) -> DataFrame:
    """Step-wise area under the precision-recall curve over distinct thresholds."""
    counts = _score_counts(df, label, score, by)
    placed = ordering.running(counts, by, [ordering.desc(score)], sums={
        "__tp": F.col("__pos"), "__seen": F.col("__pos") + F.col("__neg")})
    tp = F.col("__tp") + F.col("__pos")
    seen = F.col("__seen") + F.col("__pos") + F.col("__neg")
    area = F.sum(F.col("__pos") * tp / seen)
    return placed.groupBy(*by).agg(
        F.coalesce(ratio(area, F.sum("__pos")), F.lit(undefined).cast("double"))
        .alias("pr_auc"))


def bin_edges(n_bins: int) -> list[float]:
    """Equal-width edges over [0, 1]."""
    step = 1.0 / n_bins
    return [b * step for b in range(n_bins)] + [1.0]


def bin_index(score: Column, n_bins: int, edges: str = "left") -> Column:
    """0-based bin of a probability under one of the four edge conventions."""
    inner = bin_edges(n_bins)[1:-1]
    if edges in ("left", "legacy_half_open"):
        index = sum(((score >= e).cast("int") for e in inner), F.lit(0))
    elif edges in ("right", "open_low"):
        index = sum(((score > e).cast("int") for e in inner), F.lit(0))
    else:
        raise ValueError(f"unknown edge mode {edges!r}")
    if edges == "legacy_half_open":
        return F.when((score >= 0) & (score < 1), index)
    if edges == "open_low":
        return F.when((score > 0) & (score <= 1), index)
    return F.when(score.isNotNull(), index)


def calibration_bins(
    df: DataFrame, label: str, score: str, n_bins: int, edges: str = "left",
    by: Sequence[str] = (),
) -> DataFrame:
    """Count, mean score, observed rate and gap of every occupied bin."""
    p = F.col(score)
    if edges == "right":
        p = F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0))
    binned = df.select(*by, F.col(label).alias("__y"), p.alias("__p"))
    binned = binned.withColumn("bin", bin_index(F.col("__p"), n_bins, edges))
    grouped = binned.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("count"), F.avg("__p").alias("mean_predicted"),
        F.avg("__y").alias("observed"))
    return grouped.withColumn("gap", F.abs(F.col("mean_predicted") - F.col("observed")))


def calibration_error(
    df: DataFrame, label: str, score: str, n_bins: int = 15, edges: str = "left",
    by: Sequence[str] = (),
) -> DataFrame:
    """Expected (count weighted) and maximum calibration error.

    Rows outside every bin of the edge mode stay in the denominator.
    """
    bins = calibration_bins(df, label, score, n_bins, edges, by)
    inside = F.col("bin").isNotNull()
    weighted = F.sum(F.when(inside, F.col("count") * F.col("gap")).otherwise(0.0))
    return bins.groupBy(*by).agg(
        ratio(weighted, F.sum("count")).alias("ece"),
        F.coalesce(F.max(F.when(inside, F.col("gap"))), F.lit(0.0)).alias("mce"),
        F.sum("count").alias("n_rows"),
    )


def reliability_table(
    df: DataFrame, label: str, score: str, by: Sequence[str], n_bins: int = 15,
    edges: str = "left", drop_empty: bool = False,
) -> DataFrame:
    """Dense (keys, bin) grid; an empty bin has count 0 and NULL statistics."""
    bins = calibration_bins(df, label, score, n_bins, edges, by).filter("bin IS NOT NULL")
    if drop_empty:
        return bins
    grid = df.select(*by).distinct().withColumn(
        "bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    joined = grid.join(bins, [*by, "bin"], "left")
    return joined.withColumn("count", F.coalesce("count", F.lit(0)))


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    """Totals over outcomes; safety figures only over verified ones, NULL if there are none."""
    verified = F.col("ground_truth_complete") == 1

    def over_verified(name: str) -> Column:
        return F.sum(F.when(verified, F.col(name)))

    n_verified = F.count_if(verified)
    actual = over_verified("actual_failures")
    detected, missed = over_verified("detected_failures"), over_verified("missed_failures")
    saved = (over_verified("full_duration") - over_verified("selected_duration")) / 3600.0
    return outcomes.agg(
        F.count(F.lit(1)).alias("total_commits"), n_verified.alias("verified_commits"),
        (F.count(F.lit(1)) - n_verified).alias("unverified_commits"),
        actual.alias("total_actual_failures"), detected.alias("total_detected_failures"),
        missed.alias("total_missed_failures"),
        F.round(ratio(detected, actual), 4).alias("failure_recall"),
        F.round(ratio(missed, actual), 4).alias("missed_failure_rate"),
        F.round(F.avg(F.when(verified, F.col("time_reduction_ratio"))), 4)
        .alias("average_time_reduction"),
        F.round(F.greatest(saved, F.lit(0.0)), 2).alias("total_hours_saved"),
    )


def one_row(*parts: DataFrame) -> DataFrame:
    """Merge one-row frames with different columns into a single row."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])


def telemetry_summary(commits: DataFrame, decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Counts of repositories, commits and decisions; averages are NULL over nothing."""
    from_commits = commits.agg(
        F.count_distinct("repo").alias("total_repositories"),
        F.count(F.lit(1)).alias("total_commits"))
    abstained = F.col("abstained") == 1
    from_decisions = decisions.agg(
        F.count(F.lit(1)).alias("total_decisions"), F.count_if(~abstained).alias("fast_decisions"),
        F.count_if(abstained).alias("abstentions"),
        F.round(F.avg("estimated_saving"), 2).alias("average_test_reduction"),
        F.round(F.avg("uncertainty"), 4).alias("average_uncertainty"))
    verified = F.col("ground_truth_complete") == 1
    from_outcomes = outcomes.agg(
        F.coalesce(F.sum("detected_failures"), F.lit(0)).alias("total_failures_detected"),
        F.sum(F.when(verified, F.col("missed_failures"))).alias("total_missed_failures"),
        F.count_if(verified).alias("verified_outcomes"),
        F.count_if(~verified).alias("unverified_outcomes"))
    return one_row(from_commits, from_decisions, from_outcomes)


def stable_universe(
    runs: DataFrame, test: str, run: str, status: str, duration: str, n_runs: int
) -> DataFrame:
    """Tests that passed in every run, or the first reason they are excluded."""
    once = runs.groupBy(test, run).agg(
        F.max(status).alias("__status"), F.sum(duration).alias("__seconds"))
    per_test = once.groupBy(test).agg(
        F.count(F.lit(1)).alias("__seen"), F.min("__status").alias("__low"),
        F.max("__status").alias("__high"), F.sum("__seconds").alias("__seconds"),
        F.array_sort(F.collect_list(F.struct(run, "__status"))).alias("__by_run"))
    flips = F.concat(F.lit("flaky:"),
                     F.array_join(F.transform("__by_run", lambda s: s["__status"]), "/"))
    low, high = F.col("__low"), F.col("__high")
    reason = (
        F.when(F.col("__seen") < n_runs, F.lit("not_collected_in_every_run"))
        .when((low == "PASSED") & (high == "PASSED"), F.lit(None))
        .when(low != high, flips)
        .when(low == "SKIPPED", F.lit("skipped"))
        .otherwise(F.concat(F.lit("failing_on_clean_checkout:"), low))
    )
    result = per_test.withColumn("reason", reason)
    return result.select(
        test, F.col("reason").isNull().alias("stable"), "reason",
        F.when(F.col("reason").isNull(), F.col("__seconds") / n_runs).alias("mean_duration"))


def suite_flakiness(
    runs: DataFrame, suite: str, test: str, run: str, status: str, n_runs: int, first_run: int = 0
) -> DataFrame:
    """Per suite: tests whose status differs between runs (missing counts as a status)."""
    once = runs.groupBy(suite, test, run).agg(F.max(status).alias("__status"))
    per_test = once.groupBy(suite, test).agg(
        F.count(F.lit(1)).alias("__seen"), F.min("__status").alias("__low"),
        F.max("__status").alias("__high"),
        F.max(F.when(F.col(run) == first_run, F.col("__status"))).alias("__first"))
    flaky = (F.col("__low") != F.col("__high")) | (F.col("__seen") < n_runs)
    failing = F.coalesce(F.col("__first").isin("FAILED", "ERROR"), F.lit(False))
    counted = per_test.groupBy(suite).agg(
        F.count(F.lit(1)).alias("n_collected"), F.count_if(flaky).alias("n_flaky"),
        F.count_if(failing).alias("n_failing"))
    return counted.withColumn(
        "n_stable", F.col("n_collected") - F.col("n_flaky") - F.col("n_failing"))


def project_summary(records: DataFrame, project: str = "project") -> DataFrame:
    """Records and labelled records per project, with mean sizes of the labelled ones."""
    labelled = F.col("status") == "harvested"
    return records.groupBy(project).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(labelled).alias("harvested"),
        F.round(F.avg(F.when(labelled, F.col("universe_size"))), 2).alias("mean_universe_size"),
        F.round(F.avg(F.when(labelled, F.col("n_killed"))), 2).alias("mean_n_killed"),
        (F.count_if(labelled) > 0).alias("has_labels"),
    )


def status_counts(records: DataFrame, status: str = "status") -> DataFrame:
    return records.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def metadata_survey(specs: DataFrame, project: str, version: str, readable: str) -> DataFrame:
    """Per project: totals, readable commands, and counts per pinned version as a map."""
    counted = specs.groupBy(project, version).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(readable)).alias("r"))
    return counted.groupBy(project).agg(
        F.sum("n").alias("n_bugs"), F.sum("r").alias("n_readable"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(version, "n"))))
        .alias("versions"))


def class_weights(df: DataFrame, label: str, counted: bool = False) -> DataFrame:
    """Balanced class weights and the negative/positive ratio as one row, ``counted`` with all rows as ``n``."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    n = F.count(F.lit(1))

    def weight(count: Column, fallback: float) -> Column:
        balanced = n / (2.0 * F.greatest(count, F.lit(1)))
        return F.when(n == 0, F.lit(1.0)).when(pos == 0, F.lit(fallback)).otherwise(balanced)

    return df.agg(
        weight(neg, 1.0).alias("w_neg"), weight(pos, 10.0).alias("w_pos"),
        ratio(neg, pos).alias("scale_pos_weight"), *([n.alias("n")] if counted else []))


def sample_weights(
    df: DataFrame, label: str, flaky: str, discount: float = 0.5, cutoff: float = 0.1
) -> DataFrame:
    """Class weight, discounted where the flaky score is above ``cutoff``; and the robust
    variant ``clip(1 - 0.7 f, 0.1, 1)``."""
    weights = class_weights(df, label).first()
    base = F.when(F.col(label) == 1, F.lit(weights["w_pos"])).otherwise(F.lit(weights["w_neg"]))
    return df.withColumns({
        "sample_weight": F.when(F.col(flaky) > cutoff, base * discount).otherwise(base),
        "robust_weight": F.greatest(F.least(1 - 0.7 * F.col(flaky), F.lit(1.0)), F.lit(0.1)),
    })


def ensemble_uncertainty(members: DataFrame, keys: Sequence[str], p: str) -> DataFrame:
    """Mean, population deviation and variance across members, and entropy of the mean."""
    folded = members.groupBy(*keys).agg(
        F.avg(p).alias("mean_prob"), F.stddev_pop(p).alias("epistemic_std"),
        F.var_pop(p).alias("epistemic_variance"), F.count(p).alias("n_members"))
    return folded.withColumn("predictive_entropy", binary_entropy(F.col("mean_prob")))


def commit_uncertainty(df: DataFrame, commit: str, std: str, p: str) -> DataFrame:
    """Maximum, mean and 95th percentile of the deviation, and probabilities, per commit."""
    simple = df.groupBy(commit).agg(
        F.max(std).alias("max_std"), F.avg(std).alias("mean_std"), F.max(p).alias("max_prob"),
        F.avg(p).alias("mean_prob"))
    tails = ordering.quantiles(df.select(commit, std), [commit], std, {"p95_std": 0.95})
    return simple.join(tails, commit, "left")


def uncertainty_report(df: DataFrame, label: str, p: str, std: str, entropy: str) -> DataFrame:
    """Mean and p95 uncertainty, mean entropy, and correlation with the absolute error."""
    error = F.abs(F.col(label) - F.col(p))
    simple = df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(std).alias("mean_uncertainty"),
        F.avg(entropy).alias("mean_entropy"), F.corr(F.col(std), error).alias("error_correlation"))
    return one_row(simple, ordering.quantiles(df.select(std), [], std, {"p95_uncertainty": 0.95}))


def time_decayed_rate(
    runs: DataFrame, test: str, ts: str, ties: Sequence[str], failed: str, duration: str,
    age_days: Column, decay: float = 0.05, universe: DataFrame | None = None,
) -> DataFrame:
    """Exponentially decayed failure rate, mean duration and flip share per test.

    Tests of ``universe`` without runs get the neutral defaults 0.05, 1.0 and 0.
    """
    aged = runs.withColumn("__weight", F.exp(-decay * age_days))
    aged = ordering.lagged(aged, [test], [ts, *ties], failed, "__before")
    flips = F.count_if(F.col(failed) != F.col("__before"))
    n = F.count(F.lit(1))
    rates = aged.groupBy(test).agg(
        F.least(ratio(F.sum(F.col(failed) * F.col("__weight")), F.sum("__weight")), F.lit(1.0))
        .alias("decayed_rate"),
        F.avg(duration).alias("mean_duration"),
        F.when(n >= 3, flips / (n - 1)).otherwise(F.lit(0.0)).alias("flip_share"))
    if universe is not None:
        rates = universe.select(test).distinct().join(rates, test, "left")
    return rates.select(
        test, F.coalesce("decayed_rate", F.lit(0.05)).alias("decayed_rate"),
        F.coalesce("mean_duration", F.lit(1.0)).alias("mean_duration"),
        F.coalesce("flip_share", F.lit(0.0)).alias("flip_share"))


def macro_average(results: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Unweighted mean of per-group metrics; undefined ones are left out and counted."""
    columns = [F.count(F.lit(1)).alias("n_groups")]
    for name in metrics:
        columns += [F.avg(name).alias(f"mean_{name}"), F.count(name).alias(f"defined_{name}")]
    return results.agg(*columns)


def drift_threshold_summary(stationary: DataFrame, shifts: DataFrame) -> DataFrame:
    """Per threshold: false alarms on stationary streams against detection of real shifts."""
    quiet = stationary.groupBy("threshold").agg(
        F.sum("false_alarms").alias("false_alarms_total"),
        F.sum("streamed").alias("stationary_streamed"))
    found = F.col("detected") == 1
    moved = shifts.groupBy("threshold").agg(
        F.count_if(found).alias("shifts_detected"), F.count(F.lit(1)).alias("shifts_attempted"),
        F.sum("false_alarms_before_shift").alias("pre_shift_alarms"))
    latency = ordering.quantiles(shifts.filter(found).select("threshold", "latency"),
                                 ["threshold"], "latency", {"median_latency": 0.5})
    return (quiet.join(moved, "threshold", "full").join(latency, "threshold", "left"))


def adaptation_effect(runs: DataFrame, repo: str = "repo") -> DataFrame:
    """Per repository: the quiet run with the lowest threshold against the busiest run."""
    quiet = F.col("adaptations") == 0
    at = F.struct("threshold", "mean_error")
    busiest = F.struct(F.col("adaptations"), (-F.col("threshold")).alias("t"))
    per_repo = runs.groupBy(repo).agg(
        F.min_by(at, F.when(quiet, F.col("threshold"))).alias("q"),
        F.max_by(F.struct("threshold", "mean_error", "adaptations"), busiest).alias("b"))
    comparable = F.col("q").isNotNull() & (F.col("b.adaptations") > 0)
    return per_repo.select(
        repo, comparable.alias("comparable"),
        F.when(comparable, F.col("q.threshold")).alias("quiet_threshold"),
        F.when(comparable, F.col("q.mean_error")).alias("quiet_error"),
        F.when(comparable, F.col("b.threshold")).alias("busy_threshold"),
        F.when(comparable, F.col("b.mean_error")).alias("busy_error"),
        F.when(comparable, F.col("b.adaptations")).alias("busy_adaptations"),
        F.when(comparable, F.col("b.mean_error") - F.col("q.mean_error")).alias("error_delta"))


def batch_summary(results: DataFrame, batch: str) -> DataFrame:
    """Per batch of requests: successes, failures, candidates, selected and cost reduction."""
    good = F.col("error").isNull()
    candidates = F.sum(F.when(good, F.col("n_candidates")).otherwise(0))
    selected = F.sum(F.when(good, F.col("n_selected")).otherwise(0))
    return results.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n_changes"), F.count_if(good).alias("n_succeeded"),
        F.count_if(~good).alias("n_failed"), candidates.alias("n_candidates"),
        selected.alias("n_selected"),
        F.coalesce(1 - ratio(selected, candidates), F.lit(0.0)).alias("cost_reduction"))


def suite_size(df: DataFrame, repo: str, commit: str) -> DataFrame:
    """Median rows per commit and number of commits, per repository."""
    per_commit = df.groupBy(repo, commit).agg(F.count(F.lit(1)).alias("n"))
    counts = per_commit.groupBy(repo).agg(F.count(F.lit(1)).alias("n_commits"))
    return counts.join(
        ordering.quantiles(per_commit, [repo], "n", {"median_suite_size": 0.5}), repo)


def describe_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean, sample deviation, minimum and maximum per feature, one row each."""
    numbers = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.agg(*[
        fold(F.col(c).cast("double")).alias(f"{c}__{name}")
        for c in features for name, fold in numbers.items()])
    entries = F.array(*[
        F.struct(F.lit(c).alias("feature"), *[F.col(f"{c}__{n}").alias(n) for n in numbers])
        for c in features])
    return wide.select(F.inline(entries))


def collection_quality(
    commits: DataFrame, files: DataFrame, repo: str, commit: str, already: DataFrame | None = None
) -> DataFrame:
    """Per repository: new commits, line churn, file modifications and checkpoint size."""
    if already is None:
        known, fresh = None, commits
    else:
        known = commits.join(already, commit, "left_semi").groupBy(repo).agg(
            F.count(F.lit(1)).alias("__known"))
        fresh = commits.join(already, commit, "left_anti")
    churn = files.groupBy(commit).agg(
        F.sum(F.col("lines_added") + F.col("lines_deleted")).alias("__churn"),
        F.count(F.lit(1)).alias("__files"))
    report = fresh.join(churn, commit, "left").groupBy(repo).agg(
        F.count(F.lit(1)).alias("commits_collected"),
        F.coalesce(F.sum("__churn"), F.lit(0)).alias("total_line_churn"),
        F.coalesce(F.sum("__files"), F.lit(0)).alias("total_file_modifications"))
    if known is None:
        return report.withColumn("total_checkpointed", F.col("commits_collected"))
    # A repository may have nothing but known commits, or nothing but new ones.
    both = report.join(known, repo, "full").fillna(
        0, ["commits_collected", "total_line_churn", "total_file_modifications", "__known"])
    return both.withColumn(
        "total_checkpointed", F.col("commits_collected") + F.col("__known")).drop("__known")


def sample_digest(df: DataFrame, by: Sequence[str], item: str) -> DataFrame:
    """Fingerprint of a drawn sample: hash of its sorted ids, joined by line feeds.

    Groups are hash-partitioned and sorted by Spark, which spills; the hash is carried over the
    sorted Arrow batches, so a group of any size needs constant memory in its task. Null ids are
    left out, a group of nothing else has the digest of an empty text.
    """
    keys = list(by)
    arranged = df.select(*keys, F.col(item).cast("string").alias("__id")).repartition(
        *keys).sortWithinPartitions(*keys, "__id")
    kinds = arranged.select(*keys).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, empty = None, None, True

        def done() -> pa.RecordBatch:
            columns = [pa.array([v], t) for v, t in zip(current, types)]
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array([digest.hexdigest()[:16]])], names=[*keys, "digest"])

        for batch in batches:
            types = [c.type for c in batch.columns[:-1]]
            ids = batch.column(len(keys))
            change = np.zeros(len(batch), bool)
            for c in batch.columns[:-1]:
                codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy()
                change[1:] |= codes[1:] != codes[:-1]
            edges = [0, *np.flatnonzero(change).tolist(), len(batch)]
            for start, end in zip(edges, edges[1:]):
                if start == end:
                    continue
                key = tuple(c[start].as_py() for c in batch.columns[:-1])
                if key != current:
                    if current is not None:
                        yield done()
                    current, digest, empty = key, hashlib.sha256(), True
                some = ids.slice(start, end - start).drop_null().to_pylist()
                if some:
                    digest.update(("" if empty else "\n").encode() + "\n".join(some).encode())
                    empty = False
        if current is not None:
            yield done()

    return arranged.mapInArrow(run, T.StructType([*kinds.fields, T.StructField("digest", T.StringType())]))


def rounded_stats(df: DataFrame, by: Sequence[str], value: str, digits: int = 3) -> DataFrame:
    """Mean and linear p50/p90/p95/p99 of a measure, rounded."""
    levels = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    tails = ordering.quantiles(df.select(*by, value), by, value, levels)
    means = df.groupBy(*by).agg(F.avg(value).alias("mean"))
    joined = means.join(tails, list(by)) if by else one_row(means, tails)
    return joined.select(*by, *[F.round(c, digits).alias(c) for c in ["mean", *levels]])


def compare_models(
    df: DataFrame, model: str, label: str, score: str, thresholds: Mapping[str, float]
) -> DataFrame:
    """Precision, recall, F1, AUC and Brier per model at its own threshold, in one pass each."""
    cut = F.create_map(*[part for name, value in thresholds.items()
                         for part in (F.lit(name), F.lit(float(value)))])
    report = classification_report(
        df.withColumn("__cut", cut[F.col(model)]), label, score, F.col("__cut"), [model])
    return (
        report.select(model, "precision", "recall", "f1")
        .join(roc_auc(df, label, score, [model]), model)
        .join(probability_losses(df, label, score, [model]).select(model, "brier"), model))
