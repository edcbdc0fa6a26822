"""Per-group selection under a budget, and the metrics of a selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from . import ordering

COMMIT_STATS = (
    "tests_available", "tests_selected", "failures_available", "failures_detected",
    "duration_available", "duration_selected", "abstained", "escaped",
)


def budget_size(n: Column, budget: float, k_rule: str = "floor") -> Column:
    """How many of ``n`` items a budget share buys, never less than one."""
    if k_rule == "floor":
        size = F.floor(n * F.lit(float(budget)))
    elif k_rule == "round":
        size = F.bround(n * F.lit(float(budget)))
    else:
        raise ValueError(f"unknown k_rule {k_rule!r}; use 'floor' or 'round'")
    return F.greatest(size.cast("long"), F.lit(1).cast("long"))


def topk_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], budget: float,
    k_rule: str = "floor",
) -> DataFrame:
    """Flag the best-ranked budget share of every group (``selected``, ``rank``)."""
    sized = ordering.row_rank(df, keys, order, "rank", totals={"group_size": F.lit(1)})
    return sized.withColumn("selected", F.col("rank") <= budget_size(
        F.col("group_size"), budget, k_rule))


def strategy_commit_stats(
    df: DataFrame, commit: str, strategy: str, label: str, selected: str, duration: str,
    abstained: str,
) -> DataFrame:
    """The eight sufficient statistics per (commit, strategy)."""
    chosen, failed = F.col(selected).cast("boolean"), F.col(label) == 1
    seconds = F.coalesce(F.col(duration), F.lit(0.0))
    stats = df.groupBy(commit, strategy).agg(
        F.count(F.lit(1)).alias("tests_available"),
        F.count_if(chosen).alias("tests_selected"),
        F.count_if(failed).alias("failures_available"),
        F.count_if(failed & chosen).alias("failures_detected"),
        F.sum(seconds).alias("duration_available"),
        F.sum(F.when(chosen, seconds).otherwise(0.0)).alias("duration_selected"),
        F.max(F.col(abstained).cast("int")).alias("abstained"),
    )
    missed = F.col("failures_available") > F.col("failures_detected")
    return stats.withColumn("escaped", (missed & (F.col("abstained") == 0)).cast("int"))


def pooled_metrics(total=lambda name: F.sum(name), commits: Column | None = None) -> list[Column]:
    """The reported percentages as ratios of summed commit statistics."""
    commits = F.count(F.lit(1)) if commits is None else commits
    recall = ratio(total("failures_detected"), total("failures_available"), 100.0)
    return [
        (100.0 - ratio(total("tests_selected"), total("tests_available"), 100.0)).alias("trr"),
        (100.0 - ratio(total("duration_selected"), total("duration_available"), 100.0))
        .alias("etr"),
        recall.alias("fr"),
        (100.0 - recall).alias("mfr"),
        ratio(total("abstained"), commits, 100.0).alias("ar"),
        total("escaped").alias("escaped_commits"),
        commits.alias("n_commits"),
    ]


def fold_strategy_metrics(stats: DataFrame, *keys: str) -> DataFrame:
    """Pool commit statistics into the reported metrics; an empty denominator gives NULL."""
    return stats.groupBy(*keys).agg(*pooled_metrics())


def recall_at_budget(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], label: str, budget: float,
    k_rule: str = "round",
) -> DataFrame:
    """Pooled recall of the per-group top share; NULL when nothing failed."""
    flagged = topk_per_group(df, keys, order, budget, k_rule)
    failed = F.col(label) == 1
    per_group = flagged.groupBy(*keys).agg(
        F.count_if(failed).alias("f"), F.count_if(failed & F.col("selected")).alias("d"))
    return per_group.agg(
        ratio(F.sum("d"), F.sum("f")).alias("recall"),
        F.coalesce(F.sum("d"), F.lit(0)).alias("detected"),
        F.coalesce(F.sum("f"), F.lit(0)).alias("available"),
        F.count_if(F.col("f") > 0).alias("groups_with_failures"))


def apply_budget(
    df: DataFrame, keys: Sequence[str], selected: str, p: str, ties: Sequence[str],
    min_items: int = 0, max_items: int | None = None,
) -> DataFrame:
    """Per-group floor and cap on a selection.

    The floor adds the riskiest unselected items, the cap drops the least risky selected
    ones; ``capped`` says whether the cap dropped anything.
    """
    if max_items is not None and max_items < min_items:
        raise ValueError("max_items must not be below min_items")
    chosen = F.col(selected).cast("boolean")
    sized = ordering.row_rank(
        df, keys, [ordering.desc(chosen), ordering.desc(p), *[F.col(t) for t in ties]], "__rank",
        totals={"__size": F.lit(1), "__chosen": F.coalesce(chosen.cast("int"), F.lit(0))})
    wanted = F.greatest(F.col("__chosen"), F.least(F.lit(min_items), F.col("__size")))
    kept = wanted if max_items is None else F.least(wanted, F.lit(max_items))
    return sized.withColumns({
        "final_selected": F.col("__rank") <= kept, "capped": wanted > kept,
    }).drop("__rank", "__size", "__chosen")


def flag_top(
    df: DataFrame, k: int, score: str, ties: Sequence[str], name: str, descending: bool = True
) -> DataFrame:
    """Flag the global top ``k`` rows without sorting the table.

    Score counts locate the cut score; only the rows tied at the cut are ranked.  Rows without a
    score come last either way.
    """
    if k <= 0:
        return df.withColumn(name, F.lit(False))
    column = F.col(score)
    direction = ordering.desc(column) if descending else ordering.asc(column, nulls_last=True)
    counts = df.groupBy(score).agg(F.count(F.lit(1)).alias("__c"))
    placed = ordering.running(counts, [], [direction], sums={"__before": F.col("__c")})
    at = placed.filter((F.col("__before") < k) & (F.col("__before") + F.col("__c") >= k)).first()
    if at is None:
        return df.withColumn(name, F.lit(True))
    cut, wanted = F.lit(at[score]).cast(df.schema[score].dataType), k - at["__before"]
    beyond = column.isNotNull() if at[score] is None else F.coalesce(
        column > cut if descending else column < cut, F.lit(False))
    at_cut = column.eqNullSafe(cut)
    away = df.filter(~at_cut).withColumn(name, beyond)
    tied = ordering.row_rank(df.filter(at_cut), [], [F.col(t) for t in ties], "__rank")
    return away.unionByName(tied.withColumn(name, F.col("__rank") <= wanted).drop("__rank"))


def risk_coverage(
    df: DataFrame, label: str, p: str, uncertainty: str, ties: Sequence[str],
    levels: Sequence[float] = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5),
) -> DataFrame:
    """Mean absolute error and largest kept uncertainty of the most certain share of rows."""
    n = df.count()
    ranked = ordering.row_rank(
        df, [], [F.col(uncertainty), *[F.col(t) for t in ties]], "__rank")
    error = F.abs(F.col(label) - F.col(p))
    columns = []
    for i, level in enumerate(levels):
        kept = F.col("__rank") <= max(1, int(n * level))
        columns += [F.count_if(kept).alias(f"k{i}"), F.avg(F.when(kept, error)).alias(f"e{i}"),
                    F.max(F.when(kept, F.col(uncertainty))).alias(f"u{i}")]
    entries = F.array(*[
        F.struct(F.lit(float(level)).alias("coverage"), F.col(f"k{i}").alias("retained"),
                 F.col(f"e{i}").alias("mean_error"), F.col(f"u{i}").alias("max_uncertainty"))
        for i, level in enumerate(levels)])
    return ranked.agg(*columns).select(F.inline(entries))


def risk_coverage_sweep(
    df: DataFrame, label: str, p: str, uncertainty: str, taus: Sequence[float], theta: float
) -> DataFrame:
    """Coverage and missed-failure percentage of ``uncertainty <= tau and p >= theta``.

    One pass with a conditional aggregate per tau; rows are not multiplied by the grid.
    """
    failed = F.col(label) == 1
    columns = [F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("f")]
    for i, tau in enumerate(taus):
        kept = (F.col(uncertainty) <= F.lit(float(tau))) & (F.col(p) >= F.lit(float(theta)))
        columns += [F.count_if(kept).alias(f"k{i}"), F.count_if(failed & kept).alias(f"c{i}")]
    entries = F.array(*[
        F.struct(F.lit(float(tau)).alias("tau"),
                 ratio(F.col(f"k{i}"), F.col("n"), 100.0).alias("coverage_pct"),
                 ratio(F.col("f") - F.col(f"c{i}"), F.col("f"), 100.0).alias("missed_pct"))
        for i, tau in enumerate(taus)])
    return df.agg(*columns).select(F.inline(entries))


def page(df: DataFrame, order: Sequence[Column], skip: int, limit: int) -> DataFrame:
    """Offset and limit listing under a total order."""
    return df.orderBy(*ordering.sorted_by(order)).offset(skip).limit(limit)


def global_topk(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*ordering.sorted_by(order)).limit(k)


def top_features(importances: DataFrame, k: int = 20) -> DataFrame:
    """Highest positive importances."""
    positive = importances.filter(F.col("importance") > 0)
    return positive.orderBy(F.col("importance").desc(), F.col("feature")).limit(k)


def ranked_candidates(
    df: DataFrame, commit: str, item: str, confidence: str, uncertainty: str, selected: str
) -> DataFrame:
    """Candidates of each commit by confidence, with rounded scores."""
    ranked = ordering.row_rank(
        df, [commit], [ordering.desc(confidence), F.col(item)], "position")
    return ranked.select(
        commit, item, "position", F.round(confidence, 4).alias("confidence"),
        F.round(uncertainty, 4).alias("uncertainty"), F.col(selected).alias("selected"))


def best_candidate(results: DataFrame) -> DataFrame:
    """The configuration with the best composite key: ranking metrics first, then simplicity."""
    key = F.struct(
        "pr_auc", "roc_auc", (-F.col("brier")).alias("b"), (-F.col("trees")).alias("t"),
        (-F.col("depth")).alias("d"), (-F.col("leaves")).alias("l"), "config")
    best = results.agg(F.max_by(F.struct(*results.columns), key).alias("best"))
    return best.select("best.*")


def best_f1_threshold(
    df: DataFrame, label: str, score: str, grid: Sequence[float] | None = None
) -> DataFrame:
    """The grid threshold with the highest F1; empty predictions are skipped, first one wins.

    Threshold counts come from one pass; the grid never multiplies the rows.
    """
    grid = [0.1 + 0.05 * i for i in range(16)] if grid is None else list(grid)
    failed = F.col(label) == 1
    columns = [F.count_if(failed).alias("f")]
    for i, cut in enumerate(grid):
        hit = F.col(score) >= F.lit(float(cut))
        columns += [F.count_if(hit).alias(f"h{i}"), F.count_if(hit & failed).alias(f"t{i}")]
    entries = F.array(*[
        F.struct(F.lit(float(cut)).alias("threshold"), F.col(f"h{i}").alias("h"),
                 F.coalesce(ratio(2.0 * F.col(f"t{i}"), F.col(f"h{i}") + F.col("f")), F.lit(0.0))
                 .alias("f1"))
        for i, cut in enumerate(grid)])
    table = df.agg(*columns).select(F.inline(entries))
    usable = (F.col("h") > 0) & (F.col("f1") > 0)
    best = F.struct(F.col("f1"), (-F.col("threshold")).alias("t"))
    found = table.agg(
        F.max_by("threshold", F.when(usable, best)).alias("threshold"),
        F.max(F.when(usable, F.col("f1"))).alias("f1"))
    return found.select(F.coalesce("threshold", F.lit(0.5)).alias("threshold"),
                        F.coalesce("f1", F.lit(0.0)).alias("f1"))


def reference_baselines(
    test: DataFrame, val: DataFrame, label: str, p: str, ties: Sequence[str],
    conformal_rate: float, target_recall: float = 0.95,
) -> DataFrame:
    """Run-all, fixed 0.5, cost-matched top-k and validation-tuned threshold, side by side."""
    n = test.count()
    k = round(conformal_rate * n)  # half to even, like the size rule of the other side
    cut = ordering.quantiles(val.filter(F.col(label) == 1).select(p), [], p,
                             {"cut": 1.0 - target_recall}).first()
    flagged = flag_top(test, k, p, ties, "__top")
    masks = {
        "run_all": F.lit(True), "fixed_threshold_0.5": F.col(p) >= 0.5,
        "cost_matched_topk": F.col("__top"),
    }
    if cut is not None:
        masks["val_tuned_threshold"] = F.col(p) >= F.lit(cut["cut"])
    failed = F.col(label) == 1
    columns = [F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("f")]
    for i, mask in enumerate(masks.values()):
        columns += [F.count_if(mask).alias(f"s{i}"), F.count_if(mask & failed).alias(f"c{i}")]
    entries = []
    for i, name in enumerate(masks):
        tuned = name == "val_tuned_threshold"
        recall = ratio(F.col(f"c{i}"), F.col("f"))
        promised = F.lit(target_recall if tuned else None).cast("double")
        entries.append(F.struct(
            F.lit(name).alias("strategy"), recall.alias("recall"),
            ratio(F.col(f"s{i}"), F.col("n")).alias("selection_rate"),
            (1 - ratio(F.col(f"s{i}"), F.col("n"))).alias("cost_reduction"),
            F.coalesce(ratio(F.col(f"c{i}"), F.col(f"s{i}")), F.lit(0.0)).alias("precision"),
            (F.col("f") - F.col(f"c{i}")).alias("failures_missed"),
            F.lit(cut["cut"] if tuned else None).cast("double").alias("threshold"),
            promised.alias("promised_recall"), (promised - recall).alias("recall_shortfall")))
    return flagged.agg(*columns).select(F.inline(F.array(*entries)))


def acceptance_table(
    metrics: DataFrame, targets: Sequence[tuple[str, str, float | None, str]]
) -> DataFrame:
    """Target, measurement and verdict per metric; a missing value has no verdict.

    ``metrics`` is a one-row table; each target is (label, metric, target, "ge" or "le").
    """
    entries = []
    for label, name, target, direction in targets:
        known = name in metrics.columns
        measured = F.col(name).cast("double") if known else F.lit(None).cast("double")
        goal = F.lit(target).cast("double")
        passed = measured >= goal if direction == "ge" else measured <= goal
        entries.append(F.struct(
            F.lit(label).alias("metric"), goal.alias("target"), measured.alias("measured"),
            F.lit(direction).alias("direction"), passed.alias("passed")))
    table = metrics.limit(1).select(F.array(*entries).alias("rows"))
    everything = ~F.exists("rows", lambda row: ~F.coalesce(row["passed"], F.lit(True)))
    return table.select(everything.alias("all_passed"), F.inline("rows"))
