"""Selection strategies and the registry for user-defined ones.

A strategy is a function ``DataFrame -> DataFrame`` that keeps every row and adds the boolean
columns ``selected`` and ``abstained``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import joins, ordering, policy, selection

Strategy = Callable[[DataFrame], DataFrame]
_REGISTRY: dict[str, Strategy] = {}


def register_strategy(name: str, fn: Strategy) -> None:
    """Make ``fn`` available to ``run_strategies`` under ``name``."""
    _REGISTRY[name] = fn


def registered(name: str) -> Strategy:
    if name not in _REGISTRY:
        raise KeyError(f"unknown strategy {name!r}; registered: {sorted(_REGISTRY)}")
    return _REGISTRY[name]


def _never_abstain(df: DataFrame) -> DataFrame:
    return df.withColumn("abstained", F.lit(False))


def _top_share(
    df: DataFrame, commit: str, order: Sequence[Column], budget: float
) -> DataFrame:
    ranked = selection.topk_per_group(df, [commit], order, budget, "floor")
    return _never_abstain(ranked.drop("rank", "group_size"))


def full(df: DataFrame) -> DataFrame:
    """Every test."""
    return _never_abstain(df.withColumn("selected", F.lit(True)))


def random_share(
    df: DataFrame, commit: str, identity: Sequence[str], budget: float, seed: int = 42
) -> DataFrame:
    """A uniform share per commit, replayable: the draw is a digest of seed and row identity."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(commit).cast("string"),
                             *[F.col(c).cast("string") for c in identity]))
    drawn = df.withColumn("__draw", draw)
    order = [F.col("__draw"), *[F.col(c) for c in identity]]
    return _top_share(drawn, commit, order, budget).drop("__draw")


def changed_stem(path: Column) -> Column:
    """Bare lowercase module name of a changed file."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.lower(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def name_correspondence(
    tests: DataFrame, changed: DataFrame, commit: str, test_path: str, changed_path: str
) -> DataFrame:
    """Tests whose path contains the stem of a file that their commit changed.

    A stem equal to the test's own is contained in its path as well.
    """
    stems = changed.select(commit, changed_stem(F.col(changed_path)).alias("__stem")).filter(
        "length(__stem) > 0")
    paths = tests.select(commit, test_path, F.lower(F.col(test_path)).alias("__low")).distinct()
    found = joins.containments(stems, paths, [commit], "__stem", "__low").select(commit, "__low").distinct()
    matches = paths.join(found, [commit, "__low"], "left_semi").select(
        commit, test_path).withColumn("matched", F.lit(True))
    joined = tests.join(matches, [commit, test_path], "left")
    return joined.withColumn("matched", F.coalesce("matched", F.lit(False)))


def changed_file(
    tests: DataFrame, changed: DataFrame, commit: str, test_path: str, changed_path: str,
    identity: Sequence[str] = (), budget: float | None = None,
) -> DataFrame:
    """File-level selection by name; a budget is opt-in and keeps the first matches."""
    matched = name_correspondence(tests, changed, commit, test_path, changed_path)
    if budget is None:
        return _never_abstain(matched.withColumnRenamed("matched", "selected"))
    order = [ordering.desc("matched"), *[F.col(c) for c in identity]]
    share = _top_share(matched, commit, order, budget)
    return share.withColumn("selected", F.col("selected") & F.col("matched")).drop("matched")


def dependency(
    df: DataFrame, commit: str, depth: str, identity: Sequence[str], budget: float,
    unreachable: float = 10.0,
) -> DataFrame:
    """Reachable tests by ascending depth up to the budget, else the nearest ones."""
    share = _top_share(df, commit, [F.col(depth), *[F.col(c) for c in identity]], budget)
    reachable = F.col(depth) < unreachable
    known = ordering.with_totals(share, [commit], __any=F.max(reachable.cast("int")))
    return known.withColumn(
        "selected", F.col("selected") & (reachable | (F.col("__any") == 0))).drop("__any")


def history(
    df: DataFrame, commit: str, rate: str, failures: str, identity: Sequence[str], budget: float
) -> DataFrame:
    """Lifetime failure rate plus a tenth of the prior failures, highest first."""
    score = F.col(rate) + F.col(failures) * 0.1
    return _top_share(df, commit, [ordering.desc(score), *[F.col(c) for c in identity]], budget)


def scored(
    df: DataFrame, commit: str, score: str, identity: Sequence[str], budget: float
) -> DataFrame:
    """The top share by a model score; a missing score is an error, never a default."""
    share = _top_share(df, commit, [ordering.desc(score), *[F.col(c) for c in identity]], budget)
    return share.withColumn("selected", F.when(F.col(score).isNull(), F.raise_error(
        F.lit("a row carries no model score"))).otherwise(F.col("selected")))


def with_scorer(
    df: DataFrame, scorer: Callable[[DataFrame], DataFrame], commit: str,
    identity: Sequence[str], budget: float, score: str = "score",
) -> DataFrame:
    """Rank by a user scorer: a Spark ML transformer's ``transform`` or a pandas-UDF step."""
    return scored(scorer(df), commit, score, identity, budget)


def selective(
    df: DataFrame, commit: str, item: str, label: str, confidence: str, uncertainty: str,
    ties: Sequence[str], thresholds: policy.PolicyThresholds | None,
) -> DataFrame:
    """The selective policy with tuned thresholds; without them there is nothing to run."""
    if thresholds is None:
        raise ValueError("the selective strategy needs tuned thresholds")
    identity = [item, *ties]
    share = _top_share(
        df, commit, [ordering.desc(confidence), *[F.col(c) for c in identity]], thresholds.budget)
    stats = policy.commit_policy_stats(
        df, commit, item, label, confidence, uncertainty, ties, thresholds.budget)
    verdict = policy.selective_policy(stats, thresholds).select(
        commit, F.col("abstained").alias("__abstained"))
    joined = share.join(verdict, commit)
    return joined.withColumns({
        "selected": F.col("selected") | F.col("__abstained"),
        "abstained": F.col("__abstained"),
    }).drop("__abstained")


def run_strategies(
    df: DataFrame, strategies: dict[str, Strategy] | Sequence[str], commit: str, label: str,
    duration: str,
) -> DataFrame:
    """Commit statistics of several strategies over the same rows.

    Each strategy is reduced to one row per commit before the results are combined.
    """
    if not isinstance(strategies, dict):
        strategies = {name: registered(name) for name in strategies}
    combined = None
    for name, fn in strategies.items():
        chosen = fn(df).withColumn("strategy", F.lit(name))
        stats = selection.strategy_commit_stats(
            chosen, commit, "strategy", label, "selected", duration, "abstained")
        combined = stats if combined is None else combined.unionByName(stats)
    return combined


def safety_union(df: DataFrame, selected: str, direct: str) -> DataFrame:
    """Selected or directly dependent."""
    return df.withColumn(
        selected, F.col(selected).cast("boolean") | F.col(direct).cast("boolean"))
