"""Conformal selection: ranks, thresholds, application and the request decision."""

from __future__ import annotations

import math
from functools import reduce
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from . import ordering


def marginal_rank(n: int, alpha: float) -> int:
    """Order statistic for marginal coverage ``1 - alpha``, clipped to ``n``."""
    if n <= 0 or not 0.0 < alpha < 1.0:
        raise ValueError("need n > 0 and 0 < alpha < 1")
    return min(math.ceil((n + 1) * (1.0 - alpha)), n)


def _stirling_rest(n: float) -> float:
    """log n! less Stirling's formula, by its series; small n by the function itself."""
    if n < 16.0:
        return math.lgamma(n + 1.0) - ((n + 0.5) * math.log(n) - n + 0.5 * math.log(2.0 * math.pi)) if n else 0.0
    q = n * n
    return (1.0 / 12.0 - (1.0 / 360.0 - (1.0 / 1260.0 - (1.0 / 1680.0 - 1.0 / (1188.0 * q)) / q) / q) / q) / n


def _deviance(k: float, mean: float) -> float:
    """k log(k / mean) + mean - k without cancellation near k = mean."""
    gap = k - mean
    if abs(gap) < 0.1 * (k + mean):
        v = gap / (k + mean)
        total, term, j = gap * v, 2.0 * k * v, 1
        while True:
            term *= v * v
            more = total + term / (2 * j + 1)
            if more == total:
                return more
            total, j = more, j + 1
    return k * math.log(k / mean) + mean - k


def _front(x: float, a: float, b: float) -> float:
    """x^a (1 - x)^b / (a B(a, b)), from the binomial probability in saddle-point form.

    Differences of log-gammas lose one digit for every digit of a + b; deviances of a and b from
    their means do not.
    """
    n = a + b
    log_p = (_stirling_rest(n) - _stirling_rest(a) - _stirling_rest(b)
             - _deviance(a, n * x) - _deviance(b, n * (1.0 - x)))
    return math.exp(log_p) * math.sqrt(n / (2.0 * math.pi * a * b)) * b / n


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_cdf(1.0 - x, b, a)
    front = _front(x, a, b)
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    # The terms turn after about the root of the parameters; ten times that is far beyond it.
    for m in range(1, 10_000 + int(10 * math.sqrt(a + b))):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0)),
        ):
            d = 1.0 + numerator * d
            c = 1.0 + numerator / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return front * value
    raise ArithmeticError(f"the incomplete beta function did not converge for {x}, {a}, {b}")


def beta_quantile(level: float, a: float, b: float) -> float:
    """Inverse of ``beta_cdf`` by bisection."""
    low, high = 0.0, 1.0
    for _ in range(200):
        middle = (low + high) / 2
        if beta_cdf(middle, a, b) < level:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def pac_rank(n: int, alpha: float, delta: float) -> int | None:
    """Smallest rank covering ``1 - alpha`` with confidence ``1 - delta``; None if there is none.

    The beta quantile at ``delta`` reaches ``1 - alpha`` exactly when the beta CDF at
    ``1 - alpha`` is at most ``delta``, and that falls as the rank grows.
    """
    if n <= 0 or not 0.0 < alpha < 1.0 or not 0.0 < delta < 1.0:
        raise ValueError("need n > 0 and alpha, delta in (0, 1)")
    low, high, best = 1, n, None
    while low <= high:
        k = (low + high) // 2
        if beta_cdf(1.0 - alpha, k, n + 1 - k) <= delta:
            best, high = k, k - 1
        else:
            low = k + 1
    return best


def conformal_ranks(
    sizes: DataFrame, n: str = "n", coverage: float = 0.95, confidence: float = 0.90
) -> DataFrame:
    """Marginal and PAC rank, and certified coverage, for every calibration size.

    The ranks depend on the size alone, so they are computed once per distinct size.
    """
    alpha, delta = 1.0 - coverage, 1.0 - confidence

    @F.pandas_udf("struct<marginal_rank: bigint, pac_rank: bigint, certified_coverage: double>")
    def ranks(counts: pd.Series) -> pd.DataFrame:
        rows = []
        for count in counts:
            pac = pac_rank(int(count), alpha, delta)
            certified = None if pac is None else beta_quantile(delta, pac, count + 1 - pac)
            rows.append((marginal_rank(int(count), alpha), pac, certified))
        frame = pd.DataFrame(rows, columns=["marginal_rank", "pac_rank", "certified_coverage"])
        return frame.astype({"marginal_rank": "Int64", "pac_rank": "Int64"})

    distinct = sizes.select(n).distinct().withColumn("__r", ranks(n))
    table = distinct.select(F.col(n).alias("__n"), "__r.*")
    return sizes.join(table, F.col(n) == F.col("__n")).drop("__n")


def conformal_threshold(
    df: DataFrame, label: str, p: str, by: Sequence[str] = (), coverage: float = 0.95,
    confidence: float = 0.90, guarantee: str = "pac", mondrian: bool = True,
) -> DataFrame:
    """Fit the selection rule per group: the k-th smallest nonconformity score.

    Both guarantees are reported; an unattainable PAC rank falls back to the marginal rule
    and is flagged.  Score counts stand in for the sorted scores, so neither a hot group nor a
    hot score is gathered anywhere.
    """
    if guarantee not in ("pac", "marginal"):
        raise ValueError(f"unknown guarantee {guarantee!r}")
    rows = df.filter(F.col(label) == 1) if mondrian else df
    scores = rows.select(*by, (1 - F.col(p)).alias("__s"))
    sizes = scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min("__s").alias("score_min"),
        F.max("__s").alias("score_max")).filter("n > 0")
    if sizes.isEmpty():
        raise ValueError("the calibration rows hold no positive to take a quantile over")
    if by:
        fitted = sizes.select(*[F.col(k).alias(f"__f_{k}") for k in by])
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__f_{k}")) for k in by])
        lacking = df.select(*by).distinct().join(fitted, same, "left_anti").head(1)
        if lacking:
            raise ValueError(f"group {tuple(lacking[0])} holds no positive to take a quantile over")
    ranked = conformal_ranks(sizes, "n", coverage, confidence)
    counts = scores.groupBy(*by, "__s").agg(F.count(F.lit(1)).alias("__c"))
    placed = ordering.running(counts, by, [F.col("__s")], sums={"__below": F.col("__c")})
    if by:
        renamed = ranked.withColumnsRenamed({k: f"__r_{k}" for k in by})
        condition = F.lit(True)
        for k in by:
            condition = condition & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        joined = placed.join(renamed, condition).drop(*[f"__r_{k}" for k in by])
    else:
        joined = placed.join(F.broadcast(ranked))  # one row

    def score_at(rank: str):
        holds = (F.col("__below") < F.col(rank)) & (
            F.col(rank) <= F.col("__below") + F.col("__c"))
        return F.max(F.when(holds, F.col("__s")))

    folded = joined.groupBy(
        *by, "n", "marginal_rank", "pac_rank", "certified_coverage", "score_min", "score_max"
    ).agg(score_at("marginal_rank").alias("marginal_threshold"),
          score_at("pac_rank").alias("pac_threshold"))
    certified = (F.lit(guarantee == "pac")) & F.col("pac_rank").isNotNull()
    threshold = F.when(certified, F.col("pac_threshold")).otherwise(F.col("marginal_threshold"))
    return folded.withColumns({
        "guarantee": F.when(certified, F.lit("pac")).otherwise(F.lit("marginal")),
        "pac_infeasible": F.lit(guarantee == "pac") & F.col("pac_rank").isNull(),
        "threshold": threshold, "probability_floor": 1 - threshold,
    })


def apply_conformal(df: DataFrame, rule: DataFrame, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Selection mask (``1 - p <= threshold``), margin and the guarantee behind it.

    A row whose group has no rule is an error when the result is read.
    """
    terms = rule.select(*by, "threshold", "probability_floor", "guarantee")
    if by:
        renamed = terms.withColumnsRenamed({k: f"__r_{k}" for k in by})
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in by])
        joined = df.join(renamed, same, "left").drop(*[f"__r_{k}" for k in by]).withColumn(
            "threshold", F.when(F.col("guarantee").isNotNull(), F.col("threshold")).otherwise(
                F.raise_error(F.lit("a row belongs to a group without a fitted rule"))))
    else:
        fitted = terms.first()
        joined = df.withColumns({name: F.lit(fitted[name]) for name in terms.columns})
    return joined.withColumns({
        "selected": (1 - F.col(p)) <= F.col("threshold"),
        "margin": F.col(p) - F.col("probability_floor"),
    })


def feature_completeness(
    df: DataFrame, request: str, modelled: Sequence[str], minimum: float
) -> DataFrame:
    """Share of modelled columns that any record of a request supplies."""
    present = [c for c in modelled if c in df.columns]
    supplied = df.groupBy(request).agg(
        *[F.max(F.col(c).isNotNull().cast("int")).alias(f"__has_{c}") for c in present])
    share = sum((F.col(f"__has_{c}") for c in present), F.lit(0)) / max(len(modelled), 1)
    return supplied.select(request, share.alias("feature_completeness"),
                           (share < minimum).alias("degraded"))


# The closed set of decision reason codes.
EMPTY_CANDIDATE_SET = "EMPTY_CANDIDATE_SET"
DEGRADED_FEATURE_COMPLETENESS = "DEGRADED_FEATURE_COMPLETENESS"
GUARANTEE_VOIDED_BY_BUDGET = "GUARANTEE_VOIDED_BY_BUDGET"
SELECTION_EXCEEDS_FALLBACK_FRACTION = "SELECTION_EXCEEDS_FALLBACK_FRACTION"
WITHIN_GUARANTEE = "WITHIN_GUARANTEE"


def request_decision(
    requests: DataFrame, abstain_on_degraded: bool = True,
    abstain_on_voided_guarantee: bool = True, fallback_rate: float = 0.90,
) -> DataFrame:
    """Run the selection or the full suite, with closed reason codes.

    ``requests`` has n_candidates, n_selected, degraded, budget_capped, guarantee_holds.
    """
    rate = ratio(F.col("n_selected"), F.col("n_candidates"))
    reasons = F.array_compact(F.array(
        F.when(F.col("n_candidates") <= 0, F.lit(EMPTY_CANDIDATE_SET)),
        F.when(F.col("degraded") & F.lit(abstain_on_degraded),
               F.lit(DEGRADED_FEATURE_COMPLETENESS)),
        F.when(F.col("budget_capped") & ~F.col("guarantee_holds")
               & F.lit(abstain_on_voided_guarantee), F.lit(GUARANTEE_VOIDED_BY_BUDGET)),
        F.when(rate >= fallback_rate, F.lit(SELECTION_EXCEEDS_FALLBACK_FRACTION)),
    ))
    judged = requests.withColumn("reason_codes", reasons)
    abstain = F.size("reason_codes") > 0
    return judged.withColumns({
        "safe_fallback": abstain,
        "action": F.when(abstain, F.lit("RUN_FULL_SUITE")).otherwise(F.lit("RUN_SELECTED")),
        "tests_to_run": F.when(abstain, F.col("n_candidates")).otherwise(F.col("n_selected")),
        "selection_rate": F.coalesce(rate, F.lit(0.0)),
        "reason_codes": F.when(abstain, F.col("reason_codes")).otherwise(
            F.array(F.lit(WITHIN_GUARANTEE))),
    })
