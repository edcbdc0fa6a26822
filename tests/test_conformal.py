from __future__ import annotations

import math
import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.operators import conformal


def test_known_ranks():
    assert conformal.pac_rank(4578, 0.05, 0.10) == 4369
    assert conformal.pac_rank(10, 0.05, 0.10) is None
    assert conformal.marginal_rank(100, 0.05) == 96
    assert conformal.marginal_rank(5, 0.05) == 5


def test_rank_is_the_smallest_that_certifies():
    for n in (30, 59, 200, 1000):
        k = conformal.pac_rank(n, 0.1, 0.1)
        assert conformal.beta_quantile(0.1, k, n + 1 - k) >= 0.9 - 1e-9
        assert conformal.beta_quantile(0.1, k - 1, n + 2 - k) < 0.9


@pytest.mark.parametrize("n,alpha", [(0, 0.1), (5, 0.0), (5, 1.0)])
def test_bad_arguments(n, alpha):
    with pytest.raises(ValueError):
        conformal.marginal_rank(n, alpha)


def test_no_positive_is_an_error(spark):
    df = spark.createDataFrame([(0, 0.5)], "y int, p double")
    with pytest.raises(ValueError):
        conformal.conformal_threshold(df, "y", "p")


def test_small_sets_fall_back_with_a_flag(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.9), (0, 0.1)], "y int, p double")
    rule = conformal.conformal_threshold(df, "y", "p").first()
    assert rule.pac_infeasible and rule.guarantee == "marginal"
    assert rule.probability_floor == pytest.approx(0.2)


def test_guarantee_holds_over_redraws(spark):
    # Synthetic calibrated scores, many independent calibration draws as groups of one job.
    rng = np.random.default_rng(5)
    draws = [(g, 1, float(p)) for g in range(60) for p in np.clip(rng.beta(2, 1, 150), 1e-6, 1 - 1e-6)]
    df = spark.createDataFrame(draws, "g int, y int, p double")
    floors = [r.probability_floor for r in conformal.conformal_threshold(
        df, "y", "p", ["g"], 0.9, 0.9).collect()]
    coverage = [1 - f ** 2 for f in floors]  # P(Beta(2, 1) >= f)
    assert np.mean([c >= 0.9 for c in coverage]) >= 0.8
    marginal = [r.probability_floor for r in conformal.conformal_threshold(
        df, "y", "p", ["g"], 0.9, 0.9, "marginal").collect()]
    assert np.mean(marginal) >= np.mean(floors)


def test_decision_codes(spark):
    requests = spark.createDataFrame(
        [(1, 0, 0, False, False, True), (2, 10, 10, False, False, True),
         (3, 10, 4, True, True, False), (4, 10, 4, False, False, True)],
        "id int, n_candidates int, n_selected int, degraded boolean, budget_capped boolean, "
        "guarantee_holds boolean")
    out = {r.id: r for r in conformal.request_decision(requests).collect()}
    assert out[1].reason_codes == ["EMPTY_CANDIDATE_SET"] and out[1].tests_to_run == 0
    assert out[2].reason_codes == ["SELECTION_EXCEEDS_FALLBACK_FRACTION"]
    assert out[3].reason_codes == ["DEGRADED_FEATURE_COMPLETENESS", "GUARANTEE_VOIDED_BY_BUDGET"]
    assert out[4].action == "RUN_SELECTED" and out[4].tests_to_run == 4


def test_completeness_counts_missing_columns(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", None, None), ("b", None, None)],
                               "r string, x int, y int")
    out = {r.r: r for r in conformal.feature_completeness(df, "r", ["x", "y", "z", "w"], 0.2).collect()}
    assert out["a"].feature_completeness == 0.25 and not out["a"].degraded
    assert out["b"].degraded


def test_global_rule_is_applied(spark):
    df = spark.createDataFrame([(i, 1, i / 100) for i in range(1, 100)], "id int, y int, p double")
    rule = conformal.conformal_threshold(df, "y", "p", guarantee="marginal")
    kept = conformal.apply_conformal(df, rule, "p").filter(F.col("selected")).count()
    assert kept == conformal.marginal_rank(99, 1 - 0.95)


def test_ranks_are_stable_for_huge_samples():
    """Against the binomial sum for small n, and its skew-corrected normal quantile for large n."""
    from fractions import Fraction

    for n in (30, 45, 46, 100, 333):
        tail, best = Fraction(0), None
        for k in range(n, 0, -1):
            tail += math.comb(n, k) * Fraction(19, 20) ** k * Fraction(1, 20) ** (n - k)
            if tail > Fraction(1, 10):
                break
            best = k
        assert conformal.pac_rank(n, 0.05, 0.10) == best
    z = 1.2815515655446004
    for n in (10 ** 9, 10 ** 11, 10 ** 12, 10 ** 14):
        near = 0.95 * n + 0.5 + z * math.sqrt(n * 0.95 * 0.05) - (z * z - 1) * 0.9 / 6
        assert abs(conformal.pac_rank(n, 0.05, 0.10) - near) <= 1.5
    assert conformal.pac_rank(10 ** 12, 0.05, 0.10) == 950_000_279_309
