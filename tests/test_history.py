"""Causal history on a tiny frame with hand-worked values, and hot keys against plain windows."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from causeway.operators import history

COMMITS = [
    ("aaa1", datetime(2024, 1, 1, 9)), ("bbb2", datetime(2024, 1, 5, 14, 30)),
    ("ccc3", datetime(2024, 1, 9, 21, 15)), ("ddd4", datetime(2024, 1, 12, 11, 45)),
]
API, ENGINE = "tests/test_api.py::test_views_ok", "tests/test_engine.py::test_engine_runs"


@pytest.fixture(scope="module")
def tiny(spark):
    data, i = [], 0
    for n, (sha, ts) in enumerate(COMMITS):
        for test in (API, ENGINE):
            data.append((sha, ts, test, int(test == API and n >= 2), 1.5 + 0.1 * i))
            i += 1
    return spark.createDataFrame(data, "sha string, ts timestamp, test string, label int, secs double")


@pytest.fixture(scope="module")
def messy(spark):
    """Tied times and rows exactly seven days apart."""
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    data = [(i, rng.randrange(3), start + timedelta(days=rng.randrange(40), hours=rng.choice([0, 12])),
             rng.randrange(2), rng.random()) for i in range(400)]
    return spark.createDataFrame(data, "id int, test int, ts timestamp, label int, secs double")


def by_sha(df, test):
    return {r["sha"]: r for r in df.collect() if r["test"] == test}


def test_first_run_has_no_history(tiny):
    out = by_sha(history.causal_history(tiny, ["test"], "ts", ["sha"], "label", "secs"), API)
    first = out["aaa1"]
    assert (first.execution_count, first.failure_rate_lifetime, first.recent_failures) == (0, 0.0, 0)
    assert first.duration_mean is None and first.duration_std is None


def test_own_outcome_is_not_seen(tiny):
    out = by_sha(history.causal_history(tiny, ["test"], "ts", ["sha"], "label", "secs"), API)
    assert out["ccc3"].failure_rate_lifetime == 0.0
    assert out["ddd4"].failure_rate_lifetime == pytest.approx(1 / 3)
    assert out["ddd4"].runs_since_last_failure == 0
    assert out["ccc3"].runs_since_last_failure == 2
    assert out["ddd4"].duration_mean == pytest.approx((1.5 + 1.7 + 1.9) / 3)
    assert out["ddd4"].flakiness_score == pytest.approx(0.5)  # one flip in two defined steps
    assert out["ddd4"].failure_rate_7d == pytest.approx(0.5)  # bbb2 is exactly outside by time


def brute_trailing(rows, row, days):
    earlier = [r for r in rows if r.test == row.test and (r.ts, r.id) < (row.ts, row.id)
               and r.ts > row.ts - timedelta(days=days)]
    return sum(r.label for r in earlier) / len(earlier) if earlier else 0.0


def check_against_brute_force(messy):
    data = messy.collect()
    out = {r.id: r for r in history.causal_history(
        messy, ["test"], "ts", ["id"], "label", "secs").collect()}
    assert len(out) == len(data)
    for row in data:
        prior = sorted((r for r in data if r.test == row.test and (r.ts, r.id) < (row.ts, row.id)),
                       key=lambda r: (r.ts, r.id))
        got = out[row.id]
        assert got.execution_count == len(prior)
        assert got.recent_failures == sum(r.label for r in prior[-10:])
        assert got.failure_rate_7d == pytest.approx(brute_trailing(data, row, 7))
        assert got.failure_rate_28d == pytest.approx(brute_trailing(data, row, 28))
        since = 0
        for r in prior:
            since = 0 if r.label else since + 1
        assert got.runs_since_last_failure == since
        flips = [abs(a.label - b.label) for a, b in zip(prior, prior[1:])]
        # The window looks at the last ten earlier positions; the first of all has no step.
        window = flips[-10:] if len(prior) > 10 else flips
        assert got.flakiness_score == pytest.approx(sum(window) / len(window) if window else 0.0)


def test_plain_windows_match_brute_force(messy):
    check_against_brute_force(messy)


def test_hot_keys_match_brute_force(messy, hot):
    check_against_brute_force(messy)


def test_asof_is_strict(spark):
    runs = spark.createDataFrame(
        [("t", 10, 0, 1, 2.0, 0), ("t", 20, 1, 0, 0.0, 1), ("t", 30, 2, 1, 4.0, 1)],
        "test string, at long, tie int, failed int, secs double, retries int")
    pairs = spark.createDataFrame([("t", 5, "a"), ("t", 20, "b"), ("t", 31, "c")],
                                  "test string, at long, commit string")
    out = {r.commit: r for r in history.history_asof(
        pairs, runs, ["test"], "at", ["commit"], ["tie"], "failed", "secs", "retries",
        recent=2).collect()}
    assert out["a"].hist_total_prior_runs == 0 and out["a"].hist_avg_duration == 0.05
    assert out["b"].hist_total_prior_runs == 1  # the run at the same time is not earlier
    assert out["c"].hist_recent_failure_rate == pytest.approx(0.5)
    assert out["c"].hist_avg_duration == pytest.approx(3.0)
    assert out["c"].hist_flaky_score == pytest.approx(2 / 3)
