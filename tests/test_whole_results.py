"""No row is lost and no size changes a result: cases that once were."""

from __future__ import annotations

import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.operators import conformal, history, metrics, selection
from causeway.sources import parsers
from causeway.streaming.drift import PageHinkley


def test_deviation_of_large_durations_on_both_paths(spark, request):
    values = [1e9 + 0.001 * i for i in (0, 1, 3, 2)]
    runs = spark.createDataFrame([(1, i, i, v) for i, v in enumerate(values)],
                                 "k long, ts long, tie long, d double")

    def deviations():
        found = history.prior_duration_stats(runs, ["k"], "ts", ["tie"], "d").orderBy("ts").collect()
        return [r.duration_std for r in found], [r.duration_mean for r in found]

    plain = deviations()
    request.getfixturevalue("hot")
    split = deviations()
    for found, means in (plain, split):
        assert found[:2] == [None, None] and means[0] is None
        for i in (2, 3):
            assert found[i] == pytest.approx(statistics.stdev(values[:i]), rel=1e-3)
            assert means[i] == pytest.approx(statistics.fmean(values[:i]), abs=1e-6)


def test_rows_equal_in_key_time_and_tie_stay(spark, hot):
    rows = spark.createDataFrame(
        [(1, "2024-01-01", 1, 1), (1, "2024-01-02", 2, 0), (1, "2024-01-02", 2, 0)],
        "k long, ts string, tie long, y int").withColumn("ts", F.to_timestamp("ts"))
    found = history.trailing_rate(rows, ["k"], "ts", ["tie"], "y", (7,)).collect()
    assert len(found) == 3


def test_rows_without_a_score_rank_last(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.9), (4, None)], "id long, s double")
    for k, wanted in ((1, {3}), (2, {3, 1}), (3, {3, 1, 2}), (9, {1, 2, 3, 4})):
        found = selection.flag_top(rows, k, "s", ["id"], "top").collect()
        assert len(found) == 4 and {r.id for r in found if r.top} == wanted
    low = selection.flag_top(rows, 1, "s", ["id"], "top", descending=False).collect()
    assert {r.id for r in low if r.top} == {1}


def test_a_group_without_positives_is_an_error(spark):
    rows = spark.createDataFrame([("a", 1, 0.9), ("a", 1, 0.8), ("b", 0, 0.1)], "g string, y int, p double")
    with pytest.raises(ValueError, match="holds no positive"):
        conformal.conformal_threshold(rows, "y", "p", ["g"])
    rule = conformal.conformal_threshold(rows.filter("g = 'a'"), "y", "p", ["g"])
    with pytest.raises(Exception, match="without a fitted rule"):
        conformal.apply_conformal(rows, rule, "p", ["g"]).collect()


def test_quality_report_keeps_finished_repositories(spark):
    commits = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "repo string, sha string")
    files = spark.createDataFrame([("1", 2, 3)], "sha string, lines_added long, lines_deleted long")
    done = spark.createDataFrame([("3",), ("2",)], "sha string")
    found = metrics.collection_quality(commits, files, "repo", "sha", done)
    assert sorted(map(tuple, found.collect())) == [("a", 1, 5, 1, 2), ("b", 0, 0, 0, 1)]


def test_cases_of_suites_at_any_depth(spark):
    nested = "<testcase classname='p.T' name='deep'/>"
    for _ in range(7):
        nested = f"<testsuite><testcase classname='p.T' name='side'><failure/></testcase>{nested}</testsuite>"
    reports = spark.createDataFrame(
        [(1, f"<testsuites>{nested}</testsuites>"), (2, "<broken"), (3, None)], "id long, xml string")
    found = parsers.ingest_junit_executed(reports, "xml").collect()
    assert [r.id for r in found] == [1] * 8
    assert sum(r.label_failed for r in found) == 7 and "p.py::T::deep" in {r.test_id for r in found}


def test_imports_in_every_form(spark):
    code = ('"""\nimport docstring\n"""\nfrom pkg.mod import (a,\n    b as c)\nfrom q import x, \\\n    y\n'
            "import os; import sys\nfrom . import near\n")
    files = spark.createDataFrame([("f", code), ("bad", "def ("), ("none", None)], "path string, text string")
    found = {r.module for r in parsers.imported_modules(files, "path", "text").collect()}
    assert found == {"pkg.mod", "pkg.mod.a", "pkg.mod.b", "q", "q.x", "q.y", "os", "sys", "near"}


def test_texts_too_hard_to_parse_give_neutral_rows(spark):
    hard = ["x = " + "-" * 60_000 + "1", "x = " + "1+" * 60_000 + "1", "\0"]
    files = spark.createDataFrame([(f"test_{i}.py", t) for i, t in enumerate(hard)], "path string, text string")
    found = parsers.source_file_metrics(files, "path", "text").collect()
    assert [tuple(r)[1:] for r in found] == [(0, 0, 0, 1.0, 0)] * 3
    assert parsers.discover_units(files, "path", "text").count() == 0


def test_units_are_top_level_functions_and_methods_of_test_classes():
    code = ("def test_a():\n    def test_inner():\n        pass\nclass TestX:\n    def test_m(self):\n        pass\n"
            "    class TestY:\n        def test_n(self):\n            pass\nclass Other:\n    def test_o(self):\n        pass\n")
    assert [u[0] for u in parsers._outline("f", code).units] == ["f::test_a", "f::TestX::test_m"]


def test_last_value_of_a_key_wins(spark):
    rows = spark.createDataFrame([("a=1\nb=2\n# c=3\na=4",)], "t string")
    assert parsers.parse_key_values(rows, "t").first().fields == {"a": "4", "b": "2"}


@pytest.mark.parametrize("threshold", [0.3, 2.0, 50.0])
def test_detector_blocks_equal_the_recurrence(threshold):
    rng = np.random.default_rng(7)
    errors = rng.random(5000) * (1 + (np.arange(5000) // 700) % 2)
    delta, alpha = 0.005, 0.99
    wanted, mean, total, low, seen = [], 0.0, 0.0, 0.0, 0
    for e in errors:
        mean = e if seen == 0 else alpha * mean + (1 - alpha) * e
        seen, total = seen + 1, total + e - mean - delta
        low = min(low, total)
        wanted.append((total - low, total - low > threshold))
        if wanted[-1][1]:
            total = low = 0.0
            seen = 0
    detector = PageHinkley(delta, threshold, alpha)
    parts = []
    for piece in np.split(errors, [1, 10, 1500, 1501, 4000]):
        statistic, alarm, detector = detector.follow(piece)
        parts += zip(statistic, alarm)
    assert [a for _, a in parts] == [a for _, a in wanted]
    assert np.allclose([s for s, _ in parts], [s for s, _ in wanted], atol=1e-9)
