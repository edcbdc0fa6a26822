"""Registered queries: metrics, aggregates and per-group selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, ordering, selection
from .catalog import Tables, query, r, sql

_RATIO = "CASE WHEN ({1}) > 0 THEN ({0}) / CAST(({1}) AS DOUBLE) END"


def ratio(top: str, bottom: str) -> str:
    return _RATIO.format(top, bottom)


def _band_rows(t: Tables):
    return t.scored.select("repo", "l_orderkey", "label")


_MANIFEST = f"""
    WITH g AS (SELECT repo, l_orderkey, count(*) AS n, sum(label) AS f FROM scored GROUP BY 1, 2),
    m AS (SELECT coalesce(CAST(repo AS STRING), 'ALL') AS repo, CAST(sum(n) AS BIGINT) AS n_rows,
          CAST(sum(f) AS BIGINT) AS n_failures, count(*) AS n_groups,
          count(*) FILTER (WHERE f > 0) AS n_detected,
          CAST(sum(CASE WHEN f > 0 THEN n ELSE 0 END) AS BIGINT) AS detected_rows
          FROM g GROUP BY ROLLUP (repo))"""


@query("outcome_manifest", "E4", sql(f"""{_MANIFEST}
    SELECT repo, n_rows, n_failures, n_groups, n_detected, n_groups - n_detected AS n_undetected,
           detected_rows, {r(ratio('n_failures', 'n_rows'))} AS failure_rate,
           {r(ratio('n_failures', 'detected_rows'))} AS detected_failure_rate FROM m""", "scored"))
def _(t: Tables):
    return metrics.outcome_manifest(_band_rows(t), "repo", ["l_orderkey"], "label")


@query("gate_rates", "B15", sql(f"""{_MANIFEST}
    SELECT repo, n_rows, {r(ratio('n_failures', 'n_rows'))} AS failure_rate,
           {r(ratio('n_failures', 'detected_rows'))} AS detected_failure_rate,
           CAST(n_failures / CAST(detected_rows AS DOUBLE) BETWEEN 0.4 AND 0.405 AS BIGINT)
               AS in_band, CAST(n_rows >= 12000 AS BIGINT) AS enough_rows FROM m""", "scored"))
def _(t: Tables):
    return metrics.gate_rates(_band_rows(t), "repo", ["l_orderkey"], "label", 0.4, 0.405, 12000)


def _masked(t: Tables):
    return t.scored.select("repo", "commit_sha", "label", (F.col("p") >= 0.6).alias("selected"))


@query("selection_metrics", "E5", sql(f"""
    SELECT repo, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS n_failures,
           count(*) FILTER (WHERE p >= 0.6) AS n_selected,
           CAST(sum(label) FILTER (WHERE p >= 0.6) AS BIGINT) AS failures_caught,
           CAST(sum(label) FILTER (WHERE p < 0.6) AS BIGINT) AS failures_missed,
           {r(ratio('sum(label) FILTER (WHERE p >= 0.6)', 'sum(label)'))} AS empirical_coverage,
           {r('avg(CASE WHEN p >= 0.6 THEN 1 ELSE 0 END)')} AS selection_rate,
           {r('1 - avg(CASE WHEN p >= 0.6 THEN 1 ELSE 0 END)')} AS cost_reduction,
           {r('avg(label) FILTER (WHERE p >= 0.6)')} AS precision
    FROM scored GROUP BY repo""", "scored"))
def _(t: Tables):
    return metrics.selection_metrics(_masked(t), "label", "selected", ["repo"])


@query("per_commit_metrics", "E6", sql(f"""
    WITH c AS (SELECT l_orderkey, count(*) AS n, sum(label) AS f,
               count(*) FILTER (WHERE p >= 0.6) AS s,
               count(*) FILTER (WHERE p >= 0.6 AND label = 1) AS c FROM scored GROUP BY 1)
    SELECT count(*) AS n_commits, count(*) FILTER (WHERE f > 0) AS n_failing_commits,
           count(*) FILTER (WHERE f > 0 AND c = f) AS commits_fully_caught,
           {r(ratio('count(*) FILTER (WHERE f > 0 AND c = f)', 'count(*) FILTER (WHERE f > 0)'))}
               AS commit_full_catch_rate,
           {r(ratio('count(*) FILTER (WHERE c > 0)', 'count(*) FILTER (WHERE f > 0)'))}
               AS commit_any_catch_rate,
           {r('avg(s)')} AS mean_selected_per_commit, {r('avg(n)')} AS mean_available_per_commit
    FROM c""", "scored"))
def _(t: Tables):
    rows = t.scored.select("l_orderkey", "label", (F.col("p") >= 0.6).alias("selected"))
    return metrics.per_commit_metrics(rows, "l_orderkey", "label", "selected")


_STATS = """
    WITH stats AS (SELECT l_orderkey AS commit_sha, repo AS strategy, count(*) AS tests_available,
        count(*) FILTER (WHERE p >= 0.6) AS tests_selected,
        CAST(sum(label) AS BIGINT) AS failures_available,
        count(*) FILTER (WHERE p >= 0.6 AND label = 1) AS failures_detected,
        sum(duration) AS duration_available,
        sum(CASE WHEN p >= 0.6 THEN duration ELSE 0 END) AS duration_selected,
        max(CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE 0 END) AS abstained
        FROM scored GROUP BY 1, 2)"""


def _stats(t: Tables):
    rows = t.scored.select(
        F.col("l_orderkey").alias("commit_sha"), F.col("repo").alias("strategy"), "label",
        (F.col("p") >= 0.6).alias("selected"), "duration",
        (F.col("l_orderkey") % 10 == 0).alias("abstained"))
    return selection.strategy_commit_stats(
        rows, "commit_sha", "strategy", "label", "selected", "duration", "abstained")


@query("strategy_commit_stats", "E7", sql(f"""{_STATS}
    SELECT commit_sha, strategy, tests_available, tests_selected, failures_available,
           failures_detected, {r('duration_available')} AS duration_available,
           {r('duration_selected')} AS duration_selected, CAST(abstained AS BIGINT) AS abstained,
           CAST(failures_available > failures_detected AND abstained = 0 AS BIGINT) AS escaped
    FROM stats""", "scored"))
def _(t: Tables):
    return _stats(t)


@query("fold_strategy_metrics", "E8", sql(f"""{_STATS}
    SELECT strategy, {r('100 - 100.0 * sum(tests_selected) / sum(tests_available)')} AS trr,
           {r('100 - 100.0 * sum(duration_selected) / sum(duration_available)')} AS etr,
           {r('100.0 * sum(failures_detected) / sum(failures_available)')} AS fr,
           {r('100 - 100.0 * sum(failures_detected) / sum(failures_available)')} AS mfr,
           {r('100.0 * sum(abstained) / count(*)')} AS ar,
           count(*) FILTER (WHERE failures_available > failures_detected AND abstained = 0)
               AS escaped_commits, count(*) AS n_commits
    FROM stats GROUP BY strategy""", "scored"))
def _(t: Tables):
    return selection.fold_strategy_metrics(_stats(t), "strategy")


@query("classification_report", "E9", sql(f"""
    WITH c AS (SELECT repo, count(*) FILTER (WHERE p >= 0.5 AND label = 1) AS tp,
        count(*) FILTER (WHERE p >= 0.5 AND label = 0) AS fp,
        count(*) FILTER (WHERE p < 0.5 AND label = 1) AS fn,
        count(*) FILTER (WHERE p < 0.5 AND label = 0) AS tn FROM scored GROUP BY repo)
    SELECT repo, tp, fp, fn, tn, {r('(tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE)')} AS accuracy,
           {r('tp / CAST(tp + fp AS DOUBLE)')} AS precision,
           {r('tp / CAST(tp + fn AS DOUBLE)')} AS recall,
           {r('2 * tp / CAST(2 * tp + fp + fn AS DOUBLE)')} AS f1,
           {r('(tp + fp) / CAST(tp + fp + fn + tn AS DOUBLE)')} AS positive_rate,
           {r('(tp + fn) / CAST(tp + fp + fn + tn AS DOUBLE)')} AS base_rate FROM c""", "scored"))
def _(t: Tables):
    return metrics.classification_report(t.scored, "label", "p", 0.5, ["repo"])


@query("probability_losses", "E10", sql(f"""
    WITH q AS (SELECT source, y, p, greatest(least(p, 1 - 1e-7), 1e-7) AS q FROM doc_labels)
    SELECT source, {r('''CASE WHEN min(y) < max(y)
               THEN avg(-(y * ln(q) + (1 - y) * ln(1 - q))) END''')} AS log_loss,
           {r('avg((y - p) * (y - p))')} AS brier FROM q GROUP BY source""", "doc_labels"))
def _(t: Tables):
    return metrics.probability_losses(t.doc_labels, "y", "p", ["source"])


def _auc(source: str, label: str, keys: str = "", null: str = "NULL") -> str:
    lead, part = (f"{keys}, ", f"PARTITION BY {keys}") if keys else ("", "")
    group = f"GROUP BY {keys}" if keys else ""
    return f"""
    WITH c AS (SELECT {lead}p, sum({label}) AS pos, sum(1 - {label}) AS neg FROM {source}
               GROUP BY {lead}p),
    w AS (SELECT *, coalesce(sum(neg) OVER ({part} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING
               AND 1 PRECEDING), 0) AS below FROM c)
    SELECT {lead}{r(f'''CASE WHEN sum(pos) > 0 AND sum(neg) > 0
           THEN sum(pos * (below + neg / CAST(2 AS DOUBLE)))
                / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) ELSE {null} END''')} AS roc_auc
    FROM w {group}"""


@query("roc_auc", "E11", sql(_auc("doc_labels", "y", "source"), "doc_labels"))
def _(t: Tables):
    return metrics.roc_auc(t.doc_labels, "y", "p", ["source"])


@query("roc_auc_global", "E11", sql(_auc("scored", "label", "", "0.5"), "scored"))
def _(t: Tables):
    return metrics.roc_auc(t.scored.select("label", "p"), "label", "p", undefined=0.5)


def _average_precision(source: str, label: str, keys: str = "") -> str:
    lead, part = (f"{keys}, ", f"PARTITION BY {keys}") if keys else ("", "")
    group = f"GROUP BY {keys}" if keys else ""
    return f"""
    WITH c AS (SELECT {lead}p, sum({label}) AS pos, count(*) AS n FROM {source} GROUP BY {lead}p),
    w AS (SELECT *, sum(pos) OVER ({part} ORDER BY p DESC) AS tp,
                 sum(n) OVER ({part} ORDER BY p DESC) AS seen FROM c)
    SELECT {lead}{r('''CASE WHEN sum(pos) > 0
           THEN sum(pos * CAST(tp AS DOUBLE) / seen) / sum(pos) END''')} AS pr_auc FROM w {group}"""


@query("average_precision", "E12",
       sql(_average_precision("doc_labels", "y", "source"), "doc_labels"))
def _(t: Tables):
    return metrics.average_precision(t.doc_labels, "y", "p", ["source"])


@query("average_precision_global", "E12", sql(_average_precision("scored", "label"), "scored"))
def _(t: Tables):
    return metrics.average_precision(t.scored.select("label", "p"), "label", "p")


def _bin_sql(column: str, n: int, mode: str) -> str:
    compare = ">=" if mode in ("left", "legacy_half_open") else ">"
    steps = " + ".join(f"CASE WHEN {column} {compare} {e:.17e} THEN 1 ELSE 0 END"
                       for e in metrics.bin_edges(n)[1:-1])
    if mode == "legacy_half_open":
        return f"CASE WHEN {column} >= 0 AND {column} < 1 THEN {steps} END"
    if mode == "open_low":
        return f"CASE WHEN {column} > 0 AND {column} <= 1 THEN {steps} END"
    return steps


def _ece(n: int, mode: str) -> str:
    return sql(f"""
    WITH b AS (SELECT source, {_bin_sql('p', n, mode)} AS bin, count(*) AS n,
                      abs(avg(p) - avg(y)) AS gap FROM doc_labels GROUP BY 1, 2)
    SELECT source, {r('coalesce(sum(n * gap) FILTER (WHERE bin IS NOT NULL), 0) / sum(n)')} AS ece,
           {r('coalesce(max(gap) FILTER (WHERE bin IS NOT NULL), 0)')} AS mce,
           CAST(sum(n) AS BIGINT) AS n_rows FROM b GROUP BY source""", "doc_labels")


def _register_calibration_modes() -> None:
    for mode, n in (("left", 15), ("right", 10), ("legacy_half_open", 10), ("open_low", 10)):
        query(f"calibration_error_{mode}", "E13", _ece(n, mode))(
            lambda t, mode=mode, n=n: metrics.calibration_error(
                t.doc_labels, "y", "p", n, mode, ["source"]))


_register_calibration_modes()


@query("reliability_table", "E14", sql(f"""
    WITH s AS (SELECT CASE WHEN test_id % 2 = 0 THEN 'test' ELSE 'val' END AS split, 'before' AS stage,
                      label, p FROM scored
               UNION ALL
               SELECT CASE WHEN test_id % 2 = 0 THEN 'test' ELSE 'val' END, 'after', label,
                      p * 0.5 FROM scored),
    b AS (SELECT split, stage, {_bin_sql('p', 15, 'left')} AS bin, count(*) AS n, avg(p) AS mp,
                 avg(label) AS o FROM s GROUP BY 1, 2, 3),
    grid AS (SELECT DISTINCT split, stage, bin FROM s, (SELECT unnest(range(0, 15)) AS bin) k)
    SELECT grid.split, grid.stage, grid.bin, coalesce(n, 0) AS count, {r('mp')} AS mean_predicted,
           {r('o')} AS observed, {r('abs(mp - o)')} AS gap
    FROM grid LEFT JOIN b ON grid.split = b.split AND grid.stage = b.stage AND grid.bin = b.bin""",
    "scored"))
def _(t: Tables):
    rows = t.scored.select(
        F.when(F.col("test_id") % 2 == 0, "test").otherwise("val").alias("split"), "label",
        F.inline(F.array(F.struct(F.lit("before").alias("stage"), F.col("p").alias("p")),
                         F.struct(F.lit("after").alias("stage"), (F.col("p") * 0.5).alias("p")))))
    return metrics.reliability_table(rows, "label", "p", ["split", "stage"])


@query("outcome_summary", "E15", sql("""
    SELECT count(*) AS total_commits, count(*) FILTER (WHERE ground_truth_complete = 1)
               AS verified_commits,
           count(*) FILTER (WHERE ground_truth_complete = 0) AS unverified_commits,
           CAST(sum(actual_failures) AS BIGINT) AS total_actual_failures,
           CAST(sum(detected_failures) FILTER (WHERE ground_truth_complete = 1) AS BIGINT)
               AS total_detected_failures,
           CAST(sum(missed_failures) AS BIGINT) AS total_missed_failures,
           round(sum(detected_failures) FILTER (WHERE ground_truth_complete = 1)
                 / CAST(sum(actual_failures) AS DOUBLE), 4) AS failure_recall,
           round(sum(missed_failures) / CAST(sum(actual_failures) AS DOUBLE), 4)
               AS missed_failure_rate,
           round(avg(1 - time_ratio), 4) AS average_time_reduction,
           round(greatest((sum(full_duration) - sum(selected_duration)
                 FILTER (WHERE ground_truth_complete = 1)) / 3600.0, 0), 2) AS total_hours_saved
    FROM outcomes""", "outcomes"))
def _(t: Tables):
    return metrics.outcome_summary(
        t.outcomes.withColumn("time_reduction_ratio", 1 - F.col("time_ratio")))


@query("telemetry_summary", "E16", sql("""
    SELECT c.*, d.*, o.* FROM
      (SELECT count(DISTINCT repo) AS total_repositories, count(*) AS total_commits FROM commits) c,
      (SELECT count(*) AS total_decisions, count(*) FILTER (WHERE abstained = 0) AS fast_decisions,
              count(*) FILTER (WHERE abstained = 1) AS abstentions,
              round(avg(estimated_saving), 2) AS average_test_reduction,
              round(avg(uncertainty), 4) AS average_uncertainty FROM decisions) d,
      (SELECT CAST(sum(detected_failures) AS BIGINT) AS total_failures_detected,
              CAST(sum(missed_failures) AS BIGINT) AS total_missed_failures,
              count(*) FILTER (WHERE ground_truth_complete = 1) AS verified_outcomes,
              count(*) FILTER (WHERE ground_truth_complete = 0) AS unverified_outcomes
       FROM outcomes) o""", "commits", "decisions", "outcomes"))
def _(t: Tables):
    return metrics.telemetry_summary(t.commits, t.decisions, t.outcomes)


_REASON = """CASE WHEN seen < 3 THEN 'not_collected_in_every_run'
         WHEN lo = 'PASSED' AND hi = 'PASSED' THEN NULL
         WHEN lo <> hi THEN concat('flaky:', flips)
         WHEN lo = 'SKIPPED' THEN 'skipped'
         ELSE concat('failing_on_clean_checkout:', lo) END"""


@query("stable_universe", "E17", sql(f"""
    WITH u AS (SELECT test_id, count(*) AS seen, min(status) AS lo, max(status) AS hi,
               sum(duration) AS secs, string_agg(status, '/' ORDER BY run) AS flips
               FROM repeat_runs WHERE run < 3 GROUP BY test_id)
    SELECT test_id, CAST({_REASON} IS NULL AS BIGINT) AS stable, {_REASON} AS reason,
           {r(f'CASE WHEN {_REASON} IS NULL THEN secs / 3 END')} AS mean_duration
    FROM u""", "repeat_runs"))
def _(t: Tables):
    return metrics.stable_universe(t.repeat_runs.filter("run < 3"), "test_id", "run", "status",
                                   "duration", 3)


@query("suite_flakiness", "E18", sql("""
    WITH u AS (SELECT test_id % 10 AS suite, test_id, count(*) AS seen, min(status) AS lo,
               max(status) AS hi, max(CASE WHEN run = 0 THEN status END) AS first
               FROM repeat_runs WHERE run < 3 GROUP BY 1, 2)
    SELECT suite, count(*) AS n_collected,
           count(*) FILTER (WHERE lo <> hi OR seen < 3) AS n_flaky,
           count(*) FILTER (WHERE first IN ('FAILED', 'ERROR')) AS n_failing,
           count(*) - count(*) FILTER (WHERE lo <> hi OR seen < 3)
               - count(*) FILTER (WHERE first IN ('FAILED', 'ERROR')) AS n_stable
    FROM u GROUP BY suite""", "repeat_runs"))
def _(t: Tables):
    runs = t.repeat_runs.filter("run < 3").withColumn("suite", F.col("test_id") % 10)
    return metrics.suite_flakiness(runs, "suite", "test_id", "run", "status", 3)


RECORDS = """SELECT o_orderkey AS record_id, o_orderpriority AS project,
        CASE o_orderstatus WHEN 'F' THEN 'harvested' WHEN 'O' THEN 'timed_out'
             ELSE 'broke_suite' END AS status,
        CASE WHEN o_orderstatus <> 'P' THEN n END AS universe_size,
        CASE WHEN o_orderstatus <> 'P' THEN k END AS n_killed
    FROM orders JOIN (SELECT l_orderkey, count(*) AS n,
        sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS k FROM lineitem GROUP BY 1) l
    ON o_orderkey = l_orderkey"""


@query("project_summary", "E19", f"""
    SELECT project, count(*) AS records, count(*) FILTER (WHERE status = 'harvested') AS harvested,
           round(avg(universe_size) FILTER (WHERE status = 'harvested'), 2) AS mean_universe_size,
           round(avg(n_killed) FILTER (WHERE status = 'harvested'), 2) AS mean_n_killed,
           CAST(count(*) FILTER (WHERE status = 'harvested') > 0 AS BIGINT) AS has_labels
    FROM ({RECORDS}) r GROUP BY project""")
def _(t: Tables):
    return metrics.project_summary(t.select(RECORDS, "orders", "lineitem"))


@query("status_counts", "E19",
       f"SELECT status, count(*) AS n FROM ({RECORDS}) r GROUP BY status")
def _(t: Tables):
    return metrics.status_counts(t.select(RECORDS, "orders", "lineitem"))


@query("metadata_survey", "E20", """
    WITH v AS (SELECT p_brand AS project, concat('3.', CAST(p_size % 4 AS STRING)) AS version,
                      count(*) AS n, count(*) FILTER (WHERE p_type <> 'PROMO') AS r
               FROM part GROUP BY 1, 2)
    SELECT project, CAST(sum(n) AS BIGINT) AS n_bugs, CAST(sum(r) AS BIGINT) AS n_readable,
           string_agg(concat(version, '=', CAST(n AS STRING)), '|' ORDER BY version) AS versions
    FROM v GROUP BY project""")
def _(t: Tables):
    specs = t.part.select(F.col("p_brand").alias("project"),
                          F.concat(F.lit("3."), (F.col("p_size") % 4).cast("string"))
                          .alias("version"), (F.col("p_type") != "PROMO").alias("readable"))
    out = metrics.metadata_survey(specs, "project", "version", "readable")
    shown = F.transform(F.map_entries("versions"),
                        lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return out.withColumn("versions", F.array_join(shown, "|"))


@query("class_weights", "E21", sql(f"""
    SELECT {r('count(*) / (2.0 * sum(1 - label_failed))')} AS w_neg,
           {r('count(*) / (2.0 * sum(label_failed))')} AS w_pos,
           {r('sum(1 - label_failed) / CAST(sum(label_failed) AS DOUBLE)')} AS scale_pos_weight
    FROM runs""", "runs"))
def _(t: Tables):
    return metrics.class_weights(t.runs, "label_failed")


@query("sample_weights", "E22", sql(f"""
    WITH w AS (SELECT count(*) / (2.0 * sum(1 - label_failed)) AS w0,
                      count(*) / (2.0 * sum(label_failed)) AS w1 FROM runs),
    f AS (SELECT event_id, label_failed, retry_count / CAST(10 AS DOUBLE) AS flaky FROM runs)
    SELECT event_id, {r('''CASE WHEN label_failed = 1 THEN w1 ELSE w0 END
               * CASE WHEN flaky > 0.1 THEN 0.5 ELSE 1 END''')} AS sample_weight,
           {r('greatest(least(1 - 0.7 * flaky, 1.0), 0.1)')} AS robust_weight
    FROM f, w""", "runs"))
def _(t: Tables):
    rows = t.runs.withColumn("flaky", F.col("retry_count") / F.lit(10.0))
    out = metrics.sample_weights(rows, "label_failed", "flaky")
    return out.select("event_id", "sample_weight", "robust_weight")


MEMBERS = " UNION ALL ".join(
    f"SELECT vec_id, {m} AS member, 1 / (1 + exp(-10 * CAST(element_at(embedding, {m}) AS DOUBLE)))"
    f" AS p, label FROM embeddings" for m in range(1, 6))


_ENTROPY_P = "greatest(least(avg(p), 1 - 1e-9), 1e-9)"
_MEMBERS_DUCK = MEMBERS.replace("element_at(embedding, ", "list_extract(embedding, ")


@query("ensemble_uncertainty", "E23", f"""
    WITH members AS ({_MEMBERS_DUCK})
    SELECT vec_id, {r('avg(p)')} AS mean_prob, {r('stddev_pop(p)')} AS epistemic_std,
           {r('var_pop(p)')} AS epistemic_variance, count(*) AS n_members,
           {r(f'-({_ENTROPY_P} * log2({_ENTROPY_P}) + (1 - {_ENTROPY_P}) * log2(1 - {_ENTROPY_P}))')}
               AS predictive_entropy
    FROM members GROUP BY vec_id""")
def _(t: Tables):
    return metrics.ensemble_uncertainty(t.select(MEMBERS, "embeddings"), ["vec_id"], "p")


@query("commit_uncertainty", "E24", sql(f"""
    SELECT commit_sha, {r('max(uncertainty)')} AS max_std, {r('avg(uncertainty)')} AS mean_std,
           {r('max(p)')} AS max_prob, {r('avg(p)')} AS mean_prob,
           {r('quantile_cont(uncertainty, 0.95)')} AS p95_std
    FROM scored GROUP BY commit_sha""", "scored"))
def _(t: Tables):
    return metrics.commit_uncertainty(t.scored, "commit_sha", "uncertainty", "p")


@query("uncertainty_report", "E25", f"""
    WITH members AS ({_MEMBERS_DUCK}),
    e AS (SELECT vec_id, max(CASE WHEN label < 3 THEN 1 ELSE 0 END) AS y, avg(p) AS mp,
                 stddev_pop(p) AS sd,
          -({_ENTROPY_P} * log2({_ENTROPY_P}) + (1 - {_ENTROPY_P}) * log2(1 - {_ENTROPY_P})) AS h
          FROM members GROUP BY vec_id)
    SELECT count(*) AS n_rows, {r('avg(sd)')} AS mean_uncertainty, {r('avg(h)')} AS mean_entropy,
           {r('corr(sd, abs(y - mp))')} AS error_correlation,
           {r('quantile_cont(sd, 0.95)')} AS p95_uncertainty FROM e""")
def _(t: Tables):
    members = t.select(MEMBERS, "embeddings").withColumn(
        "y", F.when(F.col("label") < 3, 1).otherwise(0))
    folded = metrics.ensemble_uncertainty(members, ["vec_id", "y"], "p")
    return metrics.uncertainty_report(folded, "y", "mean_prob", "epistemic_std",
                                      "predictive_entropy")


@query("time_decayed_rate", "E26", sql(f"""
    WITH u AS (SELECT unnest(range(0, 200)) AS test_id),
    x AS (SELECT *, exp(-0.05 * date_diff('day', CAST(ts AS DATE), DATE '2024-01-31')) AS w,
          lag(label_failed) OVER (PARTITION BY test_id ORDER BY ts, event_id) AS b FROM runs),
    a AS (SELECT test_id, sum(label_failed * w) / sum(w) AS d, avg(duration) AS m,
          CASE WHEN count(*) >= 3 THEN count(*) FILTER (WHERE label_failed <> b)
               / CAST(count(*) - 1 AS DOUBLE) ELSE 0 END AS f FROM x GROUP BY test_id),
    k AS (SELECT DISTINCT c_custkey AS test_id FROM customer)
    SELECT k.test_id, {r('coalesce(d, 0.05)')} AS decayed_rate, {r('coalesce(m, 1.0)')} AS mean_duration,
           {r('coalesce(f, 0)')} AS flip_share FROM k LEFT JOIN a ON k.test_id = a.test_id""",
    "runs"))
def _(t: Tables):
    age = F.datediff(F.lit("2024-01-31").cast("date"), F.col("ts").cast("date"))
    universe = t.customer.select(F.col("c_custkey").alias("test_id"))
    return metrics.time_decayed_rate(t.runs, "test_id", "ts", ["event_id"], "label_failed",
                                     "duration", age, universe=universe)


@query("macro_average", "E27", sql(f"""
    WITH g AS (SELECT commit_sha, avg(label) AS rate,
               {ratio('sum(CASE WHEN p > 0.96 THEN label END)', 'count(*) FILTER (WHERE p > 0.96 AND uncertainty > 0.07)')}
               AS recall FROM scored GROUP BY commit_sha)
    SELECT count(*) AS n_groups, {r('avg(rate)')} AS mean_rate, count(rate) AS defined_rate,
           {r('avg(recall)')} AS mean_recall, count(recall) AS defined_recall FROM g""", "scored"))
def _(t: Tables):
    top = F.count_if((F.col("p") > 0.96) & (F.col("uncertainty") > 0.07))
    caught = F.sum(F.when(F.col("p") > 0.96, F.col("label")))
    per = t.scored.groupBy("commit_sha").agg(
        F.avg("label").alias("rate"), F.when(top > 0, caught / top).alias("recall"))
    return metrics.macro_average(per, ["rate", "recall"])


DRIFT_RUNS = """SELECT c_custkey AS run_id, c_mktsegment AS repo,
        0.1 * (c_nationkey % 5 + 1) AS threshold, c_custkey % 2 AS is_shift,
        CAST(floor(abs(c_acctbal) / 2500) AS BIGINT) AS false_alarms,
        100 + c_nationkey AS streamed, CASE WHEN c_acctbal > 3000 THEN 1 ELSE 0 END AS detected,
        CAST(floor(c_acctbal) AS BIGINT) % 50 + 1 AS latency,
        c_custkey % 3 AS false_alarms_before_shift, abs(c_acctbal) / 10000 AS mean_error,
        CASE WHEN c_acctbal < 0 THEN 0 ELSE CAST(floor(c_acctbal) AS BIGINT) % 7 END AS adaptations
    FROM customer"""
# The threshold is compared as a number of tenths, so that grouping is on whole values.
DRIFT_RUNS = DRIFT_RUNS.replace("0.1 * (c_nationkey % 5 + 1)", "c_nationkey % 5 + 1")


@query("drift_threshold_summary", "E28", f"""
    WITH d AS ({DRIFT_RUNS})
    SELECT CAST(threshold AS BIGINT) AS threshold,
           CAST(sum(false_alarms) FILTER (WHERE is_shift = 0) AS BIGINT) AS false_alarms_total,
           CAST(sum(streamed) FILTER (WHERE is_shift = 0) AS BIGINT) AS stationary_streamed,
           count(*) FILTER (WHERE is_shift = 1 AND detected = 1) AS shifts_detected,
           count(*) FILTER (WHERE is_shift = 1) AS shifts_attempted,
           CAST(sum(false_alarms_before_shift) FILTER (WHERE is_shift = 1) AS BIGINT)
               AS pre_shift_alarms,
           {r('quantile_cont(latency, 0.5) FILTER (WHERE is_shift = 1 AND detected = 1)')}
               AS median_latency
    FROM d GROUP BY threshold""")
def _(t: Tables):
    runs = t.select(DRIFT_RUNS, "customer")
    return metrics.drift_threshold_summary(runs.filter("is_shift = 0"), runs.filter("is_shift = 1"))


@query("adaptation_effect", "E29", f"""
    WITH d AS ({DRIFT_RUNS}),
    o AS (SELECT repo, threshold, adaptations, run_id % 20 AS blk, avg(mean_error) AS mean_error
          FROM d GROUP BY 1, 2, 3, 4),
    q AS (SELECT concat(repo, '#', CAST(blk AS STRING)) AS repo, threshold, adaptations, mean_error
          FROM o),
    a AS (SELECT repo, arg_min(threshold, CASE WHEN adaptations = 0 THEN threshold END)
                 FILTER (WHERE adaptations = 0) AS qt,
          arg_min(mean_error, threshold) FILTER (WHERE adaptations = 0) AS qe,
          arg_max(threshold, adaptations * 10 - threshold) AS bt,
          arg_max(mean_error, adaptations * 10 - threshold) AS be,
          max(adaptations) AS ba FROM q GROUP BY repo)
    SELECT repo, CAST(qt IS NOT NULL AND ba > 0 AS BIGINT) AS comparable,
           CASE WHEN qt IS NOT NULL AND ba > 0 THEN CAST(qt AS BIGINT) END AS quiet_threshold,
           {r('CASE WHEN qt IS NOT NULL AND ba > 0 THEN qe END')} AS quiet_error,
           CASE WHEN qt IS NOT NULL AND ba > 0 THEN CAST(bt AS BIGINT) END AS busy_threshold,
           {r('CASE WHEN qt IS NOT NULL AND ba > 0 THEN be END')} AS busy_error,
           CASE WHEN qt IS NOT NULL AND ba > 0 THEN ba END AS busy_adaptations,
           {r('CASE WHEN qt IS NOT NULL AND ba > 0 THEN be - qe END')} AS error_delta FROM a""")
def _(t: Tables):
    runs = t.select(DRIFT_RUNS, "customer").withColumn("blk", F.col("run_id") % 20)
    runs = runs.groupBy("repo", "threshold", "adaptations", "blk").agg(
        F.avg("mean_error").alias("mean_error"))
    named = runs.withColumn("repo", F.concat_ws("#", "repo", F.col("blk").cast("string")))
    return metrics.adaptation_effect(named)


@query("batch_summary", "E30", f"""
    WITH x AS (SELECT c_nationkey AS batch, c_acctbal < 0 AS bad,
               CAST(floor(abs(c_acctbal)) AS BIGINT) % 100 AS n, c_custkey % 50 AS s FROM customer)
    SELECT CAST(batch AS BIGINT) AS batch, count(*) AS n_changes,
           count(*) FILTER (WHERE NOT bad) AS n_succeeded, count(*) FILTER (WHERE bad) AS n_failed,
           CAST(coalesce(sum(n) FILTER (WHERE NOT bad), 0) AS BIGINT) AS n_candidates,
           CAST(coalesce(sum(s) FILTER (WHERE NOT bad), 0) AS BIGINT) AS n_selected,
           {r('1 - sum(s) FILTER (WHERE NOT bad) / CAST(sum(n) FILTER (WHERE NOT bad) AS DOUBLE)')}
               AS cost_reduction
    FROM x GROUP BY batch""")
def _(t: Tables):
    results = t.customer.select(
        F.col("c_nationkey").alias("batch"),
        F.when(F.col("c_acctbal") < 0, F.lit("rejected")).alias("error"),
        (F.floor(F.abs("c_acctbal")) % 100).alias("n_candidates"),
        (F.col("c_custkey") % 50).alias("n_selected"))
    return metrics.batch_summary(results, "batch")


@query("suite_size", "E31", sql(f"""
    SELECT repo, count(*) AS n_commits, {r('quantile_cont(n, 0.5)')} AS median_suite_size
    FROM (SELECT repo, l_orderkey, count(*) AS n FROM scored GROUP BY 1, 2) g GROUP BY repo""",
    "scored"))
def _(t: Tables):
    return metrics.suite_size(t.scored, "repo", "l_orderkey")


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("describe_features", "E32", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, "
    f"{r(f'min({c})')} AS min, {r(f'max({c})')} AS max FROM lineitem" for c in _NUMBERS))
def _(t: Tables):
    return metrics.describe_features(t.lineitem.select(*_NUMBERS), _NUMBERS)


@query("collection_quality", "E33", sql("""
    WITH f AS (SELECT commit_sha, sum(lines_added + lines_deleted) AS churn, count(*) AS files
               FROM changed_files GROUP BY 1),
    c AS (SELECT *, message = 'F' OR repo LIKE '3%' AS done FROM commits)
    SELECT c.repo, count(*) FILTER (NOT done) AS commits_collected,
           CAST(coalesce(sum(churn) FILTER (NOT done), 0) AS BIGINT) AS total_line_churn,
           CAST(coalesce(sum(files) FILTER (NOT done), 0) AS BIGINT) AS total_file_modifications,
           count(*) AS total_checkpointed
    FROM c LEFT JOIN f ON c.sha = f.commit_sha GROUP BY c.repo""", "commits", "changed_files"))
def _(t: Tables):
    commits = t.commits.withColumnRenamed("sha", "commit_sha")
    done = commits.filter("message = 'F' OR repo LIKE '3%'").select("commit_sha")
    return metrics.collection_quality(commits, t.changed_files, "repo", "commit_sha", done)


@query("sample_digest", "E34", """
    SELECT p_brand AS family, substr(sha256(string_agg(p_name || ':' || CAST(p_partkey AS STRING), chr(10)
           ORDER BY p_name || ':' || CAST(p_partkey AS STRING))), 1, 16) AS digest
    FROM part GROUP BY p_brand""")
def _(t: Tables):
    rows = t.part.select(F.col("p_brand").alias("family"),
                         F.concat_ws(":", "p_name", F.col("p_partkey").cast("string")).alias("id"))
    return metrics.sample_digest(rows, ["family"], "id")


@query("rounded_stats", "L9", sql("""
    SELECT commit_sha, round(avg(duration), 3) AS mean, round(quantile_cont(duration, 0.5), 3) AS p50,
           round(quantile_cont(duration, 0.9), 3) AS p90,
           round(quantile_cont(duration, 0.95), 3) AS p95,
           round(quantile_cont(duration, 0.99), 3) AS p99 FROM scored GROUP BY commit_sha""",
    "scored"))
def _(t: Tables):
    return metrics.rounded_stats(t.scored, ["commit_sha"], "duration")


_SCORED_TIES = ["test_id", "l_orderkey", "l_linenumber"]
_SCORED_ORDER = "p DESC, test_id, l_orderkey, l_linenumber"


def _order():
    return [ordering.desc("p"), *[F.col(c) for c in _SCORED_TIES]]


def _topk_sql(size: str) -> str:
    return sql(f"""
    WITH k AS (SELECT *, row_number() OVER (PARTITION BY commit_sha ORDER BY {_SCORED_ORDER}) AS rk,
               count(*) OVER (PARTITION BY commit_sha) AS n FROM scored)
    SELECT commit_sha, test_id, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, rk AS rank
    FROM k WHERE rk <= greatest(1, {size})""", "scored")


@query("topk_per_group_floor", "F13", _topk_sql("CAST(floor(n * 0.25) AS BIGINT)"))
def _(t: Tables):
    out = selection.topk_per_group(t.scored, ["commit_sha"], _order(), 0.25, "floor")
    return out.filter("selected").select("commit_sha", *_SCORED_TIES, "rank")


@query("topk_per_group_round", "F13", _topk_sql("CAST(round_even(n * 0.25, 0) AS BIGINT)"))
def _(t: Tables):
    out = selection.topk_per_group(t.scored, ["commit_sha"], _order(), 0.25, "round")
    return out.filter("selected").select("commit_sha", *_SCORED_TIES, "rank")


@query("recall_at_budget", "F14", sql(f"""
    WITH k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_SCORED_ORDER}) AS rk,
               count(*) OVER (PARTITION BY l_orderkey) AS n FROM scored),
    g AS (SELECT l_orderkey, sum(label) AS f,
          sum(label) FILTER (WHERE rk <= greatest(1, CAST(round_even(n * 0.25, 0) AS BIGINT))) AS d
          FROM k GROUP BY 1)
    SELECT {r(ratio('sum(d)', 'sum(f)'))} AS recall, CAST(sum(d) AS BIGINT) AS detected,
           CAST(sum(f) AS BIGINT) AS available, count(*) FILTER (WHERE f > 0) AS groups_with_failures
    FROM g""", "scored"))
def _(t: Tables):
    return selection.recall_at_budget(t.scored, ["l_orderkey"], _order(), "label", 0.25)


@query("apply_budget", "F15", sql(f"""
    WITH k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey
                   ORDER BY p >= 0.7 DESC, {_SCORED_ORDER}) AS rk,
               count(*) OVER (PARTITION BY l_orderkey) AS n,
               count(*) FILTER (WHERE p >= 0.7) OVER (PARTITION BY l_orderkey) AS c FROM scored)
    SELECT l_orderkey, test_id, CAST(l_linenumber AS BIGINT) AS l_linenumber, commit_sha,
           CAST(rk <= least(greatest(c, least(2, n)), 3) AS BIGINT) AS final_selected,
           CAST(greatest(c, least(2, n)) > 3 AS BIGINT) AS capped FROM k""", "scored"))
def _(t: Tables):
    rows = t.scored.withColumn("selected", F.col("p") >= 0.7)
    out = selection.apply_budget(rows, ["l_orderkey"], "selected", "p", _SCORED_TIES, 2, 3)
    return out.select("l_orderkey", "test_id", "l_linenumber", "commit_sha", "final_selected",
                      "capped")


_LEVELS = [1.0, 0.9, 0.8, 0.7, 0.6, 0.5]


@query("risk_coverage", "F16", sql("""
    WITH k AS (SELECT *, row_number() OVER (ORDER BY uncertainty, commit_sha, test_id, l_orderkey,
                   l_linenumber) AS rk, count(*) OVER () AS n FROM scored)
    """ + " UNION ALL ".join(f"""
    SELECT CAST({level} AS DOUBLE) AS coverage, count(*) AS retained,
           {r('avg(abs(label - p))')} AS mean_error, {r('max(uncertainty)')} AS max_uncertainty
    FROM k WHERE rk <= greatest(1, CAST(floor(n * CAST({level} AS DOUBLE)) AS BIGINT))"""
                                   for level in _LEVELS), "scored"))
def _(t: Tables):
    return selection.risk_coverage(t.scored, "label", "p", "uncertainty",
                                   ["commit_sha", *_SCORED_TIES], _LEVELS)


_TAUS = [0.01, 0.03, 0.05, 0.07]


@query("risk_coverage_sweep", "F17", sql(" UNION ALL ".join(f"""
    SELECT CAST({tau} AS DOUBLE) AS tau,
           {r(f'100.0 * count(*) FILTER (WHERE uncertainty <= {tau}::DOUBLE AND p >= 0.08) / count(*)')}
               AS coverage_pct,
           {r(f'100 - 100.0 * sum(label) FILTER (WHERE uncertainty <= {tau}::DOUBLE AND p >= 0.08) / sum(label)')}
               AS missed_pct FROM scored""" for tau in _TAUS), "scored"))
def _(t: Tables):
    return selection.risk_coverage_sweep(t.scored, "label", "p", "uncertainty", _TAUS, 0.08)


@query("page", "G1", sql("""
    SELECT sha, CAST(ts AS STRING) AS ts, repo FROM (SELECT * FROM commits
    ORDER BY ts, sha LIMIT 50 OFFSET 100) c""", "commits"))
def _(t: Tables):
    rows = t.commits.select("sha", "ts", "repo")
    return selection.page(rows, [F.col("ts"), F.col("sha")], 100, 50)


@query("global_topk", "G2", sql(f"""
    SELECT commit_sha, test_id, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM scored
    ORDER BY p DESC, commit_sha, test_id, l_orderkey, l_linenumber LIMIT 100""", "scored"))
def _(t: Tables):
    rows = t.scored.select("p", "commit_sha", *_SCORED_TIES)
    order = [ordering.desc("p"), F.col("commit_sha"), *[F.col(c) for c in _SCORED_TIES]]
    return selection.global_topk(rows, order, 100).drop("p")


@query("top_features", "G3", f"""
    SELECT p_name AS feature, {r('sum(p_retailprice - 950)')} AS importance FROM part
    GROUP BY p_name HAVING sum(p_retailprice - 950) > 0 ORDER BY sum(p_retailprice - 950) DESC, p_name
    LIMIT 20""")
def _(t: Tables):
    importances = t.part.groupBy(F.col("p_name").alias("feature")).agg(
        F.sum(F.col("p_retailprice") - 950).alias("importance"))
    return selection.top_features(importances, 20)


@query("ranked_candidates", "G4", sql(f"""
    SELECT l_orderkey, item, row_number() OVER (PARTITION BY l_orderkey ORDER BY p DESC, item)
               AS position, {r('round(p, 4)')} AS confidence, {r('uncertainty')} AS uncertainty,
           CAST(p >= 0.5 AS BIGINT) AS selected
    FROM (SELECT *, concat_ws('-', lpad(CAST(test_id AS STRING), 9, '0'), CAST(commit_sha AS STRING),
                 CAST(l_linenumber AS STRING)) AS item FROM scored) s""", "scored"))
def _(t: Tables):
    item = F.concat_ws("-", F.lpad(F.col("test_id").cast("string"), 9, "0"),
                       F.col("commit_sha").cast("string"), F.col("l_linenumber").cast("string"))
    rows = t.scored.select("l_orderkey", item.alias("item"), "p", "uncertainty",
                           (F.col("p") >= 0.5).alias("selected"))
    return selection.ranked_candidates(rows, "l_orderkey", "item", "p", "uncertainty", "selected")


_CONFIGS = """SELECT l_suppkey % 10 AS family, concat('cfg-', CAST(l_suppkey AS STRING)) AS config,
    round(avg(l_discount), 2) AS pr_auc, round(avg(l_tax), 2) AS roc_auc,
    round(avg(l_quantity), 0) AS brier, count(*) % 5 AS trees, count(*) % 3 AS depth,
    count(*) % 7 AS leaves FROM lineitem GROUP BY l_suppkey"""


@query("best_candidate", "G5", f"""
    SELECT family, config, {r('pr_auc')} AS pr_auc, {r('roc_auc')} AS roc_auc, {r('brier')} AS brier,
           trees, depth, leaves FROM ({_CONFIGS}) c
    ORDER BY pr_auc DESC, roc_auc DESC, brier, trees, depth, leaves, config DESC LIMIT 1""")
def _(t: Tables):
    return selection.best_candidate(t.select(_CONFIGS, "lineitem"))


@query("best_f1_threshold", "J16", sql(f"""
    WITH grid AS (SELECT unnest([{', '.join(f'{0.1 + 0.05 * i:.17e}' for i in range(16))}]) AS threshold),
    f AS (SELECT threshold, count(*) FILTER (WHERE p >= threshold) AS h,
          2 * count(*) FILTER (WHERE p >= threshold AND y = 1)
          / CAST(count(*) FILTER (WHERE p >= threshold) + sum(y) AS DOUBLE) AS f1
          FROM doc_labels, grid GROUP BY threshold)
    SELECT {r('threshold')} AS threshold, {r('f1')} AS f1 FROM f WHERE h > 0
    ORDER BY f1 DESC, threshold LIMIT 1""", "doc_labels"))
def _(t: Tables):
    return selection.best_f1_threshold(t.doc_labels, "y", "p")


_LONG = """SELECT 'raw' AS model, label, p FROM scored UNION ALL
           SELECT 'tempered', label, round(p * p, 4) FROM scored UNION ALL
           SELECT 'inverse', label, round(1 - p, 4) FROM scored"""


@query("compare_models", "J17", sql(f"""
    WITH l AS ({_LONG}), cut AS (SELECT model, CASE model WHEN 'raw' THEN 0.5 WHEN 'tempered' THEN 0.3
        ELSE 0.6 END::DOUBLE AS c FROM (SELECT DISTINCT model FROM l) m),
    k AS (SELECT l.model, count(*) FILTER (WHERE p >= c AND label = 1) AS tp,
          count(*) FILTER (WHERE p >= c AND label = 0) AS fp,
          count(*) FILTER (WHERE p < c AND label = 1) AS fn, avg((label - p) * (label - p)) AS b
          FROM l JOIN cut ON l.model = cut.model GROUP BY 1),
    s AS (SELECT model, p, sum(label) AS pos, sum(1 - label) AS neg FROM l GROUP BY 1, 2),
    w AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY p ROWS BETWEEN UNBOUNDED
          PRECEDING AND 1 PRECEDING), 0) AS below FROM s),
    a AS (SELECT model, sum(pos * (below + neg / CAST(2 AS DOUBLE)))
          / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) AS auc FROM w GROUP BY model)
    SELECT k.model, {r('tp / CAST(tp + fp AS DOUBLE)')} AS precision,
           {r('tp / CAST(tp + fn AS DOUBLE)')} AS recall,
           {r('2 * tp / CAST(2 * tp + fp + fn AS DOUBLE)')} AS f1, {r('auc')} AS roc_auc, {r('b')} AS brier
    FROM k JOIN a ON k.model = a.model""", "scored"))
def _(t: Tables):
    rows = t.select(_LONG, "scored")
    return metrics.compare_models(rows, "model", "label", "p",
                                  {"raw": 0.5, "tempered": 0.3, "inverse": 0.6})
