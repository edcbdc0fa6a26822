"""Registered queries: causal history features and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import micros
from ..operators import history, ordering, selection
from .catalog import Tables, query, r, sql

_KEY, _TIES = ["test_id"], ["event_id"]
_W = "OVER (PARTITION BY test_id ORDER BY ts, event_id"
_BEFORE = _W + " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("prior_count_and_rate", "F1", sql(f"""
    SELECT event_id, count(*) {_BEFORE} AS execution_count,
           CAST(coalesce(sum(label_failed) {_BEFORE}, 0) AS BIGINT) AS prior_failures,
           {r(f'coalesce(avg(label_failed) {_BEFORE}, 0)')} AS failure_rate_lifetime
    FROM runs""", "runs"))
def _(t: Tables):
    rows = t.runs.select("event_id", "test_id", "ts", "label_failed")
    out = history.prior_count_and_rate(rows, _KEY, "ts", _TIES, "label_failed")
    return out.select("event_id", "execution_count", "prior_failures", "failure_rate_lifetime")


@query("prior_duration_stats", "F2", sql(f"""
    SELECT event_id, {r(f'avg(duration) {_BEFORE}')} AS duration_mean,
           {r(f'stddev_samp(duration) {_BEFORE}')} AS duration_std FROM runs""", "runs"))
def _(t: Tables):
    rows = t.runs.select("event_id", "test_id", "ts", "duration")
    out = history.prior_duration_stats(rows, _KEY, "ts", _TIES, "duration")
    return out.select("event_id", "duration_mean", "duration_std")


def _trailing(d: int) -> str:
    frame = (f"OVER (PARTITION BY test_id ORDER BY ts RANGE BETWEEN INTERVAL '{d - 1} days "
             "23 hours 59 minutes 59.999999 seconds' PRECEDING AND CURRENT ROW)")
    tail = ("OVER (PARTITION BY test_id, ts ORDER BY event_id "
            "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
    runs = f"(count(*) {frame} - count(*) {tail})"
    fails = f"(sum(label_failed) {frame} - sum(label_failed) {tail})"
    rate = f"CASE WHEN {runs} > 0 THEN {fails} / CAST({runs} AS DOUBLE) ELSE 0 END"
    return f"{r(rate)} AS failure_rate_{d}d"


@query("trailing_rate", "F3", sql(
    f"SELECT event_id, {_trailing(7)}, {_trailing(14)}, {_trailing(28)} FROM runs", "runs"))
def _(t: Tables):
    rows = t.runs.select("event_id", "test_id", "ts", "label_failed")
    out = history.trailing_rate(rows, _KEY, "ts", _TIES, "label_failed")
    return out.select("event_id", "failure_rate_7d", "failure_rate_14d", "failure_rate_28d")


@query("recent_failures", "F4", sql(f"""
    SELECT event_id, CAST(coalesce(sum(label_failed) {_W}
           ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS recent_failures
    FROM runs""", "runs"))
def _(t: Tables):
    rows = t.runs.select("event_id", "test_id", "ts", "label_failed")
    out = history.recent_failures(rows, _KEY, "ts", _TIES, "label_failed")
    return out.select("event_id", "recent_failures")


@query("runs_since_last_failure", "F5", sql(f"""
    WITH placed AS (SELECT *, row_number() {_W}) AS rn FROM runs)
    SELECT event_id, rn - 1 - coalesce(max(CASE WHEN label_failed > 0 THEN rn END) {_BEFORE}, 0)
           AS runs_since_last_failure FROM placed""", "runs"))
def _(t: Tables):
    rows = t.runs.select("event_id", "test_id", "ts", "label_failed")
    out = history.runs_since_last_failure(rows, _KEY, "ts", _TIES, "label_failed")
    return out.select("event_id", "runs_since_last_failure")


@query("flip_rate", "F6", sql(f"""
    WITH flips AS (SELECT *, abs(label_failed - lag(label_failed) {_W})) AS flip FROM runs)
    SELECT event_id, {r(f'coalesce(avg(flip) {_W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0)')}
           AS flakiness_score FROM flips""", "runs"))
def _(t: Tables):
    rows = t.runs.select("event_id", "test_id", "ts", "label_failed")
    out = history.flip_rate(rows, _KEY, "ts", _TIES, "label_failed")
    return out.select("event_id", "flakiness_score")


@query("causal_history", "F1 F2 F3 F4 F5 F6", sql(f"""
    WITH placed AS (SELECT *, row_number() {_W}) AS rn,
                    abs(label_failed - lag(label_failed) {_W})) AS flip FROM runs)
    SELECT event_id, count(*) {_BEFORE} AS execution_count,
           {r(f'coalesce(avg(label_failed) {_BEFORE}, 0)')} AS failure_rate_lifetime,
           {r(f'avg(duration) {_BEFORE}')} AS duration_mean,
           {r(f'stddev_samp(duration) {_BEFORE}')} AS duration_std,
           {_trailing(7)}, {_trailing(14)}, {_trailing(28)},
           CAST(coalesce(sum(label_failed) {_W}
                ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS recent_failures,
           rn - 1 - coalesce(max(CASE WHEN label_failed > 0 THEN rn END) {_BEFORE}, 0)
               AS runs_since_last_failure,
           {r(f'coalesce(avg(flip) {_W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0)')}
               AS flakiness_score
    FROM placed""", "runs"))
def _(t: Tables):
    rows = t.runs.select("event_id", "test_id", "ts", "label_failed", "duration")
    out = history.causal_history(rows, _KEY, "ts", _TIES, "label_failed", "duration")
    return out.drop("test_id", "ts", "label_failed", "duration", "prior_failures")


@query("co_change_rate", "F7", sql(f"""
    WITH pairs AS (SELECT *, test_id % 20 AS changed_file, test_id % 7 AS test_path FROM runs)
    SELECT event_id, {r('''coalesce(avg(label_failed) OVER (PARTITION BY changed_file, test_path
           ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)''')}
           AS co_change_frequency FROM pairs""", "runs"))
def _(t: Tables):
    rows = t.runs.select("event_id", "ts", "label_failed",
                         (F.col("test_id") % 20).alias("changed_file"),
                         (F.col("test_id") % 7).alias("test_path"))
    out = history.co_change_rate(rows, "changed_file", "test_path", "ts", _TIES, "label_failed")
    return out.select("event_id", "co_change_frequency")


@query("group_causal_history", "F8", sql(f"""
    WITH src AS (SELECT repo, test_id, commit_sha, label_failed,
                        concat('file_', CAST(CAST(right(commit_sha, 2) AS INT) % 7 AS STRING))
                        AS changed_file FROM runs),
    rws AS (SELECT repo, test_id, commit_sha, changed_file, max(label_failed) AS label_failed
            FROM src GROUP BY 1, 2, 3, 4),
    cmt AS (SELECT repo, commit_sha, changed_file,
                   row_number() OVER (PARTITION BY repo ORDER BY commit_sha) - 1 AS prior_runs,
                   row_number() OVER (PARTITION BY repo, changed_file ORDER BY commit_sha) - 1
                       AS prior_file_touches
            FROM (SELECT DISTINCT repo, commit_sha, changed_file FROM src) d),
    h AS (SELECT *, CAST(coalesce(sum(label_failed) OVER (PARTITION BY repo, test_id
              ORDER BY commit_sha ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
              AS prior_failures,
              coalesce(avg(label_failed) OVER (PARTITION BY repo, test_id ORDER BY commit_sha
              ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS recent FROM rws)
    SELECT h.repo, h.test_id, h.commit_sha, CAST(h.label_failed AS BIGINT) AS label_failed,
           prior_runs, prior_failures,
           {r('CASE WHEN prior_runs > 0 THEN prior_failures / CAST(prior_runs AS DOUBLE) ELSE 0 END')}
               AS lifetime_rate,
           {r('recent')} AS recent_rate,
           CAST(CASE WHEN prior_failures > 0 THEN 1 ELSE 0 END AS BIGINT) AS has_ever_failed,
           prior_file_touches
    FROM h JOIN cmt ON h.repo = cmt.repo AND h.commit_sha = cmt.commit_sha""", "runs"))
def _(t: Tables):
    number = F.substring("commit_sha", -2, 2).cast("int") % 7
    rows = t.runs.select("repo", "test_id", "commit_sha", "label_failed",
                         F.col("commit_sha").alias("day"),
                         F.concat(F.lit("file_"), number.cast("string")).alias("changed_file"))
    return history.group_causal_history(rows, "repo", "test_id", "commit_sha", "day",
                                        "changed_file", "label_failed")


@query("history_asof", "C5", sql(f"""
    WITH pairs AS (SELECT DISTINCT test_id, commit_sha, CAST(commit_sha AS TIMESTAMP) AS at
                   FROM runs),
    prior AS (SELECT p.test_id, p.commit_sha, n.event_id, n.label_failed, n.duration, n.retry_count,
                     row_number() OVER (PARTITION BY p.test_id, p.commit_sha
                                        ORDER BY n.ts DESC, n.event_id DESC) AS newest
              FROM pairs p LEFT JOIN runs n ON n.test_id = p.test_id AND n.ts < p.at)
    SELECT test_id, commit_sha, count(event_id) AS hist_total_prior_runs,
           CAST(coalesce(sum(label_failed), 0) AS BIGINT) AS hist_prior_failures,
           {r('coalesce(avg(label_failed), 0)')} AS hist_lifetime_failure_rate,
           {r('coalesce(avg(label_failed) FILTER (WHERE newest <= 10), 0)')}
               AS hist_recent_failure_rate,
           {r('coalesce(avg(duration) FILTER (WHERE duration > 0), 0.05)')} AS hist_avg_duration,
           {r('coalesce(avg(retry_count), 0)')} AS hist_flaky_score,
           CAST(coalesce(max(label_failed), 0) AS BIGINT) AS hist_has_ever_failed
    FROM prior GROUP BY test_id, commit_sha""", "runs"))
def _(t: Tables):
    runs = t.runs.withColumn("at", micros("ts"))
    pairs = runs.select("test_id", "commit_sha").distinct()
    pairs = pairs.withColumn("at", micros(F.col("commit_sha")))
    # Event ids rise with time, zero-padded so that text order is number order.
    runs = runs.withColumn("tie", F.lpad(F.col("event_id").cast("string"), 20, "0"))
    out = history.history_asof(pairs, runs, ["test_id"], "at", ["commit_sha"], ["tie"],
                               "label_failed", "duration", "retry_count")
    return out.drop("at")


@query("prior_modifications", "C6", sql("""
    WITH touch AS (SELECT f.commit_sha, f.path, c.ts FROM changed_files f
                   JOIN commits c ON c.sha = f.commit_sha),
    days AS (SELECT path, ts, count(*) AS n FROM touch GROUP BY 1, 2),
    upto AS (SELECT path, ts, coalesce(sum(n) OVER (PARTITION BY path ORDER BY ts
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM days),
    own AS (SELECT DISTINCT commit_sha, path, ts FROM touch)
    SELECT own.commit_sha, CAST(sum(before) AS BIGINT) AS prior_mod_count
    FROM own JOIN upto ON own.path = upto.path AND own.ts = upto.ts
    GROUP BY own.commit_sha""", "changed_files", "commits"))
def _(t: Tables):
    commits = t.commits.select(F.col("sha").alias("commit_sha"), "ts")
    return history.prior_modifications(commits, t.changed_files, "commit_sha", "path", "ts")


@query("history_top_quarter", "F1 F13 E7 E8", sql(f"""
    WITH prior AS (SELECT *, coalesce(avg(label_failed) {_BEFORE}, 0) AS rate FROM runs),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY commit_sha ORDER BY rate DESC, event_id)
                      AS rk, count(*) OVER (PARTITION BY commit_sha) AS n FROM prior),
    chosen AS (SELECT *, rk <= greatest(1, CAST(floor(n * 0.25) AS BIGINT)) AS sel FROM ranked)
    SELECT 'history' AS strategy,
           {r('100 - 100.0 * count(*) FILTER (WHERE sel) / count(*)')} AS trr,
           {r('100 - 100.0 * sum(duration) FILTER (WHERE sel) / sum(duration)')} AS etr,
           {r('100.0 * sum(label_failed) FILTER (WHERE sel) / sum(label_failed)')} AS fr,
           count(DISTINCT commit_sha) AS n_commits
    FROM chosen""", "runs"))
def _(t: Tables):
    rows = t.runs.select("event_id", "test_id", "commit_sha", "ts", "label_failed", "duration")
    scored = history.prior_count_and_rate(rows, _KEY, "ts", _TIES, "label_failed")
    chosen = selection.topk_per_group(
        scored, ["commit_sha"], [ordering.desc("failure_rate_lifetime"), F.col("event_id")],
        budget=0.25, k_rule="floor")
    stats = selection.strategy_commit_stats(
        chosen.withColumn("strategy", F.lit("history")).withColumn("abstained", F.lit(False)),
        "commit_sha", "strategy", "label_failed", "selected", "duration", "abstained")
    folded = selection.fold_strategy_metrics(stats, "strategy")
    return folded.select("strategy", "trr", "etr", "fr", "n_commits")
