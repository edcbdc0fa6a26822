"""Registered queries: conformal rules, policies and strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conformal, metrics, policy, selection, strategies
from ..operators.policy import PolicyThresholds
from .catalog import Tables, query, r, sql

_TIES = ["l_orderkey", "l_linenumber"]
_IDENTITY = ["test_id", *_TIES]
_ORDER = "p DESC, test_id, l_orderkey, l_linenumber"


_POSITIVES = """
    WITH s AS (SELECT repo, 1 - p AS s FROM scored WHERE label = 1),
    z AS (SELECT repo, s, row_number() OVER (PARTITION BY repo ORDER BY s) AS rk,
                 count(*) OVER (PARTITION BY repo) AS n FROM s),
    m AS (SELECT repo, max(n) AS n, min(s) AS score_min, max(s) AS score_max,
          least(CAST(ceil((max(n) + 1) * (1 - (1 - 0.95::DOUBLE))) AS BIGINT), max(n)) AS k
          FROM z GROUP BY repo),
    q AS (SELECT m.repo, m.n, m.k, score_min, score_max, z.s AS cut FROM m JOIN z
          ON m.repo = z.repo AND z.rk = m.k)"""


@query("conformal_threshold_marginal", "J2", sql(f"""{_POSITIVES}
    SELECT repo, n, k AS marginal_rank, {r('cut')} AS threshold, {r('1 - cut')} AS probability_floor,
           {r('score_min')} AS score_min, {r('score_max')} AS score_max FROM q""", "scored"))
def _(t: Tables):
    rule = conformal.conformal_threshold(t.scored, "label", "p", ["repo"], guarantee="marginal")
    return rule.select("repo", "n", "marginal_rank", "threshold", "probability_floor",
                       "score_min", "score_max")


# log C(n, i) q^i (1-q)^(n-i); the PAC rank is the smallest k whose upper tail is at most delta.
_PAC = """
    WITH s AS (SELECT commit_sha, 1 - p AS s FROM scored WHERE label = 1),
    z AS (SELECT commit_sha, s, row_number() OVER (PARTITION BY commit_sha ORDER BY s) AS rk FROM s),
    m AS (SELECT commit_sha, count(*) AS n FROM s GROUP BY commit_sha),
    d AS (SELECT DISTINCT n FROM m),
    b AS (SELECT n, unnest(range(1, n + 1)) AS i FROM d),
    c AS (SELECT n, i, exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0)
                           + i * ln(0.8::DOUBLE) + (n - i) * ln(0.2::DOUBLE)) AS w FROM b),
    t AS (SELECT n, i, sum(w) OVER (PARTITION BY n ORDER BY i DESC) AS tail FROM c),
    k AS (SELECT d.n, min(CASE WHEN tail <= 0.1 THEN i END) AS k FROM d JOIN t ON d.n = t.n GROUP BY d.n)"""


@query("conformal_ranks", "J1", sql(_PAC.replace("0.8::DOUBLE", "0.95::DOUBLE").replace(
    "0.2::DOUBLE", "0.05::DOUBLE") + """
    SELECT m.commit_sha, m.n, least(CAST(ceil((m.n + 1) * (1 - (1 - 0.95::DOUBLE))) AS BIGINT), m.n)
           AS marginal_rank, k.k AS pac_rank FROM m JOIN k ON m.n = k.n""", "scored"))
def _(t: Tables):
    sizes = t.scored.filter("label = 1").groupBy("commit_sha").agg(F.count(F.lit(1)).alias("n"))
    return conformal.conformal_ranks(sizes, "n", 0.95, 0.90).drop("certified_coverage")


@query("certified_coverage", "J1")
def _(t: Tables):
    sizes = t.scored.filter("label = 1").groupBy("commit_sha").agg(F.count(F.lit(1)).alias("n"))
    return conformal.conformal_ranks(sizes, "n", 0.95, 0.90).select(
        "commit_sha", "certified_coverage")


@query("conformal_threshold_pac", "J1 J2", sql(f"""{_PAC}
    SELECT m.commit_sha, m.n, k.k AS pac_rank, {r('z.s')} AS pac_threshold,
           CASE WHEN k.k IS NULL THEN 'marginal' ELSE 'pac' END AS guarantee,
           CAST(k.k IS NULL AS BIGINT) AS pac_infeasible
    FROM m JOIN k ON m.n = k.n LEFT JOIN z ON z.commit_sha = m.commit_sha AND z.rk = k.k""",
    "scored"))
def _(t: Tables):
    rule = conformal.conformal_threshold(t.scored, "label", "p", ["commit_sha"], 0.8, 0.9, "pac")
    return rule.select("commit_sha", "n", "pac_rank", "pac_threshold", "guarantee",
                       "pac_infeasible")


@query("conformal_threshold_global", "J2", sql(f"""
    WITH z AS (SELECT 1 - p AS s, row_number() OVER (ORDER BY 1 - p) AS rk, count(*) OVER () AS n
               FROM scored WHERE label = 1)
    SELECT n, rk AS marginal_rank, {r('s')} AS marginal_threshold FROM z
    WHERE rk = least(CAST(ceil((n + 1) * (1 - (1 - 0.95::DOUBLE))) AS BIGINT), n)""", "scored"))
def _(t: Tables):
    rule = conformal.conformal_threshold(t.scored.select("label", "p"), "label", "p")
    return rule.select("n", "marginal_rank", "marginal_threshold")


@query("apply_conformal", "J3 I10", sql(f"""{_POSITIVES}
    SELECT scored.repo, count(*) AS n_rows,
           count(*) FILTER (WHERE 1 - p <= cut) AS n_selected,
           {r('sum(p - (1 - cut))')} AS total_margin
    FROM scored JOIN q ON scored.repo = q.repo GROUP BY scored.repo""", "scored"))
def _(t: Tables):
    rows = t.scored.select("repo", "label", "p")
    rule = conformal.conformal_threshold(rows, "label", "p", ["repo"], guarantee="marginal")
    applied = conformal.apply_conformal(rows, rule, "p", ["repo"])
    return applied.groupBy("repo").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("selected").alias("n_selected"),
        F.sum("margin").alias("total_margin"))


_REQUESTS = """SELECT o_orderkey AS request, o_custkey AS author,
    CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS price,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END AS urgent,
    CASE WHEN o_custkey % 3 = 0 THEN o_custkey END AS third FROM orders"""


@query("feature_completeness", "B14", f"""
    WITH q AS (SELECT author, price, urgent, third FROM ({_REQUESTS}) x),
    s AS (SELECT author, (max(CASE WHEN price IS NOT NULL THEN 1 ELSE 0 END)
          + max(CASE WHEN urgent IS NOT NULL THEN 1 ELSE 0 END)
          + max(CASE WHEN third IS NOT NULL THEN 1 ELSE 0 END)) / CAST(4 AS DOUBLE) AS share
          FROM q GROUP BY author)
    SELECT author, {r('share')} AS feature_completeness, CAST(share < 0.7 AS BIGINT) AS degraded
    FROM s""")
def _(t: Tables):
    rows = t.select(_REQUESTS, "orders")
    return conformal.feature_completeness(
        rows, "author", ["price", "urgent", "third", "not_supplied"], 0.7)


_DECIDE = """SELECT o_orderkey AS request, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE n END
        AS n_candidates, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE s END AS n_selected,
        o_custkey % 7 = 0 AS degraded, o_custkey % 5 = 0 AS budget_capped,
        o_custkey % 2 = 0 AS guarantee_holds
    FROM orders JOIN (SELECT l_orderkey, count(*) AS n,
        sum(CASE WHEN l_quantity > 5 THEN 1 ELSE 0 END) AS s FROM lineitem GROUP BY 1) l
    ON o_orderkey = l_orderkey"""


@query("request_decision", "J4", f"""
    WITH d AS ({_DECIDE}),
    c AS (SELECT *, concat_ws('|', CASE WHEN n_candidates <= 0 THEN 'EMPTY_CANDIDATE_SET' END,
        CASE WHEN degraded THEN 'DEGRADED_FEATURE_COMPLETENESS' END,
        CASE WHEN budget_capped AND NOT guarantee_holds THEN 'GUARANTEE_VOIDED_BY_BUDGET' END,
        CASE WHEN n_candidates > 0 AND n_selected / CAST(n_candidates AS DOUBLE) >= 0.9
             THEN 'SELECTION_EXCEEDS_FALLBACK_FRACTION' END) AS codes FROM d)
    SELECT request, CASE WHEN codes = '' THEN 'WITHIN_GUARANTEE' ELSE codes END AS reason_codes,
           CASE WHEN codes = '' THEN 'RUN_SELECTED' ELSE 'RUN_FULL_SUITE' END AS action,
           CAST(CASE WHEN codes = '' THEN n_selected ELSE n_candidates END AS BIGINT)
               AS tests_to_run, CAST(codes <> '' AS BIGINT) AS safe_fallback FROM c""")
def _(t: Tables):
    out = conformal.request_decision(t.select(_DECIDE, "orders", "lineitem"))
    return out.select("request", "reason_codes", "action", "tests_to_run", "safe_fallback")


_POLICY_STATS = f"""
    WITH k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY p DESC, test_id,
                   commit_sha, l_linenumber) AS rk,
               count(*) OVER (PARTITION BY l_orderkey) AS n FROM scored),
    ps AS (SELECT l_orderkey, max(uncertainty) AS u, max(p) AS c, count(*) AS n_tests,
           count(*) FILTER (WHERE rk <= greatest(1, CAST(floor(n * 0.25) AS BIGINT))) AS n_top,
           CAST(sum(label) AS BIGINT) AS n_failures,
           count(*) FILTER (WHERE label = 1 AND rk <= greatest(1, CAST(floor(n * 0.25) AS BIGINT)))
               AS top_failures, max(l_linenumber) AS n_files,
           CAST(max(duration * 7) AS BIGINT) AS n_churn FROM k GROUP BY l_orderkey)"""


def _policy_stats(t: Tables, keep=None):
    rows = t.scored.withColumn("churn", (F.col("duration") * 7))
    if keep is not None:
        rows = rows.filter(keep)
    stats = policy.commit_policy_stats(
        rows, "l_orderkey", "test_id", "label", "p", "uncertainty", ["commit_sha", "l_linenumber"],
        0.25, "l_linenumber", "churn")
    return stats


_THRESHOLDS = PolicyThresholds(0.06, 0.5, 0.25, 6, 500)


@query("selective_policy", "J5", sql(_POLICY_STATS.replace(
    "CAST(max(duration * 7) AS BIGINT)", "max(duration * 7)") + f"""
    SELECT l_orderkey, CAST(u > 0.06 OR c < 0.5 OR n_files > 6 OR n_churn > 500 AS BIGINT) AS abstained,
           CASE WHEN u > 0.06 OR c < 0.5 OR n_files > 6 OR n_churn > 500 THEN 'SAFE_FULL_SUITE'
                ELSE 'FAST_SELECTED' END AS mode,
           CASE WHEN u > 0.06 OR c < 0.5 OR n_files > 6 OR n_churn > 500 THEN n_tests ELSE n_top END
               AS n_selected,
           concat_ws('|', CASE WHEN u > 0.06 THEN 'HIGH_UNCERTAINTY' END,
               CASE WHEN c < 0.5 THEN 'LOW_CONFIDENCE' END,
               CASE WHEN n_files > 6 OR n_churn > 500 THEN 'OUT_OF_DISTRIBUTION' END,
               CASE WHEN NOT (u > 0.06 OR c < 0.5 OR n_files > 6 OR n_churn > 500)
                    THEN 'WITHIN_THRESHOLDS' END) AS reasons,
           {r('''CASE WHEN u > 0.06 OR c < 0.5 OR n_files > 6 OR n_churn > 500 THEN 0
                 ELSE 100 - 100.0 * n_top / n_tests END''')} AS skipped_pct FROM ps""", "scored"))
def _(t: Tables):
    out = policy.selective_policy(_policy_stats(t), _THRESHOLDS)
    return out.select("l_orderkey", "abstained", "mode", "n_selected", "reasons", "skipped_pct")


_GRID_A, _GRID_C = [0.01, 0.02, 0.03, 0.04, 0.05, 0.06], [0.3, 0.5, 0.6, 0.7, 0.8, 0.9]


def _sweep(extra: str = "", where: str = "") -> str:
    return _POLICY_STATS.replace("FROM scored)", f"FROM scored {where})").replace(
        "CAST(max(duration * 7) AS BIGINT)", "max(duration * 7)") + f""",
    g AS (SELECT * FROM (SELECT unnest({_GRID_A}::DOUBLE[]) AS ta) x,
                        (SELECT unnest({_GRID_C}::DOUBLE[]) AS tc) y),
    x AS (SELECT *, (u > ta OR c < tc OR n_files > 15 OR n_churn > 500) AS ab FROM ps, g),
    s AS (SELECT ta AS tau_abstain, tc AS tau_conf, CAST(sum(n_tests) AS BIGINT) AS tests_available,
          CAST(sum(CASE WHEN ab THEN n_tests ELSE n_top END) AS BIGINT) AS tests_executed,
          CAST(sum(n_failures) AS BIGINT) AS failures_available,
          CAST(sum(CASE WHEN ab THEN n_failures ELSE top_failures END) AS BIGINT)
              AS failures_detected,
          count(*) FILTER (WHERE ab) AS abstentions,
          count(*) FILTER (WHERE NOT ab AND top_failures < n_failures) AS escaped_commits,
          count(*) AS commits FROM x GROUP BY 1, 2),
    m AS (SELECT *, 100 - 100.0 * tests_executed / tests_available AS trr_pct,
          100.0 * failures_detected / failures_available AS recall_pct,
          100.0 * abstentions / commits AS abstention_pct FROM s){extra}"""


@query("sweep_policy", "J6", sql(f"""{_sweep()}
    SELECT {r('tau_abstain')} AS tau_abstain, {r('tau_conf')} AS tau_conf, tests_available,
           tests_executed, failures_available, failures_detected, abstentions, escaped_commits,
           commits, {r('trr_pct')} AS trr_pct, {r('recall_pct')} AS recall_pct,
           {r('abstention_pct')} AS abstention_pct FROM m""", "scored"))
def _(t: Tables):
    return policy.sweep_policy(_policy_stats(t), _GRID_A, _GRID_C)


_PICK = "ORDER BY trr_pct DESC, escaped_commits, tau_abstain, tau_conf LIMIT 1"


@query("frontier_point", "J7", sql(f"""{_sweep()}
    SELECT 'recall_floor' AS objective, (SELECT count(*) FROM m) AS grid_points,
           (SELECT count(*) FROM m WHERE recall_pct >= 92) AS eligible_points,
           {r('tau_abstain')} AS tau_abstain, {r('tau_conf')} AS tau_conf, {r('trr_pct')} AS trr_pct,
           {r('recall_pct')} AS recall_pct, escaped_commits
    FROM m WHERE recall_pct >= 92 {_PICK}""", "scored"))
def _(t: Tables):
    grid = policy.sweep_policy(_policy_stats(t), _GRID_A, _GRID_C)
    out = policy.frontier_point(grid, "recall_floor", 92.0)
    return out.select("objective", "grid_points", "eligible_points", "tau_abstain", "tau_conf",
                      "trr_pct", "recall_pct", "escaped_commits")


def _cte(text: str, tag: str) -> str:
    out = text.strip()[len("WITH "):]
    for name in ("k", "ps", "g", "x", "s", "m"):
        for before, after in ((f"{name} AS (", f"{tag}{name} AS ("), (f"FROM {name} ", f"FROM {tag}{name} "),
                              (f"FROM {name})", f"FROM {tag}{name})")):
            out = out.replace(f"\n    {before}", f"\n    {after}") if before.endswith("(") else out.replace(before, after)
        if out.startswith(f"{name} AS ("):
            out = tag + out
    return out.replace("FROM ps, g)", f"FROM {tag}ps, {tag}g)")


@query("recall_floor_gate", "J8", sql(f"""
    WITH {_cte(_sweep(where='WHERE l_orderkey % 2 = 0'), 'v')},
    {_cte(_sweep(where='WHERE l_orderkey % 2 = 1'), 't')},
    pick AS (SELECT * FROM vm WHERE recall_pct >= 92 {_PICK})
    SELECT {r('p.tau_abstain')} AS tau_abstain, {r('p.tau_conf')} AS tau_conf,
           {r('p.recall_pct')} AS val_recall_pct, {r('p.trr_pct')} AS val_trr_pct,
           (SELECT count(*) FROM vm WHERE recall_pct >= 92) AS eligible_points,
           {r('h.recall_pct')} AS test_recall_pct, {r('h.trr_pct')} AS test_trr_pct,
           h.escaped_commits AS test_escaped_commits, CAST(h.recall_pct >= 92 AS BIGINT) AS gate_met,
           CAST(0 AS BIGINT) AS gate_met_at_lower,
           {r('p.recall_pct - h.recall_pct')} AS generalization_gap_pct,
           (SELECT count(*) FROM tm WHERE recall_pct >= 92) AS test_qualifying_points,
           {r('(SELECT max(trr_pct) FROM tm WHERE recall_pct >= 92)')} AS best_test_trr_pct
    FROM pick p JOIN tm h ON p.tau_abstain = h.tau_abstain AND p.tau_conf = h.tau_conf""", "scored"))
def _(t: Tables):
    val = policy.sweep_policy(_policy_stats(t, "l_orderkey % 2 = 0"), _GRID_A, _GRID_C)
    test = policy.sweep_policy(_policy_stats(t, "l_orderkey % 2 = 1"), _GRID_A, _GRID_C)
    return policy.recall_floor_gate(val, test, 92.0)


_CORRESPONDENCE = """SELECT l_suppkey AS commit_sha, l_partkey AS test_id, l_orderkey, l_linenumber,
        CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
        l_extendedprice / 1000 AS duration, l_quantity, p_name, p_type, p_brand,
        concat('tests/', lower(p_type), '/test_', replace(p_name, ' ', '_'), '.py') AS test_path
    FROM lineitem JOIN part ON l_partkey = p_partkey"""
_CHANGED = f"""SELECT DISTINCT commit_sha, concat('src/', p_brand, '/', CASE WHEN test_id % 3 = 0
        THEN element_at(split(p_name, ' '), 2) ELSE replace(p_name, ' ', '_') END, '.py') AS path
    FROM ({_CORRESPONDENCE}) c"""
_CHANGED_DUCK = _CHANGED.replace("element_at(split(p_name, ' '), 2)", "split_part(p_name, ' ', 2)")
_MATCH = f"""
    WITH rows_ AS ({_CORRESPONDENCE}),
    stems AS (SELECT DISTINCT commit_sha, lower(regexp_extract(path, '([^/]*)\\.py$', 1)) AS stem
              FROM ({_CHANGED_DUCK}) c),
    hit AS (SELECT DISTINCT a.commit_sha, a.test_path FROM (SELECT DISTINCT commit_sha, test_path
            FROM rows_) a JOIN stems s ON a.commit_sha = s.commit_sha
            AND (contains(lower(a.test_path), s.stem)))"""


def _pairs(t: Tables):
    rows = t.select(_CORRESPONDENCE, "lineitem", "part")
    return rows, t.select(_CHANGED, "lineitem", "part")


@query("name_correspondence", "C16", f"""{_MATCH}
    SELECT rows_.commit_sha, count(*) AS n, count(hit.test_path) AS n_matched,
           count(DISTINCT hit.test_path) AS matched_paths
    FROM rows_ LEFT JOIN hit ON rows_.commit_sha = hit.commit_sha AND rows_.test_path = hit.test_path
    GROUP BY rows_.commit_sha""")
def _(t: Tables):
    rows, changed = _pairs(t)
    out = strategies.name_correspondence(rows, changed, "commit_sha", "test_path", "path")
    hit = F.when(F.col("matched"), F.col("test_path"))
    return out.groupBy("commit_sha").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("matched").alias("n_matched"),
        F.count_distinct(hit).alias("matched_paths"))


def _summary(df, key="commit_sha"):
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("selected").alias("n_selected"),
        F.count_if(F.col("selected") & (F.col("label") == 1)).alias("n_caught"),
        F.max(F.col("abstained").cast("int")).alias("abstained"))


def _strategy_sql(selected: str, source: str = "scored", abstained: str = "0", lead: str = "",
                  label: str = "label") -> str:
    head = lead if lead else "WITH"
    return f"""{head} flagged AS ({selected})
    SELECT commit_sha, count(*) AS n, count(*) FILTER (WHERE sel) AS n_selected,
           count(*) FILTER (WHERE sel AND {label} = 1) AS n_caught,
           CAST(max({abstained}) AS BIGINT) AS abstained FROM flagged GROUP BY commit_sha"""


@query("strategy_full", "J9a", sql(_strategy_sql("SELECT *, true AS sel FROM scored"), "scored"))
def _(t: Tables):
    return _summary(strategies.full(t.scored))


_SHARE = "<= greatest(1, CAST(floor(count(*) OVER (PARTITION BY commit_sha) * 0.25) AS BIGINT))"


@query("strategy_random", "J9b", sql(_strategy_sql(f"""
    SELECT *, row_number() OVER (PARTITION BY commit_sha ORDER BY md5(concat_ws(':', '42',
        CAST(commit_sha AS STRING), CAST(test_id AS STRING), CAST(l_orderkey AS STRING),
        CAST(l_linenumber AS STRING)))) {_SHARE} AS sel FROM scored"""), "scored"))
def _(t: Tables):
    return _summary(strategies.random_share(t.scored, "commit_sha", _IDENTITY, 0.25, 42))


@query("strategy_changed_file", "J9c", f"""{_MATCH},
    flagged AS (SELECT rows_.*, hit.test_path IS NOT NULL AS sel FROM rows_ LEFT JOIN hit
                ON rows_.commit_sha = hit.commit_sha AND rows_.test_path = hit.test_path)
    SELECT commit_sha, count(*) AS n, count(*) FILTER (WHERE sel) AS n_selected,
           count(*) FILTER (WHERE sel AND label = 1) AS n_caught, CAST(0 AS BIGINT) AS abstained
    FROM flagged GROUP BY commit_sha""")
def _(t: Tables):
    rows, changed = _pairs(t)
    return _summary(strategies.changed_file(rows, changed, "commit_sha", "test_path", "path"))


@query("strategy_changed_file_budget", "J9c", f"""{_MATCH},
    f AS (SELECT rows_.*, hit.test_path IS NOT NULL AS m FROM rows_ LEFT JOIN hit
          ON rows_.commit_sha = hit.commit_sha AND rows_.test_path = hit.test_path),
    flagged AS (SELECT *, m AND row_number() OVER (PARTITION BY commit_sha ORDER BY m DESC, test_id,
                l_orderkey, l_linenumber) {_SHARE} AS sel FROM f)
    SELECT commit_sha, count(*) AS n, count(*) FILTER (WHERE sel) AS n_selected,
           count(*) FILTER (WHERE sel AND label = 1) AS n_caught, CAST(0 AS BIGINT) AS abstained
    FROM flagged GROUP BY commit_sha""")
def _(t: Tables):
    rows, changed = _pairs(t)
    return _summary(strategies.changed_file(rows, changed, "commit_sha", "test_path", "path",
                                            _IDENTITY, 0.25))


_DEPTH = ("SELECT l_suppkey AS commit_sha, l_partkey AS test_id, l_orderkey, l_linenumber, "
          "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, CASE WHEN l_suppkey % 4 = 0 "
          "THEN 10 ELSE CAST(round(l_discount * 100) AS BIGINT) + l_partkey % 8 END AS depth "
          "FROM lineitem")


@query("strategy_dependency", "J9d", _strategy_sql(f"""
    SELECT *, (depth < 10 OR NOT bool_or(depth < 10) OVER (PARTITION BY commit_sha))
           AND row_number() OVER (PARTITION BY commit_sha ORDER BY depth, test_id, l_orderkey,
               l_linenumber) {_SHARE} AS sel FROM ({_DEPTH}) d"""))
def _(t: Tables):
    rows = t.select(_DEPTH, "lineitem")
    return _summary(strategies.dependency(rows, "commit_sha", "depth", _IDENTITY, 0.25))


_RUN_HISTORY = """SELECT *, count(*) OVER w AS n_prior, coalesce(sum(label_failed) OVER w, 0) AS f_prior
    FROM runs WINDOW w AS (PARTITION BY test_id ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@query("strategy_history", "J9e", sql(_strategy_sql(f"""
    SELECT *, row_number() OVER (PARTITION BY commit_sha ORDER BY
        round(CASE WHEN n_prior > 0 THEN f_prior / CAST(n_prior AS DOUBLE) ELSE 0 END, 9)
        + f_prior * 0.1::DOUBLE DESC, event_id) {_SHARE} AS sel FROM ({_RUN_HISTORY}) h""",
    label="label_failed"), "runs"))
def _(t: Tables):
    from ..operators import history

    rows = history.prior_count_and_rate(
        t.runs, ["test_id"], "ts", ["event_id"], "label_failed"
    ).withColumn("rate", F.round("failure_rate_lifetime", 9))
    out = strategies.history(rows, "commit_sha", "rate", "prior_failures", ["event_id"], 0.25)
    return _summary(out.withColumnRenamed("label_failed", "label"))


@query("strategy_raw_score", "J9f", sql(_strategy_sql(f"""
    SELECT *, row_number() OVER (PARTITION BY commit_sha ORDER BY {_ORDER}) {_SHARE} AS sel
    FROM scored"""), "scored"))
def _(t: Tables):
    return _summary(strategies.scored(t.scored, "commit_sha", "p", _IDENTITY, 0.25))


_SELECTIVE_SQL = f"""
    SELECT *, max(uncertainty) OVER (PARTITION BY l_orderkey) > 0.05
           OR max(p) OVER (PARTITION BY l_orderkey) < 0.6 AS ab,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY p DESC, test_id, commit_sha,
               l_linenumber) <= greatest(1, CAST(floor(count(*) OVER (PARTITION BY l_orderkey)
               * 0.25) AS BIGINT)) AS top FROM scored"""


@query("strategy_selective", "J9g", sql(f"""
    WITH s AS ({_SELECTIVE_SQL})
    SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE ab OR top) AS n_selected,
           count(*) FILTER (WHERE (ab OR top) AND label = 1) AS n_caught,
           CAST(max(CASE WHEN ab THEN 1 ELSE 0 END) AS BIGINT) AS abstained
    FROM s GROUP BY l_orderkey""", "scored"))
def _(t: Tables):
    out = strategies.selective(t.scored, "l_orderkey", "test_id", "label", "p", "uncertainty",
                               ["commit_sha", "l_linenumber"], PolicyThresholds(0.05, 0.6))
    return _summary(out, "l_orderkey")


@query("run_strategies", "N1 E7 E8 J9a J9b J9f", sql(f"""
    WITH f AS (
      SELECT 'full' AS strategy, commit_sha, label, duration, true AS sel FROM scored UNION ALL
      SELECT 'random', commit_sha, label, duration, row_number() OVER (PARTITION BY commit_sha
        ORDER BY md5(concat_ws(':', '42', CAST(commit_sha AS STRING), CAST(test_id AS STRING),
        CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING)))) {_SHARE} FROM scored UNION ALL
      SELECT 'score', commit_sha, label, duration, row_number() OVER (PARTITION BY commit_sha
        ORDER BY {_ORDER}) {_SHARE} FROM scored)
    SELECT strategy, {r('100 - 100.0 * count(*) FILTER (WHERE sel) / count(*)')} AS trr,
           {r('100 - 100.0 * sum(duration) FILTER (WHERE sel) / sum(duration)')} AS etr,
           {r('100.0 * sum(label) FILTER (WHERE sel) / sum(label)')} AS fr,
           count(DISTINCT commit_sha) AS n_commits FROM f GROUP BY strategy""", "scored"))
def _(t: Tables):
    strategies.register_strategy("full", strategies.full)
    strategies.register_strategy(
        "random", lambda df: strategies.random_share(df, "commit_sha", _IDENTITY, 0.25, 42))
    strategies.register_strategy(
        "score", lambda df: strategies.scored(df, "commit_sha", "p", _IDENTITY, 0.25))
    stats = strategies.run_strategies(t.scored, ["full", "random", "score"], "commit_sha", "label",
                                      "duration")
    return selection.fold_strategy_metrics(stats, "strategy").select(
        "strategy", "trr", "etr", "fr", "n_commits")


@query("scorer_hook", "N3", sql(_strategy_sql(f"""
    SELECT *, row_number() OVER (PARTITION BY commit_sha ORDER BY p * (1 - uncertainty) DESC,
        test_id, l_orderkey, l_linenumber) {_SHARE} AS sel FROM scored"""), "scored"))
def _(t: Tables):
    def scorer(df):
        return df.withColumn("score", F.col("p") * (1 - F.col("uncertainty")))

    return _summary(strategies.with_scorer(t.scored, scorer, "commit_sha", _IDENTITY, 0.25))


@query("safety_union", "H3", sql("""
    SELECT commit_sha, count(*) FILTER (WHERE p >= 0.9 OR l_linenumber = 1) AS n_selected
    FROM scored GROUP BY commit_sha""", "scored"))
def _(t: Tables):
    rows = t.scored.withColumn("selected", F.col("p") >= 0.9).withColumn(
        "direct", F.col("l_linenumber") == 1)
    out = strategies.safety_union(rows, "selected", "direct")
    return out.groupBy("commit_sha").agg(F.count_if("selected").alias("n_selected"))


@query("threshold_policy", "J10", sql(f"""
    WITH s AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE p >= 0.8 OR
               (l_linenumber = 3)) AS c, max(uncertainty) AS u,
               max(CASE WHEN duration > 90 THEN 1 ELSE 0 END) AS o FROM scored GROUP BY 1),
    j AS (SELECT o_orderkey AS l_orderkey, n, c, coalesce(u, 0) AS u, o = 1 OR u > 0.06 AS ab
          FROM orders LEFT JOIN s ON o_orderkey = s.l_orderkey),
    k AS (SELECT *, CASE WHEN n IS NULL THEN 0 WHEN ab THEN n WHEN c = 0 THEN least(n, 3)
          ELSE c END AS sel FROM j)
    SELECT l_orderkey, CASE WHEN n IS NULL THEN 'NO_OP' WHEN ab THEN 'ABSTAIN_SAFE_FALLBACK'
           ELSE 'SELECTIVE_RUN' END AS action, sel AS n_selected, coalesce(n, 0) AS n_total,
           {r('coalesce(1 - sel / CAST(n AS DOUBLE), 0)')} AS reduction, {r('u')} AS max_uncertainty,
           {r('1 - u')} AS confidence FROM k""", "scored"))
def _(t: Tables):
    rows = t.scored.withColumn("direct", F.col("l_linenumber") == 3).withColumn(
        "strange", F.col("duration") > 90)
    commits = t.orders.select(F.col("o_orderkey").alias("l_orderkey"))
    return policy.threshold_policy(rows, commits, "l_orderkey", "test_id", "p", "uncertainty",
                                   "direct", "strange", ["commit_sha", "l_linenumber"], 0.06, 0.8)


@query("threshold_policy_rows", "J10 H3", sql("""
    WITH s AS (SELECT *, count(*) FILTER (WHERE p >= 0.8 OR l_linenumber = 3)
               OVER (PARTITION BY l_orderkey) AS c,
               max(uncertainty) OVER (PARTITION BY l_orderkey) > 0.06
               OR max(duration) OVER (PARTITION BY l_orderkey) > 90 AS ab,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY test_id, commit_sha, l_linenumber)
               AS rk FROM scored)
    SELECT repo, count(*) AS n, count(*) FILTER (WHERE ab OR p >= 0.8 OR l_linenumber = 3
           OR (c = 0 AND rk <= 3)) AS n_selected FROM s GROUP BY repo""", "scored"))
def _(t: Tables):
    rows = t.scored.withColumn("direct", F.col("l_linenumber") == 3).withColumn(
        "strange", F.col("duration") > 90)
    out = policy.threshold_policy_rows(
        rows, "l_orderkey", "test_id", "p", "uncertainty", "direct", "strange",
        ["commit_sha", "l_linenumber"], 0.06, 0.8)
    return out.groupBy("repo").agg(F.count(F.lit(1)).alias("n"),
                                   F.count_if("selected").alias("n_selected"))


@query("reference_baselines", "J11", sql(f"""
    WITH te AS (SELECT *, row_number() OVER (ORDER BY p DESC, commit_sha, test_id, l_orderkey,
                l_linenumber) AS rk, count(*) OVER () AS n FROM scored WHERE l_orderkey % 2 = 1),
    cut AS (SELECT quantile_cont(p, 1 - 0.95::DOUBLE) AS c FROM scored
            WHERE l_orderkey % 2 = 0 AND label = 1),
    m AS (SELECT 'run_all' AS strategy, label, true AS sel FROM te UNION ALL
          SELECT 'fixed_threshold_0.5', label, p >= 0.5 FROM te UNION ALL
          SELECT 'cost_matched_topk', label, rk <= round_even(0.3 * n, 0) FROM te UNION ALL
          SELECT 'val_tuned_threshold', label, p >= c FROM te, cut),
    a AS (SELECT strategy, sum(label) FILTER (WHERE sel) / CAST(sum(label) AS DOUBLE) AS recall,
          count(*) FILTER (WHERE sel) / CAST(count(*) AS DOUBLE) AS rate,
          sum(label) FILTER (WHERE sel) / CAST(count(*) FILTER (WHERE sel) AS DOUBLE) AS pr,
          CAST(coalesce(sum(label) FILTER (WHERE NOT sel), 0) AS BIGINT) AS missed FROM m GROUP BY 1)
    SELECT strategy, {r('recall')} AS recall, {r('rate')} AS selection_rate,
           {r('1 - rate')} AS cost_reduction, {r('pr')} AS precision, missed AS failures_missed,
           {r("CASE WHEN strategy = 'val_tuned_threshold' THEN c END")} AS threshold,
           {r("CASE WHEN strategy = 'val_tuned_threshold' THEN 0.95 END")} AS promised_recall,
           {r("CASE WHEN strategy = 'val_tuned_threshold' THEN 0.95 - recall END")}
               AS recall_shortfall FROM a, cut""", "scored"))
def _(t: Tables):
    return selection.reference_baselines(
        t.scored.filter("l_orderkey % 2 = 1"), t.scored.filter("l_orderkey % 2 = 0"), "label",
        "p", ["commit_sha", *_IDENTITY], 0.3, 0.95)


@query("acceptance_table", "J12", sql(f"""
    WITH m AS (SELECT sum(label) FILTER (WHERE p >= 0.05) / CAST(sum(label) AS DOUBLE) AS rec,
               count(*) FILTER (WHERE p >= 0.05) / CAST(count(*) AS DOUBLE) AS rate FROM scored)
    SELECT metric, {r('target')} AS target, {r('measured')} AS measured, direction,
           CAST(passed AS BIGINT) AS passed, CAST(0 AS BIGINT) AS all_passed FROM (
      SELECT 'recall' AS metric, 0.92 AS target, rec AS measured, 'ge' AS direction,
             rec >= 0.92 AS passed FROM m UNION ALL
      SELECT 'selection_rate', 0.4, rate, 'le', rate <= 0.4 FROM m UNION ALL
      SELECT 'coverage', 0.95, rec, 'ge', rec >= 0.95 FROM m UNION ALL
      SELECT 'cost_reduction', 0.6, 1 - rate, 'ge', 1 - rate >= 0.6 FROM m UNION ALL
      SELECT 'ece', 0.08, NULL, 'le', NULL FROM m) x""", "scored"))
def _(t: Tables):
    rows = t.scored.select("label", (F.col("p") >= 0.05).alias("selected"))
    measured = metrics.selection_metrics(rows, "label", "selected")
    return selection.acceptance_table(measured, [
        ("recall", "empirical_coverage", 0.92, "ge"), ("selection_rate", "selection_rate", 0.4, "le"),
        ("coverage", "empirical_coverage", 0.95, "ge"),
        ("cost_reduction", "cost_reduction", 0.6, "ge"), ("ece", "ece", 0.08, "le")])


_OBSERVED = """SELECT l_orderkey AS mutant, l_partkey AS test_id,
        CASE l_returnflag WHEN 'R' THEN CASE WHEN l_quantity > 25 THEN 'FAILED' ELSE 'ERROR' END
             WHEN 'A' THEN 'PASSED' ELSE 'SKIPPED' END AS status
    FROM lineitem WHERE l_discount > 0.01"""
_FLAGS = """SELECT o_orderkey AS mutant, o_custkey % 11 = 0 AS timed_out,
        o_custkey % 13 <> 0 AS timeout_enforced FROM orders"""


@query("run_status", "J13", f"""
    WITH o AS (SELECT mutant, test_id, max(status) AS status FROM ({_OBSERVED}) x GROUP BY 1, 2),
    u AS (SELECT DISTINCT l_orderkey AS mutant, l_partkey AS test_id FROM lineitem),
    c AS (SELECT u.mutant, count(*) AS n, count(*) FILTER (WHERE status IS NULL OR status IN
          ('FAILED', 'ERROR')) AS k, count(*) FILTER (WHERE status IS NULL) AS m,
          count(*) FILTER (WHERE status = 'SKIPPED') AS s
          FROM u LEFT JOIN o ON u.mutant = o.mutant AND u.test_id = o.test_id GROUP BY 1)
    SELECT f.mutant, n AS universe_size, k AS n_killed, m AS n_missing, s AS n_skipped,
           {r('k / CAST(n AS DOUBLE)')} AS kill_ratio,
           CASE WHEN NOT timeout_enforced THEN 'timeout_broken' WHEN timed_out THEN 'timed_out'
                WHEN k / CAST(n AS DOUBLE) >= 0.8 THEN 'broke_suite' ELSE 'harvested' END AS status
    FROM ({_FLAGS}) f JOIN c ON f.mutant = c.mutant""")
def _(t: Tables):
    universe = t.lineitem.select(F.col("l_orderkey").alias("mutant"),
                                 F.col("l_partkey").alias("test_id"))
    return policy.run_status(universe, t.select(_OBSERVED, "lineitem"), "mutant", "test_id",
                             "status", t.select(_FLAGS, "orders"), 0.8)


_DEFECTS = """SELECT o_orderkey AS bug, o_custkey % 13 <> 0 AS timeout_enforced,
        o_custkey % 11 = 0 AS timed_out, o_custkey % 7 AS n_collected, o_custkey % 5 AS n_documented,
        o_custkey % 3 AS n_not_in_universe, o_custkey % 2 AS n_not_failing FROM orders"""


@query("defect_status", "J14", f"""
    WITH d AS ({_DEFECTS}),
    s AS (SELECT *, CASE WHEN NOT timeout_enforced THEN 'timeout_broken'
        WHEN timed_out THEN 'timed_out' WHEN n_collected = 0 THEN 'collection_failed'
        WHEN n_documented = 0 THEN 'no_documented_tests'
        WHEN n_not_in_universe > 0 OR n_not_failing > 0 THEN 'documented_mismatch'
        ELSE 'harvested' END AS status FROM d)
    SELECT bug, status, CASE status WHEN 'timeout_broken' THEN 'the suite timeout did not hold'
        WHEN 'timed_out' THEN 'the defect run exceeded its time limit'
        WHEN 'collection_failed' THEN 'nothing was collected'
        WHEN 'no_documented_tests' THEN 'no readable documented test'
        WHEN 'documented_mismatch' THEN CASE WHEN n_not_in_universe > 0
             THEN 'documented test absent from the measured universe'
             ELSE 'documented test did not fail' END END AS reason FROM s""")
def _(t: Tables):
    return policy.defect_status(t.select(_DEFECTS, "orders")).select("bug", "status", "reason")


_SUBJECTS = """SELECT c_custkey AS subject,
        CASE c_custkey % 17 WHEN 0 THEN 'suite_timeout' WHEN 1 THEN 'no_tests_collected' END
            AS exit_reason, CASE WHEN c_custkey % 19 = 0 THEN 0 ELSE
            CAST(floor(abs(c_acctbal)) AS BIGINT) % 1500 END AS n_collected,
        c_nationkey * CAST(0.7 AS DOUBLE) AS suite_seconds, c_custkey % 30 AS n_flaky,
        c_custkey % 23 AS n_failing, c_custkey % 7 AS n_varying FROM customer"""


@query("screen_gates", "J15", f"""
    WITH s AS (SELECT *, suite_seconds * 250 / 3600.0 AS h, n_collected - n_flaky - n_failing AS st
               FROM ({_SUBJECTS}) x),
    g AS (SELECT *, CASE WHEN exit_reason IS NOT NULL THEN exit_reason
        WHEN n_collected = 0 THEN 'collected_zero_tests' WHEN n_collected < 50 THEN 'too_few_tests'
        WHEN n_collected > 1200 THEN 'too_many_tests' WHEN h > 1 THEN 'harvest_too_expensive'
        WHEN st < 50 THEN 'too_few_stable_tests' WHEN n_varying < 3 THEN 'too_few_varying_features'
        END AS rejection FROM s)
    SELECT subject, {r('h')} AS harvest_hours, st AS n_stable, rejection,
           CAST(rejection IS NULL AS BIGINT) AS passed FROM g""")
def _(t: Tables):
    out = policy.screen_gates(t.select(_SUBJECTS, "customer"))
    return out.select("subject", "harvest_hours", "n_stable", "rejection", "passed")
