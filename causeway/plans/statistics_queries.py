"""Registered queries: splits, effect sizes, paired tests and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import selection, split, statistics
from .catalog import Tables, query, r, sql


def _cut_sql(mode: str) -> str:
    start = "min(ts)" if mode == "min" else "arg_min(ts, (l_linenumber, test_id, commit_sha))"
    floor = "0" if mode == "min" else "1"
    return f"""
    WITH g AS (SELECT l_orderkey, {start} AS s, count(*) AS rows_ FROM scored GROUP BY 1),
    k AS (SELECT *, row_number() OVER (ORDER BY s, l_orderkey) AS rk, count(*) OVER () AS n FROM g),
    c AS (SELECT *, greatest({floor}, CAST(floor(n * 0.7::DOUBLE) AS BIGINT)) AS a,
          greatest({floor}, CAST(floor(n * 0.15::DOUBLE) AS BIGINT)) AS b FROM k)
    SELECT l_orderkey, CASE WHEN rk <= a THEN 'train' WHEN rk <= a + b THEN 'val' ELSE 'test' END
           AS split, rows_ AS n FROM c"""


@query("temporal_group_split", "F9", sql(_cut_sql("min"), "scored"))
def _(t: Tables):
    out = split.temporal_group_split(t.scored, "l_orderkey", "ts")
    return out.groupBy("l_orderkey", "split").agg(F.count(F.lit(1)).alias("n"))


@query("temporal_group_split_first", "F9", sql("""
    WITH g AS (SELECT commit_sha, min(ts) AS s, count(*) AS rows_ FROM runs GROUP BY 1),
    k AS (SELECT *, row_number() OVER (ORDER BY s, commit_sha) AS rk, count(*) OVER () AS n FROM g),
    c AS (SELECT *, greatest(1, CAST(floor(n * 0.7::DOUBLE) AS BIGINT)) AS a,
          greatest(1, CAST(floor(n * 0.15::DOUBLE) AS BIGINT)) AS b FROM k)
    SELECT commit_sha, CASE WHEN rk <= a THEN 'train' WHEN rk <= a + b THEN 'val' ELSE 'test' END
           AS split, rows_ AS n FROM c""", "runs"))
def _(t: Tables):
    out = split.temporal_group_split(t.runs, "commit_sha", "ts", mode="first", ties=["ts", "event_id"])
    return out.groupBy("commit_sha", "split").agg(F.count(F.lit(1)).alias("n"))


@query("ordered_fraction_split", "F10", sql("""
    WITH k AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rk, count(*) OVER () AS n FROM runs)
    SELECT event_id, CASE WHEN rk <= CAST(floor(n * 0.7::DOUBLE) AS BIGINT) THEN 'train'
           WHEN rk <= CAST(floor(n * 0.7::DOUBLE) AS BIGINT) + CAST(floor(n * 0.15::DOUBLE) AS BIGINT)
           THEN 'val' ELSE 'test' END AS split FROM k""", "runs"))
def _(t: Tables):
    rows = t.runs.select("event_id", "ts")
    return split.ordered_fraction_split(rows, [F.col("ts"), F.col("event_id")]).select(
        "event_id", "split")


@query("group_shuffle_split", "F11", sql("""
    WITH g AS (SELECT DISTINCT repo, l_orderkey, concat(CAST(repo AS STRING), '::', CAST(l_orderkey AS STRING))
               AS q FROM scored),
    k AS (SELECT *, row_number() OVER (ORDER BY md5(concat('42:', q)), q) AS rk, count(*) OVER () AS n FROM g)
    SELECT repo, l_orderkey, CASE WHEN rk <= CAST(floor(n * 0.85::DOUBLE) AS BIGINT) THEN 'fit'
           ELSE 'calibration' END AS split FROM k""", "scored"))
def _(t: Tables):
    out = split.group_shuffle_split(t.scored, "repo", "l_orderkey", "label")
    return out.select("repo", "l_orderkey", "split").distinct()


@query("balanced_cluster_halves", "F12", sql("""
    WITH RECURSIVE c AS (SELECT commit_sha, min(l_orderkey) AS f, count(*) AS n FROM scored GROUP BY 1),
    k AS (SELECT *, row_number() OVER (ORDER BY f, commit_sha) AS rk, count(*) OVER () AS kk,
          sum(n) OVER () * 0.5 AS target FROM c),
    w AS (SELECT rk, commit_sha, n, n AS assigned, true AS fit FROM k WHERE rk = 1
          UNION ALL SELECT k.rk, k.commit_sha, k.n, CASE WHEN k.rk < kk AND w.assigned + k.n / 2.0 <= target
          THEN w.assigned + k.n ELSE w.assigned END, k.rk < kk AND w.assigned + k.n / 2.0 <= target
          FROM w JOIN k ON k.rk = w.rk + 1)
    SELECT commit_sha, CAST(fit AS BIGINT) AS fit, n FROM w""", "scored"))
def _(t: Tables):
    out = split.balanced_cluster_halves(t.scored, "commit_sha", F.col("l_orderkey"))
    return out.groupBy("commit_sha", "fit").agg(F.count(F.lit(1)).alias("n"))


@query("stratified_round_robin", "F18", """
    WITH k AS (SELECT p_partkey AS id, p_brand AS family, row_number() OVER (PARTITION BY p_brand
               ORDER BY md5(concat('7:', CAST(p_partkey AS STRING))), p_partkey) AS rk FROM part)
    SELECT id, family FROM k ORDER BY rk, family, id LIMIT 333""")
def _(t: Tables):
    rows = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("family"))
    return split.stratified_round_robin(rows, 333, "family", "id", 7)


_XY = """SELECT l_suppkey % 20 AS grp, l_suppkey, l_orderkey, l_partkey, l_linenumber,
    CASE WHEN l_linenumber <> 3 THEN l_quantity END AS x,
    CASE WHEN l_linenumber <> 5 THEN l_quantity + l_suppkey % 20 - 10 + l_linenumber - 4 END AS y
    FROM lineitem"""


@query("cliffs_delta", "L1", f"""
    WITH d AS ({_XY}),
    v AS (SELECT grp, x AS v, 1 AS nx, 0 AS ny FROM d WHERE x IS NOT NULL UNION ALL
          SELECT grp, y, 0, 1 FROM d WHERE y IS NOT NULL),
    c AS (SELECT grp, v, sum(nx) AS nx, sum(ny) AS ny FROM v GROUP BY 1, 2),
    w AS (SELECT *, coalesce(sum(nx) OVER p, 0) AS bx, coalesce(sum(ny) OVER p, 0) AS by_ FROM c
          WINDOW p AS (PARTITION BY grp ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    s AS (SELECT grp, sum(CAST(nx * by_ AS DOUBLE) - CAST(ny * bx AS DOUBLE))
          / (CAST(sum(nx) AS DOUBLE) * CAST(sum(ny) AS DOUBLE)) AS d FROM w GROUP BY grp)
    SELECT grp, round(d, 4) AS cliffs_delta, CASE WHEN abs(d) < 0.147 THEN 'Negligible'
           WHEN abs(d) < 0.33 THEN 'Small' WHEN abs(d) < 0.474 THEN 'Medium' ELSE 'Large' END AS magnitude
    FROM s""")
def _(t: Tables):
    return statistics.cliffs_delta(t.select(_XY, "lineitem"), "x", "y", ["grp"])


@query("cliffs_delta_global", "L1", f"""
    WITH v AS (SELECT x AS v, 1 AS nx, 0 AS ny FROM ({_XY}) d WHERE x IS NOT NULL UNION ALL
          SELECT y, 0, 1 FROM ({_XY}) d WHERE y IS NOT NULL),
    c AS (SELECT v, sum(nx) AS nx, sum(ny) AS ny FROM v GROUP BY 1),
    w AS (SELECT *, coalesce(sum(nx) OVER p, 0) AS bx, coalesce(sum(ny) OVER p, 0) AS by_ FROM c
          WINDOW p AS (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    s AS (SELECT sum(CAST(nx * by_ AS DOUBLE) - CAST(ny * bx AS DOUBLE))
          / (CAST(sum(nx) AS DOUBLE) * CAST(sum(ny) AS DOUBLE)) AS d FROM w)
    SELECT round(d, 4) AS cliffs_delta, CASE WHEN abs(d) < 0.147 THEN 'Negligible'
           WHEN abs(d) < 0.33 THEN 'Small' WHEN abs(d) < 0.474 THEN 'Medium' ELSE 'Large' END AS magnitude
    FROM s""")
def _(t: Tables):
    return statistics.cliffs_delta(t.select(_XY, "lineitem"), "x", "y")


_RANK_SUMS = f"""
    WITH d AS (SELECT l_suppkey AS grp, x - y AS d FROM ({_XY}) q),
    k AS (SELECT grp, abs(d) AS m, count(*) FILTER (WHERE d > 0) AS p, count(*) FILTER (WHERE d < 0) AS q
          FROM d WHERE d <> 0 GROUP BY 1, 2),
    r AS (SELECT *, p + q AS c, coalesce(sum(p + q) OVER (PARTITION BY grp ORDER BY m ROWS BETWEEN UNBOUNDED
          PRECEDING AND 1 PRECEDING), 0) + (p + q + 1) / CAST(2 AS DOUBLE) AS rk FROM k),
    s AS (SELECT grp, CAST(sum(c) AS BIGINT) AS n, sum(p * rk) AS wp, sum(q * rk) AS wm,
          sum(CAST(c * c * c - c AS DOUBLE)) AS ties FROM r GROUP BY grp),
    z AS (SELECT grp, count(d) AS n_pairs FROM d GROUP BY grp)"""


@query("signed_rank_statistic", "L2", f"""{_RANK_SUMS}
    SELECT z.grp, n_pairs, coalesce(n, 0) AS n_nonzero, {r('coalesce(wp, 0)')} AS w_plus,
           {r('coalesce(wm, 0)')} AS w_minus, {r('coalesce(ties, 0)')} AS ties
    FROM z LEFT JOIN s ON z.grp = s.grp""")
def _(t: Tables):
    rows = t.select(_XY, "lineitem").withColumn("grp", F.col("l_suppkey"))
    return statistics.signed_rank_statistic(rows, "x", "y", ["grp"])


# The normal tail by Simpson's rule over 400 steps; beyond 12 deviations it is nothing.
@query("wilcoxon_signed_rank", "L2", f"""{_RANK_SUMS},
    w AS (SELECT z.grp, n_pairs, coalesce(n, 0) AS n, least(wp, wm) AS w, least(abs(least(wp, wm) - n * (n + 1) / 4.0)
          / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0), 12) / 400 AS h
          FROM z LEFT JOIN s ON z.grp = s.grp),
    t AS (SELECT *, 1 - sqrt(2 / pi()) * h / 3 * list_sum([CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
          * exp(-(i * h) * (i * h) / 2) FOR i IN range(0, 401)]) AS p FROM w)
    SELECT grp, n_pairs, {r('CASE WHEN n >= 5 THEN round(w, 4) ELSE 0 END')} AS w_statistic,
           {r('CASE WHEN n >= 5 THEN round(greatest(p, 0), 5) ELSE 1 END')} AS p_value,
           CAST(n >= 5 AND round(greatest(p, 0), 5) < 0.05 AS BIGINT) AS significant FROM t""")
def _(t: Tables):
    rows = t.select(_XY, "lineitem").withColumn("grp", F.col("l_suppkey"))
    return statistics.wilcoxon_signed_rank(rows, "x", "y", ["grp"], "normal")


def _strategy_stats(t: Tables):
    rows = t.scored.select(
        F.col("l_orderkey").alias("commit_sha"), "label", "duration", F.lit(False).alias("abstained"),
        F.inline(F.array(*[
            F.struct(F.lit(name).alias("strategy"), mask.alias("selected"))
            for name, mask in (("loose", F.col("p") >= 0.3), ("strict", F.col("p") >= 0.7),
                               ("certain", F.col("uncertainty") <= 0.02))])))
    return selection.strategy_commit_stats(
        rows, "commit_sha", "strategy", "label", "selected", "duration", "abstained")


_PRIME = statistics._PRIME


def _drawn(base: str, rep: str, number: str, bound: str) -> str:
    """Select items of ``statistics.draw`` in steps; the last one is the draw, named ``drawn``."""
    steps, state = [], base
    for i, added in enumerate((rep, f"({number}) // 65536", f"({number}) % 65536", "12345")):
        steps.append(f"({state} + {added}) % {_PRIME} AS a{i}, a{i} * a{i} % {_PRIME} * a{i} % {_PRIME} AS b{i}")
        state = f"b{i}"
    steps.append(f"(b3 + ({number}) % 65536 + 777) % {_PRIME} AS a4, a4 * a4 % {_PRIME} * a4 % {_PRIME} AS b4")
    steps.append(f"(b4 + 12345) % {_PRIME} AS a5, a5 * a5 % {_PRIME} * a5 % {_PRIME} AS b5")
    return ", ".join([*steps, f"(b3 * {_PRIME} + b5) % ({bound}) AS drawn"])


def _resampled(replicates: int, seed: int = 42, block: int = statistics.BLOCK_UNITS) -> str:
    """Common table expressions behind ``units (unit)``: ``times (rep, unit, w)`` and ``size (n)``."""
    cube = lambda x: f"({x}) * ({x}) % {_PRIME} * ({x}) % {_PRIME}"
    first = statistics._cube(seed)
    return f"""
    numbered AS (SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS u FROM units),
    size AS (SELECT count(*) AS n FROM units),
    every AS (SELECT rep, unnest(range(n)) AS num, n FROM range({replicates}) r(rep), size),
    first_draws AS (SELECT rep, {_drawn(str(first), 'rep', 'num', 'n')} FROM every),
    blocks AS (SELECT rep, drawn // {block} AS blk, count(*) AS c FROM first_draws GROUP BY 1, 2),
    inner_draws AS (SELECT rep, blk, unnest(range(c)) AS num,
                    {cube(f'({seed} + 1 + blk) % {_PRIME}')} AS base FROM blocks),
    placed AS (SELECT rep, blk, {_drawn('base', 'rep', 'num', f'least({block}, n - blk * {block})')}
               FROM inner_draws, size),
    times AS (SELECT p.rep, m.unit, count(*) AS w FROM placed p JOIN numbered m ON m.u = blk * {block} + drawn
              GROUP BY 1, 2)"""


@query("bootstrap_ci", "L3", f"""
    WITH units AS (SELECT c_custkey AS unit FROM customer WHERE c_acctbal IS NOT NULL), {_resampled(1000)},
    m AS (SELECT rep, sum(w * c_acctbal) / sum(w) AS v FROM times JOIN customer ON unit = c_custkey GROUP BY rep),
    p AS (SELECT avg(c_acctbal) AS mean, count(c_acctbal) AS n, quantile_cont(c_acctbal, 0.5) AS median FROM customer)
    SELECT {r('max(mean)')} AS mean, max(n) AS n, {r('max(median)')} AS median,
           {r('quantile_cont(v, 0.025)')} AS ci_lower, {r('quantile_cont(v, 0.975)')} AS ci_upper FROM m, p""")
def _(t: Tables):
    return statistics.bootstrap_ci(t.customer, ["c_custkey"], "c_acctbal")


_METRIC_SQL = """
    SELECT {keys}, unnest(['trr', 'etr', 'fr', 'mfr', 'ar']) AS metric, unnest([
        100 - 100.0 * sum(w * ts) / sum(w * ta), CASE WHEN sum(w * da) > 0 THEN 100 - 100.0 * sum(w * ds) / sum(w * da) END,
        CASE WHEN sum(w * fa) > 0 THEN 100.0 * sum(w * fd) / sum(w * fa) END,
        CASE WHEN sum(w * fa) > 0 THEN 100 - 100.0 * sum(w * fd) / sum(w * fa) END, CAST(0 AS DOUBLE)]) AS value
    FROM {source} GROUP BY {keys}"""
_STRATEGY_SQL = f"""
    WITH cells AS (
        SELECT l_orderkey AS unit, strategy, count(*) AS ta, count(*) FILTER (sel) AS ts,
               count(*) FILTER (label = 1) AS fa, count(*) FILTER (label = 1 AND sel) AS fd,
               sum(duration) AS da, coalesce(sum(duration) FILTER (sel), 0) AS ds
        FROM (SELECT *, unnest(['loose', 'strict', 'certain']) AS strategy,
                     unnest([p >= 0.3, p >= 0.7, uncertainty <= 0.02]) AS sel FROM scored) GROUP BY 1, 2),
    units AS (SELECT DISTINCT unit FROM cells), {_resampled(2000)},
    v AS ({_METRIC_SQL.format(keys='rep, strategy', source='times JOIN cells USING (unit)')}),
    pt AS ({_METRIC_SQL.format(keys='strategy', source='(SELECT *, 1 AS w FROM cells)')}),"""


@query("cluster_bootstrap", "L4", sql(f"""{_STRATEGY_SQL}
    i AS (SELECT strategy, metric, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high,
                 count(value) AS known FROM v GROUP BY 1, 2)
    SELECT strategy, metric, {r('value')} AS point, {r('low')} AS ci_lower, {r('high')} AS ci_upper,
           2000 - known AS undefined_replicates, n AS n_units
    FROM pt JOIN i USING (strategy, metric), size""", "scored"))
def _(t: Tables):
    table, _diffs = statistics.cluster_bootstrap(_strategy_stats(t), reference="loose")
    return table


@query("cluster_bootstrap_differences", "L4", sql(f"""{_STRATEGY_SQL}
    d AS (SELECT a.strategy, a.metric, a.value - b.value AS value FROM v a JOIN v b USING (rep, metric)
          WHERE a.strategy <> 'loose' AND b.strategy = 'loose'),
    i AS (SELECT strategy, metric, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high,
                 count(value) AS known FROM d GROUP BY 1, 2)
    SELECT a.strategy, a.metric, {r('a.value - b.value')} AS point, {r('low')} AS ci_lower,
           {r('high')} AS ci_upper, 2000 - known AS undefined_replicates,
           CAST(coalesce(low > 0 OR high < 0, FALSE) AS BIGINT) AS excludes_zero
    FROM pt a JOIN pt b USING (metric) JOIN i ON i.strategy = a.strategy AND i.metric = a.metric
    WHERE a.strategy <> 'loose' AND b.strategy = 'loose'""", "scored"))
def _(t: Tables):
    _table, diffs = statistics.cluster_bootstrap(_strategy_stats(t), reference="loose")
    return diffs


def _cell(point: str, low: str, high: str) -> str:
    """DuckDB text of ``format_interval`` with one digit and a percent sign."""
    fixed = lambda x: (f"printf('%.1f', CASE WHEN {x} < 0 THEN -round_even(-{x}, 1) "  # noqa: E731
                       f"ELSE round_even({x}, 1) END)")
    return (f"CASE WHEN {point} IS NULL THEN 'n/a' WHEN {low} IS NULL OR {high} IS NULL "
            f"THEN {fixed(point)} || '% [no interval]' "
            f"ELSE {fixed(point)} || '% [' || {fixed(low)} || ', ' || {fixed(high)} || ']' END")


@query("interval_table", "L5", sql(f"""{_STRATEGY_SQL}
    i AS (SELECT strategy, metric, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high
          FROM v GROUP BY 1, 2),
    c AS (SELECT strategy, metric, {_cell('value', 'low', 'high')} AS cell FROM pt JOIN i USING (strategy, metric)),
    d AS (SELECT a.strategy, quantile_cont(a.value - b.value, 0.025) AS low,
                 quantile_cont(a.value - b.value, 0.975) AS high FROM v a JOIN v b USING (rep, metric)
          WHERE a.strategy <> 'loose' AND b.strategy = 'loose' AND metric = 'fr' GROUP BY 1),
    e AS (SELECT a.strategy, a.value - b.value AS value, low, high FROM pt a JOIN d USING (strategy), pt b
          WHERE a.metric = 'fr' AND b.metric = 'fr' AND b.strategy = 'loose')
    SELECT c.strategy, """ + ", ".join(
        f"max(CASE WHEN metric = '{m}' THEN cell END) AS {m}" for m in statistics.METRICS) + f""",
           coalesce(max(CASE WHEN e.strategy IS NOT NULL THEN {_cell('e.value', 'e.low', 'e.high')}
           || CASE WHEN e.low > 0 OR e.high < 0 THEN ' *' ELSE '' END END),
                    'reference') AS fr_vs_reference
    FROM c LEFT JOIN e ON c.strategy = e.strategy GROUP BY c.strategy""", "scored"))
def _(t: Tables):
    table, diffs = statistics.cluster_bootstrap(_strategy_stats(t), reference="loose")
    return statistics.interval_table(table, diffs)


@query("significance_report", "L6")
def _(t: Tables):
    return statistics.significance_report(_strategy_stats(t), "loose", {
        "failure_recall": ("failures_detected", "failures_available"),
        "time_saved": ("duration_selected", "duration_available")})


def _calibrated(t: Tables):
    return t.scored.select(
        F.col("l_orderkey").alias("cluster"), "label", F.inline(F.array(*[
            F.struct(F.lit(name).alias("method"), p.alias("p")) for name, p in (
                ("uncalibrated", F.col("p")), ("shrunk", F.lit(0.33) + (F.col("p") - 0.5) * 0.1),
                ("squared", F.col("p") * F.col("p")))])))


_EDGES = " + ".join(f"(p > {b * 0.1:.17e})::INT" for b in range(1, 10))
_BIN_SQL = """
    SELECT {keys}, unnest(['ece', 'mce', 'brier']) AS metric, unnest([sum(n * gap) / sum(n), max(gap), sum(sq) / sum(n)]) AS value
    FROM (SELECT {keys}, bin, sum(w * n) AS n, abs(sum(w * y) / sum(w * n) - sum(w * p) / sum(w * n)) AS gap,
                 sum(w * sq) AS sq FROM {source} GROUP BY {keys}, bin) GROUP BY {keys}"""
_CALIBRATED_SQL = f"""
    WITH rows_ AS (
        SELECT l_orderkey AS unit, label, unnest(['uncalibrated', 'shrunk', 'squared']) AS method,
               unnest([p, 0.33 + (p - 0.5) * 0.1, p * p]) AS p FROM scored),
    cells AS (SELECT unit, method, {_EDGES} AS bin, count(*) AS n, sum(label) AS y, sum(p) AS p,
                     sum((label - p) * (label - p)) AS sq FROM rows_ GROUP BY 1, 2, 3),
    units AS (SELECT DISTINCT unit FROM cells), {_resampled(2000)},
    v AS ({_BIN_SQL.format(keys='rep, method', source='times JOIN cells USING (unit)')}),
    pt AS ({_BIN_SQL.format(keys='method', source='(SELECT *, 1 AS w FROM cells)')}),
    d AS (SELECT a.method, a.metric, a.value - b.value AS value FROM v a JOIN v b USING (rep, metric)
          WHERE a.method <> 'uncalibrated' AND b.method = 'uncalibrated'),
    i AS (SELECT method, metric, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high,
                 count(value) AS known FROM d GROUP BY 1, 2)"""


@query("score_calibrators", "L7", sql(f"""{_CALIBRATED_SQL}
    SELECT a.method, a.metric, {r('a.value - b.value')} AS point, {r('low')} AS ci_lower,
           {r('high')} AS ci_upper, 2000 - known AS undefined_replicates,
           CAST(coalesce(low > 0 OR high < 0, FALSE) AS BIGINT) AS excludes_zero
    FROM pt a JOIN pt b USING (metric) JOIN i ON i.method = a.method AND i.metric = a.metric
    WHERE a.method <> 'uncalibrated' AND b.method = 'uncalibrated'""", "scored"))
def _(t: Tables):
    _points, diffs = statistics.score_calibrators(_calibrated(t), "cluster", "method", "label", "p")
    return diffs


@query("select_calibrator", "L8", sql("""
    WITH m AS (SELECT 'uncalibrated' AS method, label, p FROM scored UNION ALL
               SELECT 'shrunk', label, 0.33 + (p - 0.5) * 0.1 FROM scored UNION ALL
               SELECT 'squared', label, p * p FROM scored),
    b AS (SELECT method, """ + " + ".join(
        f"CASE WHEN p > {b * 0.1:.17e} THEN 1 ELSE 0 END" for b in range(1, 10)) + f""" AS bin,
          count(*) AS n, abs(avg(label) - avg(p)) AS gap, sum((label - p) * (label - p)) AS sq
          FROM m GROUP BY 1, 2),
    s AS (SELECT method, sum(n * gap) / sum(n) AS ece, max(gap) AS mce, sum(sq) / sum(n) AS brier
          FROM b GROUP BY 1),
    j AS (SELECT s.*, CASE WHEN s.method = 'uncalibrated' THEN 'baseline' WHEN s.mce > u.mce + 0.1
          THEN 'mce_worse' WHEN s.brier > u.brier + 0.01 THEN 'brier_worse' WHEN s.ece >= u.ece
          THEN 'no_ece_gain' ELSE 'eligible' END AS verdict FROM s, s u WHERE u.method = 'uncalibrated')
    SELECT method, {r('ece')} AS ece, {r('mce')} AS mce, {r('brier')} AS brier, verdict,
           CAST(method = coalesce((SELECT method FROM j WHERE verdict = 'eligible'
               ORDER BY ece, mce, brier, method LIMIT 1), 'uncalibrated') AS BIGINT) AS chosen FROM j""",
    "scored"))
def _(t: Tables):
    points, _diffs = statistics.score_calibrators(
        _calibrated(t), "cluster", "method", "label", "p", replicates=1)
    return statistics.select_calibrator(statistics.calibrator_scores(points, None, "method"))


_THREE = ("ece", "mce", "brier")


@query("select_calibrator_intervals", "L8", sql(f"""{_CALIBRATED_SQL},
    w AS (SELECT method, """ + ", ".join(
        f"max(CASE WHEN metric = '{m}' THEN value END) AS {m}" for m in _THREE) + """ FROM pt GROUP BY method),
    x AS (SELECT a.method, a.metric, a.value - b.value AS gap,
                 CAST(coalesce(low > 0 OR high < 0, FALSE) AS BIGINT) AS clear
          FROM pt a JOIN pt b USING (metric) JOIN i ON i.method = a.method AND i.metric = a.metric
          WHERE b.method = 'uncalibrated'),
    g AS (SELECT method, """ + ", ".join(
        f"max(CASE WHEN metric = '{m}' THEN gap END) AS {m}_gap, max(CASE WHEN metric = '{m}' THEN clear END) AS {m}_clear"
        for m in _THREE) + """ FROM x GROUP BY method),
    j AS (SELECT w.*, g.* EXCLUDE (method), CASE WHEN w.method = 'uncalibrated' THEN 'baseline'
          WHEN mce_gap > 0 AND mce_clear = 1 THEN 'mce_worse' WHEN brier_gap > 0 AND brier_clear = 1 THEN 'brier_worse'
          WHEN NOT coalesce(ece_gap < 0 AND ece_clear = 1, FALSE) THEN 'no_ece_gain' ELSE 'eligible' END AS verdict
          FROM w LEFT JOIN g ON w.method = g.method)
    SELECT method, """ + ", ".join(f"{r(m)} AS {m}, {r(m + '_gap')} AS {m}_gap, {m}_clear" for m in _THREE) + """, verdict,
           CAST(method = coalesce((SELECT method FROM j WHERE verdict = 'eligible'
               ORDER BY ece, mce, brier, method LIMIT 1), 'uncalibrated') AS BIGINT) AS chosen FROM j""", "scored"))
def _(t: Tables):
    points, diffs = statistics.score_calibrators(_calibrated(t), "cluster", "method", "label", "p")
    return statistics.select_calibrator(statistics.calibrator_scores(points, diffs, "method"))


@query("user_bootstrap", "N2", sql(f"""
    WITH units AS (SELECT DISTINCT commit_sha AS unit FROM scored), {_resampled(2000)},
    cells AS (SELECT commit_sha AS unit, count(*) AS c, sum(p) AS sp, sum(p * p) AS qp, sum(label) AS sl, sum(label * p) AS xl
              FROM scored GROUP BY 1),
    sums AS (SELECT rep, sum(w * c) AS c, sum(w * sp) AS sp, sum(w * qp) AS qp, sum(w * sl) AS sl, sum(w * xl) AS xl
             FROM times JOIN cells USING (unit) GROUP BY rep),
    v AS (SELECT unnest(['mean_p', 'rate', 'spread', 'correlation']) AS statistic,
                 unnest([sp / c, sl / c, sqrt((qp - sp * sp / c) / (c - 1)),
                        (c * xl - sp * sl) / sqrt((c * qp - sp * sp) * (c * sl - sl * sl))]) AS value FROM sums),
    pt AS (SELECT unnest(['mean_p', 'rate', 'spread', 'correlation']) AS statistic,
                  unnest([avg(p), avg(label), stddev_samp(p), corr(p, label)]) AS point FROM scored)
    SELECT statistic, {r('max(point)')} AS point, {r('quantile_cont(value, 0.025)')} AS ci_lower,
           {r('quantile_cont(value, 0.975)')} AS ci_upper, 2000 - count(value) AS undefined_replicates,
           max(n) AS n_units
    FROM v JOIN pt USING (statistic), size GROUP BY statistic""", "scored"))
def _(t: Tables):
    return statistics.bootstrap(
        t.scored.select("commit_sha", "p", "label"), ["commit_sha"],
        {"mean_p": statistics.mean_of("p"), "rate": statistics.mean_of("label"),
         "spread": statistics.spread_of("p"), "correlation": statistics.correlation_of("p", "label")})


@query("user_bootstrap_moments", "N2", sql(f"""
    WITH units AS (SELECT DISTINCT commit_sha AS unit FROM scored), {_resampled(2000)},
    cells AS (SELECT commit_sha AS unit, count(*) AS c, sum(p) AS sp, sum(p * p) AS qp, sum(label) AS sl
              FROM scored GROUP BY 1),
    sums AS (SELECT rep, sum(w * c) AS c, sum(w * sp) AS sp, sum(w * qp) AS qp, sum(w * sl) AS sl
             FROM times JOIN cells USING (unit) GROUP BY rep),
    v AS (SELECT unnest(['mean_p', 'rate', 'spread']) AS statistic,
                 unnest([sp / c, sl / c, sqrt((qp - sp * sp / c) / (c - 1))]) AS value FROM sums),
    pt AS (SELECT unnest(['mean_p', 'rate', 'spread']) AS statistic,
                  unnest([avg(p), avg(label), stddev_samp(p)]) AS point FROM scored)
    SELECT statistic, {r('max(point)')} AS point, {r('quantile_cont(value, 0.025)')} AS ci_lower,
           {r('quantile_cont(value, 0.975)')} AS ci_upper, 2000 - count(value) AS undefined_replicates,
           max(n) AS n_units
    FROM v JOIN pt USING (statistic), size GROUP BY statistic""", "scored"))
def _(t: Tables):
    return statistics.bootstrap_moments(
        t.scored.select("commit_sha", "p", "label"), ["commit_sha"],
        {"mean_p": "p", "rate": "label"}, {"spread": "p"})
