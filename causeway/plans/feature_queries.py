"""Registered queries: change, cross and message features, scalar functions and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import features
from .catalog import Tables, query, r, sql

# Observation rows: every changed file of an order as one row, under a file-like path.
_ROWS = """SELECT f.commit_sha, f.l_linenumber, f.l_suppkey, f.lines_added, f.lines_deleted,
        concat(CASE WHEN f.l_suppkey % 3 = 0 THEN 'tests/' ELSE 'src/' END,
               replace(f.path, ' ', '_'), CASE f.l_linenumber WHEN 1 THEN '.yaml' WHEN 2 THEN '.md'
               WHEN 3 THEN '' ELSE '.py' END) AS path,
        concat(c.repo, CASE c.message WHEN 'F' THEN ' fix' WHEN 'O' THEN ' refactor: clean!'
               ELSE '  prefix Patch?' END) AS message,
        c.author % 7 AS author, c.ts
    FROM changed_files f JOIN commits c ON c.sha = f.commit_sha"""


def _rows(t: Tables):
    return t.select(_ROWS, "changed_files", "commits")


@query("change_features", "E1 I8", sql(f"""
    WITH o AS (SELECT *, f.author AS who FROM ({_ROWS}) f),
    n AS (SELECT commit_sha, count(DISTINCT path) AS files_changed,
          count(DISTINCT who) AS authors_count,
          count(DISTINCT lower(regexp_extract(path, '([^.]*)$', 1))) AS num_file_extensions
          FROM o GROUP BY commit_sha)
    SELECT o.commit_sha, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_suppkey, path,
           files_changed, authors_count, num_file_extensions,
           {r('o.lines_added')} AS lines_added, {r('o.lines_deleted')} AS lines_removed,
           {r('o.lines_added + o.lines_deleted')} AS total_churn,
           length(message) AS commit_message_length,
           CAST(NOT contains(lower(path), 'test') AS BIGINT) AS has_source_change,
           CAST(contains(lower(path), 'test') AS BIGINT) AS has_test_change,
           CAST(regexp_matches(path, '\\.(ya?ml|toml|cfg|ini|json)$') AS BIGINT) AS has_config_change,
           hour(ts) AS hour_of_day, isodow(ts) - 1 AS day_of_week,
           CAST(isodow(ts) >= 6 AS BIGINT) AS is_weekend
    FROM o JOIN n ON o.commit_sha = n.commit_sha""", "changed_files", "commits"))
def _(t: Tables):
    out = features.change_features(_rows(t), "commit_sha", "path", "lines_added",
                                   "lines_deleted", "message", "author", "ts")
    return out.drop("lines_deleted", "message", "author", "ts")


@query("diff_features", "E2", sql(f"""
    WITH o AS ({_ROWS}),
    f AS (SELECT commit_sha, CAST(sum(lines_added) AS BIGINT) AS a,
          CAST(sum(lines_deleted) AS BIGINT) AS d, count(*) AS n,
          count(*) FILTER (WHERE contains(lower(path), 'test')) AS t,
          max(CASE WHEN path LIKE '%.py' THEN 1 ELSE 0 END) AS py,
          max(CASE WHEN path LIKE '%.yaml' THEN 1 ELSE 0 END) AS cf FROM o GROUP BY 1),
    m AS (SELECT DISTINCT commit_sha, message FROM o)
    SELECT m.commit_sha, a AS diff_lines_added, d AS diff_lines_deleted,
           a + d AS diff_total_churn, n AS diff_num_files_changed, t AS diff_num_test_files,
           n - t AS diff_num_src_files, CAST(py AS BIGINT) AS diff_has_python,
           CAST(cf AS BIGINT) AS diff_has_config, length(trim(message)) AS diff_msg_length,
           len(list_filter(regexp_split_to_array(message, '\\s+'), lambda w: w <> ''))
               AS diff_msg_word_count,
           CAST(regexp_matches(lower(message), 'fix|bug|patch') AS BIGINT) AS diff_is_fix_commit,
           CAST(regexp_matches(lower(message), 'refactor|clean|restructure') AS BIGINT)
               AS diff_is_refactor_commit
    FROM m JOIN f ON m.commit_sha = f.commit_sha""", "changed_files", "commits"))
def _(t: Tables):
    rows = _rows(t)
    messages = rows.select("commit_sha", "message").distinct()
    return features.diff_features(rows, messages, "commit_sha", "path", "lines_added",
                                  "lines_deleted", "message")


@query("diff_features_strict", "E3 I6", sql(f"""
    WITH o AS ({_ROWS}),
    c AS (SELECT *, path LIKE '%.py' AS py, regexp_matches(lower(path), '(^|/)test_[^/]*$')
          OR lower(path) LIKE '%\\_test.py' ESCAPE '\\' OR regexp_matches(lower(path), '(^|/)tests?/') AS tf
          FROM o),
    f AS (SELECT commit_sha, CAST(sum(lines_added) AS BIGINT) AS a,
          CAST(sum(lines_deleted) AS BIGINT) AS d, count(*) AS n,
          count(*) FILTER (WHERE py AND NOT tf) AS s, count(*) FILTER (WHERE py AND tf) AS t,
          max(CASE WHEN path LIKE '%.yaml' THEN 1 ELSE 0 END) AS cf,
          max(CASE WHEN py THEN 1 ELSE 0 END) AS p FROM c GROUP BY 1),
    m AS (SELECT DISTINCT commit_sha, message FROM o)
    SELECT m.commit_sha, a AS lines_added, d AS lines_removed, a + d AS total_churn,
           n AS files_changed, s AS diff_num_src_files, t AS diff_num_test_files,
           CAST(s > 0 AS BIGINT) AS has_source_change, CAST(t > 0 AS BIGINT) AS has_test_change,
           CAST(cf AS BIGINT) AS has_config_change, CAST(p AS BIGINT) AS diff_has_python,
           length(message) AS commit_message_length,
           len(list_filter(regexp_split_to_array(message, '\\s+'), lambda w: w <> ''))
               AS diff_msg_word_count,
           CAST(regexp_matches(message, '(?i)\\b(fix|fixes|fixed|bug|bugfix|hotfix|patch)\\b') AS BIGINT)
               AS diff_is_fix_commit,
           CAST(regexp_matches(message,
               '(?i)\\b(refactor|refactoring|cleanup|clean\\s?up|rename|reorg)\\b') AS BIGINT)
               AS diff_is_refactor_commit
    FROM m JOIN f ON m.commit_sha = f.commit_sha""", "changed_files", "commits"))
def _(t: Tables):
    rows = _rows(t)
    messages = rows.select("commit_sha", "message").distinct()
    return features.diff_features_strict(rows, messages, "commit_sha", "path", "lines_added",
                                         "lines_deleted", "message")


PATH_PAIRS = """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_shipdate AS ts,
        CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_discount * 100 AS depth,
        concat(CASE l_suppkey % 4 WHEN 0 THEN 'src/' WHEN 1 THEN 'src/core/' WHEN 2 THEN '' ELSE
               'tests/' END, lower(p_type), '/', replace(p_name, ' ', 'X'), 'Module.py') AS changed,
        concat(CASE l_linenumber % 4 WHEN 0 THEN 'src/' WHEN 1 THEN 'src/core/' WHEN 2 THEN ''
               ELSE 'tests/' END, CASE l_suppkey % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large'
               ELSE 'promo' END, '/test_', replace(p_name, ' ', '-'), '.py') AS test_path,
        concat('test_', replace(p_name, ' ', 'X'), 'Works', p_type) AS fn
    FROM lineitem JOIN part ON l_partkey = p_partkey"""

_STOPS = "['test', 'tests', 'src', 'lib', 'py', 'init', 'main', 'a', 'the']"


def tokens_sql(column: str) -> str:
    return (f"list_distinct(list_filter(string_split_regex(lower(regexp_replace({column}, "
            f"'([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), "
            f"lambda x: length(x) > 1 AND NOT list_contains({_STOPS}, x)))")


def dirs_sql(column: str) -> str:
    return (f"list_filter(string_split_regex({column}, '[/\\\\]')[:-2], lambda x: x <> '')")


def overlap_sql(a: str, b: str) -> str:
    return f"""CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0
        WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0
        ELSE len(list_filter(range(1, least(len({a}), len({b})) + 1),
             lambda i: {a}[1:i] = {b}[1:i])) / CAST(greatest(len({a}), len({b})) AS DOUBLE) END"""


@query("cross_features", "I1 I2 I3 I4 F7", f"""
    WITH o AS (SELECT *, {tokens_sql('changed')} AS tc, {tokens_sql('test_path')} AS tp,
               {tokens_sql('fn')} AS tf, {dirs_sql('changed')} AS dc, {dirs_sql('test_path')} AS dt
               FROM ({PATH_PAIRS}) x)
    SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_suppkey, l_partkey,
           {r('''CASE WHEN len(tc) > 0 AND len(tp) > 0 THEN 2.0 * len(list_intersect(tc, tp))
                 / (len(tc) + len(tp)) ELSE 0 END''')} AS file_test_similarity,
           {r('''CASE WHEN len(tc) > 0 AND len(tf) > 0 THEN len(list_intersect(tc, tf))
                 / CAST(len(list_distinct(list_concat(tc, tf))) AS DOUBLE) ELSE 0 END''')}
               AS lexical_similarity,
           {r(overlap_sql('dc', 'dt'))} AS path_overlap,
           CAST(regexp_replace(changed, '/[^/]*$', '') = regexp_replace(test_path, '/[^/]*$', '')
                AS BIGINT) AS same_module,
           {r(f'1 - ({overlap_sql("dc", "dt")})')} AS dependency_distance,
           {r('''coalesce(avg(label) OVER (PARTITION BY changed, test_path ORDER BY ts, l_orderkey,
                 l_linenumber, l_suppkey, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND
                 1 PRECEDING), 0)''')} AS co_change_frequency
    FROM o""")
def _(t: Tables):
    rows = t.select(PATH_PAIRS, "lineitem", "part")
    keys = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"]
    out = features.cross_features(rows, "changed", "test_path", "fn", "ts", keys, "label")
    return out.drop("ts", "label", "depth", "changed", "test_path", "fn")


@query("dependency_distance", "I4", f"""
    SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_suppkey, l_partkey,
           {r('CASE WHEN depth > 0 THEN depth ELSE 99 END')} AS dependency_distance
    FROM ({PATH_PAIRS}) x""")
def _(t: Tables):
    rows = t.select(PATH_PAIRS, "lineitem", "part")
    keys = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"]
    out = features.cross_features(rows, "changed", "test_path", "fn", "ts", keys, "label",
                                  depth="depth")
    return out.select(*keys, "dependency_distance")


@query("identifier_tokens", "I1", f"""
    SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_suppkey, l_partkey,
           array_to_string(list_sort({tokens_sql('changed')}), '|') AS tokens
    FROM ({PATH_PAIRS}) x""")
def _(t: Tables):
    rows = t.select(PATH_PAIRS, "lineitem", "part")
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey",
                       F.array_sort(text.identifier_tokens(F.col("changed"))).alias("tokens"))


_PAGE_PAIRS = "SELECT a.page_id, a.path AS x, b.path AS y FROM paths a JOIN paths b ON b.page_id = a.page_id + 1"


@query("path_similarity", "I1 I2 I3", sql(f"""
    WITH q AS ({_PAGE_PAIRS}),
    o AS (SELECT *, {tokens_sql('x')} AS tx, {tokens_sql('y')} AS ty, {dirs_sql('x')} AS dx,
          {dirs_sql('y')} AS dy FROM q)
    SELECT page_id, {r('''CASE WHEN len(tx) > 0 AND len(ty) > 0 THEN 2.0 * len(list_intersect(tx, ty))
           / (len(tx) + len(ty)) ELSE 0 END''')} AS dice,
           {r('''CASE WHEN len(tx) > 0 AND len(ty) > 0 THEN len(list_intersect(tx, ty))
           / CAST(len(list_distinct(list_concat(tx, ty))) AS DOUBLE) ELSE 0 END''')} AS jaccard,
           {r(overlap_sql('dx', 'dy'))} AS overlap FROM o""", "paths"))
def _(t: Tables):
    paths = t.paths
    shifted = paths.select((F.col("page_id") - 1).alias("page_id"), F.col("path").alias("y"))
    rows = paths.withColumnRenamed("path", "x").join(shifted, "page_id")
    x, y = text.identifier_tokens(F.col("x")), text.identifier_tokens(F.col("y"))
    return rows.select("page_id", text.dice(x, y).alias("dice"), text.jaccard(x, y).alias("jaccard"),
                       text.path_overlap(F.col("x"), F.col("y")).alias("overlap"))


@query("test_ids", "I5 I6", f"""
    WITH o AS (SELECT *, replace(test_path, '/', CASE WHEN l_suppkey % 2 = 0 THEN '\\' ELSE '/' END)
               AS raw, CASE WHEN l_linenumber = 2 THEN ' TestThing ' ELSE '' END AS cls
               FROM ({PATH_PAIRS}) x),
    n AS (SELECT *, concat_ws('::', 'pytest', regexp_replace(replace(raw, '\\', '/'), '\\s+', '', 'g'),
          CASE WHEN trim(cls) <> '' THEN trim(cls) END, concat(fn, '[', l_linenumber, ']')) AS id FROM o)
    SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_suppkey, l_partkey, id,
           regexp_replace(split_part(id, '::', 1), '\\.py$', '') AS head,
           fn AS name, CAST(regexp_matches(lower(changed), '(^|/)test_[^/]*$')
               OR regexp_matches(lower(changed), '(^|/)tests?/') AS BIGINT) AS is_test
    FROM n""")
def _(t: Tables):
    rows = t.select(PATH_PAIRS, "lineitem", "part")
    raw = F.when(F.col("l_suppkey") % 2 == 0, F.replace("test_path", F.lit("/"), F.lit("\\"))
                 ).otherwise(F.col("test_path"))
    cls = F.when(F.col("l_linenumber") == 2, F.lit(" TestThing ")).otherwise(F.lit(""))
    fn = F.concat("fn", F.lit("["), F.col("l_linenumber").cast("string"), F.lit("]"))
    named = rows.withColumn("id", text.normalize_test_id(F.lit(" pytest "), raw, cls, fn))
    head, name = text.canonical_key(F.col("id"))
    return named.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "id",
                        head.alias("head"), name.alias("name"),
                        text.is_test_path(F.col("changed")).alias("is_test"))


@query("message_features", "I7", f"""
    SELECT doc_id, length(text) AS msg_length,
           len(list_filter(string_split_regex(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')) AS msg_words,
           CAST(regexp_matches(lower(text), 'bug|fix|issue|error|fail|crash|defect') AS BIGINT)
               AS has_bug_keyword,
           CAST(regexp_matches(lower(text), 'test|spec|assert|mock|flaky|check') AS BIGINT)
               AS has_test_keyword,
           CAST(regexp_matches(lower(text), 'ci|cd|pipeline|build|travis|jenkins|github') AS BIGINT)
               AS has_ci_keyword,
           {r("len(regexp_extract_all(text, '\\p{Lu}')) / CAST(greatest(length(text), 1) AS DOUBLE)")}
               AS uppercase_ratio,
           length(text) - length(replace(text, '!', '')) AS exclamation_count,
           length(text) - length(replace(text, '?', '')) AS question_count,
           len(regexp_extract_all(text, '\\.[a-zA-Z0-9]+')) AS body_file_count
    FROM documents""")
def _(t: Tables):
    out = features.message_features(t.documents.select("doc_id", "text"), "text", "text")
    return out.drop("text")


@query("clock_features", "I8", sql("""
    SELECT event_id, hour(ts) AS hour_of_day, isodow(ts) - 1 AS day_of_week,
           CAST(isodow(ts) >= 6 AS BIGINT) AS is_weekend FROM runs""", "runs"))
def _(t: Tables):
    return t.runs.select("event_id", *[c.alias(n) for n, c in numbers.clock_features("ts").items()])


@query("logit_sigmoid", "I9", sql(f"""
    WITH z AS (SELECT doc_id, source, ln(greatest(least(p, 1 - 1e-7), 1e-7)
               / (1 - greatest(least(p, 1 - 1e-7), 1e-7))) AS z FROM doc_labels)
    SELECT doc_id, {r('z')} AS logit, {r('1 / (1 + exp(-z))')} AS back,
           {r('CASE WHEN z * 100 > -700 THEN 1 / (1 + exp(-z * 100)) ELSE 0 END')} AS far FROM z""",
    "doc_labels"))
def _(t: Tables):
    z = numbers.logit(F.col("p"))
    return t.doc_labels.select(
        "doc_id", z.alias("logit"), numbers.sigmoid(z).alias("back"),
        numbers.sigmoid(z * 100).alias("far"))


@query("risk_tier", "I11", sql("""
    SELECT commit_sha, prediction, risk_tier, count(*) AS n FROM (
      SELECT commit_sha, CASE WHEN p >= 0.55 THEN 'FLAKY' ELSE 'STABLE' END AS prediction,
             CASE WHEN p >= 0.7 THEN 'HIGH' WHEN p >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier
      FROM scored) x GROUP BY 1, 2, 3""", "scored"))
def _(t: Tables):
    out = features.risk_tier(t.scored, "p", 0.55)
    return out.groupBy("commit_sha", "prediction", "risk_tier").agg(F.count(F.lit(1)).alias("n"))


_REASON_ROWS = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
        CASE WHEN l_linenumber = 1 THEN 1.0 ELSE 0.0 END AS dep_is_direct_import,
        l_discount * 100 AS dep_shortest_path_depth,
        CASE WHEN l_suppkey % 5 = 0 THEN 1.0 ELSE 0.0 END AS dep_name_heuristic_coupled,
        CASE WHEN l_returnflag = 'R' THEN l_tax ELSE 0.0 END AS hist_recent_10_failure_rate,
        l_quantity / 200 AS hist_lifetime_failure_rate, l_extendedprice / 500 AS diff_total_churn,
        CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END AS diff_is_fix_commit,
        l_quantity / 51 AS p FROM lineitem"""


@query("reason_codes", "I12", f"""
    WITH x AS ({_REASON_ROWS}),
    c AS (SELECT *, concat_ws('|',
        CASE WHEN dep_is_direct_import = 1 THEN 'DIRECT_DEPENDENCY'
             WHEN dep_shortest_path_depth <= 2 THEN 'CALL_GRAPH_PROXIMITY'
             WHEN dep_name_heuristic_coupled = 1 THEN 'MODULE_COUPLING' END,
        CASE WHEN hist_recent_10_failure_rate > 0 THEN 'RECENT_FAILURES'
             WHEN hist_lifetime_failure_rate > 0.15 THEN 'LIFETIME_FAILURE_RATE' END,
        CASE WHEN diff_total_churn > 100 THEN 'HIGH_CHURN' END,
        CASE WHEN diff_is_fix_commit = 1 THEN 'BUGFIX_CONTEXT' END) AS codes FROM x)
    SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
           CASE WHEN codes <> '' THEN codes WHEN p >= 0.5 THEN 'BASELINE_COVERAGE'
                ELSE 'LOW_REGRESSION_RISK' END AS reasons,
           CASE WHEN p >= 0.5 THEN 'SELECTED' ELSE 'OMITTED' END AS status,
           CASE WHEN p > 0.6 THEN 'HIGH' WHEN p > 0.2 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
    FROM c""")
def _(t: Tables):
    rows = t.select(_REASON_ROWS, "lineitem").withColumn("selected", F.col("p") >= 0.5)
    out = features.reason_codes(rows, "selected", "p")
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "reasons", "status",
                      "risk_level")


_UTILITY_ROWS = """SELECT commit_sha, floor(full_duration) AS full_s, floor(selected_duration) AS sel_s,
        missed_failures AS e FROM outcomes WHERE ground_truth_complete = 1"""


@query("ci_utility", "I13", sql(f"""
    WITH x AS ({_UTILITY_ROWS})
    SELECT commit_sha, {r('greatest(full_s - sel_s, 0)')} AS time_saved_sec,
           {r('greatest(full_s - sel_s, 0) * 0.01')} AS gross_savings,
           {r('e * 50')} AS penalty_cost,
           {r('greatest(full_s - sel_s, 0) * 0.01 - e * 50')} AS net_utility FROM x""", "outcomes"))
def _(t: Tables):
    out = features.ci_utility(t.select(_UTILITY_ROWS, "outcomes"), "full_s", "sel_s", "e")
    return out.select("commit_sha", "time_saved_sec", "gross_savings", "penalty_cost",
                      "net_utility")


_STRATEGY_ROWS = """SELECT p_brand AS strategy, avg(p_size) / 60 AS etr,
        CASE WHEN count(*) % 7 <> 0 THEN avg(p_size) / 55 END AS recall, count(*) % 9 AS escapes,
        count(*) AS evaluated FROM part GROUP BY p_brand"""


@query("cost_projection", "I14", f"""
    WITH x AS ({_STRATEGY_ROWS}),
    c AS (SELECT *, 843750.0::DOUBLE * (1 - etr) * 0.016::DOUBLE AS cc,
                 843750.0::DOUBLE * (1 - etr) * 0.375::DOUBLE AS ww FROM x)
    SELECT strategy, CAST(18750 AS BIGINT) AS annual_commits, {r('round(cc, 2)')} AS compute_cost,
           {r('round(ww, 2)')} AS wait_cost, {r('round(13500 - cc, 2)')} AS compute_savings,
           {r('round(316406.25::DOUBLE - ww, 2)')} AS wait_savings,
           {r('round(13500 - cc + (316406.25::DOUBLE - ww), 2)')} AS gross_savings,
           CAST(trunc((13500 - cc + (316406.25::DOUBLE - ww)) / 3500) AS BIGINT) AS breakeven_escapes,
           {r('round(recall * 100, 1)')} AS recall_pct, {r('escapes * 3500.0')} AS escape_cost,
           {r('round(cc + ww + escapes * 3500.0::DOUBLE, 2)')} AS total_cost,
           {r('round(343906.25::DOUBLE - (cc + ww + escapes * 3500.0::DOUBLE), 2)')} AS net_benefit,
           {r('round(escapes / CAST(evaluated AS DOUBLE), 4)')} AS observed_escape_rate
    FROM c""")
def _(t: Tables):
    rows = t.select(_STRATEGY_ROWS, "part")
    out = features.cost_projection(rows, "etr", "recall", "escapes", "evaluated")
    return out.drop("etr", "recall", "escapes", "evaluated")


@query("cost_projection_unpriced", "I14", f"""
    WITH x AS ({_STRATEGY_ROWS})
    SELECT strategy, {r('round(13500 - 843750.0::DOUBLE * (1 - etr) * 0.016::DOUBLE, 2)')}
               AS compute_savings,
           {r('round(escapes / CAST(evaluated AS DOUBLE), 4)')} AS observed_escape_rate FROM x""")
def _(t: Tables):
    rows = t.select(_STRATEGY_ROWS, "part")
    out = features.cost_projection(rows, "etr", "recall", "escapes", "evaluated",
                                   price_escapes=False)
    return out.select("strategy", "compute_savings", "observed_escape_rate")


def _over(percent: float) -> str:
    """Mean discount of ``d`` less a bound, to four digits, halves away from zero; in whole numbers,
    since a sum of doubles depends on its order and many means lie halfway between two digits."""
    gap = f"(s - {round(percent * 10_000)} * n)"
    return (f"sign({gap}) * floor((2 * abs({gap}) + 100 * n) / (200 * n)) / CAST(10000 AS DOUBLE) "
            "+ CAST(0 AS DOUBLE)")


_INTERVALS = f"""SELECT unit, {_over(5)} AS point, CASE WHEN unit % 5 <> 0 THEN {_over(5.1)} END AS lo,
        CASE WHEN unit % 7 <> 0 THEN {_over(4.9)} END AS hi
    FROM (SELECT l_suppkey AS unit, CAST(count(l_discount) AS BIGINT) AS n,
                 CAST(sum(CAST(round(l_discount * 1000000) AS BIGINT)) AS BIGINT) AS s
          FROM lineitem GROUP BY l_suppkey) d"""


@query("interval_text", "I15", f"""
    WITH i AS ({_INTERVALS})
    SELECT unit, CASE WHEN unit % 11 = 0 THEN 'n/a'
        WHEN lo IS NULL OR hi IS NULL THEN printf('%.4f', point) || '% [no interval]'
        ELSE printf('%.4f', point) || '% [' || printf('%.4f', lo) || ', ' || printf('%.4f', hi) || ']'
        END AS cell,
        CASE WHEN lo IS NULL OR hi IS NULL THEN 'no paired interval on the ECE difference'
        ELSE concat('ECE difference ', printf('%+.5f', point), ' [', printf('%+.5f', lo), ', ',
             printf('%+.5f', hi), '] ', CASE WHEN lo > 0 OR hi < 0 THEN 'excludes zero'
             ELSE 'spans zero, so not a gain' END) END AS difference
    FROM i""")
def _(t: Tables):
    rows = t.select(_INTERVALS, "lineitem")
    point = F.when(F.col("unit") % 11 != 0, F.col("point"))
    return rows.select(
        "unit", features.format_interval(point, F.col("lo"), F.col("hi"), 4, "%").alias("cell"),
        features.difference_text(F.col("point"), F.col("lo"), F.col("hi")).alias("difference"))


_REPORT = """SELECT CASE WHEN p_brand = 'Brand#7' THEN 'Selective' ELSE p_brand END AS strategy,
        round(avg(p_size), 1) AS fr, round(100 - avg(p_size), 1) AS mfr, round(avg(p_size) / 2, 1) AS etr,
        round(avg(p_size) / 3, 1) AS trr, round(avg(p_size) / 4, 1) AS ar, count(*) % 10 AS escaped
    FROM part GROUP BY p_brand"""


@query("headline", "I16", f"""
    WITH s AS (SELECT * FROM ({_REPORT}) q WHERE strategy = 'Selective'),
    u AS (SELECT round(avg(l_tax), 4) AS m, round(quantile_cont(l_tax, 0.95), 4) AS p95, count(*) AS n
          FROM lineitem)
    SELECT CAST(1 AS BIGINT) AS position, 'Failure Recall' AS metric, printf('%.1f', fr) || '%' AS value,
           concat(CAST(escaped AS STRING), ' commit(s) let a failure escape, missed-failure rate ',
                  printf('%.1f', mfr), '%') AS note, CAST(1 AS BIGINT) AS measured FROM s
    UNION ALL SELECT 2, 'Test Time Reduction', printf('%.1f', etr) || '%',
           concat('test-count reduction ', printf('%.1f', trr), '%; abstained on ', printf('%.1f', ar),
                  '% of commits'), 1 FROM s
    UNION ALL SELECT 3, 'Expected Calibration Error', printf('%.4f', m), 'served uncalibrated: no gain', 1
           FROM u
    UNION ALL SELECT 4, 'Epistemic Disagreement', printf('%.4f', m),
           concat('p95 ', printf('%.4f', p95), ' over ', CAST(n AS STRING), ' samples'), 1 FROM u""")
def _(t: Tables):
    from ..operators import metrics, ordering

    strategies = t.select(_REPORT, "part")
    spread = metrics.one_row(
        t.lineitem.agg(F.round(F.avg("l_tax"), 4).alias("mean"), F.count(F.lit(1)).alias("n")),
        ordering.quantiles(t.lineitem.select("l_tax"), [], "l_tax", {"p95": 0.95}))
    served = spread.select(
        F.lit("uncalibrated").alias("method"), F.col("mean").alias("ece"),
        F.lit("no gain").alias("reason"), F.lit(None).cast("string").alias("difference"))
    return features.headline(strategies, served, spread, "Selective")
