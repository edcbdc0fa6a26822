"""Registered queries: sources, parsers and sinks over texts rendered from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_folder
from ..sources import parsers, readers, sinks
from .catalog import Tables, query, r, sql

_CSV_SCHEMA = T.StructType([
    T.StructField("repo", T.LongType()), T.StructField("commit_sha", T.StringType()),
    T.StructField("event_id", T.LongType()), T.StructField("test_id", T.LongType()),
    T.StructField("label_failed", T.IntegerType()), T.StructField("duration", T.DoubleType())])


@query("read_outcomes", "A1", sql(f"""
    SELECT repo, commit_sha, count(*) AS n, CAST(sum(label_failed) AS BIGINT) AS failures,
           {r('sum(duration)')} AS seconds, count(DISTINCT test_id) AS tests
    FROM runs GROUP BY repo, commit_sha""", "runs"))
def _(t: Tables):
    folder = scratch_folder(t.spark)
    rows = t.runs.select(*_CSV_SCHEMA.fieldNames())
    rows.filter("repo < 2").write.option("header", True).csv(f"{folder}/a")
    rows.filter("repo >= 2").write.option("header", True).csv(f"{folder}/b")
    table = readers.read_outcomes(t.spark, [f"{folder}/a", f"{folder}/b"], _CSV_SCHEMA)
    return table.groupBy("repo", "commit_sha").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label_failed").alias("failures"),
        F.sum("duration").alias("seconds"), F.count_distinct("test_id").alias("tests"))


# One report per order: its lines are the test cases, in a suite or straight below the root.
_JUNIT = """SELECT l_orderkey AS report, concat('<testcase name="',
    CASE WHEN l_linenumber = 7 THEN '' ELSE concat('test_', l_partkey) END, '" classname="pkg.mod',
    CAST(l_suppkey % 10 AS STRING), CASE WHEN l_suppkey % 2 = 0 THEN '.TestBox' ELSE '' END, '" time="',
    CASE WHEN l_linenumber = 6 THEN 'soon' ELSE CAST(l_tax AS STRING) END, '"',
    CASE WHEN l_linenumber = 5 THEN ' file="tests\\\\x.py"' ELSE '' END, '>',
    CASE l_returnflag WHEN 'R' THEN '<failure message="m">boom</failure>' WHEN 'A' THEN '' ELSE
    CASE WHEN l_linestatus = 'F' THEN '<skipped/>' ELSE '<error/>' END END, '</testcase>') AS case_xml
    FROM lineitem"""


def _reports(t: Tables):
    cases = t.select(_JUNIT, "lineitem").groupBy("report").agg(
        F.array_join(F.collect_list("case_xml"), "").alias("cases"))
    body = F.when(F.col("report") % 3 == 0, F.concat(
        F.lit("<testsuites><testsuite name='s'>"), "cases", F.lit("</testsuite></testsuites>"))
    ).when(F.col("report") % 3 == 1, F.concat(F.lit("<testsuite>"), "cases", F.lit("</testsuite>"))
           ).otherwise(F.concat(F.lit("<testsuites><testsuite>"), "cases", F.lit("</testsuite>")))
    return cases.select("report", body.alias("xml"))


_CASES = """
    WITH c AS (SELECT l_orderkey AS report, CASE WHEN l_linenumber = 7 THEN ''
        ELSE concat('test_', CAST(l_partkey AS STRING)) END AS name, l_suppkey % 10 AS m,
        l_suppkey % 2 = 0 AS boxed, CASE WHEN l_linenumber = 6 THEN 0 ELSE l_tax END AS secs,
        l_linenumber = 5 AS filed, CASE l_returnflag WHEN 'R' THEN 'FAILED' WHEN 'A' THEN 'PASSED'
        ELSE CASE WHEN l_linestatus = 'F' THEN 'SKIPPED' ELSE 'ERROR' END END AS status
        FROM lineitem WHERE l_orderkey % 3 <> 2)"""


@query("ingest_junit_executed", "A2", f"""{_CASES},
    x AS (SELECT report, concat(CASE WHEN filed THEN 'tests\\x.py' ELSE concat('pkg/mod', CAST(m AS STRING), '.py') END,
          CASE WHEN boxed THEN '::TestBox' ELSE '' END, '::', name) AS test_id, secs,
          CASE WHEN status IN ('FAILED', 'ERROR') THEN 1 ELSE 0 END AS bad FROM c
          WHERE name <> '' AND status <> 'SKIPPED')
    SELECT report, test_id, count(*) AS n, CAST(sum(bad) AS BIGINT) AS failures, {r('sum(secs)')} AS seconds
    FROM x GROUP BY report, test_id""")
def _(t: Tables):
    rows = parsers.ingest_junit_executed(_reports(t), "xml")
    return rows.groupBy("report", "test_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label_failed").alias("failures"),
        F.sum("duration").alias("seconds"))


@query("ingest_junit_status", "A3", f"""{_CASES}
    SELECT report, concat(CASE WHEN filed THEN 'tests/x.py' ELSE concat('pkg/mod', CAST(m AS STRING),
           CASE WHEN boxed THEN '/TestBox' ELSE '' END) END, '::', name) AS test_id, status,
           count(*) AS n FROM c GROUP BY 1, 2, 3""")
def _(t: Tables):
    rows = parsers.ingest_junit_status(_reports(t), "xml")
    return rows.groupBy("report", "test_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query("junit_summary", "A3", f"""{_CASES}
    SELECT report, count(*) AS total, count(*) FILTER (WHERE status = 'FAILED') AS failed,
           count(*) FILTER (WHERE status = 'ERROR') AS errors,
           count(*) FILTER (WHERE status = 'SKIPPED') AS skipped, {r('sum(secs)')} AS duration,
           count(*) FILTER (WHERE status = 'PASSED') AS passed,
           coalesce(string_agg(test_id, '|' ORDER BY test_id) FILTER (WHERE status = 'FAILED'), '') AS failures_list
    FROM (SELECT *, concat(CASE WHEN filed THEN 'tests/x.py' ELSE concat('pkg/mod', CAST(m AS STRING),
          CASE WHEN boxed THEN '/TestBox' ELSE '' END) END, '::', name) AS test_id FROM c) q GROUP BY report""")
def _(t: Tables):
    return parsers.junit_summary(parsers.ingest_junit_status(_reports(t), "xml"), "report")


_CONSOLE = """SELECT doc_id AS run_id, concat('FAILED tests/test_a.py::test_one - boom', chr(10), text, chr(10),
    'SKIPPED tests/test_b.py::TestK::test_two', chr(10), 'ERROR tests/test_', CAST(doc_id % 7 AS STRING),
    '.py::TestK::test_x[1]', chr(10), CASE WHEN doc_id % 2 = 0 THEN 'PASSED tests/test_a.py::test_one' ELSE
    'noise FAILED tests/no.py::test_no' END, chr(10)) AS text FROM documents"""


@query("ingest_console_log", "A4", """
    SELECT doc_id AS run_id, 'tests/test_a.py::test_one' || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' - boom' END
           AS test_id, 'tests/test_a.py' AS test_path, '' AS test_class,
           'test_one' || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' - boom' END AS test_function,
           CAST(doc_id % 2 AS BIGINT) AS label_failed, CAST(0 AS DOUBLE) AS duration FROM documents
    UNION ALL SELECT doc_id, 'tests/test_a.py::test_one - boom', 'tests/test_a.py', '', 'test_one - boom', 1, 0
    FROM documents WHERE doc_id % 2 = 0
    UNION ALL SELECT doc_id, concat('tests/test_', CAST(doc_id % 7 AS STRING), '.py::TestK::test_x[1]'),
           concat('tests/test_', CAST(doc_id % 7 AS STRING), '.py'), 'TestK', 'test_x[1]', 1, 0
    FROM documents""")
def _(t: Tables):
    return parsers.ingest_console_log(t.select(_CONSOLE, "documents"), "run_id", "text")


_HARVEST = """SELECT concat('m', CAST(o_orderkey AS STRING)) AS mutant_id, o_orderpriority AS repo,
    'src/a.py' AS file_path, o_custkey AS line, o_orderstatus AS operator,
    CASE o_orderstatus WHEN 'F' THEN 'harvested' WHEN 'O' THEN 'timed_out' ELSE 'broke_suite' END AS status,
    o_orderstatus = 'O' AS timed_out, true AS timeout_enforced, CAST(1 AS BIGINT) AS exit_code,
    o_totalprice / 1000 AS suite_duration, CAST(100 AS BIGINT) AS universe_size, o_custkey % 4 AS n_killed
    FROM orders"""


def _harvest_file(t: Tables) -> str:
    folder = scratch_folder(t.spark)
    rows = t.select(_HARVEST, "orders")
    line = F.to_json(F.struct(*rows.columns))
    blank = F.when(F.col("line") % 50 == 0, F.concat(line, F.lit("\n   "))).otherwise(line)
    rows.select(blank.alias("value")).write.text(folder)
    return folder


@query("read_harvest_log", "A5", f"""
    SELECT mutant_id, repo, line, n_killed, {r('suite_duration')} AS suite_duration
    FROM ({_HARVEST}) h WHERE status = 'harvested'""")
def _(t: Tables):
    usable, _others = readers.read_harvest_log(t.spark, _harvest_file(t))
    return usable.select("mutant_id", "repo", "line", "n_killed", "suite_duration")


@query("harvest_log_others", "A5", f"""
    SELECT status, count(*) AS n FROM ({_HARVEST}) h WHERE status <> 'harvested' GROUP BY status""")
def _(t: Tables):
    return readers.read_harvest_log(t.spark, _harvest_file(t))[1]


_LOG = """SELECT o_custkey AS id, o_orderkey AS seq, CASE o_orderstatus WHEN 'F' THEN 'harvested'
    WHEN 'O' THEN 'timed_out' ELSE 'broke_suite' END AS status, o_orderkey % 5 AS n_killed,
    o_orderkey % 9 = 0 AS drifted FROM orders"""


def _log(t: Tables):
    return t.select(_LOG, "orders").withColumn("checkout_drifted", F.when(
        F.col("drifted"), F.array(F.lit("a.py"))))


@query("compact_latest", "A6", f"""
    SELECT id, seq, status, n_killed FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC)
        AS rk FROM ({_LOG}) l) x WHERE rk = 1""")
def _(t: Tables):
    return readers.compact_latest(_log(t), "id", F.col("seq")).select(
        "id", "seq", "status", "n_killed")


@query("log_totals", "A6", f"""
    WITH l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rk FROM ({_LOG}) q)
    SELECT count(*) AS unique_ids, CAST(sum(n_killed) AS BIGINT) AS total_kills,
           count(*) FILTER (WHERE n_killed = 0) AS killed_none,
           count(*) FILTER (WHERE drifted) AS checkout_drifted,
           count(*) FILTER (WHERE status = 'harvested') AS harvested,
           count(*) FILTER (WHERE status = 'broke_suite') AS broke_suite,
           count(*) FILTER (WHERE status = 'timed_out') AS timed_out,
           (SELECT count(*) FROM orders) AS records FROM l WHERE rk = 1""")
def _(t: Tables):
    return readers.log_totals(_log(t), "id", F.col("seq"))


_INFO = """SELECT c_custkey AS id, concat('# comment', chr(10), 'name = "', c_name, '"', chr(10), chr(10),
    'segment=', c_mktsegment, chr(10), '9bad=1', chr(10), '  nation="', CAST(c_nationkey AS STRING), '"  ',
    chr(10), CASE WHEN c_nationkey % 2 = 0 THEN 'segment="last wins"' ELSE 'free text' END) AS text
    FROM customer"""


@query("parse_key_values", "A7", """
    SELECT c_custkey AS id, c_name AS name, CASE WHEN c_nationkey % 2 = 0 THEN 'last wins'
           ELSE c_mktsegment END AS segment, CAST(c_nationkey AS STRING) AS nation,
           CAST(3 AS BIGINT) AS n FROM customer""")
def _(t: Tables):
    out = parsers.parse_key_values(t.select(_INFO, "customer"), "text")
    return out.select("id", F.col("fields.name").alias("name"), F.col("fields.segment").alias("segment"),
                      F.col("fields.nation").alias("nation"), F.size("fields").alias("n"))


_DIFF = """SELECT p_partkey AS id, concat('diff --git', chr(10), '--- a/src/', p_name, '.py', chr(10),
    '+++ b/src/', p_name, '.py', chr(10), '@@ -', CAST(p_size AS STRING), ',3 +1,4 @@', chr(10),
    repeat(concat('-  old ', p_brand, chr(10)), p_size % 6), ' same', chr(10),
    repeat(concat('+new ', p_type, ' ', chr(10)), p_size % 5), CASE WHEN p_size % 2 = 0 THEN
    concat('--- /dev/null', chr(10), '+++ b/docs/', p_type, '.md', chr(10), '@@ -9 +1 @@', chr(10), '+doc', chr(10))
    ELSE '' END) AS text FROM part"""


@query("parse_unified_diff", "A8", """
    SELECT p_partkey AS id, concat('src/', p_name, '.py', CASE WHEN p_size % 2 = 0
               THEN concat('|docs/', p_type, '.md') ELSE '' END) AS changed_files,
           CAST(p_size % 5 + CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS lines_added,
           CAST(p_size % 6 AS BIGINT) AS lines_deleted, CAST(p_size AS BIGINT) AS first_line,
           concat('src/', p_name, '.py') AS first_file, CAST(0 AS BIGINT) AS is_doc_only,
           CASE WHEN p_size % 6 > 0 THEN array_to_string(list_resize([]::VARCHAR[], least(p_size % 6, 4),
               concat('old ', p_brand)), ' / ') END AS buggy_snippet,
           nullif(concat(array_to_string(list_resize([]::VARCHAR[], p_size % 5, concat('new ', p_type)), ' / '),
               CASE WHEN p_size % 2 = 0 AND p_size % 5 < 4 THEN CASE WHEN p_size % 5 > 0 THEN ' / doc'
               ELSE 'doc' END ELSE '' END), '') AS fixed_snippet
    FROM part""")
def _(t: Tables):
    return parsers.parse_unified_diff(t.select(_DIFF, "part"), "text").drop("text")


_NUMSTAT = """SELECT p_partkey AS id, concat(CAST(p_size AS STRING), chr(9), CASE WHEN p_size % 3 = 0 THEN '-'
    ELSE '7' END, chr(9), 'src', chr(92), p_name, chr(10), 'junk line', chr(10), '-', chr(9), '-', chr(9),
    ' img.png ', chr(10)) AS text FROM part"""


@query("parse_numstat", "A9", """
    SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS lines_added, CAST(CASE WHEN p_size % 3 = 0 THEN 0 ELSE 7 END
           AS BIGINT) AS lines_removed, concat('src/', p_name) AS path FROM part
    UNION ALL SELECT p_partkey, 0, 0, 'img.png' FROM part""")
def _(t: Tables):
    return parsers.parse_numstat(t.select(_NUMSTAT, "part"), "text")


_COMMANDS = """SELECT p_partkey AS id, concat('# run', chr(10), 'pytest -q tests/', replace(p_name, ' ', '_'),
    '.py::test_a src/b.py', chr(10), 'python -m unittest tests.mod', CAST(p_size AS STRING), '.BoxTest.test_',
    p_type, chr(10), 'python -m unittest pkg.mod.test_plain', chr(10), CASE WHEN p_size % 2 = 0 THEN
    'make check' ELSE 'tox -e py3' END) AS text FROM part"""


@query("parse_test_commands", "A10", """
    SELECT p_partkey AS id, CAST(1 AS BIGINT) AS line_no, CAST(0 AS BIGINT) AS position,
           concat('tests/', replace(p_name, ' ', '_'), '::test_a') AS test_id FROM part
    UNION ALL SELECT p_partkey, 1, 1, 'src/b.py' FROM part
    UNION ALL SELECT p_partkey, 2, 0, concat('tests/mod', CAST(p_size AS STRING), '::BoxTest::test_', p_type) FROM part
    UNION ALL SELECT p_partkey, 3, 0, 'pkg/mod::test_plain' FROM part""")
def _(t: Tables):
    return parsers.parse_test_commands(t.select(_COMMANDS, "part"), "text")[0]


@query("unreadable_commands", "A10", """
    SELECT p_partkey AS id, CAST(4 AS BIGINT) AS line_no, CASE WHEN p_size % 2 = 0 THEN 'make check'
           ELSE 'tox -e py3' END AS line FROM part""")
def _(t: Tables):
    return parsers.parse_test_commands(t.select(_COMMANDS, "part"), "text")[1]


_BODIES = """SELECT o_orderkey AS id, CASE o_orderkey % 5
    WHEN 0 THEN concat('{"change": {"churn": ', CAST(o_custkey AS STRING), ', "depth": 1}, "tests": [{"test_id": "a", "depth": 2}, {"test_id": "b"}]}')
    WHEN 1 THEN concat('{"candidates": [{"test_id": "', o_orderstatus, '"}], "min_tests": 1}')
    WHEN 2 THEN concat('[{"test_id": "x', CAST(o_custkey AS STRING), '"}]')
    WHEN 3 THEN '{"test_id": "solo", "max_tests": 3}'
    ELSE CASE WHEN o_custkey % 2 = 0 THEN '{"tests": []}' ELSE '{"change": {"a": 1}}' END END AS body
    FROM orders"""


@query("explode_requests", "A11", """
    SELECT o_orderkey AS id, CAST(0 AS BIGINT) AS position, 'a' AS test_id, '2' AS depth,
           CAST(o_custkey AS STRING) AS churn FROM orders WHERE o_orderkey % 5 = 0
    UNION ALL SELECT o_orderkey, 1, 'b', '1', CAST(o_custkey AS STRING) FROM orders WHERE o_orderkey % 5 = 0
    UNION ALL SELECT o_orderkey, 0, o_orderstatus, NULL, NULL FROM orders WHERE o_orderkey % 5 = 1
    UNION ALL SELECT o_orderkey, 0, concat('x', CAST(o_custkey AS STRING)), NULL, NULL FROM orders WHERE o_orderkey % 5 = 2
    UNION ALL SELECT o_orderkey, 0, 'solo', NULL, NULL FROM orders WHERE o_orderkey % 5 = 3""")
def _(t: Tables):
    tests, _errors = parsers.explode_requests(t.select(_BODIES, "orders"), "body")
    return tests.select("id", "position", F.col("test.test_id").alias("test_id"),
                        F.col("test.depth").alias("depth"), F.col("test.churn").alias("churn"))


@query("request_errors", "A11", """
    SELECT o_orderkey AS id, 'no candidate tests supplied' AS error FROM orders WHERE o_orderkey % 5 = 4""")
def _(t: Tables):
    return parsers.explode_requests(t.select(_BODIES, "orders"), "body")[1]


@query("read_percent_table", "A12", """
    SELECT concat(p_brand, '/', p_type) AS strategy, CASE WHEN count(*) % 3 = 0 THEN NULL
           ELSE round(avg(p_size) + 1e-9, 1) END AS fr, CAST(count(*) AS DOUBLE) AS escaped
    FROM part GROUP BY p_brand, p_type""")
def _(t: Tables):
    rows = t.part.groupBy("p_brand", "p_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("p_size") + 1e-9, 1).alias("s"))
    table = rows.select(
        F.concat_ws("/", "p_brand", "p_type").alias("Strategy / Baseline"),
        F.when(F.col("n") % 3 == 0, F.lit("n/a")).otherwise(
            F.concat(F.col("s").cast("string"), F.lit("%"))).alias("Failure Recall (FR %)"),
        F.col("n").alias("Escaped Commits"))
    folder = scratch_folder(t.spark)
    table.write.option("header", True).csv(folder)
    return readers.read_percent_table(t.spark, folder, {
        "Strategy / Baseline": "strategy", "Failure Recall (FR %)": "fr",
        "Escaped Commits": "escaped"}, text=["strategy"])


@query("read_slug_list", "A13", """
    SELECT CAST(c_custkey * 3 + 1 AS BIGINT) AS position, concat('org/', c_name) AS slug FROM customer
    WHERE c_custkey % 10 <> 0 ORDER BY c_custkey LIMIT 40""")
def _(t: Tables):
    # A list file of one partition, in key order, with comments and blanks between the ids.
    line = F.concat(F.lit("# id\n"), F.when(F.col("c_custkey") % 10 == 0, F.lit("   # "))
                    .otherwise(F.lit("  ")), F.lit("org/"), F.col("c_name"), F.lit("\n"))
    folder = scratch_folder(t.spark)
    t.customer.orderBy("c_custkey").coalesce(1).select(line.alias("value")).write.text(folder)
    return readers.read_slug_list(t.spark, folder, 40)


# One source text per part: imports, a branch per size step, and tests in and out of a class.
_SOURCES = """SELECT p_partkey AS id, concat(CASE p_size % 4 WHEN 0 THEN 'tests/test_' WHEN 1 THEN 'venv/test_'
    WHEN 2 THEN 'src/' ELSE 'tests/' END, CAST(p_partkey AS STRING), CASE p_size % 4 WHEN 3 THEN '_test.py' ELSE '.py' END) AS path,
    concat('import os', chr(10), 'from pkg.', replace(p_name, ' ', '_'), ' import (', p_type, CASE WHEN p_size % 3 = 0
    THEN concat(',', chr(10), '    other as o') ELSE '' END, ')', chr(10), CASE WHEN p_size % 7 = 0 THEN concat('import pytest', chr(10),
    '@pytest.mark.parametrize("x", [1])', chr(10)) ELSE '' END, 'def test_top():', chr(10),
    repeat(concat('    if a and b:', chr(10), '        pass', chr(10)), p_size % 5), '    assert 1', chr(10),
    'class TestBox:', chr(10), '    def test_in(self):', chr(10), '        return 1 if self else 2', chr(10),
    '    def helper(self):', chr(10), '        pass', chr(10), CASE WHEN p_size % 11 = 0 THEN 'def broken(' ELSE '' END)
    AS text FROM part"""


@query("source_file_metrics", "A14", f"""
    SELECT id, CAST(CASE WHEN bad THEN 0 ELSE 3 END AS BIGINT) AS functions_count,
           CAST(CASE WHEN bad THEN 0 ELSE 1 END AS BIGINT) AS classes_count,
           CAST(CASE WHEN bad THEN 0 ELSE 3 + (s % 3 = 0)::INT + (s % 7 = 0)::INT END AS BIGINT) AS imports_count,
           {r('CASE WHEN bad THEN 1 ELSE 1 + 2 * (s % 5) + 1 + 1 END')} AS complexity,
           CAST(NOT bad AND s % 7 = 0 AS BIGINT) AS is_parameterized
    FROM (SELECT p_partkey AS id, p_size AS s, p_size % 11 = 0 AS bad FROM part) x""")
def _(t: Tables):
    files = t.select(_SOURCES, "part")
    return parsers.source_file_metrics(files, "id", "text")


@query("imported_modules", "A14 D1", """
    WITH x AS (SELECT p_partkey AS id, concat('pkg.', replace(p_name, ' ', '_')) AS m, p_type AS n, p_size AS s FROM part
               WHERE p_size % 11 <> 0)
    SELECT id, 'os' AS module FROM x UNION ALL SELECT id, m FROM x UNION ALL SELECT id, concat(m, '.', n) FROM x
    UNION ALL SELECT id, concat(m, '.other') FROM x WHERE s % 3 = 0
    UNION ALL SELECT id, 'pytest' FROM x WHERE s % 7 = 0""")
def _(t: Tables):
    return parsers.imported_modules(t.select(_SOURCES, "part"), "id", "text")


@query("discover_units", "A15", """
    WITH x AS (SELECT concat(CASE p_size % 4 WHEN 0 THEN 'tests/test_' ELSE 'tests/' END, CAST(p_partkey AS STRING),
               CASE p_size % 4 WHEN 3 THEN '_test.py' ELSE '.py' END) AS path FROM part
               WHERE p_size % 4 IN (0, 3) AND p_size % 11 <> 0)
    SELECT concat(path, '::test_top') AS test_id, path AS test_path, 'test_top' AS test_function FROM x
    UNION ALL SELECT concat(path, '::TestBox::test_in'), path, 'test_in' FROM x""")
def _(t: Tables):
    return parsers.discover_units(t.select(_SOURCES, "part"), "path", "text")


@query("adapter_registry", "N4", f"""{_CASES}
    SELECT report, count(*) FILTER (WHERE name <> '' AND status <> 'SKIPPED') AS n FROM c GROUP BY report
    HAVING count(*) FILTER (WHERE name <> '' AND status <> 'SKIPPED') > 0""")
def _(t: Tables):
    rows = parsers.adapter_for("pytest")(_reports(t), "xml")
    return rows.groupBy("report").agg(F.count(F.lit(1)).alias("n"))


@query("write_splits", "A16", sql(f"""
    SELECT CASE WHEN commit_sha < '2024-01-20' THEN 'train' ELSE 'test' END AS split, count(*) AS n_rows,
           count(DISTINCT commit_sha) AS n_commits, CAST(sum(label_failed) AS BIGINT) AS n_failures,
           {r('avg(label_failed)')} AS failure_rate FROM runs GROUP BY 1""", "runs"))
def _(t: Tables):
    folder = scratch_folder(t.spark)
    rows = t.runs.withColumn("split", F.when(F.col("commit_sha") < "2024-01-20", "train")
                             .otherwise("test"))
    sinks.write_splits(rows, folder, "split", "commit_sha", "label_failed")
    return t.spark.read.schema(
        "split string, n_rows long, n_commits long, n_failures long, failure_rate double"
    ).json(f"{folder}/summary")


def _report(fmt: str):
    oracle = sql(f"""SELECT commit_sha, {r('avg(p)')} AS mean_p,
        {r('avg(CASE WHEN commit_sha % 4 <> 0 THEN label END)')} AS rate FROM scored GROUP BY commit_sha""", "scored")

    @query(f"write_report_{fmt}", "A17", oracle)
    def _(t: Tables):
        folder = scratch_folder(t.spark)
        report = t.scored.groupBy("commit_sha").agg(
            F.avg("p").alias("mean_p"),
            F.avg(F.when(F.col("commit_sha") % 4 != 0, F.col("label"))).alias("rate"))
        sinks.write_report(report, folder, fmt)
        reader = t.spark.read.schema("commit_sha long, mean_p double, rate double")
        return reader.json(folder) if fmt == "json" else reader.option("header", True).csv(folder)


_report("json")
_report("csv")
