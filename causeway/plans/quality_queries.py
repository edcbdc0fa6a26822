"""Registered queries: projections, validation, redaction and log context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality
from .catalog import Tables, query, r, sql

_SPARSE = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
        CASE WHEN l_quantity > 10 THEN l_quantity END AS qty,
        CASE WHEN l_linenumber = 3 THEN CAST('NaN' AS DOUBLE) ELSE l_discount END AS disc,
        l_tax AS tax FROM lineitem"""
_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
_KEYS_SQL = "l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber"


@query("select_features", "B1", f"""
    SELECT {_KEYS_SQL}, {r('coalesce(qty, 0)')} AS qty,
           {r('CASE WHEN isnan(disc) THEN 0 ELSE disc END')} AS disc, {r('tax')} AS tax
    FROM ({_SPARSE}) x""")
def _(t: Tables):
    return quality.select_features(t.select(_SPARSE, "lineitem"), ["qty", "disc", "tax"], _KEYS)


@query("conform_schema", "B2", f"""
    SELECT {_KEYS_SQL}, {r('0')} AS churn, {r('tax')} AS tax, {r('qty')} AS qty
    FROM ({_SPARSE}) x""")
def _(t: Tables):
    return quality.conform_schema(t.select(_SPARSE, "lineitem"), ["churn", "tax", "qty"], _KEYS)


@query("adapt_columns", "B3", """
    SELECT event_id, TRY_CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) AS lines_added,
           CAST(NULL AS DOUBLE) AS kind, round(value + 1e-9, 6) AS value FROM events""")
def _(t: Tables):
    raw = t.events.withColumn("diff_lines_added", F.regexp_extract("props", "[0-9]+", 0))
    adapted, names, _missing = quality.adapt_columns(
        raw, {"lines_added": "diff_lines_added", "kind": "event_type", "gone": "not_there"},
        ["value"], ["lines_added", "kind", "gone"])
    return adapted.select("event_id", *names)


@query("history_defaults", "B4", f"""
    SELECT {_KEYS_SQL}, {r('coalesce(qty, 0.05)')} AS qty, {r('tax')} AS tax FROM ({_SPARSE}) x""")
def _(t: Tables):
    out = quality.history_defaults(t.select(_SPARSE, "lineitem"), {"qty": 0.05, "tax": 0.0})
    return out.select(*_KEYS, "qty", "tax")


_RECORDS = """SELECT p_partkey AS id,
        CASE WHEN p_size % 5 = 0 THEN p_name ELSE concat('pytest::', p_name) END AS test_id,
        CASE WHEN p_size % 7 = 0 THEN '' ELSE p_name END AS test_path,
        CASE WHEN p_size % 11 = 0 THEN NULL ELSE p_name END AS raw_node_id,
        CASE WHEN p_type = 'PROMO' THEN 'unittest' ELSE 'pytest' END AS framework,
        CASE WHEN p_type = 'LARGE' THEN NULL ELSE 'python' END AS language,
        CASE WHEN p_size % 13 = 0 THEN '2.0.0' ELSE '1.4.0' END AS schema_version FROM part"""


@query("validate_records", "B5", f"""
    SELECT id, concat_ws('|', CASE WHEN test_id NOT LIKE '%::%' THEN 'TEST_ID' END,
        CASE WHEN test_path = '' THEN 'TEST_PATH' END,
        CASE WHEN raw_node_id IS NULL THEN 'RAW_NODE_ID' END,
        CASE WHEN framework <> 'pytest' THEN 'FRAMEWORK' END,
        CASE WHEN language IS NULL THEN 'LANGUAGE' END,
        CASE WHEN schema_version = '2.0.0' THEN 'SCHEMA_MAJOR' END) AS problems,
        CAST(test_id LIKE '%::%' AND test_path <> '' AND raw_node_id IS NOT NULL
             AND framework = 'pytest' AND language IS NOT NULL AND schema_version <> '2.0.0' AS BIGINT)
        AS valid FROM ({_RECORDS}) x""")
def _(t: Tables):
    return quality.validate_records(t.select(_RECORDS, "part")).select("id", "problems", "valid")


_OUTCOMES = """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS complete,
        CASE WHEN o_orderstatus <> 'P' AND o_custkey % 3 <> 0 THEN 1 END AS actual_failures,
        CASE WHEN o_orderstatus = 'F' THEN 2 END AS missed_failures,
        CASE WHEN o_orderstatus = 'F' AND o_custkey % 5 <> 0 THEN o_totalprice END AS full_duration,
        CASE WHEN o_orderstatus = 'F' OR o_custkey % 7 = 0 THEN 0.5 END AS time_reduction_ratio
    FROM orders"""


@query("check_outcome_integrity", "B6", f"""
    WITH x AS ({_OUTCOMES}),
    y AS (SELECT id, complete, concat_ws('|',
          CASE WHEN (actual_failures IS NULL) = (complete = 1) THEN 'actual_failures' END,
          CASE WHEN (full_duration IS NULL) = (complete = 1) THEN 'full_duration' END,
          CASE WHEN (missed_failures IS NULL) = (complete = 1) THEN 'missed_failures' END,
          CASE WHEN (time_reduction_ratio IS NULL) = (complete = 1) THEN 'time_reduction_ratio' END)
          AS fields FROM x)
    SELECT id, CASE WHEN complete = 1 THEN 'absent' ELSE 'unobserved' END AS violation, fields
    FROM y WHERE fields <> ''""")
def _(t: Tables):
    out = quality.check_outcome_integrity(t.select(_OUTCOMES, "orders"), "complete")
    return out.select("id", "violation", "fields")


@query("split_contaminated", "B7", """
    SELECT o_orderkey AS id, CASE WHEN o_custkey % 17 = 0
           THEN concat('suite modified tracked files during the run: a.py, ', o_orderstatus)
           WHEN o_custkey % 19 = 0 THEN 'the suite outlived the timeout meant to bound it' END
           AS contamination FROM orders WHERE o_custkey % 17 = 0 OR o_custkey % 19 = 0""")
def _(t: Tables):
    rows = t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_custkey") % 17 == 0, F.array(F.lit("a.py"), F.col("o_orderstatus")))
        .alias("drifted"),
        F.when(F.col("o_custkey") % 19 == 0, F.lit(False)).alias("enforced"))
    _clean, bad = quality.split_contaminated(rows, "drifted", "enforced", 0.2)
    return bad.select("id", "contamination")


@query("guard_columns", "B8", sql("SELECT repo, count(*) AS n FROM scored GROUP BY repo", "scored"))
def _(t: Tables):
    guarded = quality.guard_columns(t.scored, ["commit_sha", "test_id", "p"], ["label_failed"])
    return guarded.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))


_INERT = """SELECT l_quantity AS hist_a, l_tax * 0 AS hist_b, CAST(NULL AS DOUBLE) AS diff_a,
        CASE WHEN l_linenumber > 0 THEN 1.0 END AS diff_b,
        CASE WHEN l_linenumber = 1 THEN 1.0 END AS diff_c FROM lineitem"""


@query("inert_features", "B9", """
    SELECT * FROM (VALUES ('hist', 'hist_a', 0::BIGINT), ('hist', 'hist_b', 1::BIGINT),
        ('diff', 'diff_a', 1::BIGINT), ('diff', 'diff_b', 1::BIGINT), ('diff', 'diff_c', 0::BIGINT))
        v(family, feature, inert) WHERE (SELECT count(*) FROM lineitem) > 1""")
def _(t: Tables):
    return quality.inert_features(t.select(_INERT, "lineitem"), {
        "hist": ["hist_a", "hist_b"], "diff": ["diff_a", "diff_b", "diff_c"]})


@query("inert_summary", "B9", f"""
    WITH x AS ({_INERT}),
    f AS (SELECT 'hist' AS family, count(DISTINCT hist_a) + max((hist_a IS NULL)::INT) AS v FROM x
          UNION ALL SELECT 'hist', count(DISTINCT hist_b) + max((hist_b IS NULL)::INT) FROM x
          UNION ALL SELECT 'diff', count(DISTINCT diff_a) + max((diff_a IS NULL)::INT) FROM x
          UNION ALL SELECT 'diff', count(DISTINCT diff_b) + max((diff_b IS NULL)::INT) FROM x
          UNION ALL SELECT 'diff', count(DISTINCT diff_c) + max((diff_c IS NULL)::INT) FROM x)
    SELECT family, count(*) AS n_features, count(*) FILTER (WHERE v <= 1) AS n_constant,
           count(*) FILTER (WHERE v > 1) AS n_informative FROM f GROUP BY family""")
def _(t: Tables):
    return quality.inert_summary(quality.inert_features(t.select(_INERT, "lineitem"), {
        "hist": ["hist_a", "hist_b"], "diff": ["diff_a", "diff_b", "diff_c"]}))


@query("pseudonymise", "B10", """
    SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'anonymous_author'
           ELSE substr(sha256(lower(trim(c_name))), 1, 16) END AS author FROM customer""")
def _(t: Tables):
    name = F.when(F.col("c_custkey") % 10 == 0, F.lit("")).otherwise(
        F.concat(F.lit("  "), F.col("c_name")))
    return t.customer.select("c_custkey", quality.pseudonymise(name).alias("author"))


# A secret in every shape, built from the document id, in front of the whole document text.
_SECRETIVE = """SELECT doc_id, concat('Authorization: Bearer ', CAST(doc_id AS STRING), chr(10),
        'MY_API_KEY_1 = k', CAST(doc_id AS STRING), chr(10), 'go to https://user', ':pw@host/x?token=t',
        CAST(doc_id AS STRING), '&b=1 with ghp_', repeat('a', 24), ' and sk-', repeat('b', 24),
        ' and hunter2', chr(10), text) AS text FROM documents"""


def _redact_sql(column: str) -> str:
    out = f"replace(replace({column}, 'hunter22', '[REDACTED]'), 'hunter2', '[REDACTED]')"
    for shape in (r"\b(?:gh[pousr]_[A-Za-z0-9_]{20,}|github_pat_[A-Za-z0-9_]{20,})\b",
                  r"\bsk-ant-[A-Za-z0-9_-]{16,}\b", r"\bsk-[A-Za-z0-9_-]{20,}\b"):
        out = f"regexp_replace({out}, '{shape}', '[REDACTED]', 'g')"
    for shape, tail in (
        (r"(?im)^(\s*(?:authorization|x-api-key)\s*:\s*).+$", ""),
        (r"(?im)^(\s*[A-Za-z_][A-Za-z0-9_]*(?:TOKEN|SECRET|PASSWORD|API_KEY|AUTH)[A-Za-z0-9_]*\s*=\s*).+$", ""),
        (r"(?i)(https?://)([^\s/@:]+)(?::[^\s/@]*)?@", "@"),
        (r"(?i)([?&](?:token|key|secret|password|signature|sig|api_key)=)[^&#\s]+", "")):
        out = f"regexp_replace({out}, '{shape}', '\\1[REDACTED]{tail}', 'g')"
    return out


@query("redact_secrets", "B11", f"""
    WITH s AS ({_SECRETIVE}), x AS (SELECT doc_id, {_redact_sql('text')} AS clean FROM s)
    SELECT doc_id, sha256(clean) AS digest, length(clean) AS n,
           len(regexp_extract_all(clean, 'REDACTED')) AS n_redacted FROM x""")
def _(t: Tables):
    rows = t.select(_SECRETIVE, "documents").select(
        "doc_id", quality.redact_secrets(F.col("text"), ["hunter2", "hunter22"]).alias("clean"))
    return rows.select("doc_id", F.sha2("clean", 256).alias("digest"), F.length("clean").alias("n"),
                       F.regexp_count("clean", F.lit("REDACTED")).alias("n_redacted"))


# Documents as logs: the invented prose rarely says "error", so a common syllable is renamed.
_LOGS = "SELECT doc_id AS run_id, replace(text, 'oren', ' error ') AS text FROM documents"
_LINES = r"""CASE WHEN text = '' THEN [] ELSE string_split_regex(regexp_replace(text,
        '(\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}])\z', ''),
        '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') END"""
_CONTEXT = f"""
    WITH l AS (SELECT run_id, {_LINES} AS ls FROM ({_LOGS}) x),
    e AS (SELECT run_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM l),
    h AS (SELECT *, CASE WHEN regexp_matches(line, '(?i)(?:error|failed|failure|exception|traceback|assertion|fatal|module not found|no module named|exit code|timed out|permission denied)')
          THEN 1 ELSE 0 END AS hit FROM e),
    w AS (SELECT *, max(hit) OVER (PARTITION BY run_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND
          3 FOLLOWING) AS near, sum(hit) OVER (PARTITION BY run_id) AS n_hits,
          count(*) OVER (PARTITION BY run_id) AS n FROM h),
    c AS (SELECT run_id, max(n_hits) AS n_error_lines, string_agg(line, chr(10) ORDER BY i)
          AS context FROM w WHERE near = 1 OR (n_hits = 0 AND i > n - 80) GROUP BY run_id)"""


@query("failure_context", "B12", f"""{_CONTEXT}
    SELECT l.run_id, coalesce(CAST(n_error_lines AS BIGINT), 0) AS n_error_lines,
           sha256(coalesce(context, '')) AS digest, length(coalesce(context, '')) AS n
    FROM l LEFT JOIN c ON l.run_id = c.run_id""")
def _(t: Tables):
    out = quality.failure_context(t.select(_LOGS, "documents"), "text")
    return out.select("run_id", "n_error_lines", F.sha2("context", 256).alias("digest"),
                      F.length("context").alias("n"))


@query("assemble_evidence", "B13", f"""{_CONTEXT},
    b AS (SELECT run_id % 200 AS run, lpad(CAST(run_id AS STRING), 9, '0') AS name, context FROM c
          WHERE regexp_matches(context, '{quality.INK}')),
    a AS (SELECT run, substr(string_agg('--- ' || name || ' ---' || chr(10) || context,
          chr(10) || chr(10) ORDER BY name, context), 1, 5000) AS evidence FROM b GROUP BY run)
    SELECT r.run, sha256(evidence) AS digest, length(evidence) AS n,
           CASE WHEN evidence IS NULL THEN 'no readable evidence' END AS error
    FROM (SELECT DISTINCT doc_id % 200 AS run FROM documents) r LEFT JOIN a ON r.run = a.run""")
def _(t: Tables):
    logs = quality.failure_context(t.select(_LOGS, "documents"), "text").select(
        (F.col("run_id") % 200).alias("run"),
        F.lpad(F.col("run_id").cast("string"), 9, "0").alias("name"), "context")
    out = quality.assemble_evidence(logs, "run", "name", "context", 5000)
    return out.select("run", F.sha2("evidence", 256).alias("digest"),
                      F.length("evidence").alias("n"), "error")
