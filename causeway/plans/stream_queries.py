"""Registered queries: drift detection and Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import micros
from ..operators.models import ModelConfig
from ..session import scratch_folder
from ..streaming import drift, ingest
from .catalog import Tables, query, r, sql


def _errors(t: Tables):
    rows = t.scored.withColumn("shifted", F.when(
        F.col("ts") > "1999-01-01", 1 - F.col("p")).otherwise(F.col("p") * 0.3))
    errors = drift.commit_errors(
        rows.withColumn("day", F.col("ts").cast("date")), ["repo"], "day", micros("ts"), "label",
        "shifted")
    return errors


@query("commit_errors", "M1 M3", sql(f"""
    SELECT repo, CAST(CAST(ts AS DATE) AS STRING) AS day,
           {r("avg(abs(label - CASE WHEN ts > TIMESTAMP '1999-01-01' THEN 1 - p ELSE p * 0.3 END))")}
               AS error FROM scored GROUP BY 1, 2""", "scored"))
def _(t: Tables):
    return _errors(t).select("repo", "day", "error")


# The recurrence row by row, as a recursive query over the ordered errors.
_RECURRENCE = """
    WITH RECURSIVE e AS (SELECT repo, CAST(CAST(ts AS DATE) AS STRING) AS day, epoch_us(min(ts)) AS first_at,
        avg(abs(label - CASE WHEN ts > TIMESTAMP '1999-01-01' THEN 1 - p ELSE p * 0.3 END)) AS error
        FROM scored GROUP BY 1, 2),
    o AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY first_at, day) AS pos FROM e),
    s AS (SELECT DISTINCT repo, CAST(0 AS BIGINT) AS pos, 0::DOUBLE AS mean, 0::DOUBLE AS total, 0::DOUBLE AS low,
          0 AS samples, 0::DOUBLE AS stat, '' AS day, CAST(0 AS BIGINT) AS first_at FROM e
      UNION ALL SELECT repo, pos, m, CASE WHEN st > 1 THEN 0 ELSE t2 END, CASE WHEN st > 1 THEN 0 ELSE l2 END,
          CASE WHEN st > 1 THEN 0 ELSE samples + 1 END, st, day, first_at FROM (
          SELECT *, t2 - l2 AS st FROM (SELECT *, least(low, t2) AS l2 FROM (
          SELECT *, total + (error - m - 0.005::DOUBLE) AS t2 FROM (
          SELECT o.repo, o.pos, o.day, o.first_at, o.error, s.low, s.total, s.samples, CASE WHEN s.samples = 0
              THEN o.error ELSE 0.99::DOUBLE * s.mean + (1.0::DOUBLE - 0.99::DOUBLE) * o.error END AS m
          FROM s JOIN o ON o.repo = s.repo AND o.pos = s.pos + 1) a) b) c) d)"""


@query("page_hinkley", "M1", sql(_RECURRENCE + f"""
    SELECT repo, day, {r('stat')} AS statistic FROM s WHERE stat > 1""", "scored"))
def _(t: Tables):
    out = drift.page_hinkley(_errors(t), ["repo"], ["at", "day"], "error", threshold=1.0)
    return out.filter("alarm = 1").select("repo", "day", "statistic")


@query("page_hinkley_stream", "M1", sql(_RECURRENCE + f"""
    SELECT repo, first_at AS "at", {r('stat')} AS statistic FROM s WHERE stat > 1""", "scored"))
def _(t: Tables):
    folder = scratch_folder(t.spark)
    errors = _errors(t).select("repo", "at", "error")
    errors.repartition(1).write.parquet(f"{folder}/in")
    stream = ingest.replay_files(t.spark, f"{folder}/in", errors.schema)
    found = drift.page_hinkley_stream(stream, "repo", "at", "error", threshold=1.0)
    ingest.run_available(found, f"{folder}/out", f"{folder}/state")
    return t.spark.read.parquet(f"{folder}/out").filter("alarm = 1").select("repo", "at", "statistic")


@query("replay_buffer", "M2", sql("""
    WITH u AS (SELECT event_id, ts, 0 AS late FROM runs WHERE event_id % 2 = 0 UNION ALL
               SELECT event_id, ts, 1 FROM runs WHERE event_id % 2 = 1)
    SELECT event_id FROM u ORDER BY late DESC, ts DESC, event_id DESC LIMIT 1000""", "runs"))
def _(t: Tables):
    rows = t.runs.select("event_id", "ts")
    return drift.replay_buffer(
        rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1"),
        ["ts", "event_id"], 1000).select("event_id")


@query("continual_learn", "M3")
def _(t: Tables):
    folder = scratch_folder(t.spark)
    rows = t.select("""SELECT CAST(CAST(l_shipdate AS DATE) AS STRING) AS day, l_quantity AS a, l_discount AS b,
        CASE WHEN (l_partkey * 7 + l_orderkey * 13) % 100 < l_quantity THEN 1 ELSE 0 END AS label,
        l_shipdate FROM lineitem""", "lineitem").withColumn("at", micros("l_shipdate")).drop("l_shipdate")
    early = rows.filter("day < '1998-01-01'")
    late = rows.filter("day >= '1998-01-01'")
    # Three runs over the same folders, files arriving between them: each goes on from the state tables.
    for begin, end in (("1998", "1999"), ("1999", "2001"), ("2001", "2999")):
        part = late.filter((F.col("day") >= begin) & (F.col("day") < end))
        part.repartitionByRange(2, "at").write.mode("append").parquet(f"{folder}/in")
        learner = ingest.ContinualLearner(
            early, ["a", "b"], "label", "day", "at", f"{folder}/learner", 1000, drift.PageHinkley(threshold=0.5),
            ModelConfig(trees=2, depth=2))
        learner.run(ingest.replay_files(t.spark, f"{folder}/in", rows.schema), f"{folder}/out",
                    f"{folder}/state")
    return t.spark.read.parquet(f"{folder}/out").select("commit", "error", "alarm", "adaptations")


@query("ordered_commit_stream", "M4", sql("""
    WITH s AS (SELECT repo, l_orderkey, min(ts) AS ts, arg_min(test_id, (ts, test_id)) AS i FROM scored GROUP BY 1, 2)
    SELECT repo, l_orderkey, row_number() OVER (PARTITION BY repo ORDER BY ts, i, l_orderkey) AS position
    FROM s""", "scored"))
def _(t: Tables):
    out = drift.ordered_commit_stream(t.scored, "repo", "l_orderkey", "ts", "test_id", ["label"])
    return out.select("repo", "l_orderkey", "position").distinct()


def _experiment(t: Tables):
    rows = t.scored.withColumn("day", F.col("ts").cast("date"))
    errors = drift.commit_errors(rows, ["repo"], "day", micros("ts"), "label", "p")
    placed = drift.ordered_commit_stream(errors, "repo", "day", "at", "at")
    lifted = placed.withColumn("error", F.col("error") + F.col("repo") * 0.1)
    return drift.drift_experiment(lifted, "repo", "position", "error", [0.25, 1.0, 4.0], 100, 500)


# The streams of the experiment and the recurrence over all of them at once.
_TRACED = """
    WITH RECURSIVE e AS (SELECT repo, CAST(ts AS DATE) AS day, epoch_us(min(ts)) AS first_at,
        avg(abs(label - p)) + repo * 0.1 AS error FROM scored GROUP BY 1, 2),
    o AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY first_at, day) AS pos FROM e),
    nx AS (SELECT repo AS src, coalesce(lead(repo) OVER (ORDER BY repo), min(repo) OVER ()) AS dst
           FROM (SELECT DISTINCT repo FROM o) q),
    st AS (SELECT 'stationary' AS kind, repo AS src, 'source' AS segment, pos - 100 AS step, error FROM o
               WHERE pos > 100 AND pos <= 600
           UNION ALL SELECT 'shift', repo, 'source', pos - 100, error FROM o WHERE pos > 100 AND pos <= 600
           UNION ALL SELECT 'shift', src, 'target', pos + 500, error FROM o JOIN nx ON o.repo = nx.dst WHERE pos <= 500),
    x AS (SELECT *, row_number() OVER (PARTITION BY kind, src, threshold ORDER BY step, segment) AS n
          FROM st, (SELECT unnest([0.25::DOUBLE, 1.0::DOUBLE, 4.0::DOUBLE]) AS threshold) g),
    s AS (SELECT DISTINCT kind, src, threshold, CAST(0 AS BIGINT) AS n, 0::DOUBLE AS mean, 0::DOUBLE AS total,
                 0::DOUBLE AS low, 0 AS samples, 0::DOUBLE AS stat, '' AS segment, CAST(0 AS BIGINT) AS step,
                 0::DOUBLE AS error FROM x
      UNION ALL SELECT kind, src, threshold, n, m, CASE WHEN stat > threshold THEN 0 ELSE t2 END,
          CASE WHEN stat > threshold THEN 0 ELSE l2 END, CASE WHEN stat > threshold THEN 0 ELSE samples + 1 END, stat,
          segment, step, error FROM (
          SELECT *, t2 - l2 AS stat FROM (SELECT *, least(low, t2) AS l2 FROM (
          SELECT *, total + (error - m - 0.005::DOUBLE) AS t2 FROM (
          SELECT x.kind, x.src, x.threshold, x.n, x.segment, x.step, x.error, s.low, s.total, s.samples,
              CASE WHEN s.samples = 0 THEN x.error ELSE 0.99::DOUBLE * s.mean + (1.0::DOUBLE - 0.99::DOUBLE) * x.error
              END AS m
          FROM s JOIN x ON x.kind = s.kind AND x.src = s.src AND x.threshold = s.threshold AND x.n = s.n + 1) a) b) c) d),
    a AS (SELECT *, stat > threshold AS alarm FROM s WHERE n > 0)"""


@query("drift_experiment", "M5 E28", sql(_TRACED + f"""
    SELECT src AS repo, {r('threshold')} AS threshold, count(*) FILTER (segment = 'source') AS source_samples,
           count(*) FILTER (segment = 'target') AS target_samples,
           count(*) FILTER (alarm AND segment = 'source') AS false_alarms_before_shift,
           min(step - 500) FILTER (alarm AND segment = 'target') AS latency,
           CAST(count(*) FILTER (alarm AND segment = 'target') > 0 AS BIGINT) AS detected
    FROM a WHERE kind = 'shift' GROUP BY src, threshold""", "scored"))
def _(t: Tables):
    return _experiment(t)[1]


@query("drift_stationary", "M5", sql(_TRACED + f"""
    SELECT src AS repo, {r('threshold')} AS threshold, count(*) AS streamed, count(*) FILTER (alarm) AS false_alarms,
           count(*) FILTER (alarm) AS adaptations, {r('avg(error)')} AS mean_error
    FROM a WHERE kind = 'stationary' GROUP BY src, threshold""", "scored"))
def _(t: Tables):
    return _experiment(t)[0]


@query("resume_ingest", "M6", """
    SELECT user_id, count(*) AS n FROM (SELECT DISTINCT event_id, user_id FROM events) e GROUP BY user_id""")
def _(t: Tables):
    folder = scratch_folder(t.spark)
    events = t.events.select("event_id", "user_id")
    # The second file repeats half of the first; a restart then finds nothing new to take.
    events.repartition(1).write.parquet(f"{folder}/in")
    events.filter("event_id % 2 = 0").repartition(1).write.mode("append").parquet(f"{folder}/in")
    for _restart in range(2):
        stream = ingest.replay_files(t.spark, f"{folder}/in", events.schema)
        ingest.run_available(ingest.resume_ingest(stream, ["event_id"]), f"{folder}/out",
                             f"{folder}/state")
    taken = t.spark.read.parquet(f"{folder}/out")
    return taken.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


_EVENTS = """SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'pull_request' WHEN 1 THEN 'workflow_run' ELSE 'ping' END
        AS kind,
    CASE user_id % 3 WHEN 0 THEN concat('{"action": "', CASE event_type WHEN 'error' THEN 'opened' WHEN 'click'
        THEN 'closed' ELSE 'synchronize' END, '", "number": ', CAST(user_id AS STRING),
        ', "repository": {"full_name": "org/r', CAST(user_id % 5 AS STRING), '"}, "pull_request": {"head": {"sha": "s',
        CAST(event_id AS STRING), '"}}}')
    ELSE concat('{"repository": {"full_name": "org/r', CAST(user_id % 5 AS STRING), '"}, "workflow_run": {"id": ',
        CAST(event_id AS STRING), ', "conclusion": "', CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END,
        '", "html_url": "u", "head_sha": "h", "pull_requests": [{"number": ', CAST(user_id AS STRING), '}]}}') END AS body
    FROM events"""


def _event_stream(t: Tables):
    folder = scratch_folder(t.spark)
    events = t.select(_EVENTS, "events")
    events.write.parquet(f"{folder}/in")
    return ingest.replay_files(t.spark, f"{folder}/in", events.schema), folder


@query("pr_event_stream", "M7", """
    SELECT event_id, CASE event_type WHEN 'error' THEN 'opened' ELSE 'synchronize' END AS action,
           concat('org/r', CAST(user_id % 5 AS STRING)) AS repo, user_id AS number,
           concat('s', CAST(event_id AS STRING)) AS head_sha
    FROM events WHERE user_id % 3 = 0 AND event_type <> 'click'""")
def _(t: Tables):
    stream, folder = _event_stream(t)
    ingest.run_available(ingest.pr_event_stream(stream, "kind", "body"), f"{folder}/out", f"{folder}/state")
    return t.spark.read.parquet(f"{folder}/out")


@query("failed_run_stream", "M7", """
    SELECT event_id, concat('org/r', CAST(user_id % 5 AS STRING)) AS repo, event_id AS run_id, 'u' AS run_url,
           'h' AS head_sha, user_id AS number
    FROM events WHERE user_id % 3 = 1 AND event_type = 'error'""")
def _(t: Tables):
    stream, folder = _event_stream(t)
    ingest.run_available(ingest.failed_run_stream(stream, "kind", "body"), f"{folder}/out",
                         f"{folder}/state")
    return t.spark.read.parquet(f"{folder}/out")
