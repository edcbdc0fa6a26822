"""The registry behind ``queries()`` and ``oracle_sql()``, and the views they share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure

# Views over the provided tables. The text is valid on Spark and on DuckDB alike.
VIEWS: dict[str, str] = {
    "runs": """
        SELECT event_id, user_id AS test_id, user_id % 5 AS repo, ts,
               CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label_failed,
               value AS duration, CAST(CAST(ts AS DATE) AS STRING) AS commit_sha,
               event_type,
               CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) % 3 AS retry_count
        FROM events""",
    "scored": """
        SELECT l_suppkey AS commit_sha, l_partkey AS test_id, l_orderkey, l_linenumber,
               CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
               l_quantity / 51 AS p, l_tax AS uncertainty,
               l_extendedprice / 1000 AS duration, l_suppkey % 5 AS repo, l_shipdate AS ts
        FROM lineitem""",
    "commits": """
        SELECT o_orderkey AS sha, o_orderdate AS ts, o_orderpriority AS repo,
               o_custkey AS author, o_orderstatus AS message
        FROM orders""",
    "changed_files": """
        SELECT l_orderkey AS commit_sha, l_linenumber, l_suppkey,
               concat(p_brand, '/', p_type, '/', p_name) AS path,
               CAST(l_quantity AS BIGINT) AS lines_added, l_linenumber AS lines_deleted
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "decisions": """
        SELECT c_custkey AS decision_id, c_custkey AS commit_sha,
               CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS abstained,
               abs(c_acctbal) / 10000 AS uncertainty,
               CASE WHEN c_acctbal < 0 THEN 'ABSTAIN' ELSE 'FAST' END AS mode,
               c_nationkey AS selected_count, 25 AS total_count,
               1 - c_nationkey / CAST(25 AS DOUBLE) AS estimated_saving
        FROM customer""",
    "outcomes": """
        SELECT o_orderkey AS commit_sha,
               CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS ground_truth_complete,
               CASE WHEN o_orderstatus = 'F' THEN f.failures END AS actual_failures,
               CASE WHEN o_orderstatus = 'F' THEN f.missed END AS missed_failures,
               CASE WHEN o_orderstatus = 'F' THEN f.full_duration END AS full_duration,
               CASE WHEN o_orderstatus = 'F' THEN f.selected_duration / f.full_duration END
                   AS time_ratio,
               f.selected_duration, f.caught AS detected_failures
        FROM orders JOIN (
            SELECT l_orderkey,
                   sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS failures,
                   sum(CASE WHEN l_returnflag = 'R' AND l_quantity < 10 THEN 1 ELSE 0 END)
                       AS missed,
                   sum(CASE WHEN l_returnflag = 'R' AND l_quantity >= 10 THEN 1 ELSE 0 END)
                       AS caught,
                   sum(l_extendedprice / 1000) AS full_duration,
                   sum(CASE WHEN l_quantity >= 10 THEN l_extendedprice / 1000 ELSE 0 END)
                       AS selected_duration
            FROM lineitem GROUP BY l_orderkey) f ON o_orderkey = f.l_orderkey""",
    "doc_labels": """
        SELECT d.doc_id, d.source, d.lang, l.quality AS y,
               least(d.n_chars / CAST(5000 AS DOUBLE), 1.0) AS p
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "repeat_runs": """
        SELECT conv_id AS test_id, turn AS run,
               CASE WHEN length(text) % 4 = 1 AND turn % 3 = 2 THEN 'FAILED'
                    WHEN length(text) % 16 = 2 THEN 'SKIPPED'
                    WHEN length(text) % 16 = 3 THEN 'ERROR' ELSE 'PASSED' END AS status,
               length(text) / CAST(100 AS DOUBLE) AS duration
        FROM conversations""",
    "paths": """
        SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')
               AS path FROM pages""",
    "logs": "SELECT doc_id AS run_id, source AS repo, text FROM documents",
}

_VIEW_INPUTS: dict[str, tuple[str, ...]] = {
    "runs": ("events",), "scored": ("lineitem",), "commits": ("orders",),
    "changed_files": ("lineitem", "part"), "decisions": ("customer",),
    "outcomes": ("orders", "lineitem"), "doc_labels": ("labels", "documents"),
    "repeat_runs": ("conversations",), "paths": ("pages",),
    "logs": ("documents",),
}


class Tables:
    """The provided tables and the views over them, for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = configure(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        return self.select(VIEWS[name], *_VIEW_INPUTS[name])

    def select(self, text: str, *inputs: str) -> DataFrame:
        """Run SQL ``text`` over provided tables or views named in ``inputs``."""
        for name in inputs:
            frame = self.view(name) if name in VIEWS else self.base(name)
            frame.createOrReplaceTempView(name)
        return self.spark.sql(text)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.view(name) if name in VIEWS else self.base(name)


@dataclass(frozen=True)
class Entry:
    build: Callable[[Tables], DataFrame]
    oracle: str | None
    survey: str


ENTRIES: dict[str, Entry] = {}


def query(name: str, survey: str, oracle: str | None = None):
    """Register a query under ``name``; ``survey`` is the inventory id it covers."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in ENTRIES:
            raise ValueError(f"query {name!r} is registered twice")
        ENTRIES[name] = Entry(build, oracle, survey)
        return build

    return register


def sql(body: str, *views: str) -> str:
    """Oracle text: the named views as common table expressions in front of ``body``."""
    if not views:
        return body
    clauses = [f"{name} AS ({VIEWS[name]})" for name in views]
    stripped = body.strip()
    if stripped.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(clauses) + ", " + stripped[len("WITH RECURSIVE "):]
    if stripped.upper().startswith("WITH "):
        return "WITH " + ", ".join(clauses) + ", " + stripped[len("WITH "):]
    return "WITH " + ", ".join(clauses) + " " + stripped


def r(expression: str) -> str:
    """SQL text that rounds a double the way ``present`` does on the Spark side."""
    return f"round(CAST({expression} AS DOUBLE) + 1e-9, 6)"


def rounded(column: Column) -> Column:
    # The tiny offset keeps decimal ties from depending on summation order.
    return F.round(column.cast("double") + F.lit(1e-9), 6)


def present(df: DataFrame) -> DataFrame:
    """Comparable form of a result: doubles rounded, counts as BIGINT, flags as 0/1."""
    outputs = []
    for field in df.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType.typeName()
        if kind in ("double", "float") or kind.startswith("decimal"):
            column = rounded(column)
        elif kind in ("integer", "short", "byte", "boolean"):
            column = column.cast("int").cast("long")
        elif kind in ("timestamp", "timestamp_ntz"):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif kind == "date":
            column = column.cast("string")
        elif kind == "array":
            column = F.array_join(column.cast("array<string>"), "|")
        outputs.append(column.alias(field.name))
    return df.select(*outputs)
