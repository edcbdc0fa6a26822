"""The registered corpus queries against their SQL, and the pipeline stage by stage."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import check  # noqa: E402
from helpers import line_dedup, near, quality  # noqa: E402

import corpus_pipeline  # noqa: E402
from causeway.llm import queries  # noqa: E402
from causeway.llm.common import store  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    found = duckdb.connect()
    for table in check.TABLES:
        found.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return found


@pytest.mark.parametrize("name", queries.queries())
def test_query_matches_its_sql(spark, connection, name):
    line, good = check.compare(spark, connection, DATA, name, queries.queries()[name],
                               queries.oracle_sql().get(name))
    assert good, line


def test_stages_match_plain_python(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    tables = []
    for _, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, DATA))
        tables.append(docs)
    assert all(t.columns == list(corpus_pipeline.COLUMNS) for t in tables[:-1])
    good, lines, copies, clean, packed = (t.collect() for t in tables)
    assert sorted(r.doc_id for r in good) == sorted(k for k, r in rows.items() if quality(r.text)[-1])
    wanted = line_dedup(sorted((r.doc_id, r.text) for r in good), 8, 5, 5)
    assert sorted((r.doc_id, r.text) for r in lines) == sorted(
        (k, t) for k, _, lost, t in wanted if not lost or t.split())
    kept = [k for k, _, _, stays in near([(r.doc_id, r.text) for r in lines], 5) if stays]
    assert sorted(r.doc_id for r in copies) == sorted(kept)
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in copies)
    assert all(r.n_chars == len(r.text) for r in lines + clean)
    assert {r.doc_id for r in packed} == {r.doc_id for r in clean}
    assert sum(r.length for r in packed if r.start + r.length == r.doc_tokens) > 0


def test_toxicity_on_held_out_rows(spark):
    found = queries.queries()["op10_toxicity"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = found.filter("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in rows)
    assert hit >= 0.8 * sum(r.toxic for r in rows) and hit >= 0.9 * sum(r.predicted for r in rows)
