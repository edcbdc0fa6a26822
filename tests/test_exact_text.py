"""Texts of means that lie halfway between two digits, in any order of the rows."""

from __future__ import annotations

import random
from fractions import Fraction

import duckdb

from causeway.plans import registry


def test_interval_text_rounds_halves_by_the_exact_mean(spark, tmp_path):
    rng = random.Random(3)
    cents = {u: [rng.randrange(11) for _ in range(200)] for u in range(1, 61)}
    rows = [(u, c / 100) for u, all_ in cents.items() for c in all_]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "l_suppkey long, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")

    def text(u, bound):  # ten-thousandths of the mean less the bound, halves away from zero
        x = Fraction(sum(cents[u]) * 100, len(cents[u])) - bound
        whole = int(abs(x) + Fraction(1, 2)) * (1 if x > 0 else -1)
        return f"{whole / 10000 + 0.0:.4f}"

    name = "interval_text"
    found = {r.unit: r.cell for r in registry.queries()[name](spark, str(tmp_path)).collect()}
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert dict(connection.execute(f"SELECT unit, cell FROM ({registry.oracle_sql()[name]})").fetchall()) == found
    for u in cents:
        if u % 11 and u % 5 and u % 7:
            assert found[u] == f"{text(u, 500)}% [{text(u, 510)}, {text(u, 490)}]", u
