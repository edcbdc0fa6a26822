"""The search for the nearest changed file, against breadth-first searches commit by commit."""

import random

import pytest

from causeway.operators import graph


def brute(edges, changed, test):
    seen, frontier, depth = {test}, {test}, 0
    while frontier:
        if frontier & changed:
            return depth
        frontier = {b for a, b in edges if a in frontier} - seen
        seen |= frontier
        depth += 1
    return None


@pytest.mark.parametrize("places", [3, 4096])
def test_features_equal_a_search_per_commit(spark, monkeypatch, places):
    """Cycles, loops, repeated rows, commits without tests or files, tests outside the graph, nulls."""
    monkeypatch.setattr(graph, "_PLACES", places, raising=False)
    rng = random.Random(places)
    edges = {(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(45)} | {("n1", "n1"), ("n2", "n3"), ("n3", "n2")}
    changed = {(c, f"n{rng.randrange(34)}") for c in range(1, 9) for _ in range(2)}
    pairs = [(c, f"n{i}") for c in range(8) for i in range(0, 34, 2 + c % 2)] + [(3, "n0"), (3, "n0"), (None, "n1"), (2, None)]
    found = graph.dependency_features(
        spark.createDataFrame(pairs, "c int, t string"),
        spark.createDataFrame(sorted(changed) * 2 + [(None, "n1"), (4, None)], "c int, p string"),
        spark.createDataFrame(sorted(edges) * 2, "src string, dst string"), "c", "t", "p").collect()
    assert sorted(repr((r.c, r.t)) for r in found) == sorted(map(repr, pairs))
    nodes = {v for e in edges for v in e}
    for r in found:
        files = {p for c, p in changed if c == r.c}
        depth = None if r.c is None or r.t is None else brute(edges, files & nodes, r.t)
        assert (r.dep_shortest_path_depth, r.dep_is_reachable) == ((10, 0) if depth is None else (depth, 1)), r
        assert r.dep_is_direct_import == int(r.c is not None and any(a == r.t and a != b and b in files for a, b in edges))
        assert r.dep_name_heuristic_coupled == int(r.t is not None and any(r.t in p for p in files))
        assert r.dep_test_total_out_degree == sum(a == r.t for a, _ in edges)


def test_a_commit_keeps_to_what_its_tests_import(spark, monkeypatch):
    """A file that everything imports is changed; every commit has one test."""
    stored, store = [], graph.materialise

    def counted(df):
        kept = store(df)
        stored.append(kept.count() if {"commit", "places"} & set(kept.columns) else 0)
        return kept

    monkeypatch.setattr(graph, "materialise", counted)
    edges = spark.createDataFrame([(f"n{i}", "hub") for i in range(300)], "src string, dst string")
    commits = spark.range(40).selectExpr("id AS commit", "'hub' AS node")
    wanted = spark.range(40).selectExpr("id AS commit", "concat('n', id) AS node")
    found = graph.nearest_change(edges, commits, wanted).collect()
    assert sorted((r.commit, r.node, r.depth, r.direct) for r in found) == [(i, f"n{i}", 1, 1) for i in range(40)]
    assert max(stored) <= 80
