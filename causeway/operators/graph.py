"""Import graph: edges, distances and dependency features."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import materialise
from . import joins

# Fixed value: the depth reported for an unreachable pair.
UNREACHABLE_DEPTH = 10


def module_name(path: Column) -> Column:
    """Dotted module name of a file; a package initialiser stands for its folder."""
    dotted = F.regexp_replace(F.regexp_replace(path, r"\.py", ""), r"[/\\]", ".")
    return F.regexp_replace(dotted, r"\.__init__$", "")


def import_edges(files: DataFrame, imports: DataFrame, path: str, module: str) -> DataFrame:
    """Edges importer -> imported project file.

    A module is known by its dotted name and by its stem; on a clash the later path wins.  An
    import is looked up whole, then by its first component.
    """
    known = files.select(path, F.explode(F.array(
        module_name(F.col(path)), text.file_stem(F.col(path)))).alias("__key"))
    known = known.groupBy("__key").agg(F.max(path).alias("__file"))
    wanted = imports.select(F.col(path).alias("src"), F.col(module).alias("__m")).distinct()
    exact = known.select(F.col("__key").alias("__m"), F.col("__file").alias("__exact"))
    base = known.select(F.col("__key").alias("__b"), F.col("__file").alias("__base"))
    looked = wanted.join(exact, "__m", "left").withColumn(
        "__b", F.element_at(F.split("__m", r"\."), 1)).join(base, "__b", "left")
    edges = looked.select("src", F.coalesce("__exact", "__base").alias("dst"))
    return edges.filter("dst IS NOT NULL AND dst <> src").distinct()


def distances_to(edges: DataFrame, targets: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Shortest distance from every node that reaches a target, level by level.

    ``targets`` has one column ``target``.  Each level is one join of the frontier with the
    edges and one anti-join against what is known; the known set is checkpointed per level so
    that the lineage stays short and a lost executor costs a re-read.
    """
    # Read once per level, so the distinct edges are worked out only once.
    back = materialise(
        edges.select(F.col("dst").alias("node"), F.col("src").alias("__next")).distinct())
    known = materialise(targets.select("target").distinct().select(
        "target", F.col("target").alias("node"), F.lit(0).alias("depth")))
    frontier, depth = known, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        reached = frontier.join(back, "node").select("target", F.col("__next").alias("node"))
        fresh = reached.distinct().join(known, ["target", "node"], "left_anti")
        frontier = materialise(fresh.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
        if depth % 5 == 0:  # keep the union of levels flat
            known = materialise(known)
    return known


# How many commits have their places in one row of a node: enough to fold most rows of a node into
# one, few enough that a node that everything imports stays a small row.
_PLACES = 4096


def _folded(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(commit, node) rows as (node, part, places): a node once per part of the commits, with a list."""
    return rows.join(ids, "commit").groupBy("node", "part").agg(F.array_distinct(F.collect_list("place")).alias("places"))


def _moved(frontier: DataFrame, edges: DataFrame, known: DataFrame) -> DataFrame:
    """One step along ``edges`` (node, next): (node, part, all, fresh), without and with what is known."""
    steps = frontier.join(edges, "node").select(F.col("next").alias("node"), "part", F.col("places").alias("new"))
    old = known.select("node", "part", F.col("places").alias("old"))
    met = steps.unionByName(old, True).groupBy("node", "part").agg(
        F.flatten(F.collect_list("new")).alias("new"), F.flatten(F.collect_list("old")).alias("old"))
    return met.filter(F.size("new") > 0).select("node", "part", F.col("new").alias("all"),
                                                F.array_except("new", "old").alias("fresh"))


def _within(rows: DataFrame, name: str, others: DataFrame) -> DataFrame:
    """What the lists ``name`` and the places of ``others`` share, as (node, part, places)."""
    kept = rows.select("node", "part", name).join(others.select("node", "part", F.col("places").alias("__other")),
                                                  ["node", "part"])
    return kept.select("node", "part", F.array_intersect(name, "__other").alias("places")).filter(F.size("places") > 0)


def _near_parts(back: DataFrame, files: DataFrame) -> DataFrame:
    """(node, part) of the nodes from which a file can be reached that some commit of the part changes."""
    known = frontier = materialise(files.select("node", "part").distinct())
    for level in itertools.count(1):
        steps = frontier.join(back, "node").select(F.col("next").alias("node"), "part").distinct()
        frontier = materialise(steps.join(known, ["node", "part"], "left_anti"))
        if frontier.isEmpty():
            return materialise(known)
        known = known.unionByName(frontier)
        if level % 5 == 0:
            known = materialise(known)


def nearest_change(edges: DataFrame, changed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(commit, node, depth, direct) of every wanted row with a path to a changed file of its commit.

    ``edges`` (src, dst; distinct), ``changed`` (commit, node) and ``wanted`` (commit, node) with the
    tests in question; ``depth`` is the shortest import distance, ``direct`` says whether the node itself
    imports a changed file. The first search finds which nodes have a path to a file that any commit of
    a part changes, the second, among those, what a commit's own tests import, however indirectly; the
    third runs backwards from all files of a commit at once and keeps to that. A node carries its
    commits as lists, so a level exchanges nodes and not (commit, node) rows; what is stored is bounded
    by commits x nodes that their tests import. A level is one job.
    """
    edges = materialise(edges.filter("src <> dst").select("src", "dst"))
    onward = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("next"))
    commits = wanted.select("commit").distinct().join(changed.select("commit").distinct(), "commit", "left_semi")
    numbered = materialise(commits.orderBy("commit").select("commit", F.monotonically_increasing_id().alias("id")))
    id_ = F.col("id")
    ids = numbered.select("commit", F.floor(id_ / _PLACES).alias("part"), (id_ % _PLACES).cast("int").alias("place"))
    tests, files = materialise(_folded(wanted, ids)), materialise(_folded(changed, ids))

    near = _near_parts(back, files)
    tests = materialise(tests.join(near, ["node", "part"], "left_semi"))
    imported = frontier = tests
    for level in itertools.count(1):
        found = _moved(frontier, onward, imported).select("node", "part", F.col("fresh").alias("places"))
        frontier = materialise(found.filter(F.size("places") > 0).join(near, ["node", "part"], "left_semi"))
        if frontier.isEmpty():
            break
        imported = imported.unionByName(frontier)
        if level % 5 == 0:  # keep the union of levels flat
            imported = materialise(imported)
    imported = materialise(imported)

    frontier = known = materialise(_within(files, "places", imported))
    depths, direct = [known.withColumn("depth", F.lit(0))], None
    for level in itertools.count(1):
        moved = _moved(frontier, back, known)
        if direct is None:
            moved = materialise(moved)
            direct = _within(moved, "all", tests)
        frontier = materialise(_within(moved, "fresh", imported))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
        depths.append(frontier.withColumn("depth", F.lit(level)))
        if level % 5 == 0:
            known, depths = materialise(known), [materialise(reduce(DataFrame.unionByName, depths))]
    settled = reduce(DataFrame.unionByName, depths).join(
        tests.withColumnRenamed("places", "__tests"), ["node", "part"]).select(
        "node", "part", F.explode(F.array_intersect("places", "__tests")).alias("place"), "depth")
    hits = direct.select("node", "part", F.explode("places").alias("place"), F.lit(1).alias("direct"))
    both = settled.unionByName(hits, True).groupBy("node", "part", "place").agg(
        F.min("depth").alias("depth"), F.max("direct").alias("direct"))
    return both.join(ids, ["part", "place"]).select("commit", "node", "depth", "direct")


def dependency_features(
    pairs: DataFrame, changed: DataFrame, edges: DataFrame, commit: str, test: str, path: str
) -> DataFrame:
    """Dependency features of every (commit, test) row against the commit's changed files."""
    pairs, edges = materialise(pairs), materialise(edges.select("src", "dst").distinct())
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    files = materialise(changed.select(F.col(commit).alias("commit"), F.col(path).alias("node")).distinct())
    in_graph = materialise(files.join(nodes, "node", "left_semi").select("commit", "node"))
    wanted = pairs.select(F.col(commit).alias("commit"), F.col(test).alias("node"))
    nearest = nearest_change(edges, in_graph, wanted).select(
        F.col("commit").alias(commit), F.col("node").alias(test), F.col("depth").alias("__depth"),
        F.col("direct").alias("__direct"))
    reverse = edges.groupBy(F.col("dst").alias("node")).agg(F.count("src").alias("__in"))
    most = in_graph.join(reverse, "node", "left").groupBy(F.col("commit").alias(commit)).agg(
        F.max(F.coalesce("__in", F.lit(0))).alias("__reverse"))
    out = edges.groupBy(F.col("src").alias(test)).agg(F.count("dst").alias("__out"))
    coupled = _name_coupled(pairs, files, commit, test)
    both = [commit, test]
    joined = (
        pairs.join(nearest, both, "left").join(coupled, both, "left")
        .join(most, commit, "left").join(out, test, "left"))
    return joined.select(
        *pairs.columns,
        F.coalesce("__direct", F.lit(0)).alias("dep_is_direct_import"),
        F.coalesce("__coupled", F.lit(0)).alias("dep_name_heuristic_coupled"),
        F.coalesce("__depth", F.lit(UNREACHABLE_DEPTH)).alias("dep_shortest_path_depth"),
        F.col("__depth").isNotNull().cast("int").alias("dep_is_reachable"),
        F.coalesce("__reverse", F.lit(0)).alias("dep_max_reverse_dependencies"),
        F.coalesce("__out", F.lit(0)).alias("dep_test_total_out_degree"))


def _name_coupled(pairs: DataFrame, files: DataFrame, commit: str, test: str) -> DataFrame:
    """(commit, test) rows whose bare stem is contained in a changed stem of the commit."""
    # Names are cut once per distinct string, not once per row and use.
    stems = materialise(files.join(files.select("node").distinct().withColumn(
        "stem", text.file_stem(F.col("node").cast("string"))), "node").select("commit", "stem").distinct())
    bare = F.regexp_replace(F.regexp_replace(
        text.file_stem(F.col(test).cast("string")), "test_", ""), "_test", "")
    names = pairs.select(test).distinct().withColumn("bare", bare)
    tests = materialise(pairs.select(F.col(commit).alias("commit"), test).distinct().join(names, test))
    found = joins.containments(tests, stems, ["commit"], "bare", "stem").select("commit", "bare").distinct()
    return tests.join(found, ["commit", "bare"], "left_semi").select(
        F.col("commit").alias(commit), test).distinct().withColumn("__coupled", F.lit(1))


# Path components too common to carry a dependency.
GENERIC_ROOTS = ("src", "tests", "test", "lib", "app", "core", "pkg")


def path_overlap_score(
    candidates: DataFrame, test: str, changed: str, imports: str,
    generic: Sequence[str] = GENERIC_ROOTS,
) -> DataFrame:
    """1.0 for a direct import, else the best token Jaccard capped at 0.9; no imports give 0.1.

    ``candidates`` holds the (test, changed file, import list) rows to score; the result is
    one row per test.
    """
    clean = F.regexp_replace(F.regexp_replace(changed, r"[/\\]", "."), r"\.py", "")

    def tokens(column: Column, lower: bool = False) -> Column:
        return F.array_distinct(F.filter(
            F.split(column, r"\."),
            lambda t: ~(F.lower(t) if lower else t).isin(*generic) if generic else F.lit(True)))

    module_tokens = F.filter(tokens(clean, True), lambda t: t != "")
    import_tokens = F.flatten(F.transform(imports, lambda i: F.split(i, r"\.")))
    direct = F.arrays_overlap(module_tokens, import_tokens) | F.array_contains(
        F.col(imports), clean)
    left = tokens(F.regexp_replace(test, r"[/\\]", "."))
    right = tokens(F.regexp_replace(changed, r"[/\\]", "."))
    overlap = F.size(F.array_intersect(left, right)) / F.size(F.array_union(left, right))
    scored = candidates.select(
        test, F.size(imports).alias("__n"), F.coalesce(direct, F.lit(False)).alias("__d"),
        F.coalesce(overlap, F.lit(0.0)).alias("__o"))
    return scored.groupBy(test).agg(
        F.when(F.max("__n") <= 0, F.lit(0.1)).when(F.max(F.col("__d")), F.lit(1.0))
        .otherwise(F.least(F.max("__o"), F.lit(0.9))).alias("score"))


def dependency_variance(
    features: DataFrame, by: Sequence[str], names: Sequence[str], minimum: int = 3
) -> DataFrame:
    """How many features take more than one value, and how many distinct vectors there are."""
    rounded = features.select(*by, *[F.round(n, 4).alias(n) for n in names])
    vectors = rounded.distinct()  # everything below works on the distinct vectors
    varies = [(F.min(n) != F.max(n)).cast("int") for n in names]
    return vectors.groupBy(*by).agg(
        sum(varies[1:], varies[0]).alias("n_varying"),
        F.count(F.lit(1)).alias("n_vectors"),
        F.array_compact(F.array(*[
            F.when(F.min(n) != F.max(n), F.lit(n)) for n in names])).alias("varying"),
    ).withColumn("passed", F.col("n_varying") >= minimum)
