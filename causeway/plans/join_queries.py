"""Registered queries: joins, set operations and the import graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, joins
from .catalog import Tables, query, r, sql
from .feature_queries import PATH_PAIRS, dirs_sql, overlap_sql, tokens_sql

_PAIR_INPUT = """SELECT c.c_nationkey AS repo, o_orderkey AS commit_sha FROM orders
    JOIN customer c ON o_custkey = c_custkey"""
_PAIR_TESTS = "SELECT l_suppkey % 25 AS repo, l_partkey AS test_id FROM lineitem"
_PAIR_RUNS = """SELECT l_orderkey AS commit_sha, l_partkey AS test_id,
    CASE l_returnflag WHEN 'R' THEN 'FAILED' WHEN 'N' THEN 'ERROR' ELSE 'PASSED' END AS status
    FROM lineitem"""


@query("build_pairs", "C1", f"""
    WITH c AS ({_PAIR_INPUT}), t AS (SELECT DISTINCT repo, test_id FROM ({_PAIR_TESTS}) x),
    rn AS (SELECT commit_sha, test_id, max(CASE WHEN status IN ('FAILED', 'ERROR') THEN 1 ELSE 0 END)
           AS label FROM ({_PAIR_RUNS}) x GROUP BY 1, 2),
    z AS (SELECT repo, count(*) AS n FROM t GROUP BY repo),
    s AS (SELECT c.repo, c.commit_sha, count(*) AS ran, sum(label) AS failed FROM c
          JOIN rn ON rn.commit_sha = c.commit_sha JOIN t ON t.repo = c.repo AND t.test_id = rn.test_id
          GROUP BY 1, 2)
    SELECT CAST(c.repo AS BIGINT) AS repo, c.commit_sha, z.n AS n_pairs, coalesce(ran, 0) AS n_ran,
           CAST(coalesce(failed, 0) AS BIGINT) AS n_failed
    FROM c JOIN z ON z.repo = c.repo LEFT JOIN s ON s.commit_sha = c.commit_sha""")
def _(t: Tables):
    commits = t.select(_PAIR_INPUT, "orders", "customer").withColumn("repo", F.col("repo").cast("long"))
    _ran, counts = joins.build_pairs(
        commits, t.select(_PAIR_TESTS, "lineitem"), t.select(_PAIR_RUNS, "lineitem"), "repo",
        "commit_sha", "test_id", "status")
    return counts


@query("pair_labels", "C1", f"""
    WITH c AS ({_PAIR_INPUT}), t AS (SELECT DISTINCT repo, test_id FROM ({_PAIR_TESTS}) x),
    rn AS (SELECT commit_sha, test_id, max(CASE WHEN status IN ('FAILED', 'ERROR') THEN 1 ELSE 0 END)
           AS label FROM ({_PAIR_RUNS}) x GROUP BY 1, 2)
    SELECT CAST(c.repo AS BIGINT) AS repo, c.commit_sha, rn.test_id, CAST(label AS BIGINT) AS label
    FROM c JOIN rn ON rn.commit_sha = c.commit_sha
    JOIN t ON t.repo = c.repo AND t.test_id = rn.test_id""")
def _(t: Tables):
    commits = t.select(_PAIR_INPUT, "orders", "customer").withColumn("repo", F.col("repo").cast("long"))
    ran, _counts = joins.build_pairs(
        commits, t.select(_PAIR_TESTS, "lineitem"), t.select(_PAIR_RUNS, "lineitem"), "repo",
        "commit_sha", "test_id", "status")
    return ran


_KILLS = """SELECT l_suppkey % 5 AS repo, l_orderkey * 5 + l_suppkey % 5 AS mutant,
    CASE WHEN l_returnflag = 'R' THEN l_partkey END AS test_id FROM lineitem"""
_UNIVERSE = "SELECT DISTINCT p_size % 5 AS repo, p_partkey AS test_id FROM part WHERE p_size < 40"


@query("expand_kill_labels", "C2", f"""
    WITH k AS ({_KILLS}), u AS ({_UNIVERSE}), g AS (SELECT DISTINCT repo, mutant FROM k),
    z AS (SELECT repo, count(*) AS n FROM u GROUP BY repo),
    h AS (SELECT k.repo, k.mutant, count(DISTINCT k.test_id) AS n FROM k JOIN u
          ON u.repo = k.repo AND u.test_id = k.test_id GROUP BY 1, 2)
    SELECT g.repo, g.mutant, z.n AS universe_size, coalesce(h.n, 0) AS n_killed,
           CAST(h.n IS NOT NULL AS BIGINT) AS detected
    FROM g JOIN z ON z.repo = g.repo LEFT JOIN h ON h.repo = g.repo AND h.mutant = g.mutant""")
def _(t: Tables):
    groups = t.select(_KILLS, "lineitem").groupBy("repo", "mutant").agg(
        F.collect_list("test_id").alias("killed"))
    universe = t.select(_UNIVERSE, "part").withColumn("repo", F.col("repo").cast("long"))
    _hits, counts = joins.expand_kill_labels(groups, universe, "repo", "mutant", "killed", "test_id")
    return counts


@query("score_distinct_and_join", "C3", f"""
    WITH d AS (SELECT l_partkey, avg(p_retailprice) * 2 AS s FROM lineitem
               JOIN part ON l_partkey = p_partkey GROUP BY 1)
    SELECT l.l_suppkey, count(*) AS n, {r('sum(s)')} AS total FROM lineitem l
    LEFT JOIN d ON d.l_partkey = l.l_partkey GROUP BY l.l_suppkey""")
def _(t: Tables):
    prices = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")

    def scorer(keys):
        return keys.join(prices, "l_partkey").select(
            "l_partkey", (F.col("p_retailprice") * 2).alias("s"))

    out = joins.score_distinct_and_join(t.lineitem.select("l_suppkey", "l_partkey"),
                                        ["l_partkey"], scorer)
    return out.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("total"))


@query("join_embeddings", "C4", f"""
    SELECT d.doc_id, {r('embedding[1]')} AS emb_0, {r('embedding[2]')} AS emb_1,
           {r('embedding[64]')} AS emb_63
    FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id""")
def _(t: Tables):
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    out = joins.join_embeddings(t.documents.select("doc_id"), vectors, "doc_id", "embedding", 64)
    return out.select("doc_id", "emb_0", "emb_1", "emb_63")


_TWO = """SELECT l_orderkey AS commit_sha, 'ref' AS strategy, count(*) FILTER (WHERE l_quantity > 30
        AND l_returnflag = 'R') AS d, count(*) FILTER (WHERE l_returnflag = 'R') AS f
    FROM lineitem GROUP BY l_orderkey UNION ALL
    SELECT l_orderkey, 'other', count(*) FILTER (WHERE l_tax > 0.03 AND l_returnflag = 'R'),
        count(*) FILTER (WHERE l_returnflag = 'R') FROM lineitem WHERE l_orderkey % 3 <> 0
    GROUP BY l_orderkey"""


@query("pair_strategies", "C7", f"""
    WITH s AS ({_TWO})
    SELECT a.commit_sha, {r('a.d / CAST(a.f AS DOUBLE)')} AS ref, {r('b.d / CAST(b.f AS DOUBLE)')} AS other
    FROM s a JOIN s b ON a.commit_sha = b.commit_sha
    WHERE a.strategy = 'ref' AND b.strategy = 'other' AND a.f > 0 AND b.f > 0""")
def _(t: Tables):
    pairs, _report = joins.pair_strategies(t.select(_TWO, "lineitem"), "ref", "other", "d", "f")
    return pairs


@query("pair_strategies_report", "C7", f"""
    WITH s AS ({_TWO})
    SELECT count(*) AS available, count(*) FILTER (WHERE a.f > 0 AND b.f > 0) AS used,
           count(*) FILTER (WHERE NOT (a.f > 0 AND b.f > 0)) AS dropped
    FROM s a JOIN s b ON a.commit_sha = b.commit_sha
    WHERE a.strategy = 'ref' AND b.strategy = 'other'""")
def _(t: Tables):
    return joins.pair_strategies(t.select(_TWO, "lineitem"), "ref", "other", "d", "f")[1]


@query("recent_decisions", "C8", sql(f"""
    SELECT substr(CAST(d.commit_sha AS STRING), 1, 8) AS short_sha, mode, {r('uncertainty')} AS uncertainty
    FROM decisions d JOIN commits c ON c.sha = d.commit_sha
    ORDER BY c.ts DESC, d.commit_sha LIMIT 10""", "decisions", "commits"))
def _(t: Tables):
    commits = t.commits.select(F.col("sha").alias("commit_sha"), "ts")
    out = joins.recent_decisions(t.decisions, commits, "commit_sha", "ts", ["commit_sha"], 10)
    return out.select("short_sha", "mode", "uncertainty")


@query("commits_with_decisions", "C9", sql(f"""
    SELECT c.sha AS commit_sha, coalesce(mode, 'NOT_EVALUATED') AS mode,
           CAST(coalesce(abstained, 0) AS BIGINT) AS abstained, {r('estimated_saving')} AS estimated_saving
    FROM commits c LEFT JOIN decisions d ON c.sha = d.commit_sha""", "commits", "decisions"))
def _(t: Tables):
    commits = t.commits.select(F.col("sha").alias("commit_sha"))
    out = joins.commits_with_decisions(commits, t.decisions, "commit_sha")
    return out.select("commit_sha", "mode", "abstained", "estimated_saving")


@query("nearest_source", "C10", f"""
    WITH o AS (SELECT DISTINCT l_orderkey, test_path, changed FROM ({PATH_PAIRS.replace(
        "'Module.py') AS changed", "'Module.py') AS changed0").replace(
        "AS fn", "AS fn, concat('src/core/', lower(p_type), '/', p_brand, 'X', replace(p_name, ' ', '_'), '.py') AS changed")}) x),
    s AS (SELECT *, {tokens_sql('changed')} AS tc, {tokens_sql('test_path')} AS tt,
          {dirs_sql('changed')} AS dc, {dirs_sql('test_path')} AS dt FROM o),
    q AS (SELECT l_orderkey, test_path, changed, CASE WHEN len(tc) > 0 AND len(tt) > 0
          THEN 2.0 * len(list_intersect(tc, tt)) / (len(tc) + len(tt)) ELSE 0 END AS sim,
          {overlap_sql('dc', 'dt')} AS ov FROM s),
    k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, test_path
          ORDER BY sim DESC, ov DESC, changed) AS rk FROM q)
    SELECT l_orderkey, test_path, changed AS nearest, {r('sim')} AS similarity, {r('ov')} AS overlap
    FROM k WHERE rk = 1""")
def _(t: Tables):
    changed = ("concat('src/core/', lower(p_type), '/', p_brand, 'X', replace(p_name, ' ', '_'), "
               "'.py') AS changed2")
    rows = t.select(PATH_PAIRS.replace("AS fn", f"AS fn, {changed}"), "lineitem", "part").select(
        "l_orderkey", "test_path", F.col("changed2").alias("changed"))
    return joins.nearest_source(rows, ["l_orderkey"], "test_path", "changed")


@query("insert_if_absent", "C11", """
    WITH t AS (SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 2 = 0),
    n AS (SELECT o_custkey AS id, concat('order-', CAST(min(o_orderkey) AS STRING)) AS name
          FROM orders GROUP BY 1)
    SELECT id, name FROM t UNION ALL
    SELECT id, name FROM n WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.id = n.id)""")
def _(t: Tables):
    target = t.customer.filter("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    rows = t.orders.select(F.col("o_custkey").alias("id"), "o_orderkey", F.concat(
        F.lit("order-"), F.col("o_orderkey").cast("string")).alias("name"))
    return joins.insert_if_absent(target, rows, ["id"], F.col("o_orderkey"))


@query("delete_cascade", "C12", """
    SELECT 'customer' AS name, count(*) AS n FROM customer WHERE c_nationkey <> 3 UNION ALL
    SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN
        (SELECT c_custkey FROM customer WHERE c_nationkey = 3) UNION ALL
    SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders
        WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3))""")
def _(t: Tables):
    tables = {"customer": t.customer, "orders": t.orders, "lineitem": t.lineitem}
    doomed = t.customer.filter("c_nationkey = 3").select("c_custkey")
    kept = joins.delete_cascade(tables, "customer", doomed, [
        ("orders", "o_custkey", "customer", "c_custkey"),
        ("lineitem", "l_orderkey", "orders", "o_orderkey")])
    counts = None
    for name, frame in kept.items():
        one = frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return counts


@query("skip_processed", "C13 M6", """
    SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN
        (SELECT l_orderkey FROM lineitem WHERE l_quantity > 20)""")
def _(t: Tables):
    done = t.lineitem.filter("l_quantity > 20").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.skip_processed(t.orders.select("o_orderkey"), done, ["o_orderkey"])


@query("orphans", "C13", """
    SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_orderkey NOT IN
        (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def _(t: Tables):
    done = t.lineitem.select(F.col("l_orderkey").alias("id"))
    sample = t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"))
    return joins.orphans(done, sample, ["id"])


_DOCUMENTED = """SELECT DISTINCT CASE WHEN p_size % 9 = 0 THEN concat(p_brand, '/', p_type, '.py')
        ELSE concat(p_brand, '/', p_type, '.py::', replace(p_name, ' ', '_')) END AS doc
    FROM part"""
_MEASURED = """SELECT DISTINCT concat(p_brand, '/', p_type, '::K', CAST(p_size % 4 AS STRING), '::',
        replace(p_name, ' ', '_'), '[', CAST(p_size AS STRING), ']') AS item FROM part"""


@query("match_documented", "C14", f"""
    WITH d AS (SELECT doc, regexp_replace(split_part(doc, '::', 1), '\\.py$', '') AS h,
               split_part(doc, '::', 2) AS n FROM ({_DOCUMENTED}) x),
    m AS (SELECT item, split_part(item, '::', 1) AS h,
          regexp_replace(split_part(item, '::', 3), '\\[.*$', '') AS n FROM ({_MEASURED}) y)
    SELECT doc, item FROM d LEFT JOIN m ON d.h = m.h AND (d.n = '' OR d.n = m.n)""")
def _(t: Tables):
    return joins.match_documented(t.select(_DOCUMENTED, "part"), t.select(_MEASURED, "part"),
                                  "doc", "item")


_IDS = """SELECT DISTINCT CASE WHEN p_size % 6 = 0 THEN concat('noseparator', p_brand)
        ELSE concat('root/', p_brand, '/', p_type, '/', replace(p_name, ' ', '_'), '/TestCase::',
        'test_', p_name, '[a::', CAST(p_size AS STRING), ']') END AS test_id FROM part"""
_FILES = """SELECT DISTINCT CASE WHEN p_size % 4 = 0 THEN concat(p_brand, '/', p_type, '.py')
        WHEN p_size % 4 = 1 THEN concat(p_type, '/', replace(p_name, ' ', '_'), '.py')
        WHEN p_size % 4 = 2 THEN concat(replace(p_name, ' ', '_'), '.py')
        ELSE concat('root/', p_brand, '/', p_type, '/', replace(p_name, ' ', '_'), '.py') END AS path
    FROM part"""


@query("resolve_ids", "C15", f"""
    WITH i AS (SELECT test_id, CASE WHEN contains(test_id, '::')
               THEN list_filter(string_split(substr(test_id, 1, instr(test_id, '::') - 1), '/'), lambda s: s <> '') END AS seg,
               substr(test_id, instr(test_id, '::') + 2) AS fn FROM ({_IDS}) x),
    k AS (SELECT *, unnest(range(1, len(seg) + 1)) AS k FROM i WHERE seg IS NOT NULL),
    s AS (SELECT *, unnest(range(0, k)) AS st FROM k),
    c AS (SELECT *, array_to_string(seg[st + 1:k], '/') || '.py' AS path FROM s),
    h AS (SELECT c.*, row_number() OVER (PARTITION BY test_id ORDER BY k DESC, st) AS rk
          FROM c JOIN ({_FILES}) f ON f.path = c.path)
    SELECT i.test_id, h.path AS test_path, array_to_string(h.seg[h.k + 1:], '.') AS test_class,
           h.fn AS test_function
    FROM i LEFT JOIN h ON i.test_id = h.test_id AND h.rk = 1""")
def _(t: Tables):
    return joins.resolve_ids(t.select(_IDS, "part"), t.select(_FILES, "part"), "test_id", "path")


_IMPORTS = """SELECT p_partkey % 97 AS test, CASE p_size % 4
        WHEN 0 THEN concat('src.', lower(p_type), '.', replace(p_name, ' ', '_'))
        WHEN 1 THEN split_part(p_name, ' ', 2) WHEN 2 THEN concat(lower(p_type), '.', split_part(p_name, ' ', 1))
        ELSE 'os' END AS module FROM part"""
_MODULES = """SELECT DISTINCT concat('src/', lower(p_type), '/', CASE WHEN p_size % 2 = 0
        THEN replace(p_name, ' ', '_') ELSE split_part(p_name, ' ', 1) END, '.py') AS path
    FROM part"""


@query("direct_import", "C17", f"""
    WITH i AS (SELECT DISTINCT test, module FROM ({_IMPORTS}) x), f AS ({_MODULES}),
    g AS (SELECT path, regexp_extract(path, '([^/]*)\\.py$', 1) AS stem,
          replace(regexp_replace(path, '\\.py$', ''), '/', '.') AS dotted FROM f)
    SELECT DISTINCT test, path FROM i JOIN g ON list_contains(string_split(module, '.'), stem)
        OR ends_with(module, dotted) OR ends_with(dotted, module)""")
def _(t: Tables):
    return joins.direct_import(t.select(_IMPORTS, "part"), t.select(_MODULES, "part"), "test",
                               "module", "path")


_OWN_IMPORTS = """SELECT l_orderkey AS commit_sha, concat('tests/t', CAST(l_partkey AS STRING), '.py') AS test,
        concat(CASE l_linenumber % 2 WHEN 0 THEN 'lib.' ELSE '' END, split_part(p_name, ' ', 1), '.',
               CASE l_suppkey % 3 WHEN 0 THEN 'utils' ELSE split_part(p_name, ' ', 2) END) AS module
    FROM lineitem JOIN part ON l_partkey = p_partkey"""
_OWN_CHANGES = """SELECT l_orderkey AS commit_sha, concat('src/', split_part(p_name, ' ', 1), '/',
        CASE l_linenumber % 3 WHEN 0 THEN 'utils' ELSE split_part(p_name, ' ', 2) END, '.py') AS path
    FROM lineitem JOIN part ON l_partkey = p_partkey"""


@query("direct_import_by_commit", "C17", f"""
    WITH i AS (SELECT DISTINCT * FROM ({_OWN_IMPORTS}) x), f AS (SELECT DISTINCT * FROM ({_OWN_CHANGES}) y),
    g AS (SELECT commit_sha, path, regexp_extract(path, '([^/]*)\\.py$', 1) AS stem,
          replace(regexp_replace(path, '\\.py$', ''), '/', '.') AS dotted FROM f)
    SELECT DISTINCT i.commit_sha, test, path FROM i JOIN g ON i.commit_sha = g.commit_sha AND (
        list_contains(string_split(module, '.'), stem) OR ends_with(module, dotted) OR ends_with(dotted, module))""")
def _(t: Tables):
    return joins.direct_import(
        t.select(_OWN_IMPORTS, "lineitem", "part"), t.select(_OWN_CHANGES, "lineitem", "part"),
        "test", "module", "path", ["commit_sha"])


@query("union_corpora", "H1", """
    SELECT repo, count(*) AS n, count(DISTINCT grp) AS groups_, count(tax) AS with_tax FROM (
      SELECT 'a' AS repo, concat('a::', CAST(l_orderkey AS STRING)) AS grp, NULL AS tax FROM lineitem
      WHERE l_linenumber % 2 = 1 UNION ALL
      SELECT 'b', concat('b::', CAST(l_orderkey AS STRING)), l_tax FROM lineitem
      WHERE l_linenumber % 2 = 0) x GROUP BY repo""")
def _(t: Tables):
    first = t.lineitem.filter("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("grp"))
    second = t.lineitem.filter("l_linenumber % 2 = 0").select(
        F.col("l_orderkey").alias("grp"), F.col("l_tax").alias("tax"))
    out = joins.union_corpora({"a": first, "b": second}, "grp")
    return out.groupBy("repo").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("grp").alias("groups_"),
        F.count("tax").alias("with_tax"))


@query("detected", "H2", """
    SELECT l_orderkey AS commit_sha, count(DISTINCT CASE WHEN l_quantity > 25 THEN l_partkey END)
               AS n_selected,
           count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS n_failing,
           coalesce(max(k), 0) AS n_detected
    FROM lineitem LEFT JOIN (SELECT o, count(*) AS k FROM
        (SELECT l_orderkey AS o, l_partkey FROM lineitem WHERE l_quantity > 25 INTERSECT
         SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R') i GROUP BY o) d
    ON d.o = l_orderkey WHERE l_quantity > 25 OR l_returnflag = 'R' GROUP BY l_orderkey""")
def _(t: Tables):
    rows = t.lineitem.select(F.col("l_orderkey").alias("commit_sha"),
                             F.col("l_partkey").alias("test_id"), "l_quantity", "l_returnflag")
    return joins.detected(rows.filter("l_quantity > 25"), rows.filter("l_returnflag = 'R'"),
                          "commit_sha", "test_id")


_OVERLAY = """SELECT l_orderkey AS bug, l_linenumber, l_suppkey,
    concat(CASE l_suppkey % 3 WHEN 0 THEN 'tests/' WHEN 1 THEN 'src/' ELSE 'tests2/' END, p_name) AS path
    FROM lineitem JOIN part ON l_partkey = p_partkey"""


@query("overlay_paths", "H4", f"""
    WITH o AS ({_OVERLAY})
    SELECT bug, path FROM o WHERE l_linenumber % 3 = 1 UNION
    SELECT bug, path FROM o WHERE l_linenumber % 3 = 2 AND path LIKE 'tests/%' EXCEPT
    SELECT bug, path FROM o WHERE l_linenumber % 3 = 0""")
def _(t: Tables):
    rows = t.select(_OVERLAY, "lineitem", "part")
    return joins.overlay_paths(
        rows.filter("l_linenumber % 3 = 1"), rows.filter("l_linenumber % 3 = 2"),
        rows.filter("l_linenumber % 3 = 0"), "bug", "path", ["tests/"])


_GRAPH_FILES = """SELECT concat('src/m', CAST(s_suppkey % 20 AS STRING), '/f', CAST(s_suppkey AS STRING),
    '.py') AS path FROM supplier"""
_GRAPH_IMPORTS = """SELECT concat('src/m', CAST(l_suppkey % 20 AS STRING), '/f', CAST(l_suppkey AS STRING),
        '.py') AS path,
    CASE l_linenumber % 3 WHEN 0 THEN concat('src.m', CAST(l_partkey % 20 AS STRING), '.f',
        CAST(l_partkey % 100 AS STRING)) WHEN 1 THEN concat('f', CAST(l_partkey % 200 AS STRING), '.helper')
    ELSE concat('f', CAST(l_partkey % 150 AS STRING)) END AS module
    FROM lineitem"""


@query("import_edges", "D1", f"""
    WITH f AS ({_GRAPH_FILES}), i AS (SELECT DISTINCT path, module FROM ({_GRAPH_IMPORTS}) x),
    k AS (SELECT key, max(path) AS file FROM (
          SELECT replace(regexp_replace(path, '\\.py$', ''), '/', '.') AS key, path FROM f UNION ALL
          SELECT regexp_extract(path, '([^/]*)\\.py$', 1), path FROM f) q GROUP BY key)
    SELECT DISTINCT i.path AS src, coalesce(a.file, b.file) AS dst
    FROM i LEFT JOIN k a ON a.key = i.module LEFT JOIN k b ON b.key = split_part(i.module, '.', 1)
    WHERE coalesce(a.file, b.file) <> i.path""")
def _(t: Tables):
    return graph.import_edges(t.select(_GRAPH_FILES, "supplier"),
                              t.select(_GRAPH_IMPORTS, "lineitem"), "path", "module")


# Every part imports one or two parts with a third of its number: a graph that grows and deepens
# with the data, with cycles only at its root.
_EDGES = """SELECT src, dst FROM (SELECT DISTINCT concat('n', CAST(l_partkey AS STRING)) AS src,
        concat('n', CAST(CAST((l_partkey - l_partkey % 3) / 3 + l_suppkey % 2 AS BIGINT) AS STRING)) AS dst
    FROM lineitem) q WHERE src <> dst"""
_G_PAIRS = """SELECT DISTINCT l_suppkey AS commit_sha, concat('n', CAST(l_partkey AS STRING)) AS test
    FROM lineitem"""
_G_CHANGED = """SELECT DISTINCT commit_sha, concat('n', CAST(part AS STRING)) AS path FROM (
        SELECT max(l_suppkey) AS commit_sha, min(l_partkey) AS part FROM lineitem GROUP BY l_orderkey) q"""


@query("dependency_features", "D2", f"""
    WITH RECURSIVE e AS ({_EDGES}), p AS ({_G_PAIRS}), c AS ({_G_CHANGED}),
    nd AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
    ct AS (SELECT c.* FROM c JOIN nd ON nd.node = c.path),
    bfs AS (SELECT DISTINCT path AS target, path AS node, 0 AS depth FROM ct
            UNION SELECT b.target, e.src, b.depth + 1 FROM bfs b JOIN e ON e.dst = b.node
            WHERE b.depth < 24),
    dist AS (SELECT target, node, min(depth) AS depth FROM bfs GROUP BY 1, 2),
    near AS (SELECT commit_sha, node, min(depth) AS depth, max((depth = 1)::INT) AS direct
             FROM ct JOIN dist ON dist.target = ct.path GROUP BY 1, 2),
    rev AS (SELECT dst, count(*) AS n FROM e GROUP BY 1),
    mx AS (SELECT commit_sha, max(coalesce(n, 0)) AS n FROM ct LEFT JOIN rev ON rev.dst = ct.path GROUP BY 1),
    og AS (SELECT src, count(*) AS n FROM e GROUP BY 1)
    SELECT p.commit_sha, p.test, CAST(coalesce(direct, 0) AS BIGINT) AS dep_is_direct_import,
           CAST(EXISTS (SELECT 1 FROM c WHERE c.commit_sha = p.commit_sha AND contains(c.path, p.test))
                AS BIGINT) AS dep_name_heuristic_coupled,
           CAST(coalesce(depth, 10) AS BIGINT) AS dep_shortest_path_depth,
           CAST(depth IS NOT NULL AS BIGINT) AS dep_is_reachable,
           coalesce(mx.n, 0) AS dep_max_reverse_dependencies, coalesce(og.n, 0) AS dep_test_total_out_degree
    FROM p LEFT JOIN near ON near.commit_sha = p.commit_sha AND near.node = p.test
    LEFT JOIN mx ON mx.commit_sha = p.commit_sha LEFT JOIN og ON og.src = p.test""")
def _(t: Tables):
    return graph.dependency_features(
        t.select(_G_PAIRS, "lineitem"), t.select(_G_CHANGED, "lineitem"),
        t.select(_EDGES, "lineitem"), "commit_sha", "test", "path")


_OVERLAP_ROWS = """SELECT l_orderkey AS k, concat('tests/', lower(p_type), '/test_',
        CAST(l_orderkey AS STRING), '.py') AS test,
    concat('src/', CASE l_suppkey % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'promo' END, '/',
        split_part(p_name, ' ', 2), '.py') AS changed,
    CASE l_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'os' WHEN 2 THEN concat('lib.', 'ring')
         ELSE 'src.large.bolt' END AS module
    FROM lineitem JOIN part ON l_partkey = p_partkey"""
_GENERIC = "['src', 'tests', 'test', 'lib', 'app', 'core', 'pkg']"


@query("path_overlap_score", "D3", f"""
    WITH o AS ({_OVERLAP_ROWS}),
    x AS (SELECT *, list_filter(string_split(replace(replace(changed, '/', '.'), '.py', ''), '.'),
          lambda t: NOT list_contains({_GENERIC}, t)) AS mt,
          replace(replace(changed, '/', '.'), '.py', '') AS clean,
          list_distinct(list_filter(string_split(replace(test, '/', '.'), '.'), lambda t: NOT list_contains({_GENERIC}, t))) AS lt,
          list_distinct(list_filter(string_split(replace(changed, '/', '.'), '.'), lambda t: NOT list_contains({_GENERIC}, t))) AS rt
          FROM o),
    s AS (SELECT test, module <> '' AS has_imports, module <> '' AND (list_has_any(mt, string_split(module, '.'))
          OR clean = module) AS d, len(list_intersect(lt, rt)) / CAST(len(list_distinct(list_concat(lt, rt)))
          AS DOUBLE) AS ov FROM x)
    SELECT test, {r('CASE WHEN NOT bool_or(has_imports) THEN 0.1 WHEN bool_or(d) THEN 1.0 ELSE least(max(ov), 0.9) END')}
           AS score FROM s GROUP BY test""")
def _(t: Tables):
    rows = t.select(_OVERLAP_ROWS, "lineitem", "part").withColumn("imports", F.when(
        F.col("module") == "", F.array().cast("array<string>")).otherwise(F.array("module")))
    return graph.path_overlap_score(rows, "test", "changed", "imports")


_DEP_FEATURES = """SELECT l_suppkey % 20 AS repo, l_tax AS a, l_discount AS b,
    CASE WHEN l_suppkey % 20 < 5 THEN 0.0 ELSE l_linenumber * 1.0 END AS c,
    CASE WHEN l_suppkey % 20 < 9 THEN 1.0 ELSE l_quantity END AS d, 1.0 AS e FROM lineitem"""


@query("dependency_variance", "D4", f"""
    WITH x AS (SELECT repo, round(a, 4) AS a, round(b, 4) AS b, round(c, 4) AS c, round(d, 4) AS d,
               round(e, 4) AS e FROM ({_DEP_FEATURES}) q)
    SELECT repo, CAST((min(a) <> max(a))::INT + (min(b) <> max(b))::INT + (min(c) <> max(c))::INT
               + (min(d) <> max(d))::INT + (min(e) <> max(e))::INT AS BIGINT) AS n_varying,
           count(DISTINCT (a, b, c, d, e)) AS n_vectors,
           concat_ws('|', CASE WHEN min(a) <> max(a) THEN 'a' END, CASE WHEN min(b) <> max(b) THEN 'b' END,
               CASE WHEN min(c) <> max(c) THEN 'c' END, CASE WHEN min(d) <> max(d) THEN 'd' END,
               CASE WHEN min(e) <> max(e) THEN 'e' END) AS varying,
           CAST((min(a) <> max(a))::INT + (min(b) <> max(b))::INT + (min(c) <> max(c))::INT
               + (min(d) <> max(d))::INT + (min(e) <> max(e))::INT >= 3 AS BIGINT) AS passed
    FROM x GROUP BY repo""")
def _(t: Tables):
    return graph.dependency_variance(t.select(_DEP_FEATURES, "lineitem"), ["repo"],
                                     ["a", "b", "c", "d", "e"], 3)
