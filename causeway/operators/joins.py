"""Joins between commits, tests, runs, decisions and files, and set operations on them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import ordering


def build_pairs(
    commits: DataFrame, tests: DataFrame, runs: DataFrame, repo: str, commit: str, test: str,
    status: str,
) -> tuple[DataFrame, DataFrame]:
    """Labels of all (commit, test) pairs of a repository, without writing the product out.

    A pair without a run has label 0.  The first result holds the pairs that ran, with their
    label; the second counts per commit how many pairs there are, ran and failed, so the
    remaining ``n_pairs - n_ran`` zero labels are known without being materialised.
    """
    failed = F.col(status).isin("FAILED", "ERROR")
    ran = runs.groupBy(commit, test).agg(F.max(failed.cast("int")).alias("label"))
    ran = ran.join(commits.select(repo, commit), commit).join(
        tests.select(repo, test).distinct(), [repo, test], "left_semi")
    sizes = tests.select(repo, test).distinct().groupBy(repo).agg(
        F.count(F.lit(1)).alias("n_pairs"))
    seen = ran.groupBy(commit).agg(
        F.count(F.lit(1)).alias("__ran"), F.sum("label").alias("__failed"))
    counts = commits.select(repo, commit).join(sizes, repo).join(seen, commit, "left").select(
        repo, commit, "n_pairs", F.coalesce("__ran", F.lit(0)).alias("n_ran"),
        F.coalesce("__failed", F.lit(0)).alias("n_failed"))
    return ran.select(repo, commit, test, "label"), counts


def expand_kill_labels(
    groups: DataFrame, universe: DataFrame, repo: str, group: str, killed: str, test: str
) -> tuple[DataFrame, DataFrame]:
    """Labels from sparse kill lists.

    The first result holds the label-1 rows on the resolved universe (every other universe
    row of a group is label 0); the second says per group how large the universe is and
    whether the group was detected on it.
    """
    listed = groups.select(repo, group, F.explode(F.array_distinct(F.col(killed))).alias(test))
    hits = listed.join(universe.select(repo, test).distinct(), [repo, test], "left_semi")
    sizes = universe.select(repo, test).distinct().groupBy(repo).agg(
        F.count(F.lit(1)).alias("universe_size"))
    found = hits.groupBy(repo, group).agg(F.count(F.lit(1)).alias("n_killed"))
    counts = groups.select(repo, group).join(sizes, repo).join(found, [repo, group], "left")
    counted = counts.withColumn("n_killed", F.coalesce("n_killed", F.lit(0)))
    return hits, counted.withColumn("detected", (F.col("n_killed") > 0).cast("int"))


def score_distinct_and_join(
    df: DataFrame, key: Sequence[str], scorer: Callable[[DataFrame], DataFrame],
    inputs: Sequence[str] = (),
) -> DataFrame:
    """Score every distinct key once and join the scores back."""
    distinct = df.select(*key, *inputs).dropDuplicates(list(key))
    scores = scorer(distinct).drop(*inputs)
    return df.join(scores, list(key), "left")


def join_embeddings(
    df: DataFrame, embeddings: DataFrame, key: str, vector: str, size: int, prefix: str = "emb_"
) -> DataFrame:
    """Attach the components of a per-key vector as columns; unknown keys get NULLs."""
    wide = embeddings.select(
        key, *[F.get(F.col(vector), F.lit(i)).alias(f"{prefix}{i}") for i in range(size)])
    return df.join(wide, key, "left")


def pair_strategies(
    stats: DataFrame, reference: str, other: str, numerator: str, denominator: str,
    commit: str = "commit_sha",
) -> tuple[DataFrame, DataFrame]:
    """One-to-one pairs of two strategies per commit where both denominators are positive.

    A repeated (commit, strategy) row is an error.  The second result counts the available,
    used and dropped pairs.
    """
    both = stats.filter(F.col("strategy").isin(reference, other))
    values = []
    for side, name in (("ref", reference), ("other", other)):
        mine = F.col("strategy") == name
        values += [
            F.count_if(mine).alias(f"__n_{side}"),
            F.max(F.when(mine & (F.col(denominator) > 0), F.col(numerator) / F.col(denominator)))
            .alias(side)]
    wide = both.groupBy(commit).agg(*values)
    unique = F.when((F.col("__n_ref") > 1) | (F.col("__n_other") > 1), F.raise_error(
        F.lit("a commit has more than one row for a strategy"))).otherwise(F.col("ref"))
    matched = wide.withColumn("ref", unique).filter("__n_ref > 0 AND __n_other > 0")
    usable = F.col("ref").isNotNull() & F.col("other").isNotNull()
    report = matched.agg(
        F.count(F.lit(1)).alias("available"), F.count_if(usable).alias("used"),
        F.count_if(~usable).alias("dropped"))
    return matched.filter(usable).select(commit, "ref", "other"), report


def recent_decisions(
    decisions: DataFrame, commits: DataFrame, commit: str, created: str, ties: Sequence[str],
    n: int = 10,
) -> DataFrame:
    """The newest decisions with a short commit name."""
    joined = decisions.join(commits, commit)
    newest = joined.orderBy(F.col(created).desc(), *[F.col(t) for t in ties]).limit(n)
    return newest.withColumn("short_sha", F.substring(F.col(commit).cast("string"), 1, 8))


def commits_with_decisions(commits: DataFrame, decisions: DataFrame, commit: str) -> DataFrame:
    """Every commit with its decision, or NOT_EVALUATED."""
    joined = commits.join(decisions, commit, "left")
    return joined.withColumns({
        "mode": F.coalesce("mode", F.lit("NOT_EVALUATED")),
        "abstained": F.coalesce(F.col("abstained").cast("int"), F.lit(0)),
    })


def nearest_source(candidates: DataFrame, keys: Sequence[str], test: str, changed: str) -> DataFrame:
    """The most similar changed file of every test: token dice, then path overlap, then name.

    ``candidates`` holds the (test, changed file) rows to choose from, as an observation
    table carries them; the choice is one combinable aggregate.
    """
    pairs = candidates.select(*keys, test, changed).distinct()
    # Many keys hold the same two paths, which are compared once.
    scores = candidates.select(F.col(test).alias("__test"), F.col(changed).alias("__changed")).distinct().withColumns({
        "__sim": text.dice(text.identifier_tokens(F.col("__changed")),
                           text.identifier_tokens(F.col("__test"))),
        "__overlap": text.path_overlap(F.col("__changed"), F.col("__test")),
    })
    scored = pairs.join(scores, F.col(test).eqNullSafe(F.col("__test"))
                        & F.col(changed).eqNullSafe(F.col("__changed")))
    rank = F.struct((-F.col("__sim")).alias("s"), (-F.col("__overlap")).alias("o"), F.col(changed))
    best = scored.groupBy(*keys, test).agg(
        F.min_by(F.struct(changed, "__sim", "__overlap"), rank).alias("b"))
    return best.select(*keys, test, F.col("b")[changed].alias("nearest"),
                       F.col("b.__sim").alias("similarity"), F.col("b.__overlap").alias("overlap"))


def insert_if_absent(
    target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Column
) -> DataFrame:
    """Target plus the rows whose key it lacks; the first row per key wins."""
    payload = F.struct(*rows.columns)
    first = rows.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(
        F.min_by(payload, order).alias("r")).select("r.*")
    fresh = first.join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def delete_cascade(
    tables: Mapping[str, DataFrame], root: str, doomed: DataFrame,
    links: Sequence[tuple[str, str, str, str]],
) -> dict[str, DataFrame]:
    """Delete parent rows and everything that refers to them.

    ``doomed`` has the key column(s) of the root rows to delete; each link is
    (child, child foreign key, parent, parent key), parents before children.
    """
    keys = list(doomed.columns)
    removed = {root: tables[root].join(doomed, keys, "left_semi")}
    kept = {root: tables[root].join(doomed, keys, "left_anti")}
    for child, foreign, parent, key in links:
        gone = removed[parent].select(F.col(key).alias(foreign)).distinct()
        current, lost = kept.get(child, tables[child]), removed.get(child)
        newly = current.join(gone, foreign, "left_semi")
        removed[child] = newly if lost is None else lost.unionByName(newly)
        kept[child] = current.join(gone, foreign, "left_anti")
    return {name: kept.get(name, frame) for name, frame in tables.items()}


def skip_processed(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key has not been processed yet."""
    return df.join(done.select(*keys), list(keys), "left_anti")


def orphans(done: DataFrame, sample: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Processed keys that the current sample no longer contains."""
    return done.select(*keys).distinct().join(sample.select(*keys), list(keys), "left_anti")


def verify_resumable(done: DataFrame, sample: DataFrame, keys: Sequence[str]) -> None:
    """Refuse to resume when processed keys are absent from the sample."""
    lost = orphans(done, sample, keys)
    shown = lost.limit(5).collect()
    if shown:
        raise ValueError(f"processed ids absent from the sample, e.g. {[tuple(r) for r in shown]}")


def match_documented(
    documented: DataFrame, measured: DataFrame, doc: str, item: str
) -> DataFrame:
    """Documented ids with the measured ids they refer to, one row per match.

    A file-only id matches every measured test of the file; an id without a match keeps one
    row with a NULL.
    """
    head, name = text.canonical_key(F.col(doc))
    docs = documented.select(doc).distinct().withColumns({"__head": head, "__name": name})
    m_head, m_name = text.canonical_key(F.col(item))
    found = measured.select(item).distinct().withColumns({"__head": m_head, "__name": m_name})
    exact = docs.filter("__name <> ''").join(found, ["__head", "__name"], "left")
    whole = docs.filter("__name = ''").join(found.drop("__name"), "__head", "left")
    return exact.select(doc, item).unionByName(whole.select(doc, item))


def resolve_ids(ids: DataFrame, files: DataFrame, test_id: str, path: str) -> DataFrame:
    """Map dotted or pathed test ids to real files.

    Ids are split at the first ``::``.  Every run of leading segments is a candidate file; the
    deepest end wins, then the earliest start; what follows is class nesting.  Unresolved ids
    keep NULLs.
    """
    distinct = ids.select(test_id).distinct()
    cut = F.instr(F.col(test_id), "::")
    module = F.when(cut > 0, F.substr(F.col(test_id), F.lit(1), cut - 1))
    parsed = distinct.withColumns({
        "__segments": F.filter(F.split(F.regexp_replace(module, r"\\", "/"), "/"),
                               lambda s: s != ""),
        "__function": F.when(cut > 0, F.substr(F.col(test_id), cut + 2)),
    })
    usable = parsed.filter((F.size("__segments") > 0) & (F.col("__function") != ""))
    ends = usable.withColumn("__k", F.explode(F.sequence(F.lit(1), F.size("__segments"))))
    starts = ends.withColumn("__start", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)))
    piece = F.slice("__segments", F.col("__start") + 1, F.col("__k") - F.col("__start"))
    candidates = starts.withColumn("__path", F.concat(F.array_join(piece, "/"), F.lit(".py")))
    known = files.select(F.col(path).alias("__path")).distinct()
    hits = candidates.join(known, "__path")
    best = hits.groupBy(test_id).agg(F.max_by(
        F.struct(F.col("__path").alias("path"), F.col("__function").alias("function"),
                 F.array_join(F.slice("__segments", F.col("__k") + 1, F.size("__segments")), ".")
                 .alias("classes")),
        F.struct("__k", (-F.col("__start")).alias("s"))).alias("b"))
    return distinct.join(best, test_id, "left").select(
        test_id, F.col("b.path").alias("test_path"), F.col("b.classes").alias("test_class"),
        F.col("b.function").alias("test_function"))


_GRAM = 3


def _grams(column: str) -> Column:
    return F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(column) - (_GRAM - 1)), lambda i: F.substr(F.col(column), i, F.lit(_GRAM))))


def containments(
    needles: DataFrame, hays: DataFrame, keys: Sequence[str], needle: str, hay: str
) -> DataFrame:
    """Distinct (keys, needle, hay) with equal keys where the hay contains the needle.

    A needle is looked up by one of its 3-grams, the one that the fewest distinct hays hold; a hay
    offers those of its 3-grams that some needle is looked up by. Keys and gram make an
    equi-join, which adaptive execution splits where a key is hot; what it finds is verified.
    Needles of fewer characters are few by nature (at most the pairs of letters) and go to the
    hays of their keys as a list; an empty one is contained in every hay. Nulls match nothing.
    """
    needles = needles.select(*keys, needle).filter(F.col(needle).isNotNull()).distinct()
    hays = hays.select(*keys, hay).filter(F.col(hay).isNotNull()).distinct()
    long, roomy = needles.filter(F.length(needle) >= _GRAM), hays.filter(F.length(hay) >= _GRAM)
    held = roomy.select(hay).distinct().select(F.explode(_grams(hay)).alias("__gram")).groupBy(
        "__gram").agg(F.count(F.lit(1)).alias("__c"))
    asked = long.select(needle).distinct().select(needle, F.explode(_grams(needle)).alias("__gram"))
    lookup = asked.join(held, "__gram").groupBy(needle).agg(
        F.min_by("__gram", F.struct("__c", "__gram")).alias("__gram"))
    # Grams are cut from distinct hays; a hay's rows then take only those that are looked up.
    offered = roomy.select(hay).distinct().select(hay, F.explode(_grams(hay)).alias("__gram")).join(
        lookup.select("__gram").distinct(), "__gram", "left_semi").join(roomy, hay)
    found = long.join(lookup, needle).join(offered, [*keys, "__gram"]).filter(
        F.contains(F.col(hay), F.col(needle))).select(*keys, needle, hay)
    lists = needles.filter(F.length(needle) < _GRAM).groupBy(*keys).agg(
        F.collect_set(needle).alias("__short"))
    short = hays.join(lists, list(keys)).select(
        *keys, F.explode(F.filter("__short", lambda n: F.contains(F.col(hay), n))).alias(needle), hay)
    return found.unionByName(short)


def _suffixes(column: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(column)), lambda i: F.substr(column, i))


def direct_import(
    imports: DataFrame, changed: DataFrame, test: str, module: str, path: str,
    keys: Sequence[str] = (),
) -> DataFrame:
    """(keys, test, changed file) rows where an import of the test refers to the changed module.

    An import refers to a module when the module stem is one of its dotted tokens, or one
    dotted name is a suffix of the other.  All three rules are one equi-join on derived keys
    over the distinct modules and files. ``keys``, the commit as a rule, are columns of both
    tables: a test then meets the files of its own commit only, so a stem that is common in the
    corpus costs no more than its commits hold.
    """
    keys = list(keys)

    def keyed(tag: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(tag).alias("tag"), v.alias("key")))

    # Which names fit which is settled once per distinct string; a commit's rows then take only the
    # derived keys that the other side of the corpus has, not one for every suffix.
    stem = text.file_stem(F.col(path))
    dotted = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), "/", ".")
    asked = imports.select(module).distinct().filter(F.length(module) > 0).select(
        module, F.explode(F.array_distinct(F.concat(
            keyed("token", F.split(module, r"\.")), keyed("within", F.array(module)),
            keyed("ends", _suffixes(F.col(module)))))).alias("k"))
    held = changed.select(path).distinct().select(path, F.explode(F.array_distinct(F.concat(
        keyed("token", F.array(stem)), keyed("within", _suffixes(dotted)),
        keyed("ends", F.array(dotted))))).alias("k"))
    wanted = asked.join(held.select("k").distinct(), "k", "left_semi")
    offered = held.join(asked.select("k").distinct(), "k", "left_semi")
    if keys:
        wanted = imports.select(*keys, module).distinct().join(wanted, module)
        offered = changed.select(*keys, path).distinct().join(offered, path)
    matches = wanted.join(offered, [*keys, "k"]).select(*keys, module, path).distinct()
    return imports.select(*keys, test, module).distinct().join(matches, [*keys, module]).select(
        *keys, test, path).distinct()


def union_corpora(frames: Mapping[str, DataFrame], group: str) -> DataFrame:
    """Concatenate per-repository frames with group ids qualified by the repository."""
    combined = None
    for repo, frame in frames.items():
        tagged = frame.withColumns({
            "repo": F.lit(repo), group: F.concat_ws("::", F.lit(repo), F.col(group).cast("string"))})
        combined = tagged if combined is None else combined.unionByName(
            tagged, allowMissingColumns=True)
    return combined


def detected(selected: DataFrame, failing: DataFrame, commit: str, test: str) -> DataFrame:
    """Failing, selected and caught distinct tests per commit."""
    left = selected.select(commit, test).distinct().withColumn("__s", F.lit(1))
    right = failing.select(commit, test).distinct().withColumn("__f", F.lit(1))
    both = left.join(right, [commit, test], "full")
    return both.groupBy(commit).agg(
        F.count("__s").alias("n_selected"), F.count("__f").alias("n_failing"),
        F.count_if(F.col("__s").isNotNull() & F.col("__f").isNotNull()).alias("n_detected"))


def overlay_paths(
    declared: DataFrame, changed: DataFrame, patched: DataFrame, key: str, path: str,
    roots: Sequence[str],
) -> DataFrame:
    """Declared paths and changed paths under test roots, without the source-patched ones."""
    under = F.lit(False)
    for root in roots:
        base = root.rstrip("/")
        under = under | (F.col(path) == root) | F.col(path).startswith(base + "/")
    tidy = F.regexp_replace(F.trim(path), r"\\", "/")
    merged = declared.select(key, path).unionByName(changed.filter(under).select(key, path))
    cleaned = merged.select(key, tidy.alias(path)).filter(F.col(path) != "").distinct()
    return cleaned.join(patched.select(key, path).distinct(), [key, path], "left_anti")
