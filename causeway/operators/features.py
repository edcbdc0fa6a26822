"""Change, cross and message features, and reporting expressions over feature rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.numbers import clock_features, ratio
from . import history


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def change_features(
    df: DataFrame, commit: str, path: str, added: str, removed: str, message: str, author: str,
    ts: str,
) -> DataFrame:
    """Commit-level features on every row.

    Distinct counts per commit are an aggregate joined back; flags describe the row's own
    path.
    """
    cleaned = df.withColumn("__path", F.coalesce(F.col(path), F.lit("")))
    extension = F.lower(F.substring_index("__path", ".", -1))
    # An observation table repeats a commit's files and author on every test row; they are
    # reduced map-side before anything is counted.
    seen = cleaned.select(commit, "__path", author).distinct()
    totals = seen.groupBy(commit).agg(
        F.count_distinct("__path").alias("files_changed"),
        F.count_distinct(author).alias("authors_count"),
        F.count_distinct(extension).alias("num_file_extensions"))
    counted = cleaned.join(totals, commit)
    about_tests = F.contains(F.lower("__path"), F.lit("test"))
    return counted.withColumns({
        "lines_added": F.col(added).cast("double"),
        "lines_removed": F.col(removed).cast("double"),
        "total_churn": F.coalesce(F.col(added), F.lit(0)).cast("double")
        + F.coalesce(F.col(removed), F.lit(0)),
        "commit_message_length": F.length(F.coalesce(F.col(message), F.lit(""))),
        "has_source_change": _flag(~about_tests),
        "has_test_change": _flag(about_tests),
        "has_config_change": _flag(F.col("__path").rlike(text.CONFIG_SUFFIX)),
        **clock_features(ts),
    }).drop("__path")


# Suffixes and substrings of the lenient diff features.
CONFIG_ENDINGS = (".yaml", ".yml", ".json", ".toml", ".ini", ".cfg")
FIX_SUBSTRINGS = ("fix", "bug", "patch")
REFACTOR_SUBSTRINGS = ("refactor", "clean", "restructure")


def diff_features(
    changed_files: DataFrame, messages: DataFrame, commit: str, path: str, added: str,
    deleted: str, message: str, is_test: str | None = None,
) -> DataFrame:
    """The lenient diff features: tests and keywords are found by substring."""
    low = F.lower(F.col(path))
    test_file = F.contains(low, F.lit("test"))
    if is_test is not None:
        test_file = test_file | F.coalesce(F.col(is_test).cast("boolean"), F.lit(False))
    config = F.lit(False)
    for ending in CONFIG_ENDINGS:
        config = config | F.col(path).endswith(ending)
    files = changed_files.groupBy(commit).agg(
        F.sum(added).alias("diff_lines_added"), F.sum(deleted).alias("diff_lines_deleted"),
        F.count(F.lit(1)).alias("diff_num_files_changed"),
        F.count_if(test_file).alias("diff_num_test_files"),
        F.max(F.col(path).endswith(".py").cast("int")).alias("diff_has_python"),
        F.max(config.cast("int")).alias("diff_has_config"))
    body = F.coalesce(F.col(message), F.lit(""))
    named = messages.select(
        commit, F.length(F.trim(body)).alias("diff_msg_length"),
        text.word_count(body).alias("diff_msg_word_count"),
        text.contains_any(body, FIX_SUBSTRINGS).cast("int").alias("diff_is_fix_commit"),
        text.contains_any(body, REFACTOR_SUBSTRINGS).cast("int").alias("diff_is_refactor_commit"))
    joined = named.join(files, commit, "left")
    counts = ["diff_lines_added", "diff_lines_deleted", "diff_num_files_changed",
              "diff_num_test_files", "diff_has_python", "diff_has_config"]
    filled = joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})
    return filled.withColumns({
        "diff_total_churn": F.col("diff_lines_added") + F.col("diff_lines_deleted"),
        "diff_num_src_files": F.col("diff_num_files_changed") - F.col("diff_num_test_files"),
    })


def diff_features_strict(
    changed_files: DataFrame, messages: DataFrame, commit: str, path: str, added: str,
    deleted: str, message: str,
) -> DataFrame:
    """The strict variant: test files by name convention, keywords as whole words."""
    p = F.col(path)
    python, test_file = p.endswith(".py"), text.is_test_path(F.col(path))
    sources, tests = F.count_if(python & ~test_file), F.count_if(python & test_file)
    files = changed_files.groupBy(commit).agg(
        F.sum(added).alias("lines_added"), F.sum(deleted).alias("lines_removed"),
        (F.sum(added) + F.sum(deleted)).alias("total_churn"),
        F.count(F.lit(1)).alias("files_changed"),
        sources.alias("diff_num_src_files"), tests.alias("diff_num_test_files"),
        (sources > 0).cast("int").alias("has_source_change"),
        (tests > 0).cast("int").alias("has_test_change"),
        F.max(p.rlike(text.CONFIG_SUFFIX).cast("int")).alias("has_config_change"),
        F.max(python.cast("int")).alias("diff_has_python"))
    body = F.coalesce(F.col(message), F.lit(""))
    named = messages.select(
        commit, F.length(body).alias("commit_message_length"),
        text.word_count(body).alias("diff_msg_word_count"),
        body.rlike(text.FIX_WORDS).cast("int").alias("diff_is_fix_commit"),
        body.rlike(text.REFACTOR_WORDS).cast("int").alias("diff_is_refactor_commit"))
    joined = named.join(files, commit, "left")
    return joined.withColumns({
        c: F.coalesce(F.col(c), F.lit(0)) for c in files.columns if c != commit})


def cross_features(
    df: DataFrame, changed: str, test_path: str, function: str, ts: str, ties: Sequence[str],
    label: str, depth: str | None = None, reachable: str | None = None,
) -> DataFrame:
    """Change-by-test similarity, module and dependency distance, and causal co-change rate."""
    rows = df.withColumns({
        changed: F.coalesce(F.col(changed), F.lit("")),
        test_path: F.coalesce(F.col(test_path), F.lit(""))})
    # Texts are compared once per distinct combination, however many rows hold it.
    left, right = F.col("__left"), F.col("__right")
    tokens = text.identifier_tokens
    texts = rows.select(F.col(changed).alias("__left"), F.col(test_path).alias("__right"),
                        F.col(function).alias("__function")).distinct().withColumns({
        "__changed": tokens(left), "__test": tokens(right),
        "path_overlap": text.path_overlap(left, right),
        "same_module": (text.module_of(left) == text.module_of(right)).cast("int"),
    }).withColumns({
        "file_test_similarity": text.dice(F.col("__changed"), F.col("__test")),
        "lexical_similarity": text.jaccard(F.col("__changed"), tokens(F.col("__function"))),
    }).drop("__changed", "__test")
    if depth is None:
        distance = 1 - F.col("path_overlap")
    else:
        near = F.col(reachable).cast("boolean") if reachable else F.col(depth) > 0
        distance = F.coalesce(F.when(near, F.col(depth).cast("double")), F.lit(99.0))
    same = (F.col(changed) == left) & (F.col(test_path) == right) & F.col(function).eqNullSafe(F.col("__function"))
    joined = rows.join(texts, same).withColumn("dependency_distance", distance).drop(
        "__left", "__right", "__function")
    return history.co_change_rate(joined, changed, test_path, ts, ties, label)


# Keyword lists of the message features.
MESSAGE_KEYWORDS = {
    "has_bug_keyword": ("bug", "fix", "issue", "error", "fail", "crash", "defect"),
    "has_test_keyword": ("test", "spec", "assert", "mock", "flaky", "check"),
    "has_ci_keyword": ("ci", "cd", "pipeline", "build", "travis", "jenkins", "github"),
}


def message_features(
    df: DataFrame, message: str, body: str,
    keywords: Mapping[str, Sequence[str]] = MESSAGE_KEYWORDS,
) -> DataFrame:
    """Text heuristics of a commit message; the keyword lists are a parameter."""
    msg, rest = F.coalesce(F.col(message), F.lit("")), F.coalesce(F.col(body), F.lit(""))
    upper = text.count_pattern(msg, r"\p{Lu}")
    return df.withColumns({
        "msg_length": F.length(msg), "msg_words": text.word_count(msg),
        **{name: text.contains_any(msg, words).cast("int") for name, words in keywords.items()},
        "uppercase_ratio": upper / F.greatest(F.length(msg), F.lit(1)),
        "exclamation_count": text.count_pattern(msg, "!"),
        "question_count": text.count_pattern(msg, r"\?"),
        "body_file_count": text.count_pattern(rest, r"\.[a-zA-Z0-9]+"),
    })


def risk_tier(
    df: DataFrame, p: str, threshold: float, high: float = 0.7, medium: float = 0.4
) -> DataFrame:
    """Verdict, tier and recommendation for a calibrated probability."""
    flaky = F.col(p) >= threshold
    return df.withColumns({
        "prediction": F.when(flaky, F.lit("FLAKY")).otherwise(F.lit("STABLE")),
        "risk_tier": F.when(F.col(p) >= high, F.lit("HIGH"))
        .when(F.col(p) >= medium, F.lit("MEDIUM")).otherwise(F.lit("LOW")),
        "recommendation": F.when(flaky, F.lit("Quarantine test and enable auto-retry"))
        .otherwise(F.lit("Normal CI execution")),
    })


def reason_codes(df: DataFrame, selected: str, confidence: str) -> DataFrame:
    """Ordered reasons from feature rules, a default if none fires, status and risk level."""
    def value(name: str, default: float) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)

    coupling = (
        F.when(value("dep_is_direct_import", 0.0) == 1.0, F.lit("DIRECT_DEPENDENCY"))
        .when(value("dep_shortest_path_depth", 10.0) <= 2.0, F.lit("CALL_GRAPH_PROXIMITY"))
        .when(value("dep_name_heuristic_coupled", 0.0) == 1.0, F.lit("MODULE_COUPLING")))
    past = (
        F.when(value("hist_recent_10_failure_rate", 0.0) > 0.0, F.lit("RECENT_FAILURES"))
        .when(value("hist_lifetime_failure_rate", 0.0) > 0.15, F.lit("LIFETIME_FAILURE_RATE")))
    churn = F.when(value("diff_total_churn", 0.0) > 100, F.lit("HIGH_CHURN"))
    fix = F.when(value("diff_is_fix_commit", 0.0) == 1.0, F.lit("BUGFIX_CONTEXT"))
    chosen = F.col(selected).cast("boolean")
    fired = df.withColumn("reasons", F.array_compact(F.array(coupling, past, churn, fix)))
    default = F.when(chosen, F.lit("BASELINE_COVERAGE")).otherwise(F.lit("LOW_REGRESSION_RISK"))
    return fired.withColumns({
        "reasons": F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(default)),
        "status": F.when(chosen, F.lit("SELECTED")).otherwise(F.lit("OMITTED")),
        "risk_level": F.when(F.col(confidence) > 0.60, F.lit("HIGH"))
        .when(F.col(confidence) > 0.20, F.lit("MEDIUM")).otherwise(F.lit("LOW")),
    })


def ci_utility(
    df: DataFrame, full_seconds: str, selected_seconds: str, escaped: str,
    cost_per_second: float = 0.01, penalty: float = 50.0,
) -> DataFrame:
    """Seconds saved, gross saving, escape penalty and net utility."""
    saved = F.greatest(F.col(full_seconds) - F.col(selected_seconds), F.lit(0.0))
    gross, cost = saved * cost_per_second, F.col(escaped) * penalty
    return df.withColumns({
        "time_saved_sec": F.round(saved, 2), "gross_savings": F.round(gross, 2),
        "penalty_cost": F.round(cost, 2), "net_utility": F.round(gross - cost, 2),
    })


# Default cost parameters.
COST_DEFAULTS = {
    "num_developers": 25, "commits_per_dev_per_day": 3.0, "working_days_per_year": 250,
    "developer_hourly_rate": 75.0, "runner_cost_per_minute": 0.016, "suite_minutes": 45.0,
    "cost_per_escape": 3500.0, "baseline_escapes": 4, "wait_share": 0.30,
}


def cost_projection(
    df: DataFrame, time_reduction: str, recall: str, escapes: str, evaluated: str | None = None,
    params: Mapping[str, float] = COST_DEFAULTS, price_escapes: bool = True,
) -> DataFrame:
    """Annual cost of the full suite against each strategy row.

    ``time_reduction`` and ``recall`` are fractions of wall-clock time and of failures; an
    undefined recall stays undefined.  Without ``price_escapes`` only compute and waiting are
    priced, next to the observed escape rate.
    """
    c = {**COST_DEFAULTS, **params}
    commits = int(c["num_developers"] * c["commits_per_dev_per_day"] * c["working_days_per_year"])
    minutes = commits * c["suite_minutes"]
    wait_rate = c["wait_share"] / 60.0 * c["developer_hourly_rate"]
    full_compute = round(minutes * c["runner_cost_per_minute"], 2)
    full_wait = round(minutes * wait_rate, 2)
    full_escape = c["baseline_escapes"] * c["cost_per_escape"]
    left = F.lit(float(minutes)) * (1 - F.col(time_reduction))
    compute, wait = left * c["runner_cost_per_minute"], left * wait_rate
    gross = (full_compute - compute) + (full_wait - wait)
    priced = {
        "annual_commits": F.lit(commits), "compute_cost": F.round(compute, 2),
        "wait_cost": F.round(wait, 2), "compute_savings": F.round(full_compute - compute, 2),
        "wait_savings": F.round(full_wait - wait, 2), "gross_savings": F.round(gross, 2),
        "breakeven_escapes": (gross / c["cost_per_escape"]).cast("long"),
        "recall_pct": F.round(F.col(recall) * 100, 1),
    }
    if price_escapes:
        escape = F.col(escapes) * c["cost_per_escape"]
        total = compute + wait + escape
        priced["escape_cost"] = F.round(escape, 2)
        priced["total_cost"] = F.round(total, 2)
        priced["net_benefit"] = F.round(
            round(full_compute + full_wait + full_escape, 2) - total, 2)
    if evaluated is not None:
        priced["observed_escape_rate"] = F.round(ratio(F.col(escapes), F.col(evaluated)), 4)
    return df.withColumns(priced)


def _fixed(value: Column, digits: int, sign: str = "") -> Column:
    # Half-even like the report tables; a small negative keeps its sign when it rounds to zero.
    nearest = F.when(value < 0, -F.bround(-value, digits)).otherwise(F.bround(value, digits))
    return F.format_string(f"%{sign}.{digits}f", nearest)


def format_interval(point: Column, low: Column, high: Column, digits: int = 1, unit: str = ""):
    """``point [low, high]``; an undefined point is ``n/a``, a half-defined one says so."""
    head = F.concat(_fixed(point, digits), F.lit(unit))
    ends = F.concat(
        F.lit(" ["), _fixed(low, digits), F.lit(", "), _fixed(high, digits), F.lit("]"))
    return (F.when(point.isNull() | F.isnan(point), F.lit("n/a"))
            .when(low.isNull() | high.isNull() | F.isnan(low) | F.isnan(high),
                  F.concat(head, F.lit(" [no interval]")))
            .otherwise(F.concat(head, ends)))


def difference_text(point: Column, low: Column, high: Column, metric: str = "ECE") -> Column:
    """A paired difference as a sentence that ends in what it decides."""
    verdict = F.when((low > 0) | (high < 0), F.lit("excludes zero")).otherwise(
        F.lit("spans zero, so not a gain"))
    text_ = F.concat(F.lit(f"{metric} difference "), _fixed(point, 5, "+"), F.lit(" ["),
                     _fixed(low, 5, "+"), F.lit(", "), _fixed(high, 5, "+"), F.lit("] "), verdict)
    missing = point.isNull() | low.isNull() | high.isNull()
    return F.when(missing, F.lit(f"no paired interval on the {metric} difference")).otherwise(text_)


def headline(
    strategies: DataFrame, served: DataFrame, uncertainty: DataFrame, marker: str
) -> DataFrame:
    """Front-page metrics from report tables: value or NULL, note, and whether it was measured.

    ``strategies`` has strategy, fr, mfr, etr, trr, ar, escaped; ``served`` has one row
    method, ece, reason, difference; ``uncertainty`` has one row mean, p95, n.
    """
    def one(value: Column, digits: int, unit: str = "") -> Column:
        return F.concat(_fixed(value, digits), F.lit(unit))

    row = strategies.filter(F.contains("strategy", F.lit(marker))).orderBy("strategy").limit(1)
    missed = F.coalesce(
        F.concat(F.lit(", missed-failure rate "), one(F.col("mfr"), 1, "%")), F.lit(""))
    parts = F.array_compact(F.array(
        F.when(F.col("trr").isNotNull(),
               F.concat(F.lit("test-count reduction "), one(F.col("trr"), 1, "%"))),
        F.when(F.col("ar").isNotNull(), F.concat(
            F.lit("abstained on "), one(F.col("ar"), 1, "%"), F.lit(" of commits")))))
    recall = row.select(
        F.lit(1).alias("position"), F.lit("Failure Recall").alias("metric"),
        F.when(F.col("fr").isNotNull(), one(F.col("fr"), 1, "%")).alias("value"),
        F.when(F.col("fr").isNull(),
               F.lit("undefined: no commit in the split had a failing test to recall"))
        .otherwise(F.concat(F.col("escaped").cast("long").cast("string"),
                            F.lit(" commit(s) let a failure escape"), missed)).alias("note"))
    time = row.select(
        F.lit(2).alias("position"), F.lit("Test Time Reduction").alias("metric"),
        F.when(F.col("etr").isNotNull(), one(F.col("etr"), 1, "%")).alias("value"),
        F.when(F.col("etr").isNull(),
               F.lit("undefined: the dataset carries no per-test durations"))
        .otherwise(F.array_join(parts, "; ")).alias("note"))
    plain = F.col("method") == "uncalibrated"
    calibration = served.select(
        F.lit(3).alias("position"), F.lit("Expected Calibration Error").alias("metric"),
        one(F.col("ece"), 4).alias("value"),
        F.when(F.col("ece").isNull(), F.lit("report carries no calibration error"))
        .when(plain & F.col("reason").isNotNull(),
              F.concat(F.lit("served uncalibrated: "), F.col("reason")))
        .when(plain, F.lit("served uncalibrated"))
        .otherwise(F.concat(F.lit("served "), F.col("method"), F.lit(": "), F.col("difference")))
        .alias("note"))
    spread = uncertainty.select(
        F.lit(4).alias("position"), F.lit("Epistemic Disagreement").alias("metric"),
        one(F.col("mean"), 4).alias("value"),
        F.when(F.col("mean").isNull(), F.lit("report carries no mean uncertainty"))
        .otherwise(F.concat(F.lit("p95 "), one(F.col("p95"), 4), F.lit(" over "),
                            F.col("n").cast("string"), F.lit(" samples"))).alias("note"))
    rows = recall.unionByName(time).unionByName(calibration).unionByName(spread)
    # An absent report still has its line, marked as not measured.
    page = strategies.sparkSession.createDataFrame(
        [(1, "Failure Recall"), (2, "Test Time Reduction"), (3, "Expected Calibration Error"),
         (4, "Epistemic Disagreement")], "position int, metric string")
    return page.join(rows.drop("metric"), "position", "left").withColumns({
        "note": F.coalesce("note", F.lit("not measured")),
        "measured": F.col("value").isNotNull(),
    })
