"""Causal history features: a row never sees itself or anything later.

Every operator takes ``keys`` (what a history belongs to), ``ts`` and ``ties`` (columns that
make the order total).  A key's history is cut into buckets of fixed length in time
(``spark.causeway.bucketDays``, 28 by default), so that no task needs a whole key.  Inside a bucket
plain windows do the work; what earlier buckets add comes in two ways: totals per (key, bucket)
whose running totals are joined back, and, for trailing times, narrow copies of the rows that a
window can reach from a later bucket.  Frames that begin at the start of the bucket keep every
window linear in its rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import MICROS_PER_DAY, micros, ratio
from . import ordering


def _order(ts: str, ties: Sequence[str]) -> list[Column]:
    return [F.col(ts), *[F.col(t) for t in ties]]


def _or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


BUCKET_DAYS_SETTING = "spark.causeway.bucketDays"
_EARLIEST = -(1 << 40)  # the bucket of rows without a time


def _width(df: DataFrame) -> int:
    days = float(df.sparkSession.conf.get(BUCKET_DAYS_SETTING, "28"))
    return max(1, int(days * MICROS_PER_DAY))


@dataclass(frozen=True)
class _History:
    """Rows cut into (group, bucket) with the windows that the features below share."""

    df: DataFrame
    keys: Sequence[str]
    ts: str
    ties: Sequence[str]

    @property
    def order(self) -> list[Column]:
        return [F.col("__us").asc(), *[F.col(f"__tie{i}").asc() for i in range(len(self.ties))]]

    @property
    def bucket(self) -> WindowSpec:
        return Window.partitionBy("__g", "__b")

    @property
    def before(self) -> WindowSpec:
        return self.bucket.orderBy(*self.order).rowsBetween(Window.unboundedPreceding, -1)

    @property
    def earlier(self) -> WindowSpec:
        return Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)

    def rows(self, values: Mapping[str, Column], whole: bool) -> DataFrame:
        """The values with their place; ``whole`` keeps the original row in ``__row`` as well."""
        width = F.lit(_width(self.df))
        placed = self.df.withColumn("__us", micros(self.ts))
        bucket = F.coalesce((F.col("__us") - F.pmod(F.col("__us"), width)) / width, F.lit(_EARLIEST))
        payload = [F.struct(*[F.col(f"`{c}`") for c in self.df.columns]).alias("__row")] if whole else []
        return placed.select(
            F.struct(*[F.col(k) for k in self.keys]).alias("__g"), bucket.cast("long").alias("__b"),
            "__us", *[F.col(t).alias(f"__tie{i}") for i, t in enumerate(self.ties)],
            *[c.alias(n) for n, c in values.items()], F.lit(True).alias("__own"), *payload)

    def with_context(self, rows: DataFrame, label: str, days: int) -> DataFrame:
        """Add narrow copies of rows to the later buckets from which ``days`` reach back to them."""
        width, reach = F.lit(_width(self.df)), days * MICROS_PER_DAY
        last = (F.col("__us") + F.lit(reach - 1) - F.pmod(F.col("__us") + F.lit(reach - 1), width)) / width
        kept = {"__g", "__us", label}
        empty = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in kept}
        later = F.explode(F.sequence(F.col("__b") + 1, last.cast("long"))).alias("__b")
        copies = rows.filter(last > F.col("__b")).select("__g", "__us", label, later).select(*[
            F.lit(False).alias("__own") if c == "__own" else F.col(c) if c in kept or c == "__b" else empty[c]
            for c in rows.columns])
        return rows.unionByName(copies)

    def totals(self, values: Mapping[str, Column], aggregates: Sequence[Column]) -> DataFrame:
        return self.rows(values, False).groupBy("__g", "__b").agg(*aggregates)


def _finished(rows: DataFrame, df: DataFrame, features: Mapping[str, Column]) -> DataFrame:
    kept = [F.col("__row")[c].alias(c) for c in df.columns if c not in features]
    return rows.filter("__own").select(*kept, *[c.alias(n) for n, c in features.items()])


def _counts(h: _History) -> tuple[dict[str, Column], dict[str, Column], dict[str, Column]]:
    """Aggregates per bucket, carries and features of F1."""
    own = F.col("__own")
    local = {
        "__n": F.count(F.when(own, 1)).over(h.before),
        "__f": F.coalesce(F.sum(F.when(own, F.col("__label"))).over(h.before), F.lit(0)),
    }
    return (
        {"__n": F.count(F.lit(1)), "__f": F.sum("__label")},
        {n: F.coalesce(F.sum(n).over(h.earlier), F.lit(0)) for n in ("__n", "__f")}, local)


def _durations(h: _History) -> tuple[dict[str, Column], dict[str, Column], dict[str, Column]]:
    """Counts, means and squared deviations; earlier buckets are merged around the mean of the
    key's first one, so that large values keep their digits."""
    value = F.when(F.col("__own"), F.col("__secs"))
    aggregates = {"__dn": F.count("__secs"), "__dm": F.avg("__secs"),
                  "__dq": F.coalesce(F.var_pop("__secs") * F.count("__secs"), F.lit(0.0))}
    first = F.first("__dm", True).over(Window.partitionBy("__g").orderBy("__b").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing))
    off = F.coalesce(F.col("__dm") - F.col("__shift"), F.lit(0.0))
    n, s = (F.sum(c).over(h.earlier) for c in (F.col("__dn"), F.col("__dn") * off))
    q = F.sum(F.col("__dq") + F.col("__dn") * off * off).over(h.earlier)
    carries = {
        "__shift": first, "__dn": n, "__dm": F.col("__shift") + ratio(s, n),
        "__dq": F.greatest(q - s * ratio(s, n), F.lit(0.0))}
    local = {"__dn": F.count(value).over(h.before), "__dm": F.avg(value).over(h.before),
             "__dq": F.var_pop(value).over(h.before) * F.count(value).over(h.before)}
    return aggregates, carries, local


def _merged_durations(local, carry) -> dict[str, Column]:
    a, b = local("__dn"), F.coalesce(carry("__dn"), F.lit(0))
    gap = carry("__dm") - local("__dm")
    n = a + b
    mean = F.when(b == 0, local("__dm")).when(a == 0, carry("__dm")).otherwise(
        local("__dm") + gap * ratio(b, n))
    spread = F.when(b == 0, local("__dq")).when(a == 0, carry("__dq")).otherwise(
        local("__dq") + carry("__dq") + gap * gap * ratio(a * b, n))
    return {"duration_mean": mean, "duration_std": F.sqrt(ratio(spread, n - 1))}


def _trailing(h: _History, days: Sequence[int]) -> dict[str, Column]:
    """Running totals up to the row less those up to ``d`` days ago, inside the bucket with its
    copies of earlier rows."""
    by_time = h.bucket.orderBy("__us")
    found = {}
    for d in days:
        old = by_time.rangeBetween(Window.unboundedPreceding, -d * MICROS_PER_DAY)
        zero = F.lit(0)
        runs = F.count(F.lit(1)).over(h.before) - F.count(F.lit(1)).over(old)
        failures = F.coalesce(F.sum("__label").over(h.before), zero) - F.coalesce(
            F.sum("__label").over(old), zero)
        found[f"failure_rate_{d}d"] = _or_zero(ratio(failures, runs))
    return found


def _tails(h: _History, label: Column, k: int) -> DataFrame:
    """Per (group, bucket): what its rows before it end with.

    ``__fails``, ``__flips`` and ``__steps`` hold, at place j, failures, outcome flips and defined
    steps among the last j earlier rows (j up to k), ``__prev`` the last outcome, ``__since`` the
    rows since the last failure. A bucket sends its last k + 1 outcomes; k + 1 buckets back hold
    all that count.
    """
    placed = h.rows({"__label": label}, False)
    by_row = h.bucket.orderBy(*h.order)
    numbered = placed.select("__g", "__b", "__label", F.row_number().over(by_row).alias("__i"),
                             F.count(F.lit(1)).over(h.bucket).alias("__size"))
    tail = F.collect_list(F.when(F.col("__i") >= F.col("__size") - k, F.struct(
        F.col("__i").alias("i"), F.col("__label").alias("l"))))
    parts = numbered.groupBy("__g", "__b").agg(
        F.max("__size").alias("__size"), F.max(F.when(F.col("__label") > 0, F.col("__i"))).alias("__hit"),
        F.transform(F.sort_array(tail), lambda x: x["l"]).alias("__tail"))
    back = Window.partitionBy("__g").orderBy("__b").rowsBetween(-(k + 1), -1)
    placed = parts.select("__g", "__b", "__hit", F.flatten(F.collect_list("__tail").over(back)).alias("__all"),
                          F.coalesce(F.sum("__size").over(h.earlier), F.lit(0)).alias("__start"))
    last_hit = F.max(F.col("__start") + F.col("__hit")).over(h.earlier)
    held = F.slice(F.col("__all"), F.greatest(F.size("__all") - k, F.lit(1)), k + 1)
    placed = placed.select("__g", "__b", held.alias("__held"),
                           (F.col("__start") - F.coalesce(last_hit, F.lit(0))).alias("__since"))
    newest = F.reverse("__held")
    step = F.transform(newest, lambda x, i: F.abs(x - F.get(newest, i + 1)))

    def sums(values: Column) -> Column:
        """Sums of the first j values, for every j up to k."""
        return F.transform(F.sequence(F.lit(0), F.lit(k)), lambda j: F.aggregate(
            F.slice(values, F.lit(1), j), F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0))))

    return placed.select(
        "__g", "__b", "__since", F.get(newest, F.lit(0)).alias("__prev"), sums(newest).alias("__fails"),
        sums(step).alias("__flips"), sums(F.transform(step, lambda x: x.isNotNull().cast("int"))).alias("__steps"))


def _features(
    df: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[str], wanted: frozenset[str],
    label: str | None = None, duration: str | None = None, days: Sequence[int] = (), k: int = 10,
) -> DataFrame:
    """The ``wanted`` families over one exchange of the rows by (group, bucket)."""
    h = _History(df, keys, ts, ties)
    values = {}
    if label:
        values["__label"] = F.col(label)
    if duration:
        values["__secs"] = F.col(duration)
    rows = h.rows(values, True)
    if "trailing" in wanted and days:
        rows = h.with_context(rows, "__label", max(days))
    sides = [_counts(h)] if "counts" in wanted else []
    sides += [_durations(h)] if "durations" in wanted else []
    local: dict[str, Column] = {n: c for *_, some in sides for n, c in some.items()}
    if "tail" in wanted:
        local |= _counts(h)[2]
    if "trailing" in wanted:
        local |= _trailing(h, days)
    by_row = h.bucket.orderBy(*h.order)
    if "tail" in wanted:
        last_k = by_row.rowsBetween(-k, -1)
        own_label = F.when(F.col("__own"), F.col("__label"))
        local |= {"__k_fails": F.coalesce(F.sum(own_label).over(last_k), F.lit(0)),
                  "__lag": F.lag(F.when(F.col("__own"), F.struct(F.col("__label").alias("v")))).over(by_row)}
    rows = rows.select("*", *[c.alias(f"__l{n}") for n, c in local.items()])
    if "tail" in wanted:
        hit = F.when(F.col("__own") & (F.col("__label") > 0), F.col("__l__n") + 1)
        rows = rows.withColumn("__l__hit", F.max(hit).over(h.before))
    if sides:
        aggregates = [c.alias(n) for some, *_ in sides for n, c in some.items()]
        parts = h.totals(values, aggregates)
        if "durations" in wanted:
            parts = parts.withColumn("__shift", _durations(h)[1]["__shift"])
        carries = parts.select("__g", "__b", *[
            c.alias(f"__c{n}") for _, some, _ in sides for n, c in some.items() if n != "__shift"])
        rows = rows.join(carries, ["__g", "__b"], "left")  # a bucket may hold nothing but copies

    def at(name: str) -> Column:
        return F.col(f"__l{name}") + F.coalesce(F.col(f"__c{name}"), F.lit(0))

    features: dict[str, Column] = {}
    if "counts" in wanted:
        features |= {"execution_count": at("__n"), "prior_failures": at("__f"),
                     "failure_rate_lifetime": _or_zero(ratio(at("__f"), at("__n")))}
    if "durations" in wanted:
        features |= _merged_durations(lambda n: F.col(f"__l{n}"), lambda n: F.col(f"__c{n}"))
    if "trailing" in wanted:
        features |= {n: F.col(f"__l{n}") for n in _trailing(h, days)}
    if "tail" in wanted:
        rows = rows.join(_tails(h, F.col(label), k), ["__g", "__b"], "left")
        before = F.coalesce(F.col("__l__lag"), F.when(F.col("__l__n") == 0, F.struct(F.col("__prev").alias("v"))))
        rows = rows.withColumn("__flip", F.when(F.col("__own"), F.abs(F.col("__label") - before["v"])))
        last_k = by_row.rowsBetween(-k, -1)
        rows = rows.withColumns({"__k_flips": F.coalesce(F.sum("__flip").over(last_k), F.lit(0)),
                                 "__k_steps": F.count("__flip").over(last_k)})
        need = F.greatest(k - F.col("__l__n"), F.lit(0)).cast("int")

        def recent(local: str, tail: str) -> Column:
            return F.col(local) + F.coalesce(F.get(F.col(tail), need), F.lit(0.0))

        hit = F.col("__l__hit")
        features |= {
            "recent_failures": recent("__l__k_fails", "__fails").cast(
                T.LongType() if isinstance(df.schema[label].dataType, T.IntegralType) else T.DoubleType()),
            "runs_since_last_failure": F.when(hit.isNotNull(), F.col("__l__n") - hit).otherwise(
                F.col("__l__n") + F.coalesce("__since", F.lit(0))).cast("long"),
            "flakiness_score": _or_zero(ratio(recent("__k_flips", "__flips"), recent("__k_steps", "__steps"))),
        }
    return _finished(rows, df, features)


def prior_count_and_rate(
    df: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[str], label: str
) -> DataFrame:
    """Prior runs, and prior failures over prior runs (0 when there are none)."""
    return _features(df, keys, ts, ties, frozenset({"counts"}), label)


def prior_duration_stats(
    df: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[str], duration: str
) -> DataFrame:
    """Mean and sample deviation of earlier durations; NULL while undefined."""
    return _features(df, keys, ts, ties, frozenset({"durations"}), duration=duration)


def trailing_rate(
    df: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[str], label: str,
    days: Sequence[int] = (7, 14, 28),
) -> DataFrame:
    """Failure rate over the trailing window ``(t - d, t]`` without the row itself.

    A row at exactly ``t - d`` is outside, and so are rows that share ``t`` but come later.
    """
    return _features(df, keys, ts, ties, frozenset({"trailing"}), label, days=days)


def recent_failures(
    df: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[str], label: str, k: int = 10
) -> DataFrame:
    """Failures among the last ``k`` earlier runs."""
    found = _features(df, keys, ts, ties, frozenset({"tail"}), label, k=k)
    return found.drop("runs_since_last_failure", "flakiness_score")


def runs_since_last_failure(
    df: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[str], label: str
) -> DataFrame:
    """Earlier runs since the last earlier failure; all earlier runs if it never failed."""
    found = _features(df, keys, ts, ties, frozenset({"tail"}), label, k=1)
    return found.drop("recent_failures", "flakiness_score")


def flip_rate(
    df: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[str], label: str, k: int = 10
) -> DataFrame:
    """Share of outcome flips among the last ``k`` earlier runs (0 while undefined)."""
    found = _features(df, keys, ts, ties, frozenset({"tail"}), label, k=k)
    return found.drop("recent_failures", "runs_since_last_failure")


def causal_history(
    df: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[str], label: str,
    duration: str, days: Sequence[int] = (7, 14, 28), k: int = 10,
) -> DataFrame:
    """All per-item history features together, over one exchange of the rows."""
    wanted = frozenset({"counts", "durations", "trailing", "tail"})
    return _features(df, keys, ts, ties, wanted, label, duration, days, k)


def co_change_rate(
    df: DataFrame, changed: str, item: str, ts: str, ties: Sequence[str], label: str
) -> DataFrame:
    """Failure rate of earlier rows with the same (changed file, test path) pair."""
    scanned = ordering.running(
        df, [changed, item], _order(ts, ties),
        sums={"__n": F.lit(1), "__f": F.col(label)},
    )
    rate = _or_zero(ratio(F.col("__f"), F.col("__n")))
    return scanned.withColumn("co_change_frequency", rate).drop("__n", "__f")


def strictly_before(
    events: DataFrame, probes: DataFrame, keys: Sequence[str], time: str,
    event_ties: Sequence[str], probe_id: Sequence[str], sums: Mapping[str, Column],
) -> tuple[DataFrame, DataFrame]:
    """Totals of the events earlier than each probe, plus the events with their positions.

    Probes are merged into the event order just ahead of events with the same time, so one
    running total answers every probe: no range join and no pair of (probe, event) rows.
    Returns (probes with totals and ``__pos``, events with the same columns).
    """
    ties = [F.col(t).cast("string") for t in event_ties]
    marked = events.withColumns({f"__v_{n}": c for n, c in sums.items()})
    left = marked.select(
        *keys, F.col(time).alias("__at"), F.lit(1).alias("__event"),
        F.concat_ws("\u0001", *ties).alias("__tie"), *[f"__v_{n}" for n in sums],
        *[F.lit(None).cast(probes.schema[c].dataType).alias(f"__p_{c}") for c in probe_id],
    )
    right = probes.select(
        *keys, F.col(time).alias("__at"), F.lit(0).alias("__event"),
        F.concat_ws("\u0001", *[F.col(c).cast("string") for c in probe_id]).alias("__tie"),
        *[F.lit(None).cast(marked.schema[f"__v_{n}"].dataType).alias(f"__v_{n}") for n in sums],
        *[F.col(c).alias(f"__p_{c}") for c in probe_id],
    )
    totals = {"__pos": F.col("__event").cast("long")}
    totals.update({n: F.coalesce(F.col(f"__v_{n}"), F.lit(0)) for n in sums})
    scanned = ordering.running(
        left.unionByName(right), keys,
        [F.col("__at"), F.col("__event"), F.col("__tie")], sums=totals,
    )
    answered = scanned.filter("__event = 0").select(
        *keys, F.col("__at").alias(time), "__pos", *sums,
        *[F.col(f"__p_{c}").alias(c) for c in probe_id if c not in {*keys, time}],
    )
    return answered, scanned.filter("__event = 1").select(*keys, "__pos", *sums)


def history_asof(
    pairs: DataFrame, runs: DataFrame, keys: Sequence[str], time: str,
    pair_id: Sequence[str], run_ties: Sequence[str], failed: str, duration: str,
    retries: str, recent: int = 10, default_duration: float = 0.05,
) -> DataFrame:
    """Run history of each (commit time, test) pair from runs strictly before it."""
    timed = duration_known = F.col(duration) > 0
    answered, events = strictly_before(
        runs, pairs, keys, time, run_ties, pair_id,
        sums={
            "__failures": F.col(failed).cast("long"), "__retries": F.col(retries).cast("long"),
            "__seconds": F.when(duration_known, F.col(duration)).otherwise(0.0),
            "__timed": F.when(timed, 1).otherwise(0),
        },
    )
    old = events.select(
        *[F.col(k).alias(f"__o_{k}") for k in keys], (F.col("__pos") + recent).alias("__o_pos"),
        F.col("__failures").alias("__o_failures"),
    )
    condition = F.col("__pos") == F.col("__o_pos")
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__o_{k}"))
    joined = answered.join(old, condition, "left")
    runs_before = F.col("__pos")
    recent_failed = F.col("__failures") - F.coalesce(F.col("__o_failures"), F.lit(0))
    return joined.select(
        *keys, time, *[c for c in pair_id if c not in {*keys, time}],
        runs_before.alias("hist_total_prior_runs"),
        F.col("__failures").alias("hist_prior_failures"),
        _or_zero(ratio(F.col("__failures"), runs_before)).alias("hist_lifetime_failure_rate"),
        _or_zero(ratio(recent_failed, F.least(runs_before, F.lit(recent))))
        .alias("hist_recent_failure_rate"),
        F.coalesce(ratio(F.col("__seconds"), F.col("__timed")), F.lit(default_duration))
        .alias("hist_avg_duration"),
        _or_zero(ratio(F.col("__retries"), runs_before)).alias("hist_flaky_score"),
        (F.col("__failures") > 0).cast("int").alias("hist_has_ever_failed"),
    )


def prior_modifications(
    commits: DataFrame, changed_files: DataFrame, commit: str, path: str, time: str
) -> DataFrame:
    """Per commit: earlier touches of any file in its own diff, strictly by time.

    Each row of ``changed_files`` with its commit is a touch; those without a file or a time count
    for nothing. A commit's rows of one file nearly all differ, so they are counted side by side in
    the order in which they are then joined, not in a hash table. Touches are counted per
    (file, time) next, so the running total is over distinct times and not over touches.
    """
    def counted(rows: DataFrame, key: str, name: str) -> DataFrame:
        beside = Window.partitionBy(commit, key).orderBy(key)
        known = rows.filter(F.col(commit).isNotNull() & F.col(key).isNotNull())
        numbered = known.repartition(commit).withColumns({
            name: F.row_number().over(beside), "__more": F.lead(F.lit(True)).over(beside)})
        return numbered.filter("__more IS NULL").drop("__more")

    files = counted(changed_files.select(commit, path), path, "__lines")
    times = counted(commits.select(commit, micros(time).alias("__us")), "__us", "__rows")
    touches = files.join(times, commit)
    width = F.lit(_width(commits))
    # Never null, so that both uses below ask the same of the rows and Spark counts them once.
    start = F.col("__us") - F.pmod(F.col("__us"), width)
    bucket = F.coalesce((start / width).cast("long"), F.lit(_EARLIEST))
    moments = touches.groupBy(path, "__us").agg(
        F.sum(F.col("__lines").cast("long") * F.col("__rows")).alias("__n")).withColumn("__b", bucket)
    within = Window.partitionBy(path, "__b").orderBy("__us")
    upto = F.sum("__n").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = moments.withColumns({"__upto": upto, "__more": F.lead(F.lit(True)).over(within)})
    earlier = Window.partitionBy(path).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carries = placed.filter("__more IS NULL").select(
        path, "__b", F.coalesce(F.sum("__upto").over(earlier), F.lit(0)).alias("__carry"))
    before = placed.drop("__more").join(carries, [path, "__b"]).select(
        path, "__us", (F.col("__upto") - F.col("__n") + F.col("__carry")).alias("__before"))
    found = touches.select(commit, path, "__us").join(before, [path, "__us"])
    # Few rows of a task share a commit: adding them up ahead of the exchange would only hold them.
    return found.select(commit, "__before").repartition(commit).groupBy(commit).agg(
        F.sum("__before").alias("prior_mod_count"))


def group_causal_history(
    df: DataFrame, repo: str, item: str, commit: str, time: str, changed: str, label: str,
    recent: int = 10,
) -> DataFrame:
    """History read one commit at a time: all rows of a commit see the same earlier state.

    ``prior_runs`` counts earlier commits of the repository; touches count earlier commits
    with the same changed file.
    """
    rows = df.groupBy(repo, item, commit, time, changed).agg(F.max(label).alias(label))
    commits = df.select(repo, commit, time, changed).distinct()
    order = [F.col(time), F.col(commit)]
    commits = ordering.running(commits, [repo], order, sums={"prior_runs": F.lit(1)})
    commits = ordering.running(commits, [repo, changed], order,
                               sums={"prior_file_touches": F.lit(1)})
    keys = [repo, item]
    rows = ordering.running(rows, keys, order, sums={"prior_failures": F.col(label)})
    with_recent = recent_failures(rows, keys, time, [commit], label, recent)
    with_recent = ordering.running(with_recent, keys, order, sums={"__seen": F.lit(1)})
    joined = with_recent.join(commits.select(repo, commit, "prior_runs", "prior_file_touches"),
                              [repo, commit])
    return joined.select(
        repo, item, commit, label, "prior_runs", "prior_failures",
        _or_zero(ratio(F.col("prior_failures"), F.col("prior_runs"))).alias("lifetime_rate"),
        _or_zero(ratio(F.col("recent_failures"), F.least(F.col("__seen"), F.lit(recent))))
        .alias("recent_rate"),
        (F.col("prior_failures") > 0).cast("int").alias("has_ever_failed"),
        "prior_file_touches",
    )
