"""Effect sizes, paired tests and bootstrap intervals."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import ratio
from ..session import materialise
from . import metrics, ordering
from .features import format_interval


def cliffs_delta(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Dominance of column ``a`` over column ``b`` with its magnitude.

    Value counts and running totals replace the pairwise comparison; either column may hold
    NULLs (unequal sample sizes).
    """
    long = df.select(*by, F.inline(F.array(
        F.struct(F.col(a).cast("double").alias("v"), F.lit(1).alias("x")),
        F.struct(F.col(b).cast("double").alias("v"), F.lit(0).alias("x")))))
    counts = long.filter("v IS NOT NULL").groupBy(*by, "v").agg(
        F.sum("x").alias("nx"), F.sum(1 - F.col("x")).alias("ny"))
    placed = ordering.running(counts, by, [F.col("v")], sums={
        "__x": F.col("nx"), "__y": F.col("ny")})
    nx, ny = F.col("nx").cast("double"), F.col("ny").cast("double")
    folded = placed.groupBy(*by).agg(
        F.sum(nx * F.col("__y")).alias("wins"), F.sum(ny * F.col("__x")).alias("losses"),
        F.sum(nx).alias("n_a"), F.sum(ny).alias("n_b"))
    delta = F.coalesce(ratio(F.col("wins") - F.col("losses"), F.col("n_a") * F.col("n_b")),
                       F.lit(0.0))
    size = F.abs("delta")
    # Published cut-offs of the magnitude labels.
    magnitude = (F.when(size < 0.147, F.lit("Negligible")).when(size < 0.330, F.lit("Small"))
                 .when(size < 0.474, F.lit("Medium")).otherwise(F.lit("Large")))
    return folded.withColumn("delta", delta).select(
        *by, F.round("delta", 4).alias("cliffs_delta"), magnitude.alias("magnitude"))


def exact_signed_rank_p(statistic: float, ranks: Sequence[tuple[float, int]]) -> float:
    """Two-sided p of a rank sum under random signs, for any ranks (rank, how often), ties or not.

    The null distribution is the convolution of the ranks' two-point distributions. Averaged ranks
    are halves, so twice the ranks are whole and index an array of probabilities.
    """
    doubled = [(round(2 * rank), count) for rank, count in ranks]
    total = sum(rank * count for rank, count in doubled)
    mass = np.zeros(total + 1)
    mass[0], reached = 1.0, 0
    for rank, count in doubled:
        for _ in range(count):
            mass[rank: reached + rank + 1] += mass[: reached + 1].copy()
            mass[: reached + rank + 1] *= 0.5
            reached += rank
    below = float(mass[: math.floor(2 * statistic + 1e-9) + 1].sum())
    return min(1.0, 2.0 * below)


def normal_signed_rank_p(statistic: float, n: int, ties: float) -> float:
    """Tie-corrected normal approximation of the same p; its error falls with the root of n."""
    variance = n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0
    if variance <= 0:
        return 1.0
    z = (statistic - n * (n + 1) / 4.0) / math.sqrt(variance)
    return math.erfc(abs(z) / math.sqrt(2.0))


def _signed_ranks(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """One row per size of difference: its averaged rank, how often it is positive (p), negative
    (q) and either (n)."""
    diffs = df.select(*by, (F.col(x) - F.col(y)).alias("d"))
    counts = diffs.filter("d <> 0").groupBy(*by, F.abs("d").alias("m")).agg(
        F.count_if(F.col("d") > 0).alias("p"), F.count_if(F.col("d") < 0).alias("q"))
    placed = ordering.running(counts, by, [F.col("m")],
                              sums={"__below": F.col("p") + F.col("q")})
    n = F.col("p") + F.col("q")
    return placed.select(*by, "p", "q", n.alias("n"), (F.col("__below") + (n.cast("double") + 1) / 2).alias("rank"))


def signed_rank_statistic(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Positive and negative rank sums with tie-averaged ranks, and the tie term."""
    sized = df.groupBy(*by).agg(F.count(F.col(x) - F.col(y)).alias("n_pairs"))
    tied, rank = F.col("n").cast("double"), F.col("rank")
    sums = _signed_ranks(df, x, y, by).groupBy(*by).agg(
        F.sum(F.col("p") * rank).alias("w_plus"), F.sum(F.col("q") * rank).alias("w_minus"),
        F.sum(tied).cast("long").alias("n_nonzero"),
        F.sum(tied * tied * tied - tied).alias("ties"))
    if by:
        joined = sized.join(sums, list(by), "left")
    else:
        joined = metrics.one_row(sized, sums)
    return joined.select(
        *by, "n_pairs", F.coalesce("n_nonzero", F.lit(0)).alias("n_nonzero"),
        F.coalesce("w_plus", F.lit(0.0)).alias("w_plus"),
        F.coalesce("w_minus", F.lit(0.0)).alias("w_minus"),
        F.coalesce("ties", F.lit(0.0)).alias("ties"))


def wilcoxon_signed_rank(
    df: DataFrame, x: str, y: str, by: Sequence[str] = (), method: str = "exact"
) -> DataFrame:
    """Two-sided signed-rank test: fewer than five non-zero pairs give (0, 1, not significant).

    One rule for every size and for ties, chosen by ``method``: ``"exact"`` is the null distribution
    itself, whose memory grows as the square of a group's pairs, ``"normal"`` the tie-corrected
    approximation for groups of any size.
    """
    if method not in ("normal", "exact"):
        raise ValueError(f"unknown method {method!r}")
    sums = signed_rank_statistic(df, x, y, by)
    w = F.least("w_plus", "w_minus")
    enough = F.col("n_nonzero") >= 5
    if method == "normal":
        @F.pandas_udf(T.DoubleType())
        def p_values(w: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
            return pd.Series([normal_signed_rank_p(*row) for row in zip(w, n.astype(int), ties)])

        p = p_values(w, "n_nonzero", "ties")
    else:
        @F.pandas_udf(T.DoubleType())
        def exact(w: pd.Series, ranks: pd.Series) -> pd.Series:
            return pd.Series([exact_signed_rank_p(a, [] if r is None else [(c["rank"], c["n"]) for c in r])
                              for a, r in zip(w, ranks)])

        ranked = _signed_ranks(df, x, y, by).groupBy(*by).agg(
            F.collect_list(F.struct("rank", "n")).alias("__ranks"))
        sums = sums.join(ranked, list(by), "left") if by else metrics.one_row(sums, ranked)
        p = exact(w, "__ranks")
    tested = sums.withColumn("p_value", F.when(enough, p).otherwise(F.lit(1.0)))
    return tested.select(
        *by, "n_pairs", F.when(enough, F.round(w, 4)).otherwise(F.lit(0.0)).alias("w_statistic"),
        F.round("p_value", 5).alias("p_value"), (F.col("p_value") < 0.05).alias("significant"))


# ---- bootstrap -------------------------------------------------------------------------


def unit_index(df: DataFrame, unit: Sequence[str]) -> tuple[DataFrame, int]:
    """Distinct units with a dense index by unit order, and their number."""
    units = df.select(*unit).distinct()
    ranked = ordering.row_rank(units, [], [F.col(u) for u in unit], "__unit")
    return ranked.withColumn("__unit", F.col("__unit") - 1), units.count()


# ---- resampling
#
# A replicate draws as many units as there are, with replacement. Which block of units each draw
# falls into is counted first, replicate by replicate; the draws of a block are then resolved inside
# it, where its rows lie. Adjoining blocks make a group that adds up its own sums, so what is
# exchanged are counts per replicate and block and sums per replicate, key and group, never draws
# joined with rows. Both levels draw by the same arithmetic, written once for columns and once for
# arrays, so any engine can repeat it.

_PRIME = 2147483579  # below 2**31 and 2 modulo 3, so cubing permutes the residues
BLOCK_UNITS = 512


def _cube(x):
    return x * x % _PRIME * x % _PRIME


def _links(number) -> tuple:
    """What is folded into the state for one draw, in order, after the replicate."""
    high = F.floor(number / 65536) if isinstance(number, Column) else number // 65536
    return high, number % 65536, 12345


#: Draws worked out at a time, so that their arrays stay in a core's cache.
_CHUNK = 1 << 15


def _cubed(x: np.ndarray, spare: np.ndarray, held: np.ndarray) -> None:
    """``_cube`` in place, of numbers that may be a little over the prime."""
    held[:] = x
    for factor in (x, held):
        x *= factor
        np.floor_divide(x, np.uint64(_PRIME), out=spare)  # much faster than a remainder
        spare *= np.uint64(_PRIME)
        x -= spare


def _drawn(state: np.ndarray | int, low: np.ndarray, bound: int) -> np.ndarray:
    """``draw`` from the state that the replicate and the high digits made, and the low digits."""
    low = low.astype(np.uint64)
    first = low + np.asarray(state, np.uint64)
    spare, held = np.empty_like(first), np.empty_like(first)
    _cubed(first, spare, held)
    first += np.uint64(12345)
    _cubed(first, spare, held)
    second = first + low
    second += np.uint64(777)
    _cubed(second, spare, held)
    second += np.uint64(12345)
    _cubed(second, spare, held)
    first *= np.uint64(_PRIME)
    first += second
    np.floor_divide(first, np.uint64(bound), out=spare)
    spare *= np.uint64(bound)
    first -= spare
    return first.view(np.int64)


def _begun(seed: int, replicate, high):
    state = _cube((_cube(seed % _PRIME) + replicate) % _PRIME)
    return _cube((state + high) % _PRIME)


def draw(seed: int, replicate, number, bound):
    """Numbers below ``bound`` for arrays of draws; two residues, so large bounds are even too."""
    number = np.asarray(number, np.int64)
    return _drawn(_begun(seed, replicate, number // 65536), number % 65536, bound)


def with_draw(
    df: DataFrame, seed: int, replicate: Column, number: Column, bound: int, name: str
) -> DataFrame:
    """``draw`` as columns, one step each, so that no expression grows with the chain."""
    def cubed(rows: DataFrame, value: Column, at: str) -> DataFrame:
        return rows.withColumn("__base", value % _PRIME).withColumn(at, _cube(F.col("__base")))

    rows = df.withColumn("__first", F.lit(_cube(seed % _PRIME)).cast("long"))
    for added in (replicate, *_links(number)):
        rows = cubed(rows, F.col("__first") + added, "__first")
    rows = cubed(rows, F.col("__first") + number % 65536 + 777, "__second")
    rows = cubed(rows, F.col("__second") + 12345, "__second")
    return rows.withColumn(name, (F.col("__first") * _PRIME + F.col("__second")) % bound).drop(
        "__base", "__first", "__second")


def _every_draw(df: DataFrame, n: int, replicates: int, seed: int) -> DataFrame:
    """(rep, __unit): ``n`` draws with replacement per replicate, made where they are read."""
    size = max(n, 1)
    numbered = df.sparkSession.range(replicates * n).select(
        F.floor(F.col("id") / size).alias("rep"), (F.col("id") % size).alias("__number"))
    drawn = with_draw(numbered, seed, F.col("rep"), F.col("__number"), size, "__unit")
    return drawn.select(F.col("rep").cast("int").alias("rep"), "__unit")


def _block_counts(
    spark: SparkSession, n: int, replicates: int, seed: int, block: int, span: int
) -> DataFrame:
    """(rep, __group, __counts): how many of a replicate's draws fall into each block of a group.

    A task holds one number per block. Replicates are cut up where there are fewer than cores.
    """
    blocks = -(-n // block)
    groups = -(-blocks // span)
    slots = spark.sparkContext.defaultParallelism
    cut = max(1, min(-(-slots // replicates), -(-n // _CHUNK)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = np.empty(1 << 20, np.int64)
        for item in (i for batch in batches for i in batch.column(0).to_pylist()):
            rep, part = divmod(item, cut)
            counts, held = np.zeros(groups * span, np.int64), 0
            steps = -(-n // _CHUNK)
            for at in range(part * steps // cut * _CHUNK, (part + 1) * steps // cut * _CHUNK, _CHUNK):
                low = np.arange(at % 65536, at % 65536 + min(_CHUNK, n - at))
                if held + len(low) > len(buffer):
                    counts += np.bincount(buffer[:held], minlength=len(counts))
                    held = 0
                np.floor_divide(_drawn(_begun(seed, rep, at // 65536), low, n), block,
                                out=buffer[held: held + len(low)])
                held += len(low)
            counts += np.bincount(buffer[:held], minlength=len(counts))
            places = np.arange(0, (groups + 1) * 4 * span, 4 * span, dtype=np.int32)
            packed = pa.Array.from_buffers(pa.binary(), groups, [
                None, pa.py_buffer(places), pa.py_buffer(counts.astype("<i4"))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(groups, rep, np.int32)), pa.array(np.arange(groups)), packed],
                ["rep", "__group", "__counts"])

    items = replicates * cut if n else 0
    return spark.range(0, items, 1, max(1, min(items, 4 * slots))).mapInArrow(
        count, "rep int, __group long, __counts binary")


def _block_weights(seed: int, number: int, times: np.ndarray, size: int) -> np.ndarray:
    """Replicates x units of a block: how often each unit is drawn in each replicate."""
    replicates = len(times)
    weights = np.empty((replicates, size))
    state = _begun(seed + 1 + number, np.arange(replicates), 0)
    step = max(1, _CHUNK // max(1, int(times.max())))
    for at in range(0, replicates, step):
        own = times[at: at + step]
        row = np.repeat(np.arange(len(own)), own)
        turn = np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own)
        if len(turn) and own.max() > 65536:
            place = draw(seed + 1 + number, at + row, turn, size)
        else:
            place = _drawn(state[at: at + step][row], turn, size)
        weights[at: at + step] = np.bincount(row * size + place, minlength=len(own) * size).reshape(-1, size)
    return weights


def resampled_sums(
    df: DataFrame, unit: Sequence[str], keys: Sequence[str], sums: Sequence[str],
    replicates: int, seed: int, block: int = BLOCK_UNITS,
) -> tuple[DataFrame, int]:
    """(rep, keys, sums) over resampled units, and the number of units.

    ``sums`` are columns that add up; NULL counts as 0. Every key that a group of blocks holds appears
    in every replicate, so a task holds replicates x its keys numbers.
    """
    if replicates < 1:
        raise ValueError("need at least one replicate")
    spark = df.sparkSession
    units, n = unit_index(df, unit)
    slots = spark.sparkContext.defaultParallelism
    span = min(256, max(1, -(-n // (block * 8 * slots))))
    tasks = max(1, min(-(-n // (block * span)), 4 * slots))
    cells = df.groupBy(*unit, *keys).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in sums])
    placed = cells.join(units, list(unit)).select(
        F.floor(F.col("__unit") / (block * span)).alias("__group"),
        (F.col("__unit") % (block * span)).cast("int").alias("__place"), *keys, *sums)
    counted = _block_counts(spark, n, replicates, seed, block, span)

    def resolve(group: tuple, rows: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=["rep", *keys, *sums])
        times = np.zeros((replicates, span), np.int64)
        np.add.at(times, counts["rep"].to_numpy(),
                  np.frombuffer(b"".join(counts["__counts"]), "<i4").reshape(-1, span))
        code = (rows.groupby(list(keys), dropna=False, sort=False).ngroup().to_numpy() if keys
                else np.zeros(len(rows), np.int64))
        names = rows[list(keys)].iloc[np.unique(code, return_index=True)[1]]
        held = rows[list(sums)].to_numpy(float)
        which, place = np.divmod(rows["__place"].to_numpy(), block)
        order = np.argsort(which, kind="stable")
        ends = np.searchsorted(which[order], np.arange(span + 1))
        totals = np.zeros((replicates, len(names), len(sums)))
        for i in np.flatnonzero(np.diff(ends)):
            own = order[ends[i]: ends[i + 1]]
            number = int(group[0]) * span + int(i)
            size = min(block, n - number * block)
            present, inner = np.unique(code[own], return_inverse=True)
            values = np.zeros((size, len(present), len(sums)))
            values[place[own], inner] = held[own]
            weights = _block_weights(seed, number, times[:, i], size)
            totals[:, present] += (weights @ values.reshape(size, -1)).reshape(replicates, len(present), -1)
        out = names.iloc[np.tile(np.arange(len(names)), replicates)].reset_index(drop=True)
        out.insert(0, "rep", np.repeat(np.arange(replicates, dtype=np.int32), len(names)))
        for j, c in enumerate(sums):
            out[c] = totals[:, :, j].ravel()
        return out

    kinds = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    shape = ", ".join(["rep int", *[f"`{k}` {kinds[k]}" for k in keys], *[f"`{c}` double" for c in sums]])
    # Few rows and much work in each: adaptive execution would put them together.
    partial = placed.repartition(tasks, "__group").groupBy("__group").cogroup(
        counted.repartition(tasks, "__group").groupBy("__group")).applyInPandas(resolve, shape)
    return partial.groupBy("rep", *keys).agg(*[F.sum(c).alias(c) for c in sums]), n


def intervals(
    replicates: DataFrame, points: DataFrame, keys: Sequence[str], total: int, ci: float = 0.95
) -> DataFrame:
    """Percentile intervals of long replicate values (keys, rep, value) around point values.

    Undefined replicates are left out of the percentiles and counted.
    """
    tail = (1.0 - ci) / 2.0
    ends = ordering.quantiles(replicates.select(*keys, "value"), keys, "value",
                              {"ci_lower": tail, "ci_upper": 1.0 - tail})
    known = replicates.groupBy(*keys).agg(F.count("value").alias("__defined"))
    joined = points.join(ends, list(keys), "left").join(known, list(keys), "left")
    return joined.select(
        *keys, "point", "ci_lower", "ci_upper",
        (F.lit(total) - F.coalesce("__defined", F.lit(0))).alias("undefined_replicates"))


def differences(
    replicates: DataFrame, points: DataFrame, name: str, reference, within: Sequence[str],
    total: int, ci: float = 0.95,
) -> DataFrame:
    """Paired intervals of every series against ``reference``, replicate by replicate."""
    base = replicates.filter(F.col(name) == reference).select(
        *within, "rep", F.col("value").alias("__base"))
    paired = replicates.filter(F.col(name) != reference).join(base, [*within, "rep"]).select(
        name, *within, "rep", (F.col("value") - F.col("__base")).alias("value"))
    at = points.filter(F.col(name) == reference).select(*within, F.col("point").alias("__base"))
    moved = points.filter(F.col(name) != reference)
    # Without inner keys the reference is a single row.
    moved = moved.join(at, list(within)) if within else moved.join(F.broadcast(at))
    moved = moved.select(name, *within, (F.col("point") - F.col("__base")).alias("point"))
    table = intervals(paired, moved, [name, *within], total, ci)
    clear = (F.col("ci_lower") > 0) | (F.col("ci_upper") < 0)
    return table.withColumn("excludes_zero", F.coalesce(clear, F.lit(False)))


METRICS = ("trr", "etr", "fr", "mfr", "ar")


def cluster_bootstrap(
    stats: DataFrame, commit: str = "commit_sha", strategy: str = "strategy",
    replicates: int = 2000, seed: int = 42, ci: float = 0.95, reference: str | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Intervals of the pooled metrics over resampled commits, and paired differences.

    All strategies and metrics share the draws.
    """
    from .selection import COMMIT_STATS, pooled_metrics

    sums, n = resampled_sums(stats, [commit], [strategy], COMMIT_STATS, replicates, seed)
    values = sums.select("rep", strategy, *pooled_metrics(F.col, F.lit(n)))
    # One value per replicate, strategy and metric; every interval below reads it again.
    long = materialise(values.unpivot(["rep", strategy], list(METRICS), "metric", "value"))
    pooled = stats.groupBy(strategy).agg(*pooled_metrics())
    points = pooled.unpivot([strategy], list(METRICS), "metric", "point")
    table = intervals(long, points, [strategy, "metric"], replicates, ci).withColumn(
        "n_units", F.lit(n))
    if reference is None:
        return table, None
    return table, differences(long, points, strategy, reference, ["metric"], replicates, ci)


def interval_table(
    table: DataFrame, diffs: DataFrame | None = None, strategy: str = "strategy", digits: int = 1
) -> DataFrame:
    """Strategy by metric text cells, and recall against the reference with a ``*`` verdict."""
    cell = format_interval(F.col("point"), F.col("ci_lower"), F.col("ci_upper"), digits, "%")
    wide = table.withColumn("cell", cell).groupBy(strategy).pivot("metric", list(METRICS)).agg(
        F.first("cell"))
    if diffs is None:
        return wide
    mark = F.when(F.col("excludes_zero"), F.lit(" *")).otherwise(F.lit(""))
    versus = diffs.filter("metric = 'fr'").select(
        strategy, F.concat(cell, mark).alias("fr_vs_reference"))
    return wide.join(versus, strategy, "left").withColumn(
        "fr_vs_reference", F.coalesce("fr_vs_reference", F.lit("reference")))


@dataclass(frozen=True)
class Aggregate:
    """An aggregate as sums that can carry a replicate's weight, and what they come to.

    ``sums`` gets the ``columns``, each less its mean over all rows (so that squares keep their
    digits), and gives what is added up per row; ``final`` gets those totals and the means.
    """

    columns: tuple[str, ...]
    sums: Callable[[list[Column]], list[Column]]
    final: Callable[[list[Column], list[Column]], Column]


def _seen(x: Column) -> Column:
    return x.isNotNull().cast("double")


def mean_of(column: str) -> Aggregate:
    return Aggregate((column,), lambda x: [_seen(x[0]), x[0]], lambda s, m: m[0] + ratio(s[1], s[0]))


def spread_of(column: str) -> Aggregate:
    """Sample standard deviation; NULL for fewer than two values."""
    return Aggregate(
        (column,), lambda x: [_seen(x[0]), x[0], x[0] * x[0]],
        lambda s, m: F.when(s[0] > 1, F.sqrt(F.greatest(s[2] - s[1] * s[1] / s[0], F.lit(0.0)) / (s[0] - 1))))


def ratio_of(numerator: Column, denominator: Column) -> Aggregate:
    """Ratio of two totals; NULL where the denominator is not positive."""
    return Aggregate((), lambda x: [numerator, denominator], lambda s, m: ratio(s[0], s[1]))


def correlation_of(first: str, second: str) -> Aggregate:
    """Pearson correlation of the rows that have both values."""
    def both(x: list[Column]) -> list[Column]:
        one = _seen(x[0]) * _seen(x[1])
        a, b = (F.when(one > 0, v) for v in x)
        return [one, a, b, a * a, b * b, a * b]

    def final(s: list[Column], m: list[Column]) -> Column:
        n, a, b, aa, bb, ab = s
        return ratio(n * ab - a * b, F.sqrt((n * aa - a * a) * (n * bb - b * b)))

    return Aggregate((first, second), both, final)


def bootstrap(
    df: DataFrame, unit: Sequence[str], statistics: Mapping[str, Aggregate | Column],
    replicates: int = 2000, seed: int = 42, ci: float = 0.95,
) -> DataFrame:
    """Intervals of user aggregates over resampled clusters.

    An ``Aggregate`` is split into sums: a replicate weighs each cluster's totals, and no row is
    multiplied. Any other aggregate, a plain Column such as a median, can't be weighed; it is
    evaluated per replicate over the rows of the drawn clusters, repeated by their multiplicity.
    """
    split = {n: a for n, a in statistics.items() if isinstance(a, Aggregate)}
    plain = {n: c for n, c in statistics.items() if n not in split}
    parts, points, n = [], [], None
    if split:
        columns = sorted({c for a in split.values() for c in a.columns})
        # a plain count keeps the row when no column needs a mean
        means = df.agg(F.count(F.lit(1)), *[F.avg(c).cast("double") for c in columns]).first()
        centre = {c: F.lit(float(m or 0.0)) for c, m in zip(columns, means[1:])}
        inputs, places = {}, {}
        for name, a in split.items():
            away = [F.col(c).cast("double") - centre[c] for c in a.columns]
            places[name] = [f"__{len(inputs) + i}" for i in range(len(a.sums(away)))]
            inputs |= {k: v.cast("double") for k, v in zip(places[name], a.sums(away))}
        values = [a.final([F.col(k) for k in places[name]], [centre[c] for c in a.columns]).cast("double").alias(name)
                  for name, a in split.items()]
        rows = df.select(*unit, *[v.alias(k) for k, v in inputs.items()])
        folded, n = resampled_sums(rows, unit, [], list(inputs), replicates, seed)
        parts.append(folded.select("rep", *values).unpivot(["rep"], list(split), "statistic", "value"))
        whole = rows.agg(*[F.sum(k).alias(k) for k in inputs]).select(F.lit(1).alias("__one"), *values)
        points.append(whole.unpivot(["__one"], list(split), "statistic", "point").drop("__one"))
    if plain:
        units, n = unit_index(df, unit)
        drawn = _every_draw(df, n, replicates, seed).join(units, "__unit")
        values = [c.cast("double").alias(s) for s, c in plain.items()]
        folded = df.join(drawn, list(unit)).groupBy("rep").agg(*values)
        parts.append(folded.unpivot(["rep"], list(plain), "statistic", "value"))
        whole = df.agg(*values).withColumn("__one", F.lit(1))
        points.append(whole.unpivot(["__one"], list(plain), "statistic", "point").drop("__one"))
    long = materialise(reduce(DataFrame.unionByName, parts))
    return intervals(long, reduce(DataFrame.unionByName, points), ["statistic"], replicates, ci).withColumn(
        "n_units", F.lit(n))


def bootstrap_moments(
    df: DataFrame, unit: Sequence[str], means: Mapping[str, str], spreads: Mapping[str, str],
    replicates: int = 2000, seed: int = 42, ci: float = 0.95,
) -> DataFrame:
    """``bootstrap`` of means and sample standard deviations (name -> column), from resampled sums.

    Counts, sums and sums of squares are taken around the mean of all rows, so a spread that is
    small beside its mean keeps its digits. NULLs are left out, as the aggregates do.
    """
    used = sorted({*means.values(), *spreads.values()})
    at = df.agg(*[F.avg(c).cast("double").alias(s) for s, c in means.items()],
                *[F.stddev_samp(c).cast("double").alias(s) for s, c in spreads.items()])
    middle = df.agg(*[F.avg(c).cast("double").alias(f"m{i}") for i, c in enumerate(used)]).first()
    sums = {}
    for i, c in enumerate(used):
        away = F.col(c).cast("double") - F.lit(middle[i] or 0.0)
        sums |= {f"__n{i}": F.col(c).isNotNull().cast("double"), f"__s{i}": away, f"__q{i}": away * away}
    folded, n = resampled_sums(df.select(*unit, *[v.alias(k) for k, v in sums.items()]),
                               unit, [], list(sums), replicates, seed)
    count, total, square = ([F.col(f"__{k}{i}") for i in range(len(used))] for k in "nsq")
    values = [(F.lit(middle[i] or 0.0) + ratio(total[i], count[i])).alias(s)
              for s, i in ((s, used.index(c)) for s, c in means.items())]
    values += [F.when(count[i] > 1, F.sqrt(F.greatest(
        square[i] - total[i] * total[i] / count[i], F.lit(0.0)) / (count[i] - 1))).alias(s)
        for s, i in ((s, used.index(c)) for s, c in spreads.items())]
    names = [*means, *spreads]
    long = materialise(folded.select("rep", *values).unpivot(["rep"], names, "statistic", "value"))
    points = at.withColumn("__one", F.lit(1)).unpivot(
        ["__one"], names, "statistic", "point").drop("__one")
    return intervals(long, points, ["statistic"], replicates, ci).withColumn("n_units", F.lit(n))


def bootstrap_ci(
    df: DataFrame, identity: Sequence[str], value: str, replicates: int = 1000, seed: int = 42,
    ci: float = 0.95,
) -> DataFrame:
    """Row-wise percentile bootstrap of the mean, with the sample mean and median.

    An empty sample gives NULLs with n = 0.
    """
    present = df.filter(F.col(value).isNotNull()).select(*identity, value)
    point = present.agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    counted = present.withColumns({"__v": F.col(value).cast("double"), "__one": F.lit(1)})
    folded, n = resampled_sums(counted, identity, [], ["__v", "__one"], replicates, seed)
    if n == 0:
        return point.withColumns({c: F.lit(None).cast("double")
                                  for c in ("median", "ci_lower", "ci_upper")})
    sampled = folded.select(ratio(F.col("__v"), F.col("__one")).alias("value"))
    tail = (1.0 - ci) / 2.0
    ends = ordering.quantiles(sampled.select("value"), [], "value",
                              {"ci_lower": tail, "ci_upper": 1.0 - tail})
    middle = ordering.quantiles(present.select(value), [], value, {"median": 0.5})
    return metrics.one_row(point, middle, ends)


def significance_report(
    stats: DataFrame, reference: str, measures: Mapping[str, tuple[str, str]],
    commit: str = "commit_sha", strategy: str = "strategy", replicates: int = 1000, seed: int = 42,
    method: str = "normal",
) -> DataFrame:
    """Paired comparison of every strategy with the reference on every measure.

    ``measures`` is name -> (numerator, denominator).  All (strategy, measure) pairs are keys
    of the same jobs: pair counts, effect size, signed-rank test and an interval of the mean
    difference.
    """
    fields = [F.struct(
        F.lit(m).alias("measure"), ratio(F.col(top), F.col(bottom), 100.0).alias("value"))
        for m, (top, bottom) in measures.items()]
    long = stats.select(commit, strategy, F.inline(F.array(*fields)))
    mine = long.filter(F.col(strategy) == reference).select(
        commit, "measure", F.col("value").alias("ref"))
    theirs = long.filter(F.col(strategy) != reference).withColumnRenamed("value", "other")
    pairs = theirs.join(mine, [commit, "measure"])
    keys = [strategy, "measure"]
    usable = materialise(pairs.filter("ref IS NOT NULL AND other IS NOT NULL"))
    counts = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("available"),
        F.count_if(F.col("ref").isNotNull() & F.col("other").isNotNull()).alias("used"))
    effect = cliffs_delta(usable, "ref", "other", keys)
    test = wilcoxon_signed_rank(usable, "ref", "other", keys, method).drop("n_pairs")
    gaps = usable.withColumns({"__d": F.col("ref") - F.col("other"), "__one": F.lit(1)})
    folded, _n = resampled_sums(gaps, [commit], keys, ["__d", "__one"], replicates, seed)
    sampled = materialise(folded.select(*keys, "rep", ratio(F.col("__d"), F.col("__one")).alias("value")))
    points = usable.groupBy(*keys).agg(F.avg(F.col("ref") - F.col("other")).alias("point"))
    spread = intervals(sampled, points, keys, replicates)
    return (counts.withColumn("dropped", F.col("available") - F.col("used"))
            .join(effect, keys, "left").join(test, keys, "left").join(spread, keys, "left"))


# ---- calibrator scoring ----------------------------------------------------------------


def _calibration_measures(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    gap = F.abs(F.col("y") / F.col("n") - F.col("p") / F.col("n"))
    folded = bins.withColumn("gap", gap).groupBy(*keys).agg(
        ratio(F.sum(F.col("n") * F.col("gap")), F.sum("n")).alias("ece"),
        F.max("gap").alias("mce"), ratio(F.sum("sq"), F.sum("n")).alias("brier"))
    return folded.unpivot(list(keys), ["ece", "mce", "brier"], "metric", "value")


def score_calibrators(
    df: DataFrame, cluster: str, method: str, label: str, p: str,
    baseline: str = "uncalibrated", n_bins: int = 10, replicates: int = 2000, seed: int = 42,
    ci: float = 0.95,
) -> tuple[DataFrame, DataFrame]:
    """ECE, MCE and Brier per method, and their paired differences from the baseline.

    The error decomposes over bins, so rows are reduced to sums per (cluster, method, bin)
    before any resampling.
    """
    clipped = F.greatest(F.least(F.col(p), F.lit(1.0)), F.lit(0.0))
    y = F.col(label).cast("double")
    sums = df.select(cluster, method, metrics.bin_index(clipped, n_bins, "right").alias("bin"),
                     y.alias("y"), clipped.alias("p"), ((y - F.col(p)) ** 2).alias("sq"))
    sums = materialise(sums.groupBy(cluster, method, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), F.sum("p").alias("p"),
        F.sum("sq").alias("sq")))
    resampled, _n = resampled_sums(
        sums, [cluster], [method, "bin"], ("n", "y", "p", "sq"), replicates, seed)
    resampled = resampled.filter("n > 0")
    sampled = materialise(_calibration_measures(resampled, ["rep", method]))
    pooled = sums.groupBy(method, "bin").agg(
        *[F.sum(c).alias(c) for c in ("n", "y", "p", "sq")])
    points = _calibration_measures(pooled, [method]).withColumnRenamed("value", "point")
    return points, differences(sampled, points, method, baseline, ["metric"], replicates, ci)


def calibrator_scores(points: DataFrame, diffs: DataFrame | None, method: str) -> DataFrame:
    """One row per method: the three measures, and the differences where they were taken."""
    wide = points.groupBy(method).pivot("metric", ["ece", "mce", "brier"]).agg(F.max("point"))
    if diffs is None:
        return wide
    gaps = diffs.groupBy(method).pivot("metric", ["ece", "mce", "brier"]).agg(
        F.max("point").alias("gap"), F.max(F.col("excludes_zero").cast("int")).alias("clear"))
    return wide.join(gaps, method, "left")


# Tolerances of the mode without intervals.
MCE_TOLERANCE = 0.10
BRIER_TOLERANCE = 0.01


def select_calibrator(
    scores: DataFrame, method: str = "method", baseline: str = "uncalibrated"
) -> DataFrame:
    """The verdict on every method and which one is chosen; declining is a valid outcome.

    With intervals (columns ``ece_gap``, ``ece_clear`` and so on) a method is rejected when MCE
    or Brier is measurably worse and needs a measurable ECE gain.  Otherwise fixed tolerances
    apply.  Ties go to the lower MCE, then Brier, then name.
    """
    at = scores.filter(F.col(method) == baseline).first()
    if at is None:
        raise ValueError(f"the {baseline!r} baseline is missing from the scores")
    if "ece_gap" in scores.columns:
        def worse(name: str) -> Column:
            return (F.col(f"{name}_gap") > 0) & (F.col(f"{name}_clear") == 1)

        gain = (F.col("ece_gap") < 0) & (F.col("ece_clear") == 1)
    else:
        def worse(name: str) -> Column:
            slack = MCE_TOLERANCE if name == "mce" else BRIER_TOLERANCE
            return F.col(name) > at[name] + slack

        gain = F.col("ece") < at["ece"]
    is_base = F.col(method) == baseline
    verdict = (F.when(is_base, F.lit("baseline")).when(worse("mce"), F.lit("mce_worse"))
               .when(worse("brier"), F.lit("brier_worse"))
               .when(~F.coalesce(gain, F.lit(False)), F.lit("no_ece_gain"))
               .otherwise(F.lit("eligible")))
    judged = scores.withColumn("verdict", verdict)
    key = F.struct("ece", "mce", "brier", method)
    best = judged.agg(F.min_by(method, F.when(F.col("verdict") == "eligible", key))).first()[0]
    return judged.withColumn("chosen", F.col(method) == (best or baseline))
