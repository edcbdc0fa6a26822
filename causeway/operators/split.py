"""Group-respecting splits and stratified samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import ordering


def _attach(df: DataFrame, groups: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    return df.join(groups.select(group, *columns), group)


def _three_way(n: int, ratios: Sequence[float], at_least_one: bool) -> tuple[int, int]:
    floor = 1 if at_least_one else 0
    train = max(floor, int(n * ratios[0]))
    return train, train + max(floor, int(n * ratios[1]))


def temporal_group_split(
    df: DataFrame, group: str, ts: str, ratios: Sequence[float] = (0.70, 0.15, 0.15),
    mode: str = "min", ties: Sequence[str] = (),
) -> DataFrame:
    """Train, val and test by time with every row of a group on one side.

    ``min`` orders groups by their earliest time.  ``first`` orders them by the time of their
    first row under ``ties``, keeps at least one group per side, and fails when the sides
    overlap in time.
    """
    if mode not in ("min", "first"):
        raise ValueError(f"unknown mode {mode!r}")
    start = F.min(ts) if mode == "min" else F.min_by(ts, F.struct(*ties))
    starts = df.groupBy(group).agg(start.alias("__start"))
    n = starts.count()
    if n < 3:
        raise ValueError(f"need at least 3 groups to split, found {n}")
    train, val = _three_way(n, ratios, mode == "first")
    ranked = ordering.row_rank(starts, [], [F.col("__start"), F.col(group)], "__rank")
    side = (F.when(F.col("__rank") <= train, F.lit("train"))
            .when(F.col("__rank") <= val, F.lit("val")).otherwise(F.lit("test")))
    result = _attach(df, ranked.withColumn("split", side), group, ["split"])
    if mode == "first":
        _check_time_order(result, ts)
    return result


def _check_time_order(df: DataFrame, ts: str) -> None:
    spans = {row["split"]: row for row in df.groupBy("split").agg(
        F.min(ts).alias("low"), F.max(ts).alias("high")).collect()}  # three rows
    for earlier, later in (("train", "val"), ("val", "test")):
        if earlier in spans and later in spans and spans[earlier]["high"] > spans[later]["low"]:
            raise ValueError(f"{earlier} overlaps {later} in time")


def ordered_fraction_split(
    df: DataFrame, order: Sequence[Column], ratios: Sequence[float] = (0.70, 0.15, 0.15)
) -> DataFrame:
    """Split by row position after a sort.  Unsafe: a group can straddle a cut."""
    train, val = _three_way(df.count(), ratios, False)
    ranked = ordering.row_rank(df, [], order, "__rank")
    side = (F.when(F.col("__rank") <= train, F.lit("train"))
            .when(F.col("__rank") <= val, F.lit("val")).otherwise(F.lit("test")))
    return ranked.withColumn("split", side).drop("__rank")


def shuffled(seed: int, *names: str) -> Column:
    """A replayable shuffle key: the digest of a seed and an identity."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(n).cast("string") for n in names]))


def group_shuffle_split(
    df: DataFrame, repo: str, group: str, label: str, fraction: float = 0.85, seed: int = 42
) -> DataFrame:
    """Shuffle qualified groups and cut; both sides are non-empty and calibration has a failure."""
    qualified = df.withColumn("__group", F.concat_ws(
        "::", F.col(repo).cast("string"), F.col(group).cast("string")))
    groups = qualified.select("__group").distinct()
    n = groups.count()
    fit = min(max(int(n * fraction), 1), n - 1) if n > 1 else 1
    ranked = ordering.row_rank(groups, [], [shuffled(seed, "__group"), F.col("__group")], "__rank")
    side = F.when(F.col("__rank") <= fit, F.lit("fit")).otherwise(F.lit("calibration"))
    result = _attach(qualified, ranked.withColumn("split", side), "__group", ["split"])
    held = result.filter("split = 'calibration'").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(label), F.lit(0)).alias("f")).first()
    if n < 2 or held["n"] == 0:
        raise ValueError("a grouped split left one side empty")
    if held["f"] == 0:
        raise ValueError("the calibration side holds no failing row")
    return result.drop("__group")


def balanced_cluster_halves(
    df: DataFrame, cluster: str, order: Column, holdout: float = 0.5
) -> DataFrame:
    """Greedy halves by cluster in first-appearance order (``fit`` flag).

    A cluster joins the fit side when ``assigned + size / 2`` stays within the target; the
    first is always fitted and the last always held out.  Each round takes the longest prefix
    that fits by running totals over the cluster table and continues behind the first cluster
    that does not, so only scalars reach the driver.
    """
    if not 0.0 < holdout < 1.0:
        raise ValueError("holdout must be in (0, 1)")
    sizes = df.groupBy(cluster).agg(F.min(order).alias("__first"), F.count(F.lit(1)).alias("__n"))
    totals = sizes.agg(F.count(F.lit(1)).alias("k"), F.sum("__n").alias("rows")).first()
    if totals["k"] < 2:
        raise ValueError("a cluster split needs at least 2 clusters")
    target = totals["rows"] * (1.0 - holdout)
    ranked = materialise(ordering.row_rank(
        sizes, [], [F.col("__first"), F.col(cluster)], "__rank"))
    assigned = ranked.filter("__rank = 1").first()["__n"]
    fitted, position = F.col("__rank") == 1, 1
    while True:
        slack = target - assigned
        wanted = ((F.col("__rank") > position) & (F.col("__rank") < totals["k"])
                  & (F.col("__n") / 2 <= slack))
        placed = ordering.running(ranked.filter(wanted), [], [F.col("__rank")],
                                  sums={"__before": F.col("__n")})
        stop = placed.filter(F.col("__before") + F.col("__n") / 2 > slack).agg(
            F.min("__rank")).first()[0]
        limit = totals["k"] if stop is None else stop
        taken = wanted & (F.col("__rank") < limit)
        assigned += ranked.filter(taken).agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
        fitted = fitted | taken
        if stop is None:
            break
        position = stop
    return _attach(df, ranked.withColumn("fit", fitted), cluster, ["fit"])


def stratified_round_robin(
    df: DataFrame, n: int, family: str, identity: str, seed: int = 42
) -> DataFrame:
    """A bounded draw balanced over families: rounds of one per family in name order.

    Growing ``n`` keeps every earlier draw.
    """
    if n <= 0:
        return df
    drawn = ordering.row_rank(
        df, [family], [shuffled(seed, identity), F.col(identity)], "__round")
    return drawn.orderBy("__round", family, identity).limit(n).drop("__round")
