"""Monotone regression over any number of scores, and the map it gives."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import ordering

#: Knots that are sent to every task (24 bytes each); beyond it rows and knots are merged in order.
BROADCAST_KNOTS = 1_000_000


def pool(weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Where the pooled stretches begin that make means non-decreasing (adjacent violators)."""
    begins, weights, totals = [], [], []
    for i, (w, s) in enumerate(zip(weight.tolist(), total.tolist())):
        begins.append(i)
        weights.append(w)
        totals.append(s)
        while len(begins) > 1 and totals[-2] * weights[-1] > totals[-1] * weights[-2]:
            w, s = weights.pop(), totals.pop()
            begins.pop()
            weights[-1] += w
            totals[-1] += s
    return np.array(begins, np.int64)


_STRETCH = "low double, high double, w double, s double, part int"


def _pooled(arranged: DataFrame, own: bool) -> DataFrame:
    """Pool the stretches of each part; rows lie sorted by (part, low). ``own``: a task is a part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        if own:
            rows["part"] = TaskContext.get().partitionId()
        for part, some in rows.groupby("part", sort=False):
            low, high, w, s = (some[c].to_numpy() for c in ("low", "high", "w", "s"))
            begins = pool(w, s)
            yield pd.DataFrame({
                "low": low[begins], "high": high[np.append(begins[1:], len(some)) - 1],
                "w": np.add.reduceat(w, begins), "s": np.add.reduceat(s, begins), "part": part})

    return arranged.mapInPandas(run, _STRETCH)


@dataclass(frozen=True)
class IsotonicCalibrator:
    """A monotone map through its fitted points, flat beyond them.

    ``knots``: one row (low, high, y) per stretch; between stretches the map is linear.
    """

    knots: DataFrame
    count: int

    def _points(self) -> tuple[np.ndarray, np.ndarray]:
        if self.count > BROADCAST_KNOTS:
            raise ValueError("too many knots to send to every task; use transform")
        rows = self.knots.orderBy("low").toPandas()
        xs = np.stack([rows["low"], rows["high"]], 1).ravel()
        return xs, np.repeat(rows["y"].to_numpy(), 2)

    def apply(self, p: Column) -> Column:
        """The map as a column, looked up by binary search in Arrow batches."""
        xs, ys = self._points()
        shared = self.knots.sparkSession.sparkContext.broadcast((xs, ys))

        def look_up(values: pa.Array) -> pa.Array:
            xs, ys = shared.value
            p = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
            return pa.array(np.clip(np.interp(p, xs, ys), 0.0, 1.0), mask=np.isnan(p))

        look_up.__annotations__ = {"values": pa.Array, "return": pa.Array}
        return F.arrow_udf(look_up, "double")(p)

    def transform(self, df: DataFrame, p: str, name: str) -> DataFrame:
        """``df`` with the calibrated score; any number of knots."""
        if self.count <= BROADCAST_KNOTS:
            return df.withColumn(name, self.apply(F.col(p)))
        return self.merged(df, p, name)

    def merged(self, df: DataFrame, p: str, name: str) -> DataFrame:
        """The same by merging rows and knots in score order: the last knot at or below a row and
        the first at or above it come from two running maxima."""
        row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
        none = F.lit(None)
        ends = self.knots.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("x"), "y")
        both = df.select(F.col(p).cast("double").alias("x"), none.cast("double").alias("y"),
                         F.lit(1).alias("kind"), row.alias("row")).unionByName(
            ends.select("x", "y", F.lit(0).alias("kind"), none.cast(df.select(row).schema[0].dataType).alias("row")))
        knot = F.col("kind") == 0
        both = ordering.running(both, [], ["x", "kind"], maxes={
            "below": F.when(knot, F.struct("x", "y"))})
        both = ordering.running(both, [], [ordering.desc("x"), "kind"], maxes={
            "above": F.when(knot, F.struct((-F.col("x")).alias("x"), "y"))})
        low, high, high_x = F.col("below"), F.col("above"), -F.col("above.x")
        share = (F.col("x") - low["x"]) / (high_x - low["x"])
        value = (F.when(F.col("x").isNull() | F.isnan("x"), none).when(low.isNull(), high["y"])
                 .when(high.isNull() | (high_x == low["x"]), low["y"])
                 .otherwise(low["y"] + share * (high["y"] - low["y"])))
        clipped = F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0)))
        return both.filter("kind = 1").select("row.*", clipped.alias(name))


def fit_isotonic(df: DataFrame, label: str, p: str) -> IsotonicCalibrator:
    """Monotone calibration map; rows are reduced to weighted distinct scores first.

    Violators are pooled inside range partitions. The pooled stretches at the borders of the parts
    tell whether anything is left to pool; parts with a violation between them become one part and
    are pooled again. The order of pooling does not change the result. Missing scores and labels
    are left out.
    """
    known = df.filter(F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double")) & F.col(label).isNotNull())
    reduced = known.groupBy(F.col(p).cast("double").alias("low")).agg(
        F.count(F.lit(1)).cast("double").alias("w"), F.sum(F.col(label).cast("double")).alias("s"))
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = reduced.select("low", F.col("low").alias("high"), "w", "s", F.lit(0).alias("part"))
    table = materialise(_pooled(ranged.repartitionByRange(spread, "low").sortWithinPartitions("low"), True))
    while True:
        ends = table.groupBy("part").agg(
            F.min_by(F.struct("w", "s"), "low").alias("a"), F.max_by(F.struct("w", "s"), "low").alias("b"),
            F.min("low").alias("low"), F.count(F.lit(1)).alias("n")).orderBy("low").collect()  # one row per part
        merged: dict[int, int] = {}
        for x, y in zip(ends, ends[1:]):
            if x.b.s * y.a.w > y.a.s * x.b.w:
                merged[y.part] = merged.get(x.part, x.part)
        if not merged:
            knots = table.select("low", "high", (F.col("s") / F.col("w")).alias("y"))
            return IsotonicCalibrator(knots, sum(e.n for e in ends))
        part = F.col("part")
        moved = F.create_map(*[F.lit(v) for pair in merged.items() for v in pair])
        arranged = table.withColumn("part", F.coalesce(F.try_element_at(moved, part), part)).repartition(
            "part").sortWithinPartitions("part", "low")
        table = materialise(_pooled(arranged, False))
