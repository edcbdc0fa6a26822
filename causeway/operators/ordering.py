"""Ordered computations that never put one whole group into one task.

A plain ``Window.partitionBy(key).orderBy(...)`` sends every row of a key to a single task. Here a
group is cut along its order into buckets, and work goes in two levels: a window inside
(key, bucket), and totals per (key, bucket), whose running totals over the buckets of a key come
back as carries. The rows are exchanged once, by (key, bucket), which is also how the carries are
joined. Buckets are equal shares of the range between the smallest and the largest value of the
leading order column, so they need no group sizes; everything stays one lazy plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS_SETTING = "spark.causeway.orderBuckets"


@dataclass(frozen=True)
class Key:
    """One column of an order. Nulls go first when ascending and last when descending, unless told."""

    column: Column
    descending: bool = False
    nulls_last: bool | None = None

    @property
    def last(self) -> bool:
        return self.descending if self.nulls_last is None else self.nulls_last

    def sort(self) -> Column:
        if self.descending:
            return self.column.desc_nulls_last() if self.last else self.column.desc_nulls_first()
        return self.column.asc_nulls_last() if self.last else self.column.asc_nulls_first()


Order = Sequence["Column | str | Key"]


def asc(column: Column | str, nulls_last: bool | None = None) -> Key:
    return Key(F.col(column) if isinstance(column, str) else column, False, nulls_last)


def desc(column: Column | str) -> Key:
    return Key(F.col(column) if isinstance(column, str) else column, True)


def order_keys(order: Order) -> list[Key]:
    """Columns and names as ascending keys. A Column can't be asked for its direction, so one made
    by ``Column.desc()`` is refused."""
    found = []
    for c in order:
        if isinstance(c, Column) and str(c).endswith((" DESC NULLS LAST'>", " DESC NULLS FIRST'>")):
            raise TypeError("use ordering.desc(column) instead of column.desc()")
        found.append(c if isinstance(c, Key) else asc(c))
    return found


def sort_columns(order: Order) -> list[Column]:
    return [k.sort() for k in order_keys(order)]


def sorted_by(order: Order) -> list[Column | str]:
    """Arguments of ``orderBy``; Columns with a direction of their own are taken as they are."""
    return [c.sort() if isinstance(c, Key) else c for c in order]


def order_buckets(df: DataFrame) -> int:
    """Shares of an order's range: as many as the session has shuffle partitions, unless set."""
    conf = df.sparkSession.conf
    return int(conf.get(BUCKETS_SETTING, conf.get("spark.sql.shuffle.partitions", "200")))


def _number(column: Column, kind: T.DataType) -> Column:
    """A number that never decreases with the value; the first bytes of a string."""
    if isinstance(kind, T.StringType):
        head = F.rpad(F.hex(F.substring(F.encode(column, "UTF-8"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(column.cast("timestamp")).cast("double")
    if isinstance(kind, T.NumericType):
        return column.cast("double")
    return F.when(column.isNotNull(), F.lit(0.0))


def _plain(key: Key, kind: T.DataType) -> list[Key]:
    """The keys by which a value is compared: whether a struct is null, then its fields in turn.

    Fields are known by their place, since a struct may hold one name twice.
    """
    if not isinstance(kind, T.StructType):
        return [key]
    present = key.column.isNull() if key.last else key.column.isNotNull()
    placed = key.column.cast(T.StructType([T.StructField(f"f{i}", f.dataType) for i, f in enumerate(kind)]))
    return [Key(present), *[k for i, f in enumerate(kind) for k in _plain(
        Key(placed.getField(f"f{i}"), key.descending), f.dataType)]]


def _bucketed(df: DataFrame, order: Sequence[Key]) -> DataFrame:
    """``df`` with ``__b``, a bucket number that never decreases along the order.

    Leading flags count whole (the rest of the order cuts each of them); then the first other
    column is cut into equal shares of its range. That range is one row, worked out in the plan.
    """
    buckets = order_buckets(df)
    kinds = df.select(*[k.column.alias(f"c{i}") for i, k in enumerate(order)]).schema
    if any(isinstance(f.dataType, T.StructType) for f in kinds):
        order = [p for k, f in zip(order, kinds) for p in _plain(k, f.dataType)]
        kinds = df.select(*[k.column.alias(f"c{i}") for i, k in enumerate(order)]).schema
    flags = [k for k, f in zip(order, kinds) if isinstance(f.dataType, T.BooleanType)]
    lead = next((i for i, f in enumerate(kinds) if not isinstance(f.dataType, T.BooleanType)), None)
    flags = flags[:lead]
    place = F.lit(0).cast("long")
    for k in flags:
        level = F.coalesce(k.column.cast("int"), F.lit(2 if k.last != k.descending else -1))
        place = place * 4 + (-level if k.descending else level)
    if lead is None or buckets < 2:
        return df.withColumn("__b", place if flags else F.lit(0).cast("long"))
    key = order[lead]
    coded = df.withColumn("__code", _number(key.column, kinds[lead].dataType))
    ends = coded.select(F.nanvl("__code", F.lit(None).cast("double")).alias("c")).agg(
        F.min("c").alias("__low"), F.max("c").alias("__high"))
    code, low, high = F.col("__code"), F.col("__low"), F.col("__high")
    share = F.nanvl((code - low) / (high - low) * buckets, F.lit(0.0))
    null = buckets + 1 if key.last != key.descending else -1
    level = (F.when(code.isNull(), null).when(F.isnan(code), buckets).when(code >= high, buckets - 1)
             .otherwise(F.least(F.floor(share), F.lit(buckets - 1)))).cast("long")
    joined = coded.join(F.broadcast(ends))  # one row
    return joined.withColumn("__b", place * (2 * buckets + 8) + (-level if key.descending else level)).drop(
        "__code", "__low", "__high")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Order,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Exclusive running sums and maxima per key, and sums over the whole group (``totals``).

    Without keys the whole table is one group. ``order`` should be total within a key.
    """
    sums, maxes, totals = dict(sums or {}), dict(maxes or {}), dict(totals or {})
    order = order_keys(order)
    inputs = {f"__in_{n}": c for n, c in {**sums, **maxes, **totals}.items()}
    # A struct is never null, so that groups with a null key join like any other.
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)
    rows = _bucketed(df.withColumns({**inputs, "__g": group}), order)

    def fold(name: str) -> Column:
        return F.max(f"__in_{name}") if name in maxes else F.sum(f"__in_{name}")

    parts = rows.groupBy("__g", "__b").agg(*[fold(n).alias(n) for n in (*sums, *maxes, *totals)])
    across = Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("__g")
    carries = parts.select(
        "__g", "__b", *[F.sum(n).over(across).alias(f"__carry_{n}") for n in sums],
        *[F.max(n).over(across).alias(f"__carry_{n}") for n in maxes],
        *[F.sum(n).over(whole).alias(f"__whole_{n}") for n in totals])
    within = Window.partitionBy("__g", "__b").orderBy(*[k.sort() for k in order]).rowsBetween(
        Window.unboundedPreceding, -1)
    kept = [F.col(c) for c in df.columns if c not in {*sums, *maxes, *totals}]
    local = rows.select(*kept, "__g", "__b", *[
        fold(n).over(within).alias(f"__local_{n}") for n in (*sums, *maxes)])
    zero = F.lit(0)
    results = [(F.coalesce(F.col(f"__local_{n}"), zero) + F.coalesce(F.col(f"__carry_{n}"), zero)).alias(n)
               for n in sums]
    results += [F.greatest(F.col(f"__local_{n}"), F.col(f"__carry_{n}")).alias(n) for n in maxes]
    results += [F.col(f"__whole_{n}").alias(n) for n in totals]
    return local.join(carries, ["__g", "__b"]).select(*kept, *results)


def row_rank(
    df: DataFrame, keys: Sequence[str], order: Order, name: str = "rank",
    totals: Mapping[str, Column] | None = None,
) -> DataFrame:
    """1-based position of each row inside its group under a total ``order``, and group totals."""
    ranked = running(df, keys, order, sums={name: F.lit(1)}, totals=totals)
    return ranked.withColumn(name, F.col(name) + 1)


def with_totals(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Attach per-group aggregates.

    An aggregate joined back, not a window: the aggregate combines map-side and the join is
    split by adaptive execution when a key is hot.
    """
    totals = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    renamed = totals.withColumnsRenamed({k: f"__t_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & df[k].eqNullSafe(renamed[f"__t_{k}"])
    return df.join(renamed, condition, "inner").drop(*[f"__t_{k}" for k in keys])


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, levels: Mapping[str, float]
) -> DataFrame:
    """Exact linearly interpolated quantiles per group.

    Works on value counts and their running totals, so neither a hot group nor a hot value
    is ever held in one aggregation buffer.
    """
    present = df.filter(F.col(value).isNotNull())
    counts = present.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    placed = running(counts, keys, [F.col(value)], sums={"__below": F.col("__c")},
                     totals={"__size": F.col("__c")})
    picks = []
    for name, level in levels.items():
        position = F.lit(float(level)) * (F.col("__size") - 1)
        for side, index in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            holds = (F.col("__below") <= index) & (index < F.col("__below") + F.col("__c"))
            picks.append(F.max(F.when(holds, F.col(value))).alias(f"__{side}_{name}"))
    picked = placed.groupBy(*keys).agg(F.max("__size").alias("__size"), *picks)
    outputs = []
    for name, level in levels.items():
        position = F.lit(float(level)) * (F.col("__size") - 1)
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        outputs.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return picked.select(*keys, *outputs)


def shifted(
    df: DataFrame, keys: Sequence[str], position: str, by: int, columns: Mapping[str, str]
) -> DataFrame:
    """Values of the row ``by`` positions earlier in the same group.

    An equi-join on (key, position), which is unique, so no group is ever gathered.
    """
    earlier = df.select(
        *[F.col(k).alias(f"__s_{k}") for k in keys],
        (F.col(position) + by).alias("__s_pos"),
        *[F.col(c).alias(n) for n, c in columns.items()],
    )
    condition = F.col(position) == F.col("__s_pos")
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__s_{k}"))
    return df.join(earlier, condition, "left").drop("__s_pos", *[f"__s_{k}" for k in keys])


def lagged(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str
) -> DataFrame:
    """The value of ``column`` one row earlier in the same group; ``order`` names columns, ascending."""
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)
    rows = _bucketed(df.withColumn("__g", group), order_keys(order))
    last = F.max_by(F.struct(F.col(column).alias("v")), F.struct(*order))
    across = Window.partitionBy("__g").orderBy("__b")
    carries = rows.groupBy("__g", "__b").agg(last.alias("__last")).select(
        "__g", "__b", F.lag("__last").over(across).alias("__carried"))
    within = Window.partitionBy("__g", "__b").orderBy(*sort_columns(order))
    local = rows.withColumns({"__own": F.lag(F.struct(F.col(column).alias("v"))).over(within)})
    joined = local.join(carries, ["__g", "__b"])
    return joined.withColumn(name, F.coalesce("__own", "__carried")["v"]).drop(
        "__g", "__b", "__own", "__carried")
