"""Near-duplicate documents by SetSketch registers.

A document's word shingles set registers to exponentially spaced, truncated minima: register i is
floor(1 - log_base(x)) of the smallest exponential value x that any shingle has for i. Registers of
a union are their maxima, and two documents agree in a register about as often as their sets
overlap. Bands of registers file documents into buckets. The joint likelihood of the registers of a
pair estimates its similarity; pairs far below the limit go, the rest are confirmed on the full
shingle sets.

Equal sets are one node from the start, so thousands of exact copies cost one row each. Every member
of a bucket is first compared with the bucket's pivot alone, which settles most groups of copies
whatever their size. What buckets still hold apart is compared in blocks inside the tasks, members
of one component not with each other; no pairs are written out and no link is left out. At 28 bands
of 5, a pair at the limit of 0.8 shares no bucket with probability 1.5e-5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, Words, mix, prepare, store, unsigned, with_row
from .components import components, forest


@dataclass(frozen=True)
class Sketch:
    """``shingle`` words, links from ``percent``; registers are bands x rows of base ``base``."""

    shingle: int = 5
    percent: int = 80
    bands: int = 28
    rows: int = 5
    base: float = 1.001
    rate: float = 20.0
    margin: float = 6.0
    block_bytes: int = 1 << 20  # of texts that meet others in a task

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of A-Z-folded words, sorted by both.

    A text with fewer than ``n`` words but one or more has its whole sequence as its only shingle.
    """
    words = Words(texts, lower=True)
    where, value = words.windows(n)
    text = words.doc[where]
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            more = words.counts[short] > k
            extra[more] = mix(extra[more] + words.hashes[words.first[short[more]] + k])
        text, value = np.concatenate([text, short]), np.concatenate([value, mix(extra + np.uint64(1))])
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]


def fill_registers(text: np.ndarray, value: np.ndarray, count: int, plan: Sketch) -> np.ndarray:
    """Register values, one row per text; rows of texts without shingles are zero.

    Each shingle is a Poisson process of rate ``rate`` x registers whose points hit random
    registers, which gives every (shingle, register) an independent exponential minimum. Points are
    drawn only up to a time by which all registers are almost surely set; where one is not, the
    time is extended.
    """
    m = plan.registers
    lowest = np.full(count * m, np.inf)
    size = np.bincount(text, minlength=count)
    until = (np.log(m) + 8) / (np.maximum(size, 1) * plan.rate)
    todo = size > 0
    while todo.any():
        pick = todo[text]
        state, owner = value[pick], text[pick]
        when = np.zeros(len(state))
        while len(state):
            state = mix(state + np.uint64(0xA0761D6478BD642F))
            uniform = ((state >> np.uint64(11)).astype(np.float64) + 1) * 2.0 ** -53
            when = when - np.log(uniform) / (m * plan.rate)
            alive = when <= until[owner]
            state, owner, when = state[alive], owner[alive], when[alive]
            place = (mix(state ^ np.uint64(0xE7037ED1A0B428DB)) % np.uint64(m)).astype(np.int64)
            np.minimum.at(lowest, owner * m + place, when)
        open_ = ~np.isfinite(lowest.reshape(count, m)).all(axis=1)
        todo &= open_
        until = np.where(todo, until * 2, until)
    with np.errstate(divide="ignore"):
        level = np.floor(1 - np.log(lowest) / np.log(plan.base))
    out = np.clip(np.where(np.isfinite(lowest), level, 0), 0, 65535).astype(np.uint16)
    return out.reshape(count, m)


def _fixed(data: np.ndarray, width: int) -> pa.Array:
    raw = np.ascontiguousarray(data).view(np.uint8).reshape(-1, width)
    return pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(width), len(raw), [None, pa.py_buffer(raw)]).cast(pa.binary())


def sketches(rows: DataFrame, plan: Sketch) -> DataFrame:
    """key, r1, r2, n (set size), node (128-bit fingerprint of the set) and registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            n = part.num_rows
            text, value = shingle_sets(part.column(3), plan.shingle)
            size = np.bincount(text, minlength=n)
            edges = np.concatenate([[0], np.cumsum(size)])
            sums = []
            for salt in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3):
                total = np.zeros(len(text) + 1, np.uint64)
                np.cumsum(mix(value ^ np.uint64(salt)), out=total[1:])
                sums.append(mix(total[edges[1:]] - total[edges[:-1]] + size.astype(np.uint64)))
            filled = fill_registers(text, value, n, plan)
            yield pa.RecordBatch.from_arrays(
                [part.column(2), part.column(0), part.column(1), pa.array(size),
                 _fixed(np.stack(sums, 1), 16), _fixed(filled, 2 * plan.registers)],
                names=["key", "r1", "r2", "n", "node", "registers"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"key {kind}, r1 long, r2 long, n long, node binary, registers binary")


def _bands(nodes: DataFrame, plan: Sketch) -> DataFrame:
    """(bucket, node): one row per band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            filled = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16)
            filled = filled.reshape(part.num_rows, plan.bands, plan.rows).astype(np.uint64)
            bucket = np.broadcast_to(np.arange(plan.bands, dtype=np.uint64), filled.shape[:2])
            for k in range(plan.rows):
                bucket = mix(bucket * np.uint64(0x9E3779B97F4A7C15) + filled[:, :, k] + np.uint64(1))
            where = pa.array(np.repeat(np.arange(part.num_rows), plan.bands))
            yield pa.RecordBatch.from_arrays(
                [unsigned(bucket.ravel()), part.column(0).take(where)], names=["bucket", "node"])

    return nodes.select("node", "registers").mapInArrow(run, "bucket long, node binary")


def estimate(left: np.ndarray, right: np.ndarray, n: np.ndarray, k: np.ndarray,
             plan: Sketch) -> np.ndarray:
    """Similarity of set pairs: the maximum of the joint likelihood of their registers.

    ``left``/``right`` hold register rows, ``n``/``k`` the set sizes, which are known exactly.
    """
    more, less = (left > right).sum(axis=1), (left < right).sum(axis=1)
    equal = plan.registers - more - less
    u, v = n / (n + k), k / (n + k)
    step = (plan.base - 1) / plan.base
    grid = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)[:, None] * (1 - 1e-9)
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * step) / np.log(plan.base)
    up, down = chance(u[:, None] - v[:, None] * grid), chance(v[:, None] - u[:, None] * grid)
    tiny = 1e-300
    value = (more[:, None] * np.log(up + tiny) + less[:, None] * np.log(down + tiny)
             + equal[:, None] * np.log(np.maximum(1 - up - down, tiny)))
    return grid[np.arange(len(grid)), value.argmax(axis=1)]


def _promising(pairs: DataFrame, nodes: DataFrame, plan: Sketch) -> DataFrame:
    """Pairs (a, b) whose set sizes allow the limit and whose estimate is not far below it."""
    limit = plan.percent / 100
    least = limit - plan.margin * np.sqrt(limit * (1 - limit) / plan.registers)
    side = lambda c: nodes.select(
        F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("registers").alias(f"s{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").filter(
        f"100 * least(na, nb) >= {plan.percent} * greatest(na, nb)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            row = {n: part.column(i) for i, n in enumerate(part.schema.names)}
            sides = [np.frombuffer(b"".join(row[c].to_pylist()), np.uint16).reshape(
                part.num_rows, plan.registers) for c in ("sa", "sb")]
            found = estimate(*sides, row["na"].to_numpy(), row["nb"].to_numpy(), plan) if part.num_rows else []
            keep = pa.array(np.asarray(found) >= least)
            yield pa.RecordBatch.from_arrays(
                [row["a"].filter(keep), row["b"].filter(keep)], names=["a", "b"])

    return joined.mapInArrow(run, "a binary, b binary")


def _confirmed(pairs: DataFrame, texts: DataFrame, plan: Sketch) -> DataFrame:
    """Pairs that reach the limit on their full shingle sets."""
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"t{c}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            n = part.num_rows
            sets = [shingle_sets(part.column(i), plan.shingle) for i in (2, 3)]
            mine, theirs = (mix(value + mix(text.astype(np.uint64))) for text, value in sets)
            common = np.bincount(sets[0][0][np.isin(mine, theirs)], minlength=n)
            either = sum(np.bincount(text, minlength=n) for text, _ in sets) - common
            keep = pa.array(100 * common >= plan.percent * either)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).filter(keep), part.column(1).filter(keep)], names=["a", "b"])

    return joined.mapInArrow(run, "a binary, b binary")


def _relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (node, root) after new ``links``, which are taken between roots."""
    if labels is None:
        return components(links)
    left, right = (labels.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    between = links.join(left, "a", "left").join(right, "b", "left").select(
        F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    moved = components(between).select(F.col("node").alias("root"), F.col("root").alias("above"))
    known = labels.join(moved, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    fresh = moved.join(labels.select(F.col("node").alias("root")), "root", "left_anti").select(
        F.col("root").alias("node"), F.col("above").alias("root"))
    return store(known.unionByName(fresh))


def _compared(blocks: DataFrame, plan: Sketch) -> DataFrame:
    """Links (a, b) inside clusters, between texts that no link connects yet.

    Blocks of a cluster meet by an equi-join. A block pair counts common shingles of all its texts
    as a matrix product over the shingles that both sides hold, and gives a spanning forest of the
    links it finds, so nothing of quadratic size leaves the task.
    """
    left, right = (blocks.select("cluster", F.col("part").alias(f"p{c}"), F.col("texts").alias(c))
                   for c in "lr")
    met = left.join(right, "cluster").filter("pl <= pr").select("l", "r")

    def counts(first, second, rows: int, columns: int) -> np.ndarray:
        common = np.intersect1d(first[1], second[1])
        total = np.zeros((rows, columns), np.float32)
        sides = []
        for text, value in (first, second):
            place = np.minimum(np.searchsorted(common, value), max(len(common) - 1, 0))
            held = common[place] == value if len(common) else np.zeros(len(value), bool)
            order = np.argsort(place[held], kind="stable")
            sides.append((text[held][order], place[held][order]))
        for at in range(0, len(common), 4096):
            matrix = []
            for (text, place), size in zip(sides, (rows, columns)):
                some = slice(*np.searchsorted(place, [at, at + 4096]))
                part = np.zeros((size, min(4096, len(common) - at)), np.float32)
                part[text[some], place[some] - at] = 1
                matrix.append(part)
            total += matrix[0] @ matrix[1].T
        return total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for r in range(part.num_rows):
                sides = [part.column(c)[r].values for c in (0, 1)]
                names, labels = ([np.array(x.field(f).to_pylist(), object) for x in sides]
                                 for f in ("node", "root"))
                sets = [shingle_sets(x.field("text"), plan.shingle) for x in sides]
                size = [np.bincount(t, minlength=len(n)) for (t, _), n in zip(sets, names)]
                both = counts(*sets, len(names[0]), len(names[1]))
                either = size[0][:, None] + size[1][None, :] - both
                near = (100 * both >= plan.percent * either) & (labels[0][:, None] != labels[1][None, :])
                a, b = forest(near)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(names)[a], pa.binary()), pa.array(names[0][b], pa.binary())],
                    names=["a", "b"])

    return met.mapInArrow(run, "a binary, b binary")


def _linked(nodes: DataFrame, rows: DataFrame, plan: Sketch) -> DataFrame | None:
    """(node, root) of every node in a component of two or more; None if there is none."""
    bands = _bands(nodes, plan)
    shared = bands.groupBy("bucket").agg(F.count("*").alias("c"), F.min("node").alias("pivot"))
    member = store(bands.join(shared.filter("c > 1").select("bucket", "pivot"), "bucket"))
    texts = store(nodes.join(member.select("node").distinct(), "node").select("node", "r1", "r2").join(
        rows.select(*ROW, "text"), list(ROW)).dropDuplicates(["node"]).select("node", "text"))
    pairs = store(member.filter("node <> pivot").select(
        F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())
    good = store(_confirmed(store(_promising(pairs, nodes, plan)), texts, plan))
    labels = None if good.isEmpty() else components(good)
    known = member.withColumn("root", F.col("node")) if labels is None else member.join(
        labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = known.groupBy("bucket").agg(
        F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    left = store(known.join(open_.select("bucket"), "bucket").select("pivot", "node", "root"))
    if left.isEmpty():
        return labels
    # Members of open buckets that buckets connect; all pairs that share a bucket are in a cluster.
    clusters = components(left.select(F.col("pivot").alias("a"), F.col("node").alias("b")))
    staged = store(clusters.select("node", F.col("root").alias("cluster")).join(
        left.select("node", "root").distinct(), "node").join(texts, "node"))
    sizes = staged.groupBy("cluster").agg(F.sum(F.octet_length("text")).alias("bytes"))
    blocks = staged.join(sizes, "cluster").withColumn("part", F.pmod(
        F.xxhash64("node"), F.ceil(F.col("bytes") / plan.block_bytes))).groupBy("cluster", "part").agg(
        F.collect_list(F.struct("node", "root", "text")).alias("texts"))
    found = store(_compared(blocks, plan))
    return labels if found.isEmpty() else _relabelled(labels, found)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    plan: Sketch = Sketch()) -> DataFrame:
    """One row per document: key, r1, r2 (its identity), n_shingles, component_id, kept and first.

    component_id is the smallest key (nulls first) that links reach; a text without words is linked
    with nothing. Equal sets are always linked, so repeated rows share a component and, having the
    same key, are kept or not together; ``first`` marks one identity of each component, that of
    smallest key, then r1 and r2, where several rows have the smallest key. Other columns are ignored here; ``with_classes`` attaches
    the result to whole rows. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    rows = with_row(docs, key, text)
    drawn = store(sketches(rows, plan))
    filled = drawn.filter("n > 0")
    smallest = F.min(F.struct("key", *ROW)).alias("row")  # a null is smallest
    nodes = store(filled.groupBy("node").agg(
        smallest, F.first("n").alias("n"), F.first("registers").alias("registers")).select(
        "node", "row.key", "n", "row.r1", "row.r2", "registers"))
    labels = _linked(nodes, rows, plan)
    roots = nodes.select("node", "key", *ROW, F.col("node").alias("root")) if labels is None else (
        nodes.join(labels, "node", "left").select(
            "node", "key", *ROW, F.coalesce("root", "node").alias("root")))
    lowest = roots.groupBy("root").agg(smallest).select(
        "root", F.col("row.key").alias("component"), F.col("row.r1").alias("f1"), F.col("row.r2").alias("f2"))
    classes = store(roots.join(lowest, "root").select("node", "component", "f1", "f2"))
    found = drawn.join(classes, "node", "left").select(
        F.col("key").alias(key), *ROW, F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("key").eqNullSafe(F.col("component"))).otherwise(True).alias(
            "kept"),
        F.when(F.col("n") > 0, (F.col("r1") == F.col("f1")) & (F.col("r2") == F.col("f2"))).otherwise(
            True).alias("first"))
    return found


def with_classes(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text",
                 once: bool = False) -> DataFrame:
    """``docs`` with n_shingles, component_id and kept added; columns of these names are replaced.

    ``once`` keeps one of several rows that are equal in key and text, and ``kept`` is then true for
    one row of each component, whatever keys its rows share.
    """
    new = ("n_shingles", "component_id", "kept")
    old = [c for c in docs.columns if c not in new]
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in old]).alias("_row"),
        F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("r1"),
        F.xxhash64(F.lit("row"), F.col(f"`{text}`"), F.lit(7), F.col(f"`{key}`")).alias("r2"))
    joined = base.join(found.dropDuplicates(list(ROW)), list(ROW))
    if once:  # rows of one identity are together after the join
        joined = joined.dropDuplicates(list(ROW)).withColumn("kept", F.col("first"))
    return joined.select(*[F.col("_row")[c].alias(c) for c in old], *new)
