"""Near-duplicate embeddings by an inverted multi-index.

Unit vectors are cut into halves; each half has a codebook of its own, and the pair of nearest
codes is a vector's cell in the product grid. A query steps through cells in order of a lower bound
on its distance to anything in them (the sum of the bounds of the halves) until the bound passes
the search radius. As the bound holds for every vector, the recall of the default radius is 1;
``reach`` below 1 stops sooner. Candidates are verified by cosine in double precision.

Codebooks come from a bounded sample, the index holds every vector. Identical vectors are one node
with a count. The vectors of a cell are dealt by hash into blocks of bounded size. A block walks the
grid for all its vectors and names the cells they visit, nothing else; cells that hold nothing drop
out in a join with the occupied ones. Block pairs are keys at first; vectors are fetched per pair and
verified as one matrix product that serves both directions. Links are counted, never written out: a
block pair gives one count per vector and a spanning forest of its links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, store
from .components import components, forest


@dataclass(frozen=True)
class Index:
    """``block`` vectors of up to 64 components meet at a time, fewer of longer ones. Codebooks are
    fitted on at most ``sample`` vectors and grow with the table, up to ``codes`` per half, so that
    cells hold about a block."""

    cosine: float = 0.98
    codes: int = 256
    sample: int = 20_000
    rounds: int = 12
    block: int = 2048
    reach: float = 1.0


def units(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _squares(points: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum((points ** 2).sum(1)[:, None] + (codes ** 2).sum(1)[None, :]
                      - 2 * points @ codes.T, 0)


def fit_codes(points: np.ndarray, count: int, index: Index) -> np.ndarray:
    """Codebook of one half by Lloyd rounds, started from evenly spaced sample rows."""
    points = np.unique(points, axis=0)
    count = min(count, len(points))
    codes = points[np.linspace(0, len(points) - 1, count).astype(int)].copy()
    for _ in range(index.rounds):
        near = _squares(points, codes).argmin(1)
        for c in range(count):
            if (near == c).any():
                codes[c] = points[near == c].mean(0)
    return codes


def bounds(points: np.ndarray, codes: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Squared lower bounds on the distance to any point nearest to each code.

    A point nearest to code c lies beyond the plane halfway between c and any other code, and within
    c's radius (the largest distance of an indexed point to it) of c; the farthest of these planes,
    or the distance to that ball, is the bound.
    """
    far = _squares(points, codes)
    gap = np.sqrt(_squares(codes, codes))
    np.fill_diagonal(gap, np.inf)
    gap[gap == 0] = np.inf
    best = np.maximum(np.sqrt(far) - radii - 1e-7, 0)
    for other in range(len(codes)):
        np.maximum(best, (far - far[:, other: other + 1]) / (2 * gap[:, other][None, :]), out=best)
    return best ** 2


def traverse(first: np.ndarray, second: np.ndarray, limit: float) -> tuple[np.ndarray, ...]:
    """(query, code, code) of visited cells, nearest bound first for every query.

    Both lists of a query are sorted by bound; place i of the first list goes with the places of
    the second for which the sum stays within the limit, which is where a multi-sequence walk by
    increasing sums stops. All queries of a batch walk together.
    """
    orders = [np.argsort(s, axis=1, kind="stable") for s in (first, second)]
    sorted_ = [np.take_along_axis(s, o, axis=1) for s, o in zip((first, second), orders)]
    found = []
    for i in range(first.shape[1]):
        active = np.flatnonzero(sorted_[0][:, i] + sorted_[1][:, 0] <= limit)
        if not len(active):
            break
        for j in range(second.shape[1]):
            total = sorted_[0][active, i] + sorted_[1][active, j]
            active, total = active[total <= limit], total[total <= limit]
            if not len(active):
                break
            found.append((active, orders[0][active, i], orders[1][active, j], total))
    query, left, right, total = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((total, query))
    return query[order], left[order], right[order]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), dim)


def _one_cell(dim: int) -> list[np.ndarray]:
    """A codebook for a length that the sample does not hold."""
    return [np.zeros((1, dim // 2)), np.zeros((1, dim - dim // 2))]


def _halves(vectors: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    unit = units(vectors)
    return unit[:, : dim // 2], unit[:, dim // 2:]


def _homes(nodes: DataFrame, books: dict) -> DataFrame:
    """The nodes with their home cell (i, j) and the distances of the halves to its codes."""
    shared = nodes.sparkSession.sparkContext.broadcast(books)  # codes x dimensions per dimension

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            dims = part.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                rows = pa.Table.from_batches([part]).filter(pa.array(dims == dim))
                found = []
                for half, codes in zip(_halves(_matrix(rows["vector"].combine_chunks(), dim), dim),
                                       shared.value.get(dim) or _one_cell(dim)):
                    far = _squares(half, codes)
                    near = far.argmin(1)
                    found.append((near, np.sqrt(far[np.arange(len(near)), near])))
                for name, values in zip(("i", "j", "d1", "d2"),
                                        (found[0][0], found[1][0], found[0][1], found[1][1])):
                    rows = rows.append_column(name, pa.array(values))
                yield from rows.combine_chunks().to_batches()

    kind = nodes.schema["vector"].dataType.simpleString()
    label = nodes.schema["label"].dataType.simpleString()
    return nodes.select("label", "dim", "node", "weight", "vector").mapInArrow(
        run, f"label {label}, dim long, node binary, weight long, vector {kind}, i long, j long, "
             "d1 double, d2 double")


def _radii(homes: DataFrame, books: dict) -> dict:
    """Per dimension and half the largest distance of any vector to each code."""
    radii = {dim: [np.zeros(len(c)) for c in codes] for dim, codes in books.items()}
    both = homes.select("dim", F.explode(F.array(
        F.struct(F.lit(0).alias("half"), F.col("i").alias("code"), F.col("d1").alias("d")),
        F.struct(F.lit(1).alias("half"), F.col("j").alias("code"), F.col("d2").alias("d")))).alias("c"))
    known = both.filter(F.col("dim").isin(list(books)))  # lengths of the sample: a bounded table
    for r in known.groupBy("dim", "c.half", "c.code").agg(F.max("c.d").alias("d")).collect():
        radii[r.dim][r.half][r.code] = r.d
    return radii


_CELL = ("label", "dim", "i", "j")


def _blocks(homes: DataFrame, index: Index) -> DataFrame:
    """(label, dim, i, j, part, members): the vectors of every cell in lists of about ``block``."""
    sizes = homes.groupBy(*_CELL).agg(F.count("*").alias("size"))
    split = homes.join(sizes, list(_CELL)).withColumn(
        "part", F.pmod(F.xxhash64("node"), F.ceil(
            F.col("size") * F.greatest(F.col("dim") / 64, F.lit(1.0)) / index.block)))
    return split.groupBy(*_CELL, "part").agg(
        F.collect_list(F.struct("node", "weight", "vector")).alias("members"))


def _visits(blocks: DataFrame, books: dict, radii: dict, index: Index) -> DataFrame:
    """(label, dim, i, j, part, i2, j2): the cells that any vector of a block visits, keys only.

    A pair of cells is named by its smaller one, since being near is mutual.
    """
    shared = blocks.sparkSession.sparkContext.broadcast((books, radii))
    limit = (2 - 2 * index.cosine + 1e-9) * index.reach

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, radii = shared.value
        for part in batches:
            for r in range(part.num_rows):
                dim, i, j = (part.column(c)[r].as_py() for c in (1, 2, 3))
                codes = books.get(dim)
                if codes is None:
                    cells = np.zeros((1, 2), np.int64)
                else:
                    vectors = _matrix(part.column(5)[r].values.field("vector"), dim)
                    near = [bounds(h, c, d) for h, c, d in zip(_halves(vectors, dim), codes, radii[dim])]
                    _, left, right = traverse(*near, limit)
                    seen = np.unique(left * len(codes[1]) + right)
                    seen = seen[seen >= i * len(codes[1]) + j]
                    cells = np.stack(np.divmod(seen, len(codes[1])), 1)
                one = pa.Table.from_batches([part.slice(r, 1)]).select([0, 1, 2, 3, 4])
                rows = one.take(pa.array(np.zeros(len(cells), np.int64)))
                yield from rows.append_column("i2", pa.array(cells[:, 0])).append_column(
                    "j2", pa.array(cells[:, 1])).combine_chunks().to_batches()

    label = blocks.schema["label"].dataType.simpleString()
    return blocks.select(*_CELL, "part", "members").mapInArrow(
        run, f"label {label}, dim long, i long, j long, part long, i2 long, j2 long")


def _pairs(visits: DataFrame, blocks: DataFrame) -> DataFrame:
    """(dim, same, first, second): the members of every two blocks that have to meet."""
    held = blocks.select("label", "dim", F.col("i").alias("i2"), F.col("j").alias("j2"),
                         F.col("part").alias("part2"))
    own = (F.col("i") == F.col("i2")) & (F.col("j") == F.col("j2"))
    keys = visits.join(held, ["label", "dim", "i2", "j2"]).filter(
        ~own | (F.col("part") <= F.col("part2")))
    second = blocks.select("label", "dim", F.col("i").alias("i2"), F.col("j").alias("j2"),
                           F.col("part").alias("part2"), F.col("members").alias("second"))
    first = blocks.withColumnRenamed("members", "first")
    return keys.join(second, ["label", "dim", "i2", "j2", "part2"]).join(
        first, [*_CELL, "part"]).select(
        "dim", (own & (F.col("part") == F.col("part2"))).alias("same"), "first", "second")


def _verified(pairs: DataFrame, index: Index) -> DataFrame:
    """(node, links, other): links counted for both blocks, and the links of a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for r in range(part.num_rows):
                dim, same = part.column(0)[r].as_py(), part.column(1)[r].as_py()
                sides = [part.column(c)[r].values for c in (2, 3)]
                left, right = (units(_matrix(x.field("vector"), dim)) for x in sides)
                near = left @ right.T >= index.cosine
                if same:
                    np.fill_diagonal(near, False)
                if not near.any():
                    continue
                node = np.concatenate([np.array(x.field("node").to_pylist(), object) for x in sides])
                weight = [x.field("weight").to_numpy() for x in sides]
                links = np.concatenate([near @ weight[1], weight[0] @ near * (not same)])
                linked, root = forest(near)
                other = np.full(len(node), None, object)
                other[linked] = node[root]
                keep = links > 0
                keep[linked] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[keep], pa.binary()), pa.array(links[keep], pa.int64()),
                     pa.array(other[keep], pa.binary())], names=["node", "links", "other"])

    return pairs.mapInArrow(run, "node binary, links long, other binary")


def near_embeddings(table: DataFrame, key: str = "vec_id", vector: str = "embedding",
                    label: str = "label", index: Index = Index()) -> DataFrame:
    """key, n_links, component_id and kept per row.

    Vectors are compared when labels are equal and not null and dimensions agree. A null, empty or
    zero vector, or one with a null or non-finite component, links with nothing: n_links 0, its own
    component, kept. Repeated rows link with each other like any equal vectors. component_id is the
    smallest key reached (null is smallest). Other columns are ignored; no rows give no rows.
    """
    prepare(table.sparkSession)
    named = table.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("vector"),
                         F.col(f"`{label}`").alias("label"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    fit = (F.col("label").isNotNull() & F.col("vector").isNotNull()
           & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0))
    hashed = lambda *c: F.lpad(F.hex(F.xxhash64(*c)), 16, "0")
    rows = named.withColumn("node", F.when(F.coalesce(fit, F.lit(False)), F.unhex(F.concat(
        hashed(F.col("label"), F.col("vector")), hashed(F.lit("v"), F.col("vector"), F.col("label"))))))
    smallest = F.min(F.struct("key")).getField("key")
    nodes = store(rows.filter("node IS NOT NULL").groupBy("node").agg(
        F.first("label").alias("label"), F.first("vector").alias("vector"),
        F.count("*").alias("weight"), smallest.alias("key")).withColumn(
        "dim", F.size("vector").cast("long")))
    # Node ids are hashes, so the smallest are a sample; its size is a parameter.
    sample = nodes.orderBy("node").limit(index.sample).select("dim", "vector").toPandas()
    largest = nodes.groupBy("label", "dim").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    count = min(index.codes, max(1, math.ceil(math.sqrt(largest / index.block))))
    books = {}
    for dim, some in sample.groupby("dim")["vector"]:  # other lengths have one cell
        first, second = _halves(np.array(some.tolist()), dim)
        books[dim] = [fit_codes(first, count, index) if dim > 1 else np.zeros((1, 0)),
                      fit_codes(second, count, index)]
    homes = store(_homes(nodes, books))
    blocks = store(_blocks(homes, index))
    visits = store(_visits(blocks, books, _radii(homes, books), index))
    found = store(_verified(_pairs(visits, blocks), index))
    counts = found.filter("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.filter("other IS NOT NULL").select(
        F.col("node").alias("a"), F.col("other").alias("b")))
    classed = nodes.join(counts, "node", "left").join(labels, "node", "left").select(
        "node", "key", "weight", F.coalesce("links", F.lit(0)).alias("links"),
        F.coalesce("root", "node").alias("root"))
    lowest = classed.groupBy("root").agg(smallest.alias("component"))
    result = classed.join(lowest, "root").select(
        "node", (F.col("links") + F.col("weight") - 1).alias("n_links"), "component")
    return rows.join(result, "node", "left").select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("key")).otherwise(F.col("component")).alias(
            "component_id"),
        F.when(F.col("n_links").isNull(), True).otherwise(
            F.col("key").eqNullSafe(F.col("component"))).alias("kept"))
