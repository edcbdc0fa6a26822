"""Ranked lexical search over bit-sliced Bloom signatures.

An index row holds a block of documents of like size: their texts, their numbers of terms, and a
Bloom signature of every document turned on its side, one bitmap over the documents per signature
bit. A document enters (term, level) for every level up to log2 of the term's occurrences, so the
bitmaps of a term never miss a document and bound its occurrences from above. Sums of the
bitmaps, weighted by what a level can add to a score, give an upper bound per query and document.
Each task keeps its best scores so far; a document whose bound stays below the last of them is
provably not among the best, and every other one is scored exactly from its text. Only the best
rows of each task are exchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import mix, prepare, span_hashes, store, text_bytes
from .runs import RunStrings

_INSIDE = np.ones(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _INSIDE[_low: _high + 1] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Cells of a work matrix (terms or queries by documents) held at a time.
_CELLS = 2_000_000


@dataclass(frozen=True)
class Signature:
    """``bits`` signature bits per entry at least (rounded up to a power of two for the block) and
    ``probes`` bits set per entry. ``query_bytes`` of query text are searched for in one pass."""

    bits: int = 8
    probes: int = 3
    query_bytes: int = 4 << 20


class Terms:
    """Terms of a batch of texts: (text, name, times) triples, sorted by text; names are distinct."""

    def __init__(self, column: pa.Array) -> None:
        data, offsets = text_bytes(column)
        runs = RunStrings(_LOWER[data], _INSIDE[data], offsets)
        coded = runs.strings.dictionary_encode()
        self.names = coded.dictionary
        width = max(len(self.names), 1)
        keys, times = np.unique(runs.text * width + coded.indices.to_numpy(), return_counts=True)
        self.text, self.name = np.divmod(keys, width)
        self.times = times.astype(np.int64)
        self.counts = np.diff(runs.first)  # terms per text, with repeats

    def hashes(self) -> np.ndarray:
        data, offsets = text_bytes(self.names)
        return span_hashes(data, offsets[:-1], offsets[1:])

    def matched(self, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place in the vocabulary, times) of the terms that the vocabulary holds."""
        place = pc.fill_null(pc.index_in(self.names, value_set=vocabulary), -1).to_numpy()
        found = place[self.name] if len(self.name) else np.zeros(0, np.int64)
        hit = found >= 0
        return self.text[hit], found[hit].astype(np.int64), self.times[hit]


def _probes(hashes: np.ndarray, level: np.ndarray | int, plan: Signature, log_bits: int) -> np.ndarray:
    """Signature bits (one row per entry) of terms at a level."""
    h = mix(hashes + np.uint64(0x632BE59BD9B4E019) * np.asarray(level).astype(np.uint64))
    step = (h >> np.uint64(32)) | np.uint64(1)
    i = np.arange(plan.probes, dtype=np.uint64)
    return ((h[:, None] + i * step[:, None]) & np.uint64((1 << log_bits) - 1)).astype(np.int64)


def _index_type(key: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("log_bits", T.IntegerType()), T.StructField("levels", T.IntegerType()),
        T.StructField("slices", T.BinaryType()), T.StructField("keys", T.ArrayType(key)),
        T.StructField("terms", T.ArrayType(T.LongType())),
        T.StructField("texts", T.ArrayType(T.StringType()))])


@contextmanager
def _few_rows(spark: SparkSession):
    """Index rows are large: read few of them at a time."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(name)
    spark.conf.set(name, "16")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@dataclass(frozen=True)
class Index:
    """``blocks``: the stored index. ``documents`` counts texts with a term, ``terms`` all terms."""

    blocks: DataFrame
    plan: Signature
    key: str
    documents: int
    terms: int


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text",
                plan: Signature = Signature()) -> Index:
    """Index every row of ``docs`` in one pass, without a shuffle.

    Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased.
    Texts that are null or without terms can't be found and are left out. Rows with equal ids or
    equal texts are documents of their own; other columns are not read. Documents of one batch are
    blocked by the size of their signatures, so a long one does not thin out the others' bitmaps.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["key"].dataType
    schema = _index_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            terms = Terms(part.column(1))
            if not len(terms.text):
                continue
            # np.frexp gives the bit length of a count: the levels 0 .. log2(times)
            levels = np.frexp(terms.times.astype(np.float64))[1].astype(np.int64)
            entries = np.bincount(terms.text, weights=levels, minlength=len(part)).astype(np.int64)
            size = np.where(terms.counts > 0, np.frexp(entries * float(plan.bits))[1], -1)
            hashes = terms.hashes()
            for log_bits in np.unique(size[size >= 0]).tolist():
                chosen = np.flatnonzero(size == log_bits)
                slot = np.full(len(part), -1, np.int64)
                slot[chosen] = np.arange(len(chosen))
                mine = np.flatnonzero(slot[terms.text] >= 0) if len(chosen) < len(part) else \
                    np.arange(len(terms.text))
                again = np.repeat(mine, levels[mine])
                level = np.arange(len(again)) - np.repeat(
                    np.cumsum(levels[mine]) - levels[mine], levels[mine])
                bits = _probes(hashes[terms.name[again]], level, plan, log_bits)
                flags = np.zeros((1 << log_bits, len(chosen)), bool)
                flags[bits, slot[terms.text[again]][:, None]] = True
                whole, take = pa.array([0, len(chosen)], pa.int32()), pa.array(chosen)
                yield pa.RecordBatch.from_arrays([
                    pa.array([log_bits], pa.int32()),
                    pa.array([int(levels[mine].max())], pa.int32()),
                    pa.array([np.packbits(flags, axis=1).tobytes()], pa.binary()),
                    pa.ListArray.from_arrays(whole, part.column(0).take(take)),
                    pa.ListArray.from_arrays(whole, pa.array(terms.counts[chosen], pa.int64())),
                    pa.ListArray.from_arrays(whole, part.column(1).take(take)),
                ], names=schema.names)

    found = rows.filter(F.col("text").isNotNull()).mapInArrow(run, schema)
    blocks = store(found)
    total = blocks.agg(F.sum(F.size("terms")).alias("n"),
                       F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l"))
    one = total.first()
    return Index(blocks, plan, key, int(one.n or 0), int(one.l or 0))


@dataclass(frozen=True)
class Queries:
    """A bounded block of queries: the distinct terms of all, and each query's terms and times."""

    items: list
    vocabulary: list[bytes]
    place: np.ndarray  # terms of the queries, one query after the other
    times: np.ndarray
    first: np.ndarray  # where each query begins in them


def _query_blocks(queries: DataFrame, item: str, text: str, plan: Signature) -> Iterator[list]:
    """(item, text) rows of all queries, at most about ``query_bytes`` of text at a time.

    Queries are dealt by hash into buckets of a fraction of that size; bucket sizes are measured
    and whole buckets are read together as long as they fit.
    """
    rows = queries.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("text")).filter(
        F.col("text").isNotNull())
    size = F.octet_length("text").cast("long") + 64
    total = rows.agg(F.sum(size).alias("s")).first().s or 0
    buckets = max(1, 8 * total // plan.query_bytes)
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("item", "text"), F.lit(buckets)))
    block, held = [], 0
    for b, s in sorted(tuple(r) for r in dealt.groupBy("bucket").agg(F.sum(size)).collect()):
        if block and held + s > plan.query_bytes:
            yield dealt.filter(F.col("bucket").isin(block)).select("item", "text").collect()
            block, held = [], 0
        block.append(b)
        held += s
    if block:
        yield dealt.filter(F.col("bucket").isin(block)).select("item", "text").collect()


def _queries(rows: list) -> Queries:
    terms = Terms(pa.array([r.text for r in rows], pa.string()))
    first = np.searchsorted(terms.text, np.arange(len(rows) + 1))
    asked = np.flatnonzero(np.diff(first))
    return Queries([rows[i].item for i in asked.tolist()], terms.names.to_pylist(), terms.name,
                   terms.times, np.append(first[asked], len(terms.name)))


def _document_counts(index: Index, queries: Queries) -> np.ndarray:
    """Documents that hold each term of the queries, counted over the whole index."""
    shared = index.blocks.sparkSession.sparkContext.broadcast(queries.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(shared.value, pa.large_binary())
        count = np.zeros(len(vocabulary), np.int64)
        for part in batches:
            _, place, _ = Terms(part.column(0).flatten()).matched(vocabulary)
            count += np.bincount(place, minlength=len(count))
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(count[held])], names=["term", "df"])

    counted = index.blocks.select("texts").mapInArrow(run, "term long, df long")
    df = np.zeros(len(queries.vocabulary), np.int64)
    for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect():  # one row per query term
        df[r.term] = r.df
    return df


def _saturated(times, norm):
    """What ``times`` occurrences count in a document of this length norm; grows with ``times``."""
    return (1_000_000_000 * times) // (1000 * times + 12 * norm)


class Best:
    """The best documents of each query so far, and the scores below which nothing can enter."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.rows: list[list[tuple]] = [[] for _ in range(n)]
        self.least = np.ones(n, np.int64)

    def add(self, query: int, scores: np.ndarray, keys: list) -> None:
        rows = self.rows[query] + [(-s, x is None, x) for s, x in zip(scores.tolist(), keys)]
        rows.sort(key=lambda r: r if r[2] is not None else r[:2] + (0,))
        self.rows[query] = rows[: self.k]
        if len(rows) >= self.k:
            self.least[query] = -rows[self.k - 1][0]


class Searcher:
    """Bounds and exact scores of the queries over index rows."""

    def __init__(self, queries: Queries, df: np.ndarray, documents: int, terms: int,
                 plan: Signature, k: int) -> None:
        self.queries, self.plan = queries, plan
        self.documents, self.terms = documents, terms
        self.vocabulary = pa.array(queries.vocabulary, pa.large_binary())
        data, offsets = text_bytes(self.vocabulary)
        self.hashes = span_hashes(data, offsets[:-1], offsets[1:])
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1)))
                           for d in df.tolist()], np.int64)
        self.weight = weight[queries.place] * queries.times
        self.best = Best(len(queries.items), k)

    def _sums(self, values: np.ndarray) -> np.ndarray:
        """Per query and document: weighted sums of the values (terms x documents) of its terms."""
        first, place = self.queries.first, self.queries.place
        out = np.zeros((len(first) - 1, values.shape[1]), np.int64)
        rows = max(1, _CELLS // max(values.shape[1], 1))
        low = 0
        while low < len(out):
            high = max(low + 1, int(np.searchsorted(first, first[low] + rows, "right")) - 1)
            span = slice(first[low], first[high])
            out[low:high] = np.add.reduceat(
                values[place[span]] * self.weight[span, None], first[low:high] - first[low], axis=0)
            low = high
        return out

    def bounds(self, slices: np.ndarray, log_bits: int, levels: int, norm: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores, queries x documents."""
        n = len(norm)
        out = np.zeros((len(self.queries.items), n), np.int64)
        before = np.zeros(n, np.int64)
        held = np.full((len(self.hashes), slices.shape[1]), 255, np.uint8)
        for level in range(levels):
            held &= np.bitwise_and.reduce(
                slices[_probes(self.hashes, np.full(len(self.hashes), level), self.plan, log_bits)], axis=1)
            if not held.any():
                break
            part = _saturated(np.int64(2 ** (level + 1) - 1), norm)  # the most occurrences of this level
            out += self._sums(np.unpackbits(held, axis=1)[:, :n].astype(np.int64)) * (part - before)
            before = part
        return out

    def search(self, log_bits: int, levels: int, slices: bytes, keys: list, counts: np.ndarray,
               texts: pa.Array) -> int:
        """Take one index row in; the number of documents scored exactly."""
        norm = 75 + (25 * counts * self.documents) // self.terms
        width = -(-len(counts) // 8)
        bits = np.frombuffer(slices, np.uint8).reshape(1 << log_bits, width)
        open_ = self.bounds(bits, log_bits, levels, norm) >= self.best.least[:, None]
        left = np.flatnonzero(open_.any(0))
        step = max(1, _CELLS // max(len(self.hashes), 1))
        for at in range(0, len(left), step):
            chosen = left[at: at + step]
            text, place, times = Terms(texts.take(pa.array(chosen))).matched(self.vocabulary)
            values = np.zeros((len(self.hashes), len(chosen)), np.int64)
            values[place, text] = _saturated(times, norm[chosen][text])
            scores = self._sums(values)
            enter = open_[:, chosen] & (scores >= self.best.least[:, None])
            for query in np.flatnonzero(enter.any(1)).tolist():
                which = np.flatnonzero(enter[query])
                self.best.add(query, scores[query, which], [keys[i] for i in chosen[which].tolist()])
        return len(left)


def _search_block(index: Index, rows: list, k: int, item_type: T.DataType) -> DataFrame | None:
    queries = _queries(rows)
    if not queries.items or not index.documents:
        return None
    spark = index.blocks.sparkSession
    df = _document_counts(index, queries)
    key_type = index.blocks.schema["keys"].dataType.elementType
    schema = T.StructType([
        T.StructField("query", T.LongType()), T.StructField("item", item_type),
        T.StructField("key", key_type), T.StructField("score", T.LongType())])
    kinds = [to_arrow_type(f.dataType) for f in schema]
    shared = spark.sparkContext.broadcast((queries, df))
    documents, terms, plan = index.documents, index.terms, index.plan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, df = shared.value
        searcher = Searcher(queries, df, documents, terms, plan, k)
        for part in batches:
            for i in range(len(part)):
                log_bits, levels, slices, keys, counts, texts = (c[i] for c in part.columns)
                searcher.search(log_bits.as_py(), levels.as_py(), slices.as_py(), keys.as_py(),
                                counts.values.to_numpy(), texts.values)
        found = [(q, queries.items[q], key, -score)
                 for q, best in enumerate(searcher.best.rows) for score, _, key in best]
        columns = list(zip(*found)) if found else [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds)], names=schema.names)

    return index.blocks.mapInArrow(run, schema)


def search(index: Index, queries: DataFrame, k: int = 20, item: str = "item_id",
           text: str = "text") -> DataFrame:
    """Per query its ``k`` documents of highest score above 0: item, rank (from 1), key, score.

    With N documents, L terms and df documents that hold a term, its weight is
    floor(1000 ln((2N + 2) / (2 df + 1))); a document of n terms has norm 75 + 25 n N div L; a term
    that occurs tf times adds weight * (10^9 tf div (1000 tf + 12 norm)) each time the query holds
    it. Equal scores go by ascending key, nulls last. A query that is null or holds no known term
    gets no rows; repeated query rows are ranked each. Every row of the index is bounded, and all
    that the bound does not exclude are scored. Query text goes out in blocks of ``query_bytes``.
    """
    spark = prepare(index.blocks.sparkSession)
    item_type = queries.schema[item].dataType
    best = []
    with _few_rows(spark):
        for n, rows in enumerate(_query_blocks(queries, item, text, index.plan)):
            found = _search_block(index, rows, k, item_type)
            if found is not None:
                best.append(store(found.withColumn("block", F.lit(n))))
    if not best:
        return spark.createDataFrame([], T.StructType([
            T.StructField(item, item_type), T.StructField("rank", T.IntegerType()),
            T.StructField(index.key, index.blocks.schema["keys"].dataType.elementType),
            T.StructField("score", T.LongType())]))
    rows = best[0]
    for more in best[1:]:
        rows = rows.unionByName(more)
    # a query has up to k rows of every task: the first cut is made in 64 shares of them
    order = [F.desc("score"), F.asc_nulls_last("key")]
    share = Window.partitionBy("block", "query", F.pmod(F.xxhash64("key"), F.lit(64))).orderBy(*order)
    whole = Window.partitionBy("block", "query").orderBy(*order)
    cut = rows.withColumn("_r", F.row_number().over(share)).filter(F.col("_r") <= k).drop("_r")
    ranked = cut.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item), "rank", F.col("key").alias(index.key), "score")
