"""Helpers shared by the corpus operators: reading, scratch tables, numpy views of Arrow texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, scratch_folder

#: Bytes of an Arrow batch that one Python worker holds at a time; a longer row makes its own batch.
BATCH_BYTES = 2 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the corpus operators: Arrow batches bounded in bytes, not only in rows."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Lineage ends at the table, so a lost executor costs a re-read, and later steps prune columns.
    """
    folder = scratch_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def row_hash(*names: str) -> Column:
    """A hash that tells rows with one id but different contents apart; equal rows share it."""
    return F.xxhash64(*[F.col(n) for n in names])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets into them; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)
    offsets = offsets[column.offset: column.offset + len(column) + 1].astype(np.int64)
    if data is None or len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]], offsets - offsets[0]


_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (xor-shift and multiply rounds)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, from one prefix sum over the buffer."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power = np.full(len(data), _BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
    back = np.full(len(data), _INVERSE, np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    raw = (total[ends] - total[starts]) * back[np.minimum(starts, len(data) - 1)]
    return mix(raw ^ (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


class Words:
    """Words (runs without the six ASCII white-space bytes) of a batch of texts, as arrays.

    ``starts``/``ends`` are byte positions, ``doc`` the text of each word, ``first`` the index of
    each text's first word (one more entry than texts), ``hashes`` 64-bit word hashes.
    """

    def __init__(self, column: pa.Array, lower: bool = False) -> None:
        data, self.offsets = text_bytes(column)
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        self.data = data
        self.inside = ~_SPACE[data]
        begins = self.inside.copy()
        begins[1:] &= ~self.inside[:-1]
        bounds = self.offsets[:-1][np.diff(self.offsets) > 0]
        begins[bounds] = self.inside[bounds]
        self.starts = np.flatnonzero(begins)
        finish = self.inside.copy()
        finish[:-1] &= ~self.inside[1:]
        last = bounds[1:] - 1
        finish[last] = self.inside[last]
        self.ends = np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.hashes = span_hashes(data, self.starts, self.ends)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Start indexes and hashes of every run of ``n`` words inside one text."""
        total = len(self.hashes) - n + 1
        if total <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        where = np.flatnonzero(self.doc[:total] == self.doc[n - 1:])
        value = np.zeros(total, np.uint64)
        factor = np.uint64(1)
        with np.errstate(over="ignore"):
            for k in range(n):
                value += self.hashes[k: k + total] * factor
                factor = factor * _BASE
        return where, mix(value[where] + np.uint64(n))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = np.unique(twice)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Flags of ``total`` places that lie in a window of ``n`` from one of ``starts``."""
    edge = np.zeros(total + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + n, total), -1)
    return np.cumsum(edge[:-1]) > 0


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets."""
    running = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=running[1:])
    return running[offsets[1:]] - running[offsets[:-1]]


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type)
         for f, c in ((f, columns[f.name]) for f in schema)], schema=schema)


#: Columns that identify a row by its id and text; rows equal in both share them.
ROW = ("r1", "r2")


def with_row(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Columns r1, r2 (a 128-bit identity, never null), ``key`` as key, ``text`` as text."""
    named = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return named.select(
        F.xxhash64("key", "text").alias("r1"),
        F.xxhash64(F.lit("row"), "text", F.lit(7), "key").alias("r2"), "key", "text")


def unsigned(values: np.ndarray) -> pa.Array:
    """64-bit hashes as signed integers, as Spark keeps them."""
    return pa.array(values.view(np.int64))
