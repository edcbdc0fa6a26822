"""Byte-level BPE by a two-tier lookup, and its decoding.

Tier one is a minimal perfect hash over the vocabulary: whole pre-tokens that are tokens resolve in
one vectorised probe per batch. Tier two takes the misses: a heap of adjacent pairs over linked
bytes merges the lowest rank first. Every distinct chunk of a task is encoded once and ids are
gathered back by index. Rows are independent, so nothing is shuffled.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, span_hashes

#: Distinct chunks whose ids a task remembers; beyond it the memory starts anew.
REMEMBERED = 400_000


def read_ranks(path: str) -> bytes:
    """The rank file as bytes; it is a vocabulary, so its size does not follow the data."""
    with open(path, "rb") as file:
        return file.read()


def parse_ranks(content: bytes) -> list[bytes]:
    """Token bytes by id. A file with a gap in its ids is refused."""
    ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, content.splitlines())}
    tokens = [ranks[i] for i in range(len(ranks))]
    if len({t for t in tokens if len(t) == 1}) != 256:
        raise ValueError("a byte-level vocabulary needs all 256 single bytes")
    return tokens


def _joined(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum(np.fromiter(map(len, values), np.int64, len(values)))
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if len(values) else ends
    return np.frombuffer(b"".join(values), np.uint8), starts, ends


class PerfectHash:
    """Minimal perfect hash by displacement: n keys on n slots, checked against the key's bytes.

    Keys fall into buckets by one hash; buckets, largest first, search the first seed that sends
    their keys to free slots. A probe costs two hashes and one comparison.
    """

    def __init__(self, keys: list[bytes]) -> None:
        self.n = len(keys)
        self.buckets = max(1, self.n // 4)
        base = span_hashes(*_joined(keys))
        if len(np.unique(base)) != self.n:
            raise ValueError("keys must be distinct")
        self.base = np.zeros(self.n, np.uint64)
        self.ids = np.zeros(self.n, np.int64)
        self.seeds = np.zeros(self.buckets, np.uint64)
        bucket = (mix(base + np.uint64(1)) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        free = np.ones(self.n, bool)
        for b in np.argsort(-np.diff(cuts), kind="stable"):
            members = order[cuts[b]: cuts[b + 1]]
            if not len(members):
                break
            seed = 0
            while True:
                seeds = np.arange(seed, seed + 64, dtype=np.uint64)[:, None]
                slots = (mix(base[members][None, :] ^ (seeds * np.uint64(0x9E3779B97F4A7C15)))
                         % np.uint64(self.n)).astype(np.int64)
                good = free[slots].all(axis=1)
                if len(members) > 1:
                    ordered = np.sort(slots, axis=1)
                    good &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                hit = np.flatnonzero(good)
                if len(hit):
                    chosen = slots[hit[0]]
                    self.seeds[b] = seed + int(hit[0])
                    free[chosen] = False
                    self.base[chosen] = base[members]
                    self.ids[chosen] = members
                    break
                seed += 64

    def find(self, base: np.ndarray) -> np.ndarray:
        """Key numbers by 64-bit key hash, -1 where the slot holds another key."""
        bucket = (mix(base + np.uint64(1)) % np.uint64(self.buckets)).astype(np.int64)
        slot = (mix(base ^ (self.seeds[bucket] * np.uint64(0x9E3779B97F4A7C15)))
                % np.uint64(self.n)).astype(np.int64)
        return np.where(self.base[slot] == base, self.ids[slot], -1)


class Codec:
    """Vocabulary tables of one task: perfect hash, pair merges, and the ids of chunks seen.

    Built once on the driver and broadcast; its size is the vocabulary's, whatever the data.
   """

    def __init__(self, content: bytes, pattern: str) -> None:
        self.tokens = parse_ranks(content)
        rank = {t: i for i, t in enumerate(self.tokens)}
        self.byte_id = [rank[bytes([b])] for b in range(256)]
        self.after: list[dict[int, int]] = [{} for _ in self.tokens]
        for i, t in enumerate(self.tokens):
            for cut in range(1, len(t)):
                left, right = rank.get(t[:cut]), rank.get(t[cut:])
                if left is not None and right is not None:
                    self.after[left][right] = i
        self.hash = PerfectHash(self.tokens)
        self.split = regex.compile(pattern)
        self.uneven = regex.compile(r"^\s|\s$| \s|\s ")
        self.lone = regex.compile(r"(?<=\S) (?=\S)")
        self.memory: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def fresh(self) -> Codec:
        """The same tables with nothing remembered."""
        self.memory.clear()
        self.pieces.clear()
        return self

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: merge the pair of lowest rank, leftmost first, until none is left."""
        after = self.after
        ids = [self.byte_id[b] for b in piece]
        n = len(ids)
        rank = [after[a].get(b, -1) for a, b in zip(ids, ids[1:])]
        rank.append(-1)
        heap = [r << 32 | i for i, r in enumerate(rank) if r >= 0]
        heapq.heapify(heap)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            i, merged = top & 0xFFFFFFFF, top >> 32
            if rank[i] != merged:
                continue  # one of the two has been merged since
            gone = following[i]
            ids[i], ids[gone], rank[gone] = merged, -1, -1
            right, left = following[gone], before[i]
            following[i] = right
            found = -1
            if right < n:
                before[right] = i
                found = after[merged].get(ids[right], -1)
                if found >= 0:
                    push(heap, found << 32 | i)
            rank[i] = found
            if left >= 0:
                rank[left] = found = after[ids[left]].get(merged, -1)
                if found >= 0:
                    push(heap, found << 32 | left)
        return [i for i in ids if i >= 0]

    def _learn(self, chunks: list[str]) -> None:
        """Add the ids of chunks not seen before."""
        pieces, cuts = [], [0]
        for chunk in chunks:
            pieces += self.split.findall(chunk)
            cuts.append(len(pieces))
        known = self.pieces
        fresh = [p for p in dict.fromkeys(pieces) if p not in known]
        encoded = [p.encode() for p in fresh]
        whole = self.hash.find(span_hashes(*_joined(encoded)))
        for piece, key, at in zip(fresh, encoded, whole.tolist()):
            known[piece] = (at,) if at >= 0 and self.tokens[at] == key else tuple(self.merge(key))
        for k, chunk in enumerate(chunks):
            found = pieces[cuts[k]: cuts[k + 1]]
            self.memory[chunk] = known[found[0]] if len(found) == 1 else tuple(
                i for p in found for i in known[p])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the n + 1 places where each text begins."""
        chunks, sizes = [], []
        for text in texts:
            if not text:
                sizes.append(0)
                continue
            # A pre-token never runs across a lone space between two other characters, which
            # starts one; so texts are cut there, and nowhere else.
            parts = self.lone.split(text) if self.uneven.search(text) else text.split(" ")
            chunks.append(parts[0])
            chunks += [" " + p for p in parts[1:]]
            sizes.append(len(parts))
        if not chunks:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        code, distinct = pd.factorize(np.array(chunks, object))
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
            self.pieces.clear()
        memory = self.memory
        self._learn([c for c in distinct if c not in memory])
        found = [memory[c] for c in distinct]
        length = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(length.sum()))
        ids, places = gather(flat, np.cumsum(length) - length, length, code)
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.array(sizes, np.int64))])
        return ids, places[ends]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join([self.tokens[i] for i in ids.tolist()])


def gather(flat, starts, length, code) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the runs ``flat[starts[c]:starts[c] + length[c]]`` for each c of ``code``."""
    each = length[code]
    places = np.zeros(len(code) + 1, np.int64)
    np.cumsum(each, out=places[1:])
    index = np.repeat(starts[code] - places[:-1], each) + np.arange(places[-1])
    return flat[index], places


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text",
                     ids: str = "ids") -> DataFrame:
    """Add ``ids`` (binary, little-endian unsigned 32-bit), encoded without special tokens.

    A null or empty text has no ids. Strings that look like special tokens are ordinary text.
    Repeated rows and other columns pass through; a column already named ``ids`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Codec(read_ranks(vocabulary), pattern))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = shared.value.fresh()
        for column in batches:
            values, places = codec.encode(column.fill_null("").to_pylist())
            yield pa.Array.from_buffers(
                pa.large_binary(), len(column),
                [None, pa.py_buffer(places * 4), pa.py_buffer(values.astype("<u4"))]
            ).cast(pa.binary())

    return docs.withColumn(ids, _iterating(run, "binary")(F.col(f"`{text}`")))


def decode_documents(docs: DataFrame, vocabulary: str, ids: str = "ids",
                     decoded: str = "decoded") -> DataFrame:
    """Add ``decoded`` (binary): the bytes behind ``ids``. Null ids decode to no bytes."""
    content = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        flat, starts, ends = _joined(parse_ranks(content.value))
        length = ends - starts
        for column in batches:
            packed = column.fill_null(b"").to_pylist()
            codes = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
            out, places = gather(flat, starts, length, codes)
            cuts = np.cumsum([0] + [len(p) // 4 for p in packed])
            yield pa.Array.from_buffers(
                pa.large_binary(), len(packed),
                [None, pa.py_buffer(places[cuts]), pa.py_buffer(out)]).cast(pa.binary())

    return docs.withColumn(decoded, _iterating(run, "binary")(F.col(f"`{ids}`")))


def _iterating(run: Callable, kind: str):
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)


def round_trip(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Per row: doc_id, number of ids, digest of the ids, digest of the decoded bytes."""
    coded = encode_documents(docs.select("doc_id", "text"), vocabulary, pattern)
    whole = decode_documents(coded.select("doc_id", "ids"), vocabulary)
    return whole.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

