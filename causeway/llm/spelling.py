"""Spelling variants by dense prefix-suffix tiling.

Two words are near if one code point inserted, deleted or replaced turns one into the other. The
shorter word, of m code points, is cut into two segments; the edit lies in one of them, so near
words share what lies outside it: a prefix or a suffix of half the word. Words are filed under m
and that part. A group of too many words is cut again, its segment in halves, until a segment is
one code point, where the alphabet bounds the group. Blocks of whole groups become padded
code-point matrices, and every group is compared with itself shifted row by row: the words are
near if common prefix plus common suffix reach the longer length less one. The length of the common
prefix tells which segment a pair belongs to, so no pair is found twice and pairs are never
written out: a block returns each word's number of near words and the best of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, store, text_bytes
from .runs import RunStrings

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LEAD = 0xC3  # the first of the two bytes of U+00C0 to U+00FF

#: Cells of a code-point matrix, or of a comparison of its rows, held at a time.
_CELLS = 1_000_000


@dataclass(frozen=True)
class Rule:
    """Words of ``min_chars`` code points and ``min_count`` occurrences take part; a near word of
    ``ratio`` times the occurrences becomes a word's form. Groups of more than ``group_words`` words
    or ``group_bytes`` bytes are cut further."""

    min_chars: int = 7
    min_count: int = 2
    ratio: int = 10
    group_words: int = 256
    group_bytes: int = 4 << 20


def _crc_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(0xEDB88320), value >> 1)
    return value


def continued_crc(before: np.ndarray, words: pa.Array, which: np.ndarray) -> np.ndarray:
    """crc32 of texts whose beginnings have the crc32 ``before`` and which end in ``words[which]``.

    Words of up to 64 bytes are taken byte by byte over all rows at once, longer ones singly.
    """
    data, offsets = text_bytes(words)
    size = np.diff(offsets)[which]
    order = np.argsort(-size, kind="stable")
    state = before[order].astype(np.uint32)
    size, begin = size[order], offsets[:-1][which[order]]
    long = int(np.searchsorted(-size, -64))
    for i in range(long):
        state[i] = zlib.crc32(data[begin[i]: begin[i] + size[i]].tobytes(), int(state[i]))
    table, state = _crc_table(), state ^ np.uint32(0xFFFFFFFF)
    for j in range(int(size[long]) if long < len(size) else 0):
        live = slice(long, int(np.searchsorted(-size, -j)))
        byte = data[begin[live] + j]
        state[live] = table[(state[live] ^ byte) & np.uint32(255)] ^ (state[live] >> np.uint32(8))
    state[long:] ^= np.uint32(0xFFFFFFFF)
    state[:long] ^= np.uint32(0xFFFFFFFF)
    out = np.zeros(len(which), np.uint32)
    out[order] = state
    return out


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = Rule(),
                noise: int | None = None) -> DataFrame:
    """(word, n): maximal runs of [A-Za-z U+00C0-U+00FF], A-Z lower-cased, with their occurrences.

    With ``noise`` a run loses a code point in those documents where that number divides
    h = crc32 of "<key>:<run>", namely the one at h modulo the run's length. A null text has no
    runs and a null key counts as empty; repeated rows count each. Occurrences are summed per Arrow
    batch first, then by Spark before and after its shuffle.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("key"),
                       F.col(f"`{text}`").alias("text")).filter(F.col("text").isNotNull())
    least = rule.min_chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            data, offsets = text_bytes(part.column(1))
            lead = data == _LEAD
            inside = _LETTER[data] | lead
            inside[1:] |= lead[:-1]
            runs = RunStrings(_LOWER[data], inside, offsets)
            leads = np.zeros(len(runs.buffer) + 1, np.int64)
            np.cumsum(runs.buffer == _LEAD, out=leads[1:])
            chars = np.diff(runs.places) - np.diff(leads[runs.places])
            long = chars >= least
            coded = runs.strings.filter(pa.array(long)).dictionary_encode()
            names = coded.dictionary
            if not len(names):
                continue
            code = coded.indices.to_numpy().astype(np.int64)
            length = np.zeros(len(names), np.int64)
            length[code] = chars[long]
            extra: dict[bytes, int] = {}
            if noise is None:
                n = np.bincount(code, minlength=len(names))
            else:
                pair, times = np.unique(runs.text[long] * len(names) + code, return_counts=True)
                doc, name = np.divmod(pair, len(names))
                heads = np.array([zlib.crc32(f"{k}:".encode()) for k in part.column(0).to_pylist()],
                                 np.uint32)
                crc = continued_crc(heads[doc], names, name)
                hit = crc % noise == 0
                n = np.bincount(name[~hit], weights=times[~hit], minlength=len(names)).astype(np.int64)
                for w, h, t in zip(name[hit].tolist(), crc[hit].tolist(), times[hit].tolist()):
                    if length[w] > least:
                        whole = names[w].as_py().decode()
                        cut = h % len(whole)
                        word = (whole[:cut] + whole[cut + 1:]).encode()
                        extra[word] = extra.get(word, 0) + t
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([names.take(pa.array(seen)),
                                  pa.array(list(extra), pa.large_binary())]).cast(pa.binary()).cast(pa.string()),
                pa.array(np.concatenate([n[seen], np.array(list(extra.values()), np.int64)]))],
                names=["word", "n"])

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


_GROUP = ("m", "s", "e", "g")


def _filed(words: DataFrame, segments: list[tuple[Column, Column, Column]]) -> DataFrame:
    """Each word once per segment (m, s, e), filed under a hash of what lies outside [s, e)."""
    keys = [F.struct(m.cast("int").alias("m"), s.cast("int").alias("s"), e.cast("int").alias("e"))
            for m, s, e in segments]
    rows = words.select("word", "n", F.explode(F.array(*keys)).alias("k")).select("word", "n", "k.*")
    before = F.expr("substring(word, 1, s)")
    after = F.expr("right(word, m - e)")
    return rows.withColumn("g", F.xxhash64(before, F.lit("|"), after))


class Near:
    """Near words within the groups of a block; rows of a group are neighbours."""

    def __init__(self, words: list[str], n: np.ndarray, group: np.ndarray, m: np.ndarray,
                 s: np.ndarray, e: np.ndarray) -> None:
        self.n = n
        width = max(map(len, words))
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.left = np.array(words, f"U{width}").view(np.uint32).reshape(len(words), width)
        back = np.array([w[::-1] for w in words], f"U{width}")
        self.right = back.view(np.uint32).reshape(len(words), width)
        self.words = np.array(words, f"U{width}")
        self.group, self.m, self.s, self.e = group, m, s, e

    def _check(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        prefix = np.argmin(self.left[a] == self.left[b], axis=1)  # words differ somewhere
        suffix = np.argmin(self.right[a] == self.right[b], axis=1)
        near = prefix + suffix >= np.maximum(self.size[a], self.size[b]) - 1
        mine = (prefix >= self.s[a]) & ((prefix < self.e[a]) | (self.e[a] == self.m[a]))
        return near & mine & (np.minimum(self.size[a], self.size[b]) == self.m[a])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        first, second = [], []
        step = max(1, _CELLS // self.left.shape[1])
        shift = 1
        at = np.arange(len(self.group))
        while True:
            at = at[: np.searchsorted(at, len(self.group) - shift)]
            at = at[self.group[at] == self.group[at + shift]]  # rows whose group is that long
            if not len(at):
                break
            for low in range(0, len(at), step):
                a = at[low: low + step]
                a = a[self._check(a, a + shift)]
                first += [a, a + shift]
                second += [a + shift, a]
            shift += 1
        if not first:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(first), np.concatenate(second)

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, number of near words, row of the best): most occurrences, then smallest word."""
        a, b = self.pairs()
        rank = np.zeros(len(self.words), np.int64)
        rank[np.argsort(self.words, kind="stable")] = np.arange(len(self.words))
        order = np.lexsort([rank[b], -self.n[b], a])
        row, first, count = np.unique(a[order], return_index=True, return_counts=True)
        return row, count, b[order][first]


def _changes(table: pa.Table) -> np.ndarray:
    """Flags of the rows at which a group begins."""
    change = np.ones(len(table), bool)
    change[1:] = False
    for name in _GROUP:
        value = table.column(name).to_numpy()
        change[1:] |= value[1:] != value[:-1]
    return change


def _cut(table: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
    """The groups beginning at ``starts`` in blocks that fit a matrix; a larger group is a block."""
    wide = table.column("m").to_numpy()[starts] + 1
    ends = np.append(starts[1:], len(table))
    at = 0
    while at < len(starts):
        cells = (ends[at:] - starts[at]) * wide[at:]  # m grows, so cells do
        many = max(1, int(np.searchsorted(cells, _CELLS, "right")))
        yield table.slice(starts[at], ends[at + many - 1] - starts[at])
        at += many


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Blocks of whole groups from rows sorted by group."""
    rest = None
    for part in batches:
        table = pa.Table.from_batches([part])
        table = table if rest is None else pa.concat_tables([rest, table])
        starts = np.flatnonzero(_changes(table))
        if len(starts):
            yield from _cut(table.slice(0, starts[-1]), starts[:-1])
            rest = table.slice(starts[-1])
    if rest is not None:
        yield from _cut(rest, np.zeros(1, np.int64))


def _near_words(filed: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) per word and block, from rows of finished groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            column = {c: table.column(c).to_numpy() for c in (*_GROUP, "n")}
            words = table.column("word").to_pylist()
            found = Near(words, column["n"], np.cumsum(_changes(table)), column["m"], column["s"],
                         column["e"])
            row, count, best = found.best()
            yield pa.RecordBatch.from_arrays([
                pa.array([words[i] for i in row.tolist()], pa.string()), pa.array(count, pa.int64()),
                pa.array(column["n"][best], pa.int64()),
                pa.array([words[i] for i in best.tolist()], pa.string())],
                names=["word", "n_near", "best_n", "best"])

    dealt = filed.repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    return dealt.mapInArrow(run, "word string, n_near long, best_n long, best string")


def near_words(words: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(word, n_near, best_n, best) for every word of ``words`` (word, n; distinct) with a near word.

    ``best`` is the near word of most occurrences, the smallest of several in code-point order.
    """
    size = F.char_length("word")
    half = F.floor(size / 2), F.floor((size - 1) / 2)
    none = F.lit(0)
    filed = _filed(words, [(size, none, half[0]), (size, half[0], size),
                           (size - 1, none, half[1]), (size - 1, half[1], size - 1)])
    filed = store(filed.filter(F.col("m") >= rule.min_chars))
    found = None
    while True:
        sizes = filed.groupBy(*_GROUP).agg(
            F.count("*").alias("c"), F.sum(F.octet_length("word")).alias("b"),
            F.max(F.char_length("word") == F.col("m")).alias("short"))
        crowded = ((F.col("c") > rule.group_words) | (F.col("b") > rule.group_bytes)) & (
            F.col("e") - F.col("s") > 1)
        live = store(sizes.filter((F.col("c") > 1) & F.col("short")).select(
            *_GROUP, crowded.alias("crowded")))
        rows = filed.join(live, list(_GROUP))
        near = store(_near_words(rows.filter(~F.col("crowded")).select("word", "n", *_GROUP)))
        found = near if found is None else found.unionByName(near)
        if live.filter("crowded").isEmpty():
            break
        m, s, e = (F.col(c) for c in ("m", "s", "e"))
        middle = F.floor((s + e) / 2)
        filed = store(_filed(rows.filter("crowded"), [(m, s, middle), (m, middle, e)]))
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of each chain of forms, by doubling its jumps.

    Occurrences grow along a chain by the rule's ratio, so it has no cycle and is short.
    """
    ends = store(forms.select("word", F.col("form").alias("root")))
    while True:
        up = ends.select(F.col("word").alias("root"), F.col("root").alias("above"))
        moved = store(ends.join(up, "root", "left").select(
            "word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        ends = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return ends


def group_variants(words: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n, from ``words`` (word, n; one row per word).

    A null word, one that is too short or of too few occurrences is left out. The form is the
    near word of most occurrences (ties: smallest in code-point order) if it has ``ratio`` times the word's own, else null; the root is
    what forms lead to in the end, the word itself without one. Every word is compared with all
    that could be near it; nothing is sampled or cut.
    """
    prepare(words.sparkSession)
    known = store(words.filter((F.col("n") >= rule.min_count) & (
        F.char_length("word") >= rule.min_chars)).select("word", "n"))
    near = known.join(near_words(known, rule), "word", "left")
    close = F.col("best_n") >= rule.ratio * F.col("n")
    judged = store(near.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(close, F.col("best")).alias("form"), F.when(close, F.col("best_n")).alias("form_n")))
    roots = _roots(judged.filter(F.col("form").isNotNull()))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
