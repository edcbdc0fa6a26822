"""Packing by concatenate and cut.

Pass one tokenises every document, writes ids and the running token count inside its partition to
a shared table. Totals per partition, one row each, get prefix sums; added to the running counts
they place every document on one global line of tokens. Pass two cuts that line at multiples of the
window. A window that spans two partitions simply has pieces (boundary records) from both.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import per_text, prepare, store, text_bytes
from .runs import RunStrings, strings

WINDOW = 2048
END_ID = 1
#: Bytes of pieces that a task remembers with their ids; beyond it the memory starts anew. A piece
#: of over ``LONG`` bytes is not remembered.
REMEMBERED = 32 << 20
LONG = 256

#: ASCII punctuation that the tokenizer keeps together; an apostrophe may begin a contraction.
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[list(_PUNCTUATION.encode())] = True


def _latin(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the bytes of letters below U+0100, and of what 32 more makes a small letter."""
    lead = data == 0xC3
    second = np.zeros(len(data), bool)
    second[1:] = lead[:-1]
    second &= (data != 0x97) & (data != 0xB7)
    letter = _LETTER[data] | second
    letter[:-1] |= second[1:]
    return letter, ((data >= 65) & (data <= 90)) | (second & (data <= 0x9E))


def _lowered(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts of characters below U+0100 in lower case, as the tokenizer does; others as they are."""
    wide = per_text(data >= 0xC4, offsets) > 0
    _, upper = _latin(data)
    if wide.any():
        upper &= np.repeat(~wide, np.diff(offsets))
    return data + upper.astype(np.uint8) * np.uint8(32)


class Runs:
    """Runs of ids, one after another: run c lies from ends[c] to ends[c + 1]."""

    def __init__(self) -> None:
        self.flat = array("I")
        self.ends = array("q", [0])

    def add(self, ids: np.ndarray, last: np.ndarray) -> int:
        """Append runs that end at ``last`` of ``ids``; the number of the first."""
        first = len(self.ends) - 1
        self.ends.extend((last + len(self.flat)).tolist())
        self.flat.frombytes(ids.astype(np.uint32).tobytes())
        return first


class WordEncoder:
    """Encodes the distinct words of a batch once each; words are runs without ASCII white space.

    The tokenizer drops white space and never merges across it, so the ids of a text are those of
    its words. A word of Latin letters with trailing ASCII punctuation is two pre-tokens, the first
    in lower case; such pieces go straight to the merges. Any other word is handed over whole. A
    text that holds the string of a special token goes to the tokenizer as it is, which gives that
    token's id for it; elsewhere words are ordinary text.
    """

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(definition)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.normalizer = normalizers.Sequence([])
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.pieces: dict[str, int] = {"": 0}  # piece: its number
        self.held = 0
        self.kept = Runs()
        self.kept.add(np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def _library(self, texts: list[str], special: bool) -> tuple[np.ndarray, np.ndarray]:
        self.tokenizer.encode_special_tokens = not special
        coded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return (np.fromiter(chain.from_iterable(coded), np.uint32),
                np.cumsum([len(c) for c in coded], dtype=np.int64))

    def _merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = [" ".join(pieces[at: at + 100]) for at in range(0, len(pieces), 100)]
        coded = self.merges.encode_batch_fast(joined, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in coded), np.uint32)
        # Each piece is one pre-token, so it ends with the one id that closes a word.
        last = np.flatnonzero(self.closing[ids]) + 1
        if len(last) != len(pieces):
            raise ValueError("the vocabulary does not mark word ends")
        return ids, last

    def _numbers(self, pieces: list[str], code, passing: Runs) -> np.ndarray:
        """The numbers of pieces, learning those not known. Long ones go to ``passing``, the pieces
        of this batch only, whose numbers count down from -1."""
        found = list(map(self.pieces.get, pieces))
        fresh = [i for i, n in enumerate(found) if n is None]
        for runs, some in ((self.kept, [i for i in fresh if len(pieces[i]) <= LONG]),
                           (passing, [i for i in fresh if len(pieces[i]) > LONG])):
            if not some:
                continue
            names = [pieces[i] for i in some]
            first = runs.add(*code(names))
            numbers = range(first, first + len(some))
            if runs is passing:
                numbers = [-1 - n for n in numbers]
            else:
                self.pieces.update(zip(names, numbers))
                self.held += sum(map(len, names)) + 64 * len(names)
            for i, n in zip(some, numbers):
                found[i] = n
        return np.array(found, np.int64)

    def _words(self, words: pa.Array, passing: Runs) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the first and the second piece of distinct words."""
        data, offsets = text_bytes(words)
        letter, upper = _latin(data)
        place = np.where(_MARK[data], -1, np.arange(len(data)))
        begins, ends = offsets[:-1], offsets[1:]
        tail = ends - 1 - np.maximum(np.maximum.accumulate(place)[ends - 1], begins - 1)
        plain = per_text(~letter, offsets) == tail  # letters, then punctuation
        size = np.diff(offsets)
        simple = np.repeat(plain, size)
        at_tail = np.arange(len(data)) >= np.repeat(ends - tail, size)
        small = data + upper.astype(np.uint8) * np.uint8(32)
        first, second = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        coded = pa.concat_arrays([
            strings(small[simple & ~at_tail], (size - tail)[plain]),
            strings(data[simple & at_tail], tail[plain])]).dictionary_encode()
        pieces = coded.dictionary.cast(pa.large_string()).to_numpy(zero_copy_only=False).tolist()
        number = self._numbers(pieces, self._merged, passing)[coded.indices.to_numpy()]
        first[plain], second[plain] = number[: plain.sum()], number[plain.sum():]
        if not plain.all():
            rest = words.filter(pa.array(~plain)).cast(pa.large_string()).to_numpy(zero_copy_only=False).tolist()
            first[~plain] = self._numbers(
                rest, lambda texts: self._library(texts, special=False), passing)
        return first, second

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text closed by ``end_id``, and the n + 1 places where texts begin."""
        from .byte_bpe import gather

        if self.held > REMEMBERED:
            self._forget()
        texts = pc.fill_null(texts, "")
        marked = np.zeros(len(texts), bool)
        for token in self.special:
            marked |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        passing = Runs()
        passing.add(np.array([end_id], np.uint32), np.ones(1, np.int64))
        extra = np.flatnonzero(marked)
        if len(extra):
            direct = texts.filter(pa.array(marked)).to_pylist()
            passing.add(*self._library(direct, special=True))
            texts = pc.if_else(pa.array(marked), "", texts)
        data, offsets = text_bytes(texts)
        runs = RunStrings(_lowered(data, offsets), ~_SPACE[data], offsets)
        coded = runs.strings.dictionary_encode()
        both = np.zeros(0, np.int64)
        if len(coded):
            both = np.stack(self._words(coded.dictionary, passing), 1)[coded.indices.to_numpy()].ravel()
        # a text ends with the end id; one with special tokens is a piece of its own before it
        before = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(marked, out=before[1:])
        closing = np.full(len(texts) + len(extra), -1)
        closing[extra + before[extra]] = -2 - np.arange(len(extra))
        both = np.insert(both, np.repeat(2 * runs.first[1:], 1 + marked), closing)
        known = len(self.kept.ends) - 1
        both = np.where(both < 0, known - 1 - both, both)
        starts = np.concatenate([self.kept.ends[:-1], len(self.kept.flat) + np.array(passing.ends[:-1])])
        length = np.concatenate([np.diff(self.kept.ends), np.diff(passing.ends)])
        flat = np.concatenate([np.array(x, np.uint32) for x in (self.kept.flat, passing.flat)])
        ids, places = gather(flat, starts, length, both)
        return ids, places[2 * runs.first + np.arange(len(texts) + 1) + before]


def tokenise(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text",
             end_id: int = END_ID) -> DataFrame:
    """Columns key, ids (binary, unsigned 32-bit), tokens, part and the tokens before it in part."""
    with open(vocabulary, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = WordEncoder(shared.value), TaskContext.get().partitionId(), 0
        for rows in batches:
            ids, places = encoder.encode(rows.column(1), end_id)
            packed = pa.Array.from_buffers(
                pa.large_binary(), rows.num_rows,
                [None, pa.py_buffer(places * 4), pa.py_buffer(ids.astype("<u4"))])
            size = np.diff(places)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), packed.cast(pa.binary()), pa.array(size),
                 pa.array(np.full(rows.num_rows, part, np.int64)),
                 pa.array(before + places[:-1])],
                names=["key", "ids", "tokens", "part", "before"])
            before += int(places[-1])

    chosen = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = chosen.schema["key"].dataType.simpleString()
    return chosen.mapInArrow(
        run, f"key {kind}, ids binary, tokens long, part long, before long")


def pack(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text",
         window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents on one line of tokens, cut every ``window`` tokens.

    Returns key, start, length, ids (binary, little-endian unsigned 32-bit), ids_crc32,
    doc_tokens, sequence_id and offset. Only the last sequence can be shorter than ``window``.
    A null or empty text gives one token, the end id. Repeated rows are packed as often as they
    occur, a null key stays null, other columns are ignored; an empty table gives no pieces.
    """
    prepare(docs.sparkSession)
    coded = store(tokenise(docs, vocabulary, key, text, end_id))
    totals = coded.groupBy("part").agg(F.sum("tokens").alias("total"))
    line = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the input, 16 bytes each: this bounds the window and the broadcast.
    offsets = totals.select("part", F.coalesce(F.sum("total").over(line), F.lit(0)).alias("base"))
    placed = coded.join(F.broadcast(offsets), "part").select(
        "key", "ids", (F.col("base") + F.col("before")).alias("begin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            source, columns = [], [[] for _ in range(7)]
            packed, begins = rows.column(1), rows.column(2).to_pylist()
            for i, begin in enumerate(begins):
                ids = packed[i].as_buffer()
                data, tokens = memoryview(ids), ids.size // 4
                start = 0
                while start < tokens:
                    sequence, offset = divmod(begin + start, window)
                    length = min(window - offset, tokens - start)
                    piece = data[4 * start: 4 * (start + length)]
                    source.append(i)
                    for column, value in zip(columns, (
                            start, length, bytes(piece), zlib.crc32(piece), tokens, sequence,
                            offset)):
                        column.append(value)
                    start += length
            kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(source, pa.int64())),
                 *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=["key", "start", "length", "ids", "ids_crc32", "doc_tokens",
                       "sequence_id", "offset"])

    kind = placed.schema["key"].dataType.simpleString()
    return placed.mapInArrow(
        run, f"key {kind}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, "
             "sequence_id long, offset long").withColumnRenamed("key", key)


def sequences(pieces: DataFrame, pad_id: int = 0) -> DataFrame:
    """One row per sequence: its ids in order, padded to the next power of two, and its tokens.

    A group holds at most one window of tokens, whatever the input.
    """
    whole = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("tokens"),
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.aggregate(F.transform("parts", lambda p: p["ids"]),
                         F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))
    room = F.pow(F.lit(2), F.ceil(F.log2("tokens"))).cast("long")
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()),
                           (room - F.col("tokens")).cast("int")))
    return whole.select("sequence_id", "tokens", F.concat(joined, pad).alias("ids"))
