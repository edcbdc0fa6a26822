"""Substring dedup by prefix-partitioned suffix trees over words.

A suffix is a window start; only its first ``window`` words matter, so trees end at that depth.

1. Each window is filed under the smallest hash of the word 8-grams inside it (its anchor). Equal
   windows have equal anchors, so an anchor that occurs once in the corpus cannot hold a repeat. One
   row per run of windows with a common anchor (a segment, about 14 windows) is enough to count.
2. Segments of repeated anchors are fetched from their texts and shuffled by anchor: a group of
   suffixes that share an 8-word infix. Groups with more than ``group_limit`` different segments are
   split by the longest prefix, the whole window, one row per suffix.
3. In each task the groups at hand grow one truncated suffix tree level by level (depth 1, 2, 4, ...
   window) over exact word numbers: suffixes are in one node of the next level if their two halves
   are. Nodes of full depth with two suffixes or more are the repeats.
4. Marks of repeated windows return to their documents, which drop every covered word.

Hashes only choose what is compared; equality is decided on words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, _INVERSE, ROW, Words, covered, mix, prepare, store, unsigned, with_row


@dataclass(frozen=True)
class Plan:
    """``window`` words make a repeat; ``gram`` words make an anchor; ``group_limit`` different
    segments are the most that one group brings into a task (about 400 bytes each)."""

    window: int = 35
    gram: int = 8
    group_limit: int = 50_000


class Segments:
    """Runs of consecutive windows with one anchor, for a batch of texts."""

    def __init__(self, words: Words, plan: Plan) -> None:
        span = plan.window - plan.gram + 1
        total = len(words.hashes)
        starts, _ = words.windows(plan.window)
        self.words = words
        if not len(starts):
            self.first = self.count = np.zeros(0, np.int64)
            self.anchor = self.content = np.zeros(0, np.uint64)
            return
        grams = np.full(total, np.iinfo(np.uint64).max, np.uint64)
        where, value = words.windows(plan.gram)
        grams[where] = value
        best = np.arange(total)  # place of the smallest gram among the next ``reach``, first if tied
        reach = 1
        while 2 * reach <= span:
            best = self._smaller(grams, best, reach)
            reach *= 2
        if reach < span:
            best = self._smaller(grams, best, span - reach)
        chosen = best[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)
        edge = np.flatnonzero(new)
        self.first = starts[edge]
        self.count = np.diff(np.append(edge, len(starts)))
        self.anchor = grams[chosen[edge]]
        power, back = np.full(total, _BASE, np.uint64), np.full(total, _INVERSE, np.uint64)
        power[0] = back[0] = 1
        running = np.zeros(total + 1, np.uint64)
        np.cumsum(words.hashes * np.multiply.accumulate(power), out=running[1:])
        end = self.first + self.count + plan.window - 1
        self.content = mix((running[end] - running[self.first])
                           * np.multiply.accumulate(back)[self.first]
                           + self.count.astype(np.uint64))

    @staticmethod
    def _smaller(grams: np.ndarray, best: np.ndarray, step: int) -> np.ndarray:
        out = best.copy()
        out[:-step] = np.where(grams[best[:-step]] <= grams[best[step:]], best[:-step], best[step:])
        return out


def segments(rows: DataFrame, plan: Plan) -> DataFrame:
    """(anchor, content, r1, r2, first, count) of every segment; first counts words of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            words = Words(part.column(3))
            found = Segments(words, plan)
            text = words.doc[found.first]
            where = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [unsigned(found.anchor), unsigned(found.content), part.column(0).take(where),
                 part.column(1).take(where), pa.array(found.first - words.first[text]),
                 pa.array(found.count)],
                names=["anchor", "content", "r1", "r2", "first", "count"])

    return rows.mapInArrow(
        run, "anchor long, content long, r1 long, r2 long, first long, count long")


def _pieces(chosen: DataFrame, plan: Plan, single: bool) -> DataFrame:
    """Words of chosen segments: (group, content, text, places), equal ones of a batch together.

    ``chosen`` has text and a list ``wanted`` of (first, count) per document. With ``single`` every
    window is a piece of its own, grouped by all its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            column = {n: part.column(i) for i, n in enumerate(part.schema.names)}
            words = Words(column["text"])
            lists = column["wanted"]
            sizes = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(len(sizes)), sizes)
            items = lists.flatten()
            first = items.field("first").to_numpy() + words.first[owner]
            count = items.field("count").to_numpy()
            group = items.field("anchor").to_numpy().view(np.uint64)
            if single:
                owner = np.repeat(owner, count)
                inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                first = np.repeat(first, count) + inner
                count = np.ones(len(first), np.int64)
                where, value = words.windows(plan.window)
                group = value[np.searchsorted(where, first)]
                content = mix(group + words.hashes[first] + np.uint64(1))
            else:
                content = items.field("content").to_numpy().view(np.uint64)
            order = np.lexsort((content, group))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(group[order].view(np.int64)) != 0) | (
                np.diff(content[order].view(np.int64)) != 0)
            edges = np.append(np.flatnonzero(new), len(order))
            one = order[edges[:-1]]
            begin, end = words.starts[first[one]], words.ends[first[one] + count[one] + plan.window - 2]
            size = end - begin
            cuts = np.zeros(len(one) + 1, np.int64)
            np.cumsum(size, out=cuts[1:])
            copied = words.data[np.repeat(begin - cuts[:-1], size) + np.arange(cuts[-1])]
            text = pa.Array.from_buffers(
                pa.large_binary(), len(one), [None, pa.py_buffer(cuts), pa.py_buffer(copied)])
            where = pa.array(owner[order])
            places = pa.ListArray.from_arrays(
                pa.array(edges.astype(np.int32)), pa.StructArray.from_arrays(
                    [column["r1"].take(where), column["r2"].take(where),
                     pa.array(first[order] - words.first[owner[order]])],
                    names=["r1", "r2", "first"]))
            yield pa.RecordBatch.from_arrays(
                [unsigned(group[one]), unsigned(content[one]), text.cast(pa.binary()), places],
                names=["grp", "content", "text", "places"])

    return chosen.mapInArrow(
        run, "grp long, content long, text binary, "
             "places array<struct<r1: long, r2: long, first: long>>")


def word_numbers(words: Words) -> np.ndarray:
    """A number per word, equal exactly for equal bytes."""
    number, values = pd.factorize(words.hashes)
    length = words.ends - words.starts
    example = np.zeros(len(values), np.int64)
    example[number[::-1]] = np.arange(len(number))[::-1]
    same = length == length[example[number]]
    if same.all():
        cuts = np.cumsum(length) - length
        inner = np.arange(length.sum()) - np.repeat(cuts, length)
        mine = words.data[np.repeat(words.starts, length) + inner]
        theirs = words.data[np.repeat(words.starts[example[number]], length) + inner]
        if (mine == theirs).all():
            return number
    whole = words.data.tobytes()
    return pd.factorize(np.array(
        [whole[s:e] for s, e in zip(words.starts.tolist(), words.ends.tolist())], object))[0]


def repeated_windows(texts: pa.Array, weights: np.ndarray, window: int) -> np.ndarray:
    """Per text a bit mask of its windows whose words start a window anywhere else too.

    The tree's level of depth d numbers its nodes; the node of a suffix at depth d + e follows from
    its nodes at d here and at d, e words further on. ``weights`` tells how often each text occurs.
    """
    words = Words(texts)
    node = word_numbers(words)
    start = np.arange(len(node))
    room = words.first[1:][words.doc] - start  # words left in the text
    depth = 1
    while depth < window:
        step = min(depth, window - depth)
        inside = np.flatnonzero(room >= depth + step)
        pair = node[inside] * (int(node.max(initial=0)) + 1) + node[inside + step]
        node = node.copy()
        node[inside] = pd.factorize(pair)[0]
        depth += step
    inside = np.flatnonzero(room >= window)
    heavy = np.bincount(node[inside], weights=weights[words.doc[inside]]) > 1
    again = inside[heavy[node[inside]]]
    mask = np.zeros(len(texts), np.int64)
    bit = np.left_shift(np.int64(1), again - words.first[words.doc[again]])
    np.bitwise_or.at(mask, words.doc[again], bit)
    return mask


def _grow(pieces: DataFrame, plan: Plan) -> DataFrame:
    """(r1, r2, first, mask) for the places of segments that hold repeated windows."""

    def solved(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        places = rows["places"].combine_chunks()
        sizes = np.diff(places.offsets.to_numpy())
        mask = repeated_windows(rows["text"].combine_chunks(), sizes, plan.window)
        each = np.repeat(mask, sizes)
        items = places.flatten().filter(pa.array(each != 0))
        return pa.RecordBatch.from_arrays(
            [items.field("r1"), items.field("r2"), items.field("first"), pa.array(each[each != 0])],
            names=["r1", "r2", "first", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for part in batches:
            if not part.num_rows:
                continue
            group = part.column(0).to_numpy()
            turn = np.flatnonzero(group[1:] != group[:-1])
            cut = int(turn[-1]) + 1 if len(turn) else 0
            if not cut and held and group[0] == held[-1].column(0)[-1].as_py():
                held.append(part)  # still inside one group, whose size the plan bounds
                continue
            done = held + [part.slice(0, cut)] if cut else held
            if done:
                yield solved(pa.Table.from_batches(done))
            held = [part.slice(cut)]
        if held:
            yield solved(pa.Table.from_batches(held))

    return pieces.repartition("grp").sortWithinPartitions("grp").mapInArrow(
        run, "r1 long, r2 long, first long, mask long")


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    plan: Plan = Plan()) -> DataFrame:
    """key, n_words, n_removed and kept (the words left, joined by one space) per row.

    Words are runs without ASCII white space, of whole texts. Repeats inside a text count. Rows
    equal in key and text are several documents, whose windows repeat each other. A null or empty
    text has no words; a text shorter than a window keeps all. Other columns are ignored; an empty
    table gives no rows.
    """
    if not plan.gram <= plan.window < plan.gram + 62:
        raise ValueError("a segment's windows must fit a 62-bit mask")
    prepare(docs.sparkSession)
    rows = with_row(docs, key, text)
    found = store(segments(rows, plan))
    # Stored, so that both sides of the join are exchanged and Spark can split a hot anchor.
    anchors = store(found.groupBy("anchor", "content").agg(F.count("*").alias("n")).groupBy("anchor").agg(
        F.sum("n").alias("n"), F.count("*").alias("kinds")).filter("n > 1").select(
        "anchor", (F.col("kinds") > plan.group_limit).alias("large")))
    chosen = store(found.join(anchors, "anchor"))

    def fetched(large: bool) -> DataFrame:
        some = chosen.filter(F.col("large") == large)
        wanted = some.groupBy(*ROW).agg(F.collect_set(
            F.struct("anchor", "content", "first", "count")).alias("wanted"))
        # With all columns of the last join, so that Spark exchanges the texts once for both.
        return rows.join(wanted, list(ROW)).select(*ROW, "key", "text", "wanted")

    marks = _grow(_pieces(fetched(False), plan, single=False), plan)
    if not chosen.filter("large").isEmpty():
        alone = store(_pieces(fetched(True), plan, single=True))
        twice = alone.groupBy("grp", "content", "text").agg(
            F.sum(F.size("places")).alias("n")).filter("n > 1").select("grp", "content")
        marks = marks.unionByName(alone.join(twice, ["grp", "content"]).select(
            F.explode("places").alias("p")).select("p.*", F.lit(1).cast("long").alias("mask")))
    lists = marks.groupBy(*ROW).agg(F.collect_set(F.struct("first", "mask")).alias("marks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            words = Words(part.column(1))
            lists = part.column(2)
            sizes = np.diff(lists.offsets.to_numpy()) * lists.is_valid().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            items = lists.flatten()
            first = items.field("first").to_numpy() + words.first[owner]
            mask = items.field("mask").to_numpy()
            starts = np.concatenate([first[(mask >> b) & 1 == 1] + b for b in range(62)])
            gone = covered(starts, plan.window, len(words.doc))
            removed = np.bincount(words.doc[gone], minlength=part.num_rows)
            edges, whole, kept = words.offsets.tolist(), words.data.tobytes(), []
            for i, lost in enumerate(removed.tolist()):
                left = whole[edges[i]: edges[i + 1]].split()
                if lost:
                    stay = ~gone[words.first[i]: words.first[i + 1]]
                    left = [w for w, s in zip(left, stay.tolist()) if s]
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(words.counts), pa.array(removed),
                 pa.array(kept, pa.binary()).cast(pa.string())],
                names=["key", "n_words", "n_removed", "kept"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.join(lists, list(ROW), "left").select("key", "text", "marks").mapInArrow(
        run, f"key {kind}, n_words long, n_removed long, kept string").withColumnRenamed("key", key)
