"""Line dedup by a log-template tree of fixed depth.

A line's path in the tree is its token count and then its leading tokens, where a token with a
digit counts as a variable field. A leaf is a template: the leading tokens stay fixed, the fields
and the tokens behind the tree's depth vary. A line of more than twice the depth is its own leaf by
all its tokens, so at least half of a template's tokens are always fixed. Templates that recur in
``min_docs`` documents are dropped everywhere but in the first of them. Every line is a leaf of its
own bytes as well, however short or variable, and exactly equal lines are dropped from
``exact_docs`` documents on.

Leaves are counted by a map-side combined aggregate over 64-bit path hashes; a template shared by a
third of all lines is one row per task there, and the join that brings the decision back is an
equi-join whose large side Spark can split.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, Words, mix, prepare, span_hashes, store, unsigned, with_row


@dataclass(frozen=True)
class Tree:
    """``min_tokens`` and ``min_docs`` hold for templates, of whose tokens half must be fixed;
    ``exact_docs`` for exactly equal lines of any words; None leaves those to the templates."""

    depth: int = 8
    min_tokens: int = 5
    min_docs: int = 5
    exact_docs: int | None = 2


_WILD = np.uint64(0x5851F42D4C957F2D)
_EXACT = np.uint64(1)  # the lowest bit of a leaf tells equal lines from templates


class Lines:
    """Lines of a batch of texts: leaf hash, whether it can be a template, text and place there;
    with ``exact_docs`` also the hash of the line itself and whether it has words."""

    def __init__(self, texts: pa.Array, tree: Tree) -> None:
        words = Words(texts)
        data, offsets = words.data, words.offsets
        breaks = np.flatnonzero(data == 10)
        per_text = np.searchsorted(breaks, offsets)
        self.counts = np.diff(per_text) + 1  # as many lines as split("\n") gives
        edges = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.counts)])
        self.text = np.repeat(np.arange(len(self.counts)), self.counts)
        begin = np.empty(edges[-1], np.int64)
        begin[edges[:-1]] = offsets[:-1]
        inner = np.ones(edges[-1], bool)
        inner[edges[:-1]] = False
        begin[inner] = breaks + 1
        first = np.searchsorted(words.starts, begin)
        last = np.append(first[1:], len(words.starts))
        tokens = last - first
        line = np.repeat(np.arange(len(begin)), tokens)
        digit = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data >= 48) & (data <= 57), out=digit[1:])
        field = digit[words.ends] > digit[words.starts]
        place = np.arange(len(line)) - first[line]
        on_path = (place < tree.depth) | (tokens[line] > 2 * tree.depth)
        value = np.where(field, _WILD, words.hashes)
        value = mix(value + mix(place.astype(np.uint64))) * on_path
        total = np.zeros(len(line) + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        constant = np.zeros(len(line) + 1, np.int64)
        np.cumsum(on_path & ~field, out=constant[1:])
        self.leaf = mix((total[last] - total[first]) ^ mix(tokens.astype(np.uint64)))
        fixed = constant[last] - constant[first]
        self.usable = (tokens >= tree.min_tokens) & (2 * fixed >= tokens)
        self.kinds = [(self.leaf & ~_EXACT, self.usable)]
        if tree.exact_docs is not None:
            end = np.empty(edges[-1], np.int64)
            end[edges[1:] - 1] = offsets[1:]
            inner = np.ones(edges[-1], bool)
            inner[edges[1:] - 1] = False
            end[inner] = breaks
            worded = tokens > 0
            whole = np.zeros(len(begin), np.uint64)
            whole[worded] = span_hashes(data, begin[worded], end[worded])
            self.kinds.append((whole | _EXACT, worded))


def leaves(rows: DataFrame, tree: Tree) -> DataFrame:
    """(leaf, r1, r2, key), one row per text and template in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            lines = Lines(part.column(3), tree)
            text = np.concatenate([lines.text[some] for _, some in lines.kinds])
            leaf = np.concatenate([value[some] for value, some in lines.kinds])
            order = np.lexsort((leaf, text))
            text, leaf = text[order], leaf[order]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (leaf[1:] != leaf[:-1])
            where = pa.array(text[new])
            yield pa.RecordBatch.from_arrays(
                [unsigned(leaf[new]), *[part.column(i).take(where) for i in range(3)]],
                names=["leaf", "r1", "r2", "key"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"leaf long, r1 long, r2 long, key {kind}")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text",
                tree: Tree = Tree()) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``, plus n_lines and n_dropped.

    Lines are what a split at line feeds gives. The first document of a template, which keeps it,
    is the one of smallest key (nulls first), then row hash; rows equal in key and text count as
    several documents and are treated alike. The same holds for equal lines; a line goes if either
    rule drops it, and a line without words always stays. Lines inside one document are not compared with each
    other. A null text stays null with no lines, an empty one has one empty line; neither loses
    any. Other columns pass through, but for n_lines and n_dropped, which are replaced.
    """
    prepare(docs.sparkSession)
    found = store(leaves(with_row(docs, key, text), tree))
    least = F.when(F.col("leaf").bitwiseAND(1) == 1, tree.exact_docs).otherwise(tree.min_docs)
    # Stored, so that both sides of the join are exchanged and Spark can split a hot template.
    recurring = store(found.groupBy("leaf").agg(
        F.count("*").alias("docs"), F.min(F.struct("key", "r1", "r2")).alias("first")).filter(
        F.col("docs") >= least).select("leaf", "first.r1", "first.r2").toDF(
        "leaf", "f1", "f2"))
    dropped = found.join(recurring, "leaf").filter(
        (F.col("r1") != F.col("f1")) | (F.col("r2") != F.col("f2")))
    per_doc = dropped.groupBy(*ROW).agg(F.collect_set("leaf").alias("_leaves"))

    def run(texts: pa.Array, lists: pa.Array) -> pa.Array:
        lines = Lines(texts, tree)
        sizes = np.array([0 if x is None else len(x) for x in lists.to_pylist()], np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        chosen = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        wanted = np.unique(mix(chosen + mix(owner.astype(np.uint64))))
        own = mix(lines.text.astype(np.uint64))
        gone = np.zeros(len(own), bool)
        for value, some in lines.kinds:
            gone |= np.isin(mix(value + own), wanted) & some
        lost = np.bincount(lines.text[gone], minlength=len(texts))
        edges = np.concatenate([[0], np.cumsum(lines.counts)])
        out = texts.to_pylist()
        for i in np.flatnonzero(lost).tolist():
            keep = ~gone[edges[i]: edges[i + 1]]
            out[i] = "\n".join([s for s, k in zip(out[i].split("\n"), keep) if k])
        valid = texts.is_valid().to_numpy(zero_copy_only=False)
        return pa.StructArray.from_arrays(
            [pa.array(out, pa.string()), pa.array(lines.counts * valid), pa.array(lost)],
            names=["text", "n_lines", "n_dropped"])

    strip = F.arrow_udf(run, "text string, n_lines long, n_dropped long")
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(f"`{text}`").alias("_text"),
        F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("r1"),
        F.xxhash64(F.lit("row"), F.col(f"`{text}`"), F.lit(7), F.col(f"`{key}`")).alias("r2"))
    joined = base.join(per_doc, list(ROW), "left").select(
        "_row", strip("_text", "_leaves").alias("_new"))
    return joined.select(
        *[F.col("_new.text").alias(c) if c == text else F.col("_row")[c].alias(c) for c in kept],
        "_new.n_lines", "_new.n_dropped")
