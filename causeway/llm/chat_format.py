"""Chat formatting by columnar byte assembly.

Turns are gathered per conversation and ordered; then whole blocks are laid out at once. Segment
lengths (begin mark, role, separator, text, end mark) give cumulative offsets, the offsets give
scatter indices, and headers and contents are copied into one preallocated buffer that becomes the
Arrow column. Loss spans come from the same offsets.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_bytes

#: Source bytes assembled at a time; one longer conversation makes its own block.
BLOCK_BYTES = 2 << 20


@dataclass(frozen=True)
class Template:
    """A turn is ``begin`` role ``separator`` text ``end``; roles and texts never hold the marks.

    Inside a role or text a mark gets a backslash after its first character, and one that already
    has backslashes there gets one more, so taking one away restores the text.
    """

    begin: str = "<s>[INST] "
    separator: str = " [/INST]\n"
    end: str = "</s>"
    marks: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")
    trained_role: str = "assistant"

    def _rules(self, slash: str) -> list[tuple[str, str]]:
        heads: dict[str, list[str]] = {}
        for mark in self.marks:
            heads.setdefault(mark[0], []).append(re.escape(mark[1:]))
        return [(f"{re.escape(head)}{slash}(\\\\*)({'|'.join(tails)})", head)
                for head, tails in heads.items()]

    def escape(self, texts: pa.Array) -> pa.Array:
        for pattern, head in self._rules(""):
            texts = pc.replace_substring_regex(texts, pattern, head + r"\\\1\2")
        return texts

    def unescape(self, text: str) -> str:
        for pattern, head in self._rules(r"\\"):
            text = re.sub(pattern, lambda m: head + m[1] + m[2], text)
        return text

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of every turn, unescaped. Text that no turn covers is an error."""
        turn = re.compile(re.escape(self.begin) + "(.*?)" + re.escape(self.separator) + "(.*?)"
                          + re.escape(self.end), re.S)
        found, at = [], 0
        while at < len(formatted):
            match = turn.match(formatted, at)
            if not match:
                raise ValueError(f"no turn begins at {at}")
            found.append((self.unescape(match[1]), self.unescape(match[2])))
            at = match.end()
        return found


def _assemble(rows: pa.Table, template: Template) -> pa.RecordBatch:
    """Whole conversations of ``rows`` (key, role, text in order), one output row each."""
    rows = rows.combine_chunks()
    n = rows.num_rows
    roles = pc.fill_null(rows["role"].combine_chunks(), "")
    trained = pc.equal(roles, template.trained_role).to_numpy(zero_copy_only=False)
    role_bytes, role_at = text_bytes(template.escape(roles))
    body, body_at = text_bytes(template.escape(pc.fill_null(rows["text"].combine_chunks(), "")))
    fixed = [s.encode() for s in (template.begin, template.separator, template.end)]
    source = np.concatenate([np.frombuffer(b"".join(fixed), np.uint8), role_bytes, body])
    marks = np.cumsum([0] + [len(f) for f in fixed])
    starts, lengths = np.empty((n, 5), np.int64), np.empty((n, 5), np.int64)
    for column, k in ((0, 0), (2, 1), (4, 2)):
        starts[:, column], lengths[:, column] = marks[k], marks[k + 1] - marks[k]
    starts[:, 1], lengths[:, 1] = marks[3] + role_at[:-1], np.diff(role_at)
    starts[:, 3], lengths[:, 3] = marks[3] + len(role_bytes) + body_at[:-1], np.diff(body_at)
    place = np.zeros(5 * n + 1, np.int64)
    np.cumsum(lengths.ravel(), out=place[1:])
    out = np.empty(place[-1], np.uint8)
    scatter = np.repeat(starts.ravel() - place[:-1], lengths.ravel()) + np.arange(place[-1])
    np.take(source, scatter, out=out)
    first = np.flatnonzero(_begins(rows["key"].combine_chunks()))
    edges = np.append(first, n)
    turns = np.diff(edges)
    text = pa.Array.from_buffers(
        pa.large_string(), len(first),
        [None, pa.py_buffer(place[5 * edges]), pa.py_buffer(out)]).cast(pa.string())
    opened = np.repeat(place[5 * first], turns)
    begin, end = place[3:-1:5] - opened, place[4::5] - opened
    counts = np.zeros(len(first) + 1, np.int32)
    np.cumsum(np.add.reduceat(trained.astype(np.int32), first), out=counts[1:])
    spans = pa.ListArray.from_arrays(pa.array(counts), pa.StructArray.from_arrays(
        [pa.array(begin[trained]), pa.array(end[trained])], names=["start", "end"]))
    return pa.RecordBatch.from_arrays(
        [rows["key"].combine_chunks().take(pa.array(first)), pa.array(turns), text, spans],
        names=["key", "n_turns", "formatted", "loss_spans"])


def _begins(keys: pa.Array) -> np.ndarray:
    """Where a key differs from the one before it; nulls are one key."""
    flags = np.ones(len(keys), bool)
    if len(keys) > 1:
        left, right = keys.slice(0, len(keys) - 1), keys.slice(1)
        same = pc.fill_null(pc.equal(left, right), False)
        both = pc.and_(left.is_null(), right.is_null())
        flags[1:] = ~pc.or_(same, both).to_numpy(zero_copy_only=False)
    return flags


def format_chats(turns: DataFrame, template: Template = Template(), key: str = "conv_id",
                 turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: key, n_turns, formatted text, loss_spans (byte offsets in it).

    Turns are ordered by turn, then role, then text (nulls first), so ties and repeated rows come
    out the same way every time and repeated rows stay. A null role or text is empty, a null key is
    one conversation. Other columns are ignored. An empty table gives no rows. The result has one
    row per conversation, so a conversation must fit in a row; everything else is bounded by blocks.
    """
    prepare(turns.sparkSession)
    chosen = turns.select(F.col(f"`{key}`").alias("key"), F.col(f"`{turn}`").alias("turn"),
                          F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    ordered = chosen.repartition("key").sortWithinPartitions("key", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for rows in batches:
            for at in range(0, rows.num_rows, 256):
                part = rows.slice(at, 256)
                held.append(part)
                size += part.get_total_buffer_size() * part.num_rows // max(rows.num_rows, 1)
                if size < BLOCK_BYTES:
                    continue
                whole = pa.Table.from_batches(held)
                last = int(np.flatnonzero(_begins(whole["key"].combine_chunks()))[-1])
                if last:
                    yield _assemble(whole.slice(0, last), template)
                    held, size = whole.slice(last).to_batches(), 0
        if held:
            yield _assemble(pa.Table.from_batches(held), template)

    kind = chosen.schema["key"].dataType.simpleString()
    return ordered.mapInArrow(
        run, f"key {kind}, n_turns long, formatted string, "
             "loss_spans array<struct<start: long, end: long>>").withColumnRenamed("key", key)


def read_back(chats: DataFrame, template: Template = Template(), key: str = "conv_id") -> DataFrame:
    """Digests read from formatted text and spans alone: turns, text under the loss mask, length."""

    def run(formatted: pa.Array, spans: pa.Array) -> pa.Array:
        found = []
        for text, marked in zip(formatted.to_pylist(), spans.to_pylist()):
            turns = template.parse(text)
            data = text.encode()
            loss = "".join(template.unescape(data[s["start"]: s["end"]].decode()) for s in marked)
            whole = "".join(f"{role}\n{body}\n" for role, body in turns)
            found.append({
                "n_turns": len(turns), "turns_sha256": hashlib.sha256(whole.encode()).hexdigest(),
                "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(),
                "formatted_chars": len(text)})
        return pa.array(found, pa.struct([
            ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
            ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

    digest = F.arrow_udf(run, "n_turns long, turns_sha256 string, loss_chars long, "
                              "loss_sha256 string, formatted_chars long")
    return chats.select(F.col(f"`{key}`"), digest("formatted", "loss_spans").alias("d")).select(
        F.col(f"`{key}`"), "d.*")
