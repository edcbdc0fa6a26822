"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths are formed over whole Arrow batches in numpy; the
characters inside n-grams and lines that a text repeats are measured against all its characters.
One pass over the rows, no shuffle: every text is judged by itself, so no key can be hot.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, covered, mix, per_text, repeated, span_hashes

SYMBOLS = b"#*$%&|<>"
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "line_coverage double, ngram_coverage array<double>, base_failed boolean, kept boolean"
)


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict; coverages are shares of a text's word characters.

    ``ngrams`` maps an n-gram length to the largest share inside n-grams found before.
    """

    min_words: int = 10
    repeat_percent: int = 20
    ngrams: tuple[tuple[int, float], ...] = ((5, 0.30), (7, 0.25), (10, 0.20))
    line_share: float = 0.30
    symbol_percent: int = 25


def _later(keys: np.ndarray) -> np.ndarray:
    """Which keys equal an earlier one."""
    found = repeated(keys)
    where = np.flatnonzero(found)
    order = where[np.argsort(keys[where], kind="stable")]
    same = np.zeros(len(order), bool)
    same[1:] = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[same]] = True
    return out


def _lines(words: Words, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word that equal an earlier line, and the word characters in them."""
    data, offsets = words.data, words.offsets
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    starts = starts[starts < len(data)]
    starts = np.unique(starts)
    ends = np.append(starts[1:], len(data))
    closed = np.zeros(len(starts), bool)
    closed[ends > starts] = data[ends[ends > starts] - 1] == 10
    ends = ends - closed
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(chars, out=filled[1:])
    size = filled[ends] - filled[starts]
    starts, ends, size = starts[size > 0], ends[size > 0], size[size > 0]
    doc = np.searchsorted(offsets, starts, side="right") - 1
    keys = mix(span_hashes(data, starts, ends) + doc.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    again = _later(keys)
    n = len(offsets) - 1
    return (np.bincount(doc[again], minlength=n),
            np.bincount(doc[again], weights=size[again], minlength=n))


def measure(texts: pa.Array, rules: Rules) -> dict[str, np.ndarray | list]:
    """All measures and the verdict for a batch of texts."""
    words = Words(texts)
    chars = words.inside & ((words.data & 0xC0) != 0x80)
    n_words, word_chars = words.counts, per_text(chars, words.offsets)
    table = np.zeros(256, bool)
    table[list(SYMBOLS)] = True
    n_symbols = per_text(table[words.data], words.offsets)
    dup_lines, dup_line_chars = _lines(words, chars)
    running = np.zeros(len(words.data) + 1, np.int64)
    np.cumsum(chars, out=running[1:])
    length = running[words.ends] - running[words.starts]
    total = np.maximum(word_chars, 1)
    salt = words.doc.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)

    def keys(n: int) -> tuple[np.ndarray, np.ndarray]:
        where, value = words.windows(n)
        return where, mix(value + salt[where])

    where, value = keys(5)
    in_repeat = covered(where[repeated(value)], 5, len(words.doc))
    n_repeat = per_text(in_repeat, words.first)
    shares = []
    failed = np.zeros(len(n_words), bool)
    for n, limit in rules.ngrams:
        where, value = keys(n)
        inside = covered(where[_later(value)], n, len(words.doc))
        share = per_text(length * inside, words.first) / total
        failed |= share > limit
        shares.append(share)
    line_share = dup_line_chars / total
    base_failed = (n_words < rules.min_words) | (100 * n_repeat > rules.repeat_percent * n_words)
    failed |= (line_share > rules.line_share) | (100 * n_symbols > rules.symbol_percent * n_words)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols,
        "n_dup_lines": dup_lines, "n_repeat_words": n_repeat, "line_coverage": line_share,
        "ngram_coverage": list(np.stack(shares, 1)) if len(n_words) else [],
        "base_failed": base_failed, "kept": ~base_failed & ~failed,
    }


def quality_rules(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Measures and verdict per row, in a struct column ``quality`` beside the row's own columns.

    Words are runs without ASCII white space. ``n_repeat_words`` counts words in 5-word windows
    found twice or more in the text; coverages count only later occurrences. A null or empty text
    has no words, so ``base_failed`` is true and ``kept`` false. Rows are never joined or grouped:
    repeated rows, null ids and extra columns of any name pass through untouched, but for a column
    named ``quality``, which is replaced.
    """
    def arrow(column: pa.Array) -> pa.Array:
        found = measure(column, rules)
        kinds = {"line_coverage": pa.float64(), "ngram_coverage": pa.list_(pa.float64()),
                 "base_failed": pa.bool_(), "kept": pa.bool_()}
        return pa.StructArray.from_arrays(
            [pa.array(v, kinds.get(k, pa.int64())) for k, v in found.items()], names=list(found))

    measured = F.arrow_udf(arrow, _SCHEMA)
    return docs.withColumn("quality", measured(F.col(f"`{text}`")))
