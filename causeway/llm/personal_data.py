"""Personal data by bootstrapped contextual extraction.

Fixed patterns find seed entities. The words around a seed, with the class of what stands there,
make lexical patterns (`number` after `call me at`); the same patterns also meet candidates, the
numbers and addresses that no fixed pattern took. Patterns and instances form a graph. Each round
Spark scores a pattern by the share of its distinct instances that are known to be of one kind, and
an instance by the combined evidence of its confident patterns; instances above the threshold join
the known ones, until nothing new is found. Copies of a text add no weight, since instances count
once. Only the graph, never a text, is exchanged.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, store

# The kinds and their patterns. An address is found from its @ leftwards, and digits
# start where no digit stands before: the same matches, in time linear in the text.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_SIGNS = re.compile(r"[0-9@]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DIGITS = re.compile(r"[0-9]")
_NUMBER = re.compile(r"[0-9().+/-]+[,;:!?.]*")
_EDGES = ".,;:!?\"'[]{}<>*#$%&|="
_FOLD = str.maketrans("", "", ".,;!?\"'()[]{}<>*#$%&|")


@dataclass(frozen=True)
class Rule:
    """A pattern is confident with ``support`` known instances of a kind that make up ``percent`` of
    all its instances plus one; an instance is accepted if its patterns together are wrong with at
    most ``doubt`` probability. A candidate number has ``digits`` digits at least. ``rounds`` bounds
    the drift of the bootstrap."""

    support: int = 5
    percent: int = 80
    doubt: float = 0.15
    digits: int = 6
    rounds: int = 8


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    low, at = 0, text.find("@")
    while at >= 0:
        host = _HOST.match(text, at)
        start = at
        while host and start > low and text[start - 1] in _LOCAL:
            start -= 1
        low = at + 1
        if start < at:
            low = host.end()
            yield start, low
        at = text.find("@", low)


def seeds(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind, then start."""
    if not _SIGNS.search(text):
        return []
    found = [(0, *span) for span in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            found.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGITS.findall(m[0])) <= 15:
            found.append((3, *m.span()))
    return found


def _short(word: str) -> str:
    """A word as it stands in patterns and instances; a very long one by its digest."""
    return word if len(word) <= 64 else "~" + hashlib.md5(word.encode()).hexdigest()


def _folded(word: str) -> str:
    return _short(word.lower().translate(_FOLD) or word)


def _instance(value: str) -> str:
    """What makes two mentions one instance: the digits of a number, an address in lower case."""
    return "m:" + _short(value.lower()) if "@" in value else "n:" + _short("".join(_DIGITS.findall(value)))


class Context:
    """Words of one text, and the patterns around its spans."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.spans = [m.span() for m in _WORD.finditer(text)]
        self.starts = [s for s, _ in self.spans]
        self.ends = [e for _, e in self.spans]

    def around(self, start: int, end: int) -> tuple[list[str], list[str]]:
        """Up to two words before the span, nearest first, and one behind it."""
        i = bisect_right(self.starts, start) - 1
        left = [self.text[self.starts[i]: start]] if 0 <= i and self.starts[i] < start < self.ends[i] else []
        i = bisect_right(self.ends, start) - 1
        while len(left) < 2 and i >= 0:
            left.append(self.text[slice(*self.spans[i])])
            i -= 1
        j = bisect_left(self.ends, end)
        if j < len(self.ends) and self.starts[j] < end < self.ends[j]:
            return left, [self.text[end: self.ends[j]]]
        j = bisect_left(self.starts, end)
        return left, [self.text[slice(*self.spans[j])]] if j < len(self.spans) else []

    def patterns(self, start: int, end: int) -> list[str]:
        left, right = self.around(start, end)
        left, right = [_folded(w) for w in left], [_folded(w) for w in right]
        kind = "mail" if "@" in self.text[start:end] else "number"
        found = []
        if left:
            found.append(f"{kind} after {left[0]}")
        if len(left) > 1:
            found.append(f"{kind} after {left[1]} {left[0]}")
        if right:
            found.append(f"{kind} before {right[0]}")
        if left and right:
            found.append(f"{kind} between {left[0]} and {right[0]}")
        return found

    def candidates(self, taken: list[tuple[int, int]], digits: int) -> Iterator[tuple[int, int]]:
        """Numbers of several words and addresses that touch none of the ``taken`` spans."""
        words = sorted({bisect_right(self.starts, m.start()) - 1 for m in _SIGNS.finditer(self.text)})
        taken = sorted(taken)
        reach = list(accumulate((e for _, e in taken), max))
        at = 0
        while at < len(words):
            i = j = words[at]
            at += 1
            start, end = self.spans[i]
            if "@" not in self.text[start:end]:
                if not _NUMBER.fullmatch(self.text, start, end):
                    continue
                while at < len(words) and words[at] == j + 1 and self.starts[j + 1] == end + 1 and \
                        self.text[end - 1] not in ",;:!?." and \
                        _NUMBER.fullmatch(self.text, *self.spans[j + 1]):
                    j += 1
                    at += 1
                    end = self.ends[j]
            while start < end and self.text[start] in _EDGES:
                start += 1
            while start < end and self.text[end - 1] in _EDGES:
                end -= 1
            value = self.text[start:end]
            if "@" in value:
                name, _, host = value.partition("@")
                fits = bool(name) and bool(host) and "@" not in host
            else:
                fits = len(_DIGITS.findall(value)) >= digits
            before = bisect_left(taken, (end, -1))  # so many begin before the end
            if fits and not (before and reach[before - 1] > start):
                yield start, end


_SPAN = "struct<kind:int,start:int,end:int>"
_MENTION = "struct<kind:int,start:int,end:int,instance:string,patterns:array<string>>"
_SEEN = f"struct<base:array<{_SPAN}>,seen:array<{_MENTION}>>"


def _scan(text: str | None, digits: int) -> tuple[list, list]:
    """Seeds, and all mentions (kind -1: a candidate) with their instance and patterns."""
    if not text or not _SIGNS.search(text):
        return [], []
    base = seeds(text)
    context = Context(text)
    places = base + [(-1, *span) for span in context.candidates([b[1:] for b in base], digits)]
    return base, [(k, s, e, _instance(text[s:e]), context.patterns(s, e)) for k, s, e in places]


@dataclass(frozen=True)
class Extraction:
    """``rows``: (row, kept columns, found) with all mentions; ``patterns``: (pattern, kind,
    support, total) of the last round; ``learned``: (instance, kind) that patterns discovered."""

    rows: DataFrame
    patterns: DataFrame
    learned: DataFrame


def _confident(edges: DataFrame, totals: DataFrame, known: DataFrame, rule: Rule) -> DataFrame:
    counted = edges.join(known, "instance").groupBy("pattern", "kind").agg(
        F.count("*").alias("support")).filter(F.col("support") >= rule.support)
    return counted.join(totals, "pattern").filter(
        100 * F.col("support") >= rule.percent * (F.col("total") + 1))


def _accepted(edges: DataFrame, patterns: DataFrame, known: DataFrame, rule: Rule) -> DataFrame:
    """New (instance, kind). Evidence is a sum of whole thousandths of -log(doubt), so that the order
    of summing can't matter; of two kinds the one of more evidence counts, then the first."""
    doubt = 1 - F.col("support") / (F.col("total") + 1)
    weighed = patterns.select("pattern", "kind", F.floor(-1000 * F.log(doubt)).alias("evidence"))
    found = edges.join(weighed, "pattern").groupBy("instance", "kind").agg(
        F.sum("evidence").alias("evidence")).filter(
        F.col("evidence") >= math.floor(-1000 * math.log(rule.doubt)))
    best = found.groupBy("instance").agg(
        F.max(F.struct("evidence", (-F.col("kind")).alias("kind"))).alias("b"))
    return best.join(known.select("instance").distinct(), "instance", "left_anti").select(
        "instance", (-F.col("b.kind")).alias("kind"))


def extract(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text",
            rule: Rule = Rule()) -> Extraction:
    """Find seeds in every text and learn from all of them which other identifiers there are.

    A null text counts as empty. Every row is a row of its own, whatever its columns; columns in
    ``keep`` are carried along, texts are not. Without seeds, or without candidates, nothing is
    learned and the seeds are the result.
    """
    prepare(docs.sparkSession)
    digits = rule.digits

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
        seen = pa.struct([*kind, ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
        both = pa.struct([("base", pa.list_(kind)), ("seen", pa.list_(seen))])
        for column in texts:
            yield pa.array([_scan(t, digits) for t in column.to_pylist()], both)

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    kept = F.struct(*[F.col(f"`{c}`").alias(c) for c in keep]).alias("kept")
    rows = store(docs.select(F.monotonically_increasing_id().alias("row"), kept,
                             F.arrow_udf(run, _SEEN)(F.col(f"`{text}`")).alias("found")))
    seen = rows.select(F.explode("found.seen").alias("s")).select("s.*")
    edges = store(seen.select("instance", F.explode("patterns").alias("pattern")).distinct())
    totals = store(edges.groupBy("pattern").agg(F.count("*").alias("total")).filter(
        F.col("total") >= rule.support))
    known = store(seen.filter("kind >= 0").select("instance", "kind").distinct())
    learned = known.limit(0)
    for _ in range(rule.rounds):
        patterns = store(_confident(edges, totals, known, rule))
        new = store(_accepted(edges, patterns, known, rule))
        if new.isEmpty():
            break
        learned, known = learned.unionByName(new), known.unionByName(new)
    candidates = seen.filter("kind < 0").select("instance").distinct()
    same = candidates.join(known.groupBy("instance").agg(F.min("kind").alias("kind")), "instance")
    return Extraction(rows, patterns, same)


def spans(found: Extraction) -> DataFrame:
    """The kept columns with ``base`` and ``spans``, arrays of (kind, start, end) by kind, then start.

    ``spans`` adds to the seeds every mention of an instance that patterns discovered, and mentions
    of known instances in other spellings. Code points, end exclusive; kinds number ``KINDS``.
    """
    seen = found.rows.select("row", F.explode("found.seen").alias("s")).filter("s.kind < 0").select(
        "row", "s.start", "s.end", "s.instance")
    more = seen.join(found.learned, "instance").groupBy("row").agg(
        F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    joined = found.rows.select("row", "kept", F.col("found.base").alias("base")).join(more, "row", "left")
    whole = F.when(F.col("more").isNull(), F.col("base")).otherwise(
        F.array_sort(F.concat("base", "more")))
    return joined.select("kept.*", "base", whole.alias("spans"))


def span_text(column: str) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(column, lambda s: F.concat_ws(
        ":", names[s["kind"]], s["start"], s["end"])), ",")
