"""Secret scans by a recursive decoding worklist.

Each text is a first layer. Percent escapes, Unicode escapes, base64 runs and compressed payloads
found in a layer are unwrapped into further layers, until nothing new appears; a layer seen before
is not entered again. Every layer is scanned with the same patterns, and each of its characters
carries the span of the whole text it came from, so findings map back to code points of the text.
The patterns are ASCII, so decoded bytes that are not UTF-8 are scanned one character a byte.
One pass over the rows, no shuffle.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The kinds and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#x[0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
_B = "[A-Za-z0-9+/_-]"
_BREAK = r"\r?\n[ \t>]*"
# A run of 16 and what is wrapped around it: the end of a line before, and the lines behind.
_BASE64 = re.compile(rf"(?:(?<!{_B}){_B}{{1,15}}+{_BREAK})?{_B}{{16,}}+(?:{_BREAK}{_B}++)*+={{0,2}}")
_RUN = re.compile(rf"{_B}+={{0,2}}")


@dataclass(frozen=True)
class Limits:
    """``layer_bytes`` is unpacked and held at a time: a larger payload is scanned in pieces, each
    beginning with the last ``overlap_bytes`` of the one before, or with the base64 run that
    crosses its end. ``total_bytes`` guards each text against decompression bombs. A payload with
    more than that, or with a run of over half a layer, is counted in ``refused``."""

    layer_bytes: int = 64 << 20
    overlap_bytes: int = 64 << 10
    total_bytes: int = 4 << 30


@dataclass
class Guard:
    """Bytes unpacked for a text so far, and the spans of payloads not scanned in full."""

    limits: Limits
    taken: int = 0
    refused: list[tuple[int, int]] = field(default_factory=list)

    def take(self, size: int) -> bool:
        self.taken += size
        return self.taken <= self.limits.total_bytes


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping per kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(*m.span(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(*m.span(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(*m.span(), 2) for m in HEX.finditer(text)]
    return found


def _characters(data: bytes) -> str:
    """The bytes as UTF-8, or else one character a byte."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _engine(head: bytes):
    """An unpacker for gzip, zlib, bzip2 or xz by the first bytes; None for others."""
    if head[:2] == b"\x1f\x8b" or (len(head) > 2 and head[0] == 0x78 and (head[0] << 8 | head[1]) % 31 == 0):
        return zlib.decompressobj(47)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def _slices(data: bytes) -> Iterator[bytes]:
    """Short parts, so that little is lost before a damaged place."""
    return (data[at: at + 1024] for at in range(0, len(data), 1024))


def _inflated(source: Iterator[bytes], size: int) -> Iterator[bytes]:
    """Parts of at most ``size`` bytes of the packed members in ``source``, as far as they are sound."""
    engine, rest = None, b""
    try:
        for data in source:
            data, rest = rest + data, b""
            while True:
                if engine is None and (engine := _engine(data)) is None:
                    if len(data) >= 6:
                        return
                    rest = data
                    break
                out = engine.decompress(data, size)
                if out:
                    yield out
                if engine.eof:
                    data, engine = engine.unused_data, None
                    continue
                data = getattr(engine, "unconsumed_tail", b"")
                if not data and getattr(engine, "needs_input", True):
                    break
        if hasattr(engine, "flush"):
            yield engine.flush()
    except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
        return


_ALPHABET = np.zeros(256, bool)
_ALPHABET[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=\r\n")] = True


def _overlapping(stream: Iterator[bytes], guard: Guard, span: tuple[int, int]) -> Iterator[bytes]:
    """The stream in pieces of about ``layer_bytes``; a base64 run at a piece's end is carried over."""
    limits, held, whole = guard.limits, bytearray(), True
    for part in stream:
        if not guard.take(len(part)):
            whole = False
            break
        held += part
        if len(held) >= limits.layer_bytes:
            yield bytes(held)
            keep = min(limits.overlap_bytes, limits.layer_bytes // 4)
            outside = np.flatnonzero(~_ALPHABET[np.frombuffer(bytes(held[:-keep]), np.uint8)])
            begin = int(outside[-1]) + 1 if len(outside) else 0
            if len(held) - begin > limits.layer_bytes // 2:
                whole, begin = False, len(held) - keep
            held = held[begin:]
    if held:
        yield bytes(held)
    if not whole:
        guard.refused.append(span)


def _unpacked(data: bytes, guard: Guard, span: tuple[int, int]) -> Iterator[bytes]:
    """``data`` and all that is packed in it, layer by layer, in pieces."""
    limits, seen = guard.limits, set()
    size = min(1 << 20, limits.layer_bytes)
    opened: Callable[[], Iterator[bytes]] = lambda: _slices(data)
    while True:
        stream, made, length = opened(), [], 0
        for part in stream:
            made.append(part)
            length += len(part)
            if length > limits.layer_bytes:
                break
        if length > limits.layer_bytes:
            yield from _overlapping(chain(made, stream), guard, span)
            if guard.taken > limits.total_bytes:
                return
            opened = lambda below=opened: _inflated(below(), size)
            continue
        layer = b"".join(made)
        mark = hashlib.sha256(layer).digest()
        if not layer or mark in seen:
            return
        if not guard.take(length):
            guard.refused.append(span)
            return
        seen.add(mark)
        yield layer
        opened = lambda layer=layer: _inflated(_slices(layer), size)


class Layer:
    """A text and, per character, the start and end of what lies behind it in the whole text."""

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray) -> None:
        self.text, self.starts, self.ends = text, starts, ends

    @classmethod
    def whole(cls, text: str) -> Layer:
        places = np.arange(len(text) + 1)
        return cls(text, places[:-1], places[1:])

    @classmethod
    def behind(cls, text: str, start: int, end: int) -> Layer:
        """A text that lies as a whole behind one span."""
        return cls(text, *(np.broadcast_to(np.int64(x), len(text)) for x in (start, end)))

    def part(self, start: int, end: int) -> Layer:
        return Layer(self.text[start:end], self.starts[start:end], self.ends[start:end])

    def origin(self, start: int, end: int) -> tuple[int, int]:
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())


def _substituted(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """``layer`` with every match that decodes replaced; None if none does."""
    text, starts, ends, at = [], [], [], 0
    for match in pattern.finditer(layer.text):
        made = decode(match[0])
        if made is None:
            continue
        text.append(layer.text[at: match.start()])
        starts.append(layer.starts[at: match.start()])
        ends.append(layer.ends[at: match.start()])
        position = match.start()
        for piece, width in made:
            text.append(piece)
            begin, end = layer.origin(position, position + width)
            starts.append(np.full(len(piece), begin))
            ends.append(np.full(len(piece), end))
            position += width
        at = match.end()
    if not at:
        return None
    text.append(layer.text[at:])
    starts.append(layer.starts[at:])
    ends.append(layer.ends[at:])
    return Layer("".join(text), np.concatenate(starts), np.concatenate(ends))


def _percent(run: str) -> list[tuple[str, int]]:
    raw = bytes.fromhex(run.replace("%", ""))
    text = _characters(raw)
    if len(text) == len(raw):  # one character a byte
        return [(c, 3) for c in text]
    return [(c, 3 * len(c.encode())) for c in text]


def _unicode(mark: str) -> list[tuple[str, int]] | None:
    decimal = mark.startswith("&#") and mark[2] not in "xX"
    code = int(re.sub(r"[^0-9A-Fa-f]", "", mark.replace("\\x", "").replace("&#x", "")),
               10 if decimal else 16)
    if code > 0x10FFFF or 0xD800 <= code < 0xE000 or code < 9:
        return None
    return [(chr(code), len(mark))]


_ESCAPE = re.compile(r"%[0-9A-Fa-f]{2}|\\u\{?[0-9A-Fa-f]|\\x[0-9A-Fa-f]{2}|&#[0-9xX]")


def _wrapped(widths: list[int]) -> set[tuple[int, int]]:
    """First and last line of what may be one payload, among adjoining lines of these widths.

    Every line alone, all together, and lines of one width with a shorter one behind them, with and
    without it and the line before, on which a payload can begin.
    """
    found = {(i, i) for i, width in enumerate(widths) if width >= 16} | {(0, len(widths) - 1)}
    at = 0
    while at < len(widths):
        same = at
        while same + 1 < len(widths) and widths[same + 1] == widths[at]:
            same += 1
        if widths[at] >= 16:
            last = same + (same + 1 < len(widths) and widths[same + 1] < widths[at])
            found |= {(at, same), (at, last), (max(at - 1, 0), last)}
        at = same + 1
    return found


def _unwrapped(layer: Layer, guard: Guard) -> Iterator[Layer]:
    """The layers directly below ``layer``."""
    if "%" in layer.text or "\\" in layer.text or "&#" in layer.text:
        at = 0
        # The whole line is kept around an escape: a finding may begin before it and end after it.
        for line in layer.text.split("\n"):
            if _ESCAPE.search(line):
                part = layer.part(at, at + len(line))
                for pattern, decode in ((_PERCENT, _percent), (_UNICODE, _unicode)):
                    made = _substituted(part, pattern, decode)
                    if made is not None:
                        yield made
            at += len(line) + 1
    for match in _BASE64.finditer(layer.text):
        lines = [m.span() for m in _RUN.finditer(layer.text, *match.span())]
        bodies = [layer.text[a:b].rstrip("=").replace("-", "+").replace("_", "/") for a, b in lines]
        for first, last in sorted(_wrapped([len(body) for body in bodies])):
            body = "".join(bodies[first: last + 1])
            body = body[: len(body) - (len(body) % 4 == 1)]  # a lone last character holds no byte
            try:
                data = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
            except (binascii.Error, ValueError):
                continue
            span = layer.origin(lines[first][0], lines[last][1])
            for piece in _unpacked(data, guard, span):
                yield Layer.behind(_characters(piece), *span)


def search(text: str, limits: Limits = Limits()) -> tuple[list, list, list]:
    """Spans of the base scan and all spans, as (start, end, kind), and spans of refused payloads."""
    order = lambda span: (span[0], span[2], span[1])  # noqa: E731  by start, then kind
    base = sorted(scan(text), key=order)
    spans, seen, guard = set(base), {text}, Guard(limits)
    work = [_unwrapped(Layer.whole(text), guard)]
    while work:  # depth first, so that one piece of a large payload is held at a time
        inner = next(work[-1], None)
        if inner is None:
            work.pop()
            continue
        mark = inner.text if len(inner.text) < 64 else hashlib.sha256(inner.text.encode()).digest()
        mark = (mark, int(inner.starts[0]), int(inner.ends[-1]))
        if mark in seen:
            continue
        seen.add(mark)
        spans.update((*inner.origin(s, e), kind) for s, e, kind in scan(inner.text))
        work.append(_unwrapped(inner, guard))
    return base, sorted(spans, key=order), guard.refused


def find_secrets(text: str, limits: Limits = Limits()) -> tuple[list, list, int]:
    """Spans of the base scan, all spans, and refused payloads; spans are (start, end, kind)."""
    base, spans, refused = search(text, limits)
    return base, spans, len(refused)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def scan_secrets(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """Add a struct ``secrets``: base and all spans (start, end, kind; code points) and ``refused``.

    A null or empty text has none. Rows are independent: repeated rows, null ids and columns of any
    name pass through, but for a column named ``secrets``, which is replaced.
    """

    def run(column: pa.Array) -> pa.Array:
        rows = []
        for value in column.to_pylist():
            base, spans, refused = find_secrets(value or "", limits)
            rows.append({"base": [s[2] for s in base], "base_text": written(base),
                         "starts": [s[0] for s in spans], "ends": [s[1] for s in spans],
                         "spans_text": written(spans), "refused": refused})
        numbers = pa.list_(pa.int64())
        return pa.array(rows, pa.struct([
            ("base", numbers), ("base_text", pa.string()), ("starts", numbers), ("ends", numbers),
            ("spans_text", pa.string()), ("refused", pa.int64())]))

    found = F.arrow_udf(run, "base array<long>, base_text string, starts array<long>, "
                             "ends array<long>, spans_text string, refused long")
    return docs.withColumn("secrets", found(F.col(f"`{text}`")))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]",
           limits: Limits = Limits(), unscanned: str = "[UNSCANNED]") -> DataFrame:
    """Replace every found span (overlapping ones together) by ``mark``; nulls stay null.

    Payloads that were not scanned in full are replaced too, by ``unscanned`` where nothing was found
    at their start, and counted in ``refused``, which is added (replaced if there).
    """

    def run(column: pa.Array) -> pa.Array:
        out, counts = [], []
        for value in column.to_pylist():
            _, spans, refused = search(value, limits) if value else ([], [], [])
            marked = sorted([(*s[:2], 0) for s in spans] + [(*s, 1) for s in set(refused)])
            parts, at = [], 0
            for start, end, kind in marked:
                if end <= at:
                    continue
                if start >= at:
                    parts += [value[at:start], unscanned if kind else mark]
                at = end
            out.append(value if not marked else "".join(parts) + value[at:])
            counts.append(len(refused))
        return pa.StructArray.from_arrays(
            [pa.array(out, pa.string()), pa.array(counts, pa.int64())], names=["text", "refused"])

    made = F.arrow_udf(run, "text string, refused long")
    kept = [c for c in docs.columns if c != "refused"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"),
                       made(F.col(f"`{text}`")).alias("_new"))
    return rows.select(
        *[F.col("_new.text").alias(c) if c == text else F.col("_row")[c].alias(c) for c in kept],
        "_new.refused")
