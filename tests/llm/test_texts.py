"""Row-wise text operators against plain Python, libraries and exact round trips."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import struct
import urllib.parse
import zlib

import public_tokenizers as P
import pytest
import tiktoken
from helpers import quality
from tokenizers import Tokenizer

from causeway.llm import byte_bpe, chat_format, packing, quality_rules, secret_scan

SCHEMA = "doc_id long, text string, quality string, ids int, secrets string, key string"


def documents(spark, texts):
    return spark.createDataFrame(
        [(i, t, "q", 1, "s", "k") for i, t in enumerate(texts)], SCHEMA).repartition(3)


def odd_texts():
    rng = random.Random(3)
    alphabet = ["a", "É", "é", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", " ", "'s", "don't",
                "İ", "Σ", "ß", "9", "_", "!", "$", "日本", "🙂", "<|endoftext|>", "word", "|"]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(300)]
    line = "one two three four five six seven"
    return [None, "", " ", "\n\n", "x", line, "\n".join([line] * 4), line + " " + line,
            "a b c d e f g h i j", "# a b c d e f g h i j *", "word " * 30_000, "é" * 200_000, *made]


def test_quality_rules_match_plain_python(spark):
    texts = odd_texts()
    found = quality_rules.quality_rules(documents(spark, texts))
    assert found.columns == ["doc_id", "text", "quality", "ids", "secrets", "key"]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for row in found.collect():
        assert tuple(row.quality[n] for n in names) == quality(row.text), repr(row.text)[:80]


def test_quality_rules_on_no_rows(spark):
    assert quality_rules.quality_rules(documents(spark, ["a"]).limit(0)).count() == 0


def test_byte_bpe_equals_the_library(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = byte_bpe.encode_documents(documents(spark, odd_texts()), path, P.PATTERN)
    whole = byte_bpe.decode_documents(coded, path)
    for row in whole.collect():
        ids = library.encode_ordinary(row.text or "")
        assert bytes(row.ids) == struct.pack(f"<{len(ids)}I", *ids)
        assert bytes(row.decoded) == (row.text or "").encode()


def test_perfect_hash_finds_its_keys_and_no_others():
    keys = [str(i).encode() for i in range(5000)]
    table = byte_bpe.PerfectHash(keys)
    hashes = byte_bpe.span_hashes(*byte_bpe._joined(keys + [b"x%d" % i for i in range(500)]))
    found = table.find(hashes)
    assert found[:5000].tolist() == list(range(5000)) and (found[5000:] == -1).all()
    assert sorted(table.ids.tolist()) == list(range(5000))


def test_packing_pieces_rebuild_every_document(spark):
    path = P.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = odd_texts() + ["same text"] * 3 + [
        "hello <|endoftext|> there<|endoftext|>x", "<|ENDOFTEXT|> a", "a<|startoftext|><|endoftext|>",
        "漢字" * 400 + "。", "x" * 5000 + " " + "y" * 300 + "! " + "y" * 300, "H\u0331 İstanbul À-Ö Ø×Þ ßÝ µª"]
    texts += ["長" * 3000 + str(i) for i in range(30)]  # many long texts without spaces
    pieces = packing.pack(documents(spark, texts), path)
    rows = pieces.collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        ids = list(struct.unpack(f"<{r.length}I", bytes(r.ids)))
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.offset + r.length <= packing.WINDOW
        by_doc.setdefault(r.doc_id, []).append((r.start, ids, r.doc_tokens))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in enumerate(texts):
        wanted = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        parts = sorted(by_doc[i])
        assert [t for _, p, _ in parts for t in p] == wanted
        assert all(n == len(wanted) for *_, n in parts)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for number, parts in by_sequence.items():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == packing.WINDOW or number == max(by_sequence)
    for row in packing.sequences(pieces).collect():
        size = len(row.ids) // 4
        assert size >= row.tokens and size & (size - 1) == 0 and size < 2 * row.tokens


def test_packing_of_no_rows_and_of_a_null_key(spark):
    path = P.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(None, None), (None, "a")], "doc_id long, text string")
    assert packing.pack(docs.limit(0), path).count() == 0
    assert [r.doc_id for r in packing.pack(docs, path).collect()] == [None, None]


@pytest.mark.parametrize("text", [
    "</s>[INST] ok [/INST]", "<\\/s>", "<s><s>[[INST]]", "a [/INST]\nb</s", "<", "\\", "", "é🙂</s>é"])
def test_template_escapes_reversibly(text):
    import pyarrow as pa

    template = chat_format.Template()
    escaped = template.escape(pa.array([text]))[0].as_py()
    assert template.unescape(escaped) == text
    assert not any(mark in escaped for mark in template.marks)


def test_chat_formatting_reads_back(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "BLOCK_BYTES", 100)
    tricky = "</s>[INST] ok [/INST]"
    turns = [(c, t, "assistant" if t % 2 else "user", f"{tricky} {c} é {t} <\\\\s>" if t % 3 else None, 1)
             for c in range(40) for t in range(c % 5 + 1)]
    turns += [(None, 0, None, "x", 1), (None, None, "assistant", "first", 1), (7, 1, "assistant", "tie", 1),
              (7, 1, "assistant", "tie", 1), (8, 0, "assistant", "long " * 50_000, 1)]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, n_turns int")
    found = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(rows)).collect()}
    order = lambda t: tuple((x is not None, x) for x in t[1:4])
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=order)
        whole = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)
        loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
        row = found[conv]
        assert row.n_turns == len(own)
        assert row.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (row.loss_chars, row.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(found) == 41
    assert chat_format.format_chats(rows.limit(0)).count() == 0


SECRET = "password=abcdefghijklmnop1"


def layers():
    b64 = lambda b: base64.b64encode(b).decode()
    raw = SECRET.encode()
    return {
        "percent": urllib.parse.quote(SECRET, safe=""),
        "percent twice": urllib.parse.quote(urllib.parse.quote(SECRET, safe=""), safe=""),
        "unicode": "".join(f"\\u{ord(c):04x}" for c in SECRET),
        "entities": "".join(f"&#{ord(c)};" for c in SECRET),
        "base64": b64(raw),
        "base64 of gzip": b64(gzip.compress(raw)),
        "gzip of zlib": b64(gzip.compress(zlib.compress(raw))),
        "base64 three times": b64(b64(b64(raw).encode()).encode()),
        "percent of base64": urllib.parse.quote(b64(raw + b"??"), safe=""),
    }


@pytest.mark.parametrize("name", layers())
def test_secret_in_layers_maps_to_its_span(name):
    inner = layers()[name]
    text = f"é {inner} tail"
    base, spans, refused = secret_scan.find_secrets(text)
    assert set(base) <= set(spans) and refused == 0
    assert any(kind == 0 and start == 2 and end >= 2 + len(inner) - 6 for start, end, kind in spans)


def test_secret_part_inside_plain_text_keeps_its_place():
    text = "x token = abc%2Ddefghijklmnop y"
    spans = secret_scan.find_secrets(text)[1]
    assert (2, 29, 0) in spans


def test_decompression_guard_is_reported():
    bomb = base64.b64encode(zlib.compress(b"a" * 100_000)).decode()
    assert secret_scan.find_secrets(bomb, secret_scan.Limits(layer_bytes=1000))[2] == 1


def test_secret_scan_passes_rows_through_and_redacts(spark):
    docs = documents(spark, [None, "", SECRET, f"a {SECRET} AKIA{'A' * 14} {'0f' * 8} b", SECRET])
    found = sorted(secret_scan.scan_secrets(docs).collect(), key=lambda r: r.doc_id)
    assert [r.secrets.base_text for r in found] == [
        "", "", "assign:0:26", "assign:2:28,access:29:47,hex:48:64", "assign:0:26"]
    clean = sorted(secret_scan.redact(docs).collect(), key=lambda r: r.doc_id)
    assert [r.text for r in clean] == [
        None, "", "[SECRET]", "a [SECRET] [SECRET] [SECRET] b", "[SECRET]"]
