"""Lexical search, spelling variants and personal data against plain Python."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from causeway.llm import lexical_search, personal_data, spelling

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def table(spark, rows, names="doc_id long, text string"):
    return spark.createDataFrame(rows, names).repartition(3)


# ---- op12

def ranked(docs, items, k=20):
    terms = [(d, Counter(TERM.findall(low(t or "")))) for d, t in docs]
    terms = [(d, c) for d, c in terms if c]
    n, total = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in terms:
            m = 75 + (25 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                        * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
                        for t in TERM.findall(low(text or "")) if c[t])
            if score > 0:
                scored.append((-score, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def corpus(n=400):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(120)] + ["Ünï", "É", "x9"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([1, 5, 40, 300])))) for i in range(n)]
    docs += [(1000, None), (1001, ""), (1002, "!?"), (1003, "w1 " * 20_000), (1004, docs[3][1]), (1005, docs[3][1])]
    return docs, rng, words


@pytest.mark.parametrize("query_bytes, bits", [(4 << 20, 8), (200, 8), (4 << 20, 1)])
def test_search_equals_scoring_every_document(spark, query_bytes, bits):
    docs, rng, words = corpus()
    items = [(i, " ".join(rng.choices(words, k=8)).upper()) for i in range(20)]
    items += [(50, None), (51, ""), (52, "unknown"), (53, "w1 w1 unknown w2-w3")]
    plan = lexical_search.Signature(bits=bits, query_bytes=query_bytes)
    clash = "doc_id long, text string, slices string, key int"
    index = lexical_search.build_index(table(spark, [(*d, "s", 1) for d in docs], clash), plan=plan)
    found = lexical_search.search(index, table(spark, items, "item_id long, text string"))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect())) == ranked(docs, items)


def test_search_of_empty_tables_and_null_keys(spark):
    none = table(spark, [], "doc_id long, text string")
    items = table(spark, [(1, "a b")], "item_id long, text string")
    assert lexical_search.search(lexical_search.build_index(none), items).count() == 0
    docs = table(spark, [(None, "a"), (2, "a"), (2, "a"), (3, "c d e")])
    index = lexical_search.build_index(docs)
    assert lexical_search.search(index, items.limit(0)).count() == 0
    rows = lexical_search.search(index, items).collect()
    assert sorted((r.rank, r.doc_id) for r in rows) == [(1, 2), (2, 2), (3, None)]


def test_bounds_hold_and_exclude():
    """Bounds are never below a score, and a searcher that has seen good documents skips bad ones."""
    import pyarrow as pa

    docs, rng, words = corpus()
    texts = [t or "" for _, t in docs]
    terms = lexical_search.Terms(pa.array(texts))
    df = Counter(terms.names[i].as_py() for i in terms.name.tolist())
    rows = [type("Row", (), {"item": 0, "text": "w1 w2 w3 Ünï"})]
    queries = lexical_search._queries(rows)
    counts = np.array([df[w] for w in queries.vocabulary])
    n, total = int((terms.counts > 0).sum()), int(terms.counts.sum())
    plan = lexical_search.Signature()
    searcher = lexical_search.Searcher(queries, counts, n, total, plan, 20)
    norm = 75 + (25 * terms.counts * n) // total
    levels = np.frexp(terms.times.astype(float))[1].astype(int)
    flags = np.zeros((1 << 12, len(texts)), bool)
    hashes = terms.hashes()
    for text, name, level in zip(terms.text, terms.name, levels):
        flags[lexical_search._probes(hashes[[name] * level], np.arange(level), plan, 12).ravel(), text] = True
    bounds = searcher.bounds(np.packbits(flags, axis=1), 12, int(levels.max()), norm)[0]
    exact = {d: s for _, _, d, s in ranked(docs, [(0, rows[0].text)], k=len(docs))}
    assert all(bounds[i] >= exact.get(d, 0) for i, (d, _) in enumerate(docs))
    slices = np.packbits(flags, axis=1).tobytes()
    keys, column = [d for d, _ in docs], pa.array(texts)
    first = searcher.search(12, int(levels.max()), slices, keys, terms.counts, column)
    again = searcher.search(12, int(levels.max()), slices, keys, terms.counts, column)
    assert again < first


# ---- op13

def variants(count, ratio=10):
    near = defaultdict(set)
    for w in count:
        for i in range(len(w)):
            near[("cut", w[:i] + w[i + 1:], i)].add(w)
            if w[:i] + w[i + 1:] in count:
                near[w].add(w[:i] + w[i + 1:])
                near[w[:i] + w[i + 1:]].add(w)
    for key, some in list(near.items()):
        if isinstance(key, tuple):
            for a in some:
                near[a] |= some - {a}
    form = {}
    for w, n in count.items():
        best = min(near[w], key=lambda x: (-count[x], x), default=None)
        form[w] = best if best and count[best] >= ratio * n else None
    out = []
    for w, n in count.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), count[form[w]] if form[w] else None))
    return sorted(out)


def counted(docs, noise):
    count = Counter()
    for d, t in docs:
        for run in RUN.findall(t or ""):
            w = low(run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            count[w[:h % len(w)] + w[h % len(w) + 1:] if noise and h % noise == 0 else w] += 1
    return {w: n for w, n in count.items() if n >= 2 and len(w) >= 7}


def spelled():
    rng = random.Random(9)
    stems = ["".join(rng.choices("abcé", k=rng.randrange(6, 10))) for _ in range(60)]
    stems += ["prefixed" + "".join(rng.choices("ab", k=4)) for _ in range(40)] + ["Àrgüment", "x" * 300, "aaaaaaa"]
    words = []
    for s in stems:
        words += [s] * rng.choice([2, 3, 30, 400])
        for _ in range(3):
            i = rng.randrange(len(s))
            words += [rng.choice([s[:i] + s[i + 1:], s[:i] + "z" + s[i:], s[:i] + "y" + s[i + 1:]])] * rng.randrange(1, 5)
    rng.shuffle(words)
    docs = [(i % 90, " ".join(words[i::120])) for i in range(120)]
    return docs + [(None, "prefixed prefixes prefixed-prefixes"), (7, None), (8, ""), (9, "short 1234567")]


@pytest.mark.parametrize("noise, rule", [
    (31, spelling.Rule()), (None, spelling.Rule(group_words=2)), (5, spelling.Rule(group_bytes=40))])
def test_variants_equal_comparing_all_words(spark, noise, rule):
    docs = spelled()
    clash = table(spark, [(*d, 1, 2) for d in docs], "doc_id long, text string, n int, word int")
    found = spelling.group_variants(spelling.count_words(clash, noise=noise, rule=rule), rule)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, found.collect()), key=lambda r: r[0]) == variants(counted(docs, noise))


def test_variants_of_no_words(spark):
    words = spelling.count_words(table(spark, [], "doc_id long, text string"), noise=31)
    assert words.count() == 0 and spelling.group_variants(words).count() == 0


def test_continued_crc_equals_the_library():
    import pyarrow as pa

    words = pa.array([b"abc", b"", b"q" * 64, b"r" * 65, b"s" * 1000, "é".encode() * 40], pa.large_binary())
    heads = np.array([zlib.crc32(b"%d:" % i) for i in range(12)], np.uint32)
    which = np.array([i % 6 for i in range(12)])
    found = spelling.continued_crc(heads, words, which)
    assert found.tolist() == [zlib.crc32(b"%d:" % i + words[w].as_py()) for i, w in enumerate(which.tolist())]


# ---- op11

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda s: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(s[::-1])) % 10 == 0
    found = [(0, *m.span()) for m in EMAIL.finditer(text)]
    found += [(1, *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return found


def test_seeds_equal_the_patterns():
    rng = random.Random(2)
    bits = ["a@b.c", "@", ".", "x.y", "1.2.3.4", "256.1.1.1", "01.002.3.4.5.6.7.8", "+1 (555) 123-4567", "+", " ", "-",
            "4111 1111 1111 1111", "4111111111111112", "é", "%", "9", "12345678", "..", "()", "a@b", "c@d.e@f.g"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randrange(1, 12)))
        assert personal_data.seeds(text) == base(text), text
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "@" * 100_000, "+1" * 50_000):
        personal_data.seeds(text)  # linear in the text


def notes():
    """Numbers that no fixed pattern takes, in contexts that seeds share; and in others."""
    rng = random.Random(4)
    number = lambda: f"{rng.randrange(200, 999)}-{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
    filler = ["the", "of", "and", "plain", "words", "here"]
    docs = []
    for i in range(30):
        docs.append((i, f"{' '.join(rng.choices(filler, k=5))} phone me: +1 {number()} thanks {rng.choice(filler)}"))
    hidden = [number() for _ in range(3)]
    docs += [(100 + i, f"so phone me: {h} thanks again") for i, h in enumerate(hidden)]
    docs.append((110, f"seen elsewhere {hidden[0]} too"))  # known by its instance, not by its context
    docs += [(120 + i, f"part no {number()} in stock") for i in range(20)]
    docs += [(150, None), (151, ""), (152, "no digits"), (0, docs[0][1]), (None, "mail x@y.zz now")]
    return docs, hidden


def test_patterns_discover_numbers_by_context(spark):
    docs, hidden = notes()
    clash = table(spark, [(*d, "r", 1) for d in docs], "doc_id long, text string, row string, kind int")
    found = personal_data.extract(clash, keep=("doc_id", "row", "text"))
    rows = personal_data.spans(found).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = r.text or ""
        assert [tuple(s) for s in r.base] == base(text)
        extra = [text[s.start:s.end] for s in r.spans if tuple(s) not in base(text)]
        assert extra == [h for h in hidden if h in text], text
        assert all(s.kind == 3 for s in r.spans if text[s.start:s.end] in hidden)
    assert {p.pattern for p in found.patterns.collect()} >= {"number after me:", "number after phone me:"}


def test_nothing_is_learned_without_seeds(spark):
    docs = [(i, f"part no {i}23-456-7890 in stock") for i in range(20)]
    rows = personal_data.spans(personal_data.extract(table(spark, docs))).collect()
    assert len(rows) == 20 and not any(r.base or r.spans for r in rows)
    empty = table(spark, [], "doc_id long, text string")
    assert personal_data.spans(personal_data.extract(empty)).count() == 0
