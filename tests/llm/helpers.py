"""Plain Python versions of the corpus operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

WORD = re.compile("[^\x20\x09-\x0d]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def substring_dedup(rows, window):
    """(id, n_words, n_removed, kept) by counting every window."""
    lists = [words(t) for _, t in rows]
    seen = Counter(tuple(w[i:i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for (key, _), w in zip(rows, lists):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((key, len(w), len(gone), " ".join(kept)))
    return out


def shingles(text, n):
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(text)]
    if not low:
        return frozenset()
    if len(low) < n:
        return frozenset([tuple(low)])
    return frozenset(tuple(low[i:i + n]) for i in range(len(low) - n + 1))


def classes(keys, linked):
    """Smallest key per row of its component; ``linked`` are pairs of row numbers."""
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        root[find(a)] = find(b)
    order = lambda k: (k is not None, k)
    low = {}
    for i, k in enumerate(keys):
        r = find(i)
        low[r] = k if r not in low else min(low[r], k, key=order)
    return [low[find(i)] for i in range(len(keys))]


def near(rows, n, percent=80):
    sets = [shingles(t, n) for _, t in rows]
    links = [(a, b) for a, b in combinations(range(len(rows)), 2) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    keys = [k for k, _ in rows]
    return [(k, len(s), c, k == c) for k, s, c in zip(keys, sets, classes(keys, links))]


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    w = words(text)
    lines, dup, dup_chars = set(), 0, 0
    for line in (text or "").split("\n"):
        if words(line):
            if line in lines:
                dup += 1
                dup_chars += sum(map(len, words(line)))
            lines.add(line)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    count = Counter(grams)
    inside = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 5)}
    chars = sum(map(len, w))
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    failed = dup_chars > 0.30 * max(chars, 1) or 100 * symbols > 25 * len(w)
    for n, limit in ((5, 0.30), (7, 0.25), (10, 0.20)):
        seen, later = set(), set()
        for i in range(len(w) - n + 1):
            g = tuple(w[i:i + n])
            if g in seen:
                later.update(range(i, i + n))
            seen.add(g)
        failed = failed or sum(len(w[i]) for i in later) / max(chars, 1) > limit
    base = len(w) < 10 or 100 * len(inside) > 20 * len(w)
    return len(w), chars, symbols, dup, len(inside), base, not base and not failed


def line_dedup(rows, depth, min_tokens, min_docs, exact_docs=2):
    def leaf(line):
        t = ["<*>" if re.search("[0-9]", w) else w for w in words(line)]
        path = tuple(t) if len(t) > 2 * depth else tuple(t[:depth])
        fixed = sum(x != "<*>" for x in path)
        return (len(t), path) if len(t) >= min_tokens and 2 * fixed >= len(t) else None

    docs = defaultdict(list)
    for i, (_, text) in enumerate(rows):
        for found in {leaf(s) for s in (text or "").split("\n")} - {None}:
            docs[found].append(i)
    first = {f: min(rows[i][0] for i in d) for f, d in docs.items() if len(d) >= min_docs}
    held = defaultdict(list)
    for i, (_, text) in enumerate(rows):
        for line in {s for s in (text or "").split("\n") if words(s)}:
            held[line].append(i)
    equal = {s: min(rows[i][0] for i in d) for s, d in held.items() if len(d) >= exact_docs}
    out = []
    for key, text in rows:
        lines = [] if text is None else text.split("\n")
        kept = [s for s in lines if first.get(leaf(s), key) == key and equal.get(s, key) == key]
        out.append((key, len(lines), len(lines) - len(kept), None if text is None else "\n".join(kept)))
    return out
