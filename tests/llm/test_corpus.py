"""Operators over the whole corpus against plain Python on small tables."""

from __future__ import annotations

import random

import numpy as np
import pytest
from helpers import classes, line_dedup as plain_lines, near, substring_dedup as plain_substrings

from causeway.llm import embedding_dedup, line_dedup, near_dedup, substring_dedup, toxicity
from causeway.llm.components import components


def prose(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=1):
    """Ids with gaps, shared passages, periodic texts, copies, near copies, odd rows."""
    rng = random.Random(seed)
    passage, hot = prose(rng, 60), prose(rng, 40)
    texts = [None, "", " ", "one", "Two words", "two WORDS", "é x y", " ".join(["Is", "onhe."] * 60)]
    base = prose(rng, 200)
    for i in range(40):
        body = prose(rng, rng.randrange(5, 150))
        if i % 3 == 0:
            at = rng.randrange(len(body))
            body[at:at] = passage[rng.randrange(10): rng.randrange(45, 61)]
        if i % 2:
            body += hot
        texts.append(" ".join(body) if i % 5 else "\n".join(body))
    for i in range(25):
        copy = list(base)
        for _ in range(rng.randrange(0, 30)):
            copy[rng.randrange(len(copy))] = f"new{rng.randrange(1000)}"
        texts.append(" ".join(copy))
    texts += [" ".join(base)] * 4 + [" ".join(prose(rng, 3000))]
    return [(3 * i - 5, t) for i, t in enumerate(texts)] + [(-5, None), (400, " ".join(base)),
                                                            (400, " ".join(base))]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, 1, "x", True) for k, t in rows],
                                 "doc_id long, text string, r1 int, n string, kept boolean").repartition(5)


@pytest.mark.parametrize("limit", [50_000, 1])
@pytest.mark.parametrize("window", [35, 12])
def test_substring_dedup_matches_counting_windows(spark, limit, window):
    rows = corpus()
    plan = substring_dedup.Plan(window=window, group_limit=limit)
    found = substring_dedup.substring_dedup(frame(spark, rows), plan=plan)
    wanted = plain_substrings(rows, window)
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
    assert sum(r[2] for r in wanted) > 500


def test_words_of_colliding_hashes_are_told_apart(monkeypatch):
    import pyarrow as pa

    from causeway.llm import common

    words = common.Words(pa.array(["aa bb aa", "cc bb"]))
    words.hashes = np.zeros(5, np.uint64)
    number = substring_dedup.word_numbers(words).tolist()
    assert number[0] == number[2] and number[1] == number[4] and len(set(number)) == 3


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_dedup_matches_all_pairs(spark, shingle):
    rows = corpus()
    plan = near_dedup.Sketch(shingle=shingle, block_bytes=5000)
    found = near_dedup.near_duplicates(frame(spark, rows), plan=plan)
    got = found.select("doc_id", "n_shingles", "component_id", "kept").collect()
    wanted = near(rows, shingle)
    assert sorted(map(tuple, got)) == sorted(wanted)
    assert len({r[2] for r in wanted}) < len(wanted) - 10


def test_near_dedup_keeps_chains_that_no_pivot_spans(spark):
    """Texts in a row: neighbours are similar, the ends are not."""
    rng = random.Random(5)
    body, rows = prose(rng, 120, 10_000), []
    for i in range(30):
        rows.append((i, " ".join(body)))
        for k in range(4):
            body[(4 * i + k) % 120] = f"z{i}-{k}"
    plan = near_dedup.Sketch(shingle=2, block_bytes=3000)
    found = near_dedup.near_duplicates(frame(spark, rows), plan=plan)
    assert {r.component_id for r in found.collect()} == {0}


def test_near_dedup_classes_return_to_rows(spark):
    docs = frame(spark, corpus()[:20])
    found = near_dedup.near_duplicates(docs)
    whole = near_dedup.with_classes(docs, found)
    assert whole.count() == docs.count()
    assert set(whole.columns) == {"doc_id", "text", "r1", "n", "kept", "n_shingles", "component_id"}
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0
    twice = docs.unionByName(docs)
    assert near_dedup.with_classes(twice, near_dedup.near_duplicates(twice), once=True).count() == docs.count()


def test_sketch_estimate_is_close():
    rng = np.random.default_rng(1)
    plan = near_dedup.Sketch(bands=100, rows=10)
    common, own = rng.integers(0, 2**63, 600, np.int64), rng.integers(0, 2**63, (2, 100), np.int64)
    sets = [np.concatenate([common, o]).view(np.uint64) for o in own]
    filled = near_dedup.fill_registers(np.repeat([0, 1], 700), np.concatenate(sets), 2, plan)
    n = np.array([700])
    found = near_dedup.estimate(filled[:1], filled[1:], n, n, plan)[0]
    assert abs(found - 600 / 800) < 0.06
    both = near_dedup.fill_registers(np.zeros(800, int), np.unique(np.concatenate(sets)), 1, plan)
    assert (np.maximum(filled[0], filled[1]) == both[0]).all()


def test_components_of_random_links_and_a_long_chain(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [
        (i, i + 1) for i in range(1000, 1100)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = sorted({x for pair in links for x in pair if pair[0] != pair[1]})
    wanted = classes(nodes, [(nodes.index(a), nodes.index(b)) for a, b in links if a != b])
    groups = lambda labels: sorted(sorted(n for n in nodes if labels[n] == v) for v in set(labels.values()))
    assert groups(found) == groups(dict(zip(nodes, wanted)))


def test_line_dedup_matches_plain_python(spark):
    rng = random.Random(4)
    rows = [(None, None), (0, "")]
    for i in range(1, 40):
        lines = [" ".join(prose(rng, rng.randrange(3, 25), 50)) for _ in range(3)]
        lines.insert(rng.randrange(4), f"This page was printed on day {i} of the year")
        if i % 4 == 0:
            lines.append("All rights reserved by the very same people everywhere")
        if i % 7 == 0:
            lines += ["", "1 2 3 4 5 6", "short line here", "a b c d e f g h tail%d" % i]
        rows.append((i, "\n".join(lines)))
    rows += [(3, rows[4][1]), (3, rows[4][1])]
    tree = line_dedup.Tree()
    found = line_dedup.dedup_lines(frame(spark, rows), tree=tree)
    assert set(found.columns) == {"doc_id", "text", "r1", "n", "kept", "n_lines", "n_dropped"}
    key = lambda r: tuple((x is not None, x) for x in r)
    rest = [r for r in rows if r[0] is not None]
    wanted = plain_lines(rest, tree.depth, tree.min_tokens, tree.min_docs) + [(None, 0, 0, None)]
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found.collect()]
    assert sorted(got, key=key) == sorted(wanted, key=key)
    assert sum(r[2] for r in wanted) > 40
    assert line_dedup.dedup_lines(frame(spark, rows[:2])).count() == 2


def vectors(seed=6):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(30, 16))
    rows = []
    for i in range(400):
        spread = rng.choice([0.0, 0.02, 0.05, 0.08])
        v = base[rng.integers(30)] + spread * rng.normal(size=16)
        rows.append((i, [float(x) for x in np.float32(v)], int(rng.integers(2))))
    same = rows[0][1]
    rows += [(1000 + i, same, 0) for i in range(60)] + [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 16, 1)]
    rows += [(2003, [float("nan")] * 16, 1), (2004, [None] * 16, 1), (2005, same, None), (2006, same[:8], 0),
             (2007, same[:8], 0), (2008, [float("inf")] * 16, 0), (5, same, 0), (2009, [1.0], 0), (2010, [2.0], 0)]
    return rows


@pytest.mark.parametrize("block", [512, 7])
def test_embedding_dedup_matches_all_pairs(spark, block):
    rows = vectors()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    found = embedding_dedup.near_embeddings(table, index=embedding_dedup.Index(block=block, codes=8))
    good = lambda v: bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    unit = [np.array(v) / np.linalg.norm(v) if good(v) else None for _, v, _ in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][2] == rows[j][2] is not None
             and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j])
             and unit[i] @ unit[j] >= 0.98]
    degree = np.bincount([x for pair in links for x in pair], minlength=len(rows))
    keys = [r[0] for r in rows]
    wanted = [(k, int(d), c, k == c) for k, d, c in zip(keys, degree, classes(keys, links))]
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
    assert embedding_dedup.near_embeddings(table.limit(0)).count() == 0


def test_bounds_never_exceed_distances():
    rng = np.random.default_rng(3)
    points, codes = rng.normal(size=(200, 6)), rng.normal(size=(9, 6))
    to_code = ((points[:, None] - codes[None]) ** 2).sum(2)
    near = to_code.argmin(1)
    radii = np.array([np.sqrt(to_code[near == c, c]).max(initial=0) for c in range(len(codes))])
    least = embedding_dedup.bounds(points, codes, radii)
    far = ((points[:, None] - points[None]) ** 2).sum(2)
    assert (least[:, near] <= far + 1e-9).all()


def test_folding():
    for word in ("IDIOT!!", "1d10t", "idіot", "i.d.i.o.t", "(idiot)", "ｉdiot"):
        assert toxicity.fold(word) == "idiot", word
    assert toxicity.plain(toxicity.fold("Ídïot!")) == "idiot" and toxicity.fold("chÓn") == "chón"
    assert toxicity.fold("2024") == "" and toxicity.fold("&&&") == ""


def test_toxicity_learns_weighs_and_excepts(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        body = prose(rng, 60, 300)
        bad = i % 4 == 0
        if bad:
            body.insert(rng.randrange(60), rng.choice(["idiot", "1D10T!", "loweisch", "loweient", "clown"]))
        elif i % 20 == 1:
            at = rng.randrange(59)
            body[at:at + 2] = ["clown", "fish"]
        rows.append((i, " ".join(body)))
        labels.append((i, int(bad)))
    docs = frame(spark, rows + [(9000, None), (9001, ""), (None, "idiot")])
    table = spark.createDataFrame(labels + [(9000, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit_model(docs, table, toxicity.Fit(weight=1.0))
    assert "=idiot" in model.lexicon or "idiot" in model.lexicon
    assert any("clown fish" in p for p in model.exceptions)
    scored = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert scored[9000].predicted == scored[9001].predicted == 0 and 0 <= scored[9000].score <= 1
    right = sum(scored[i].predicted == y for i, y in labels)
    assert right >= 0.97 * len(labels)
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_toxicity_without_labels(spark):
    docs = frame(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit_model(docs, none)
    assert {r.score for r in toxicity.score_toxicity(docs, model).collect()} == {0.5}
