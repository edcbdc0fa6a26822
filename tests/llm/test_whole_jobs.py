"""What a reviewer found left out: small cases that the operators have to do in full."""

from __future__ import annotations

import base64
import gzip
import io
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from causeway.llm import embedding_dedup, line_dedup, secret_scan, toxicity

SECRET = b"password=abcdefghijklmnop1"


def _wrapped(data: bytes, width: int, first: int | None = None) -> str:
    text = base64.b64encode(data).decode()
    first = width if first is None else first
    return "\n".join([text[:first], *[text[i: i + width] for i in range(first, len(text), width)]])


def _tar() -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as archive:
        info = tarfile.TarInfo("a.env")
        info.size = len(SECRET)
        archive.addfile(info, io.BytesIO(SECRET))
    return out.getvalue()


def _payloads():
    noise = random.Random(1).randbytes(300)
    plain = b"".join(b"line %d of a text; " % i for i in range(40))
    one = lambda b: base64.b64encode(b).decode()
    return {
        "gzip of tar": one(_tar()), "with a NUL": one(b"a\0" + SECRET), "Latin-1": one(b"\xe9 " + SECRET),
        "percent %E9": "%E9" + "".join(f"%{b:02X}" for b in SECRET),
        "percent %00": "%00" + "".join(f"%{b:02X}" for b in SECRET),
        "wrapped at 76": _wrapped(plain[:45] + SECRET + plain, 76),
        "wrapped at 64, packed": _wrapped(gzip.compress(noise + plain + SECRET), 64),
        "begins on a line": _wrapped(gzip.compress(noise + SECRET), 76, 10),
        "indented": _wrapped(gzip.compress(noise + SECRET), 64).replace("\n", "\r\n    "),
        "PEM": "-----BEGIN X-----\n" + _wrapped(noise[:40] + SECRET + noise, 64) + "\n-----END X-----",
        "two members": one(gzip.compress(b"first") + gzip.compress(SECRET)),
    }


@pytest.mark.parametrize("name", _payloads())
def test_secret_in_any_bytes_and_wrapping_is_found(name):
    inner = _payloads()[name]
    spans = secret_scan.find_secrets(f"see {inner} end")
    assert any(kind == 0 and start < 4 + len(inner) and end > 4 for start, end, kind in spans[1])
    assert not spans[0] and spans[2] == 0


@pytest.mark.parametrize("at", [0, 900, 990, 1000, 1990, 20_000])
def test_large_payload_is_scanned_in_pieces(at):
    body = (b". " * 15_000)[:at] + SECRET + b". " * 15_000
    for packed in (gzip.compress(body), gzip.compress(gzip.compress(body))):
        text = base64.b64encode(packed).decode()
        assert secret_scan.find_secrets(text, secret_scan.Limits(layer_bytes=1000))[1:] == (
            [(0, len(text), 0)], 0)


def test_refused_payloads_are_reported_and_replaced(spark):
    from causeway.llm import queries

    bomb = base64.b64encode(gzip.compress(b". " * 50_000)).decode()
    docs = spark.createDataFrame([(1, f"a {bomb} b"), (2, "c"), (3, None)], "doc_id long, text string")
    found = secret_scan.redact(docs, limits=secret_scan.Limits(total_bytes=5000)).collect()
    assert {r.doc_id: (r.text, r.refused) for r in found} == {
        1: ("a [UNSCANNED] b", 1), 2: ("c", 0), 3: (None, 0)}
    assert "refused" in queries.op8_secret_scan(spark, "/root/testdata/sf0.001").columns


def test_equal_lines_go_from_two_documents_on(spark):
    texts = {1: "All rights reserved.\nfirst own line of five words\n\n12 34 56 78 90",
             2: "one\nAll rights reserved.\n\nthis very line is in two documents",
             3: "this very line is in two documents\n12 34 56 78 90\nAll rights reserved. \n\ntwo"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = line_dedup.dedup_lines(docs, tree=line_dedup.Tree(exact_docs=2))
    assert {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in found.collect()} == {
        1: (texts[1], 4, 0), 2: ("one\n\nthis very line is in two documents", 4, 1),
        3: ("All rights reserved. \n\ntwo", 5, 2)}


def test_a_repeated_id_gives_one_row_to_the_fit(spark, monkeypatch):
    docs = spark.createDataFrame(
        [(i, f"word{i} idiot" if i % 2 else f"word{i}") for i in range(40)]
        + [(1, f"word1 zzz{i}") for i in range(500)] + [(3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    seen, fitted = [], toxicity._logistic
    monkeypatch.setattr(toxicity, "_logistic", lambda x, y: seen.append(len(y)) or fitted(x, y))
    toxicity.fit_model(docs, labels, toxicity.Fit(sample=20))
    assert seen == [20]


def test_pipeline_keeps_one_row_of_a_group_that_shares_its_id(spark):
    import corpus_pipeline

    body = " ".join(f"w{i}" for i in range(80))
    other = " ".join(f"v{i}" for i in range(80))
    texts = [(7, body), (7, body + " a"), (7, body + " b"), (9, body + " c"), (7, body),
             (None, other), (None, other + " a"), (None, "alone " * 3), (7, "no copy of anything here"), (2, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in texts],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_copies(spark, docs.repartition(3), "").collect()
    groups = sorted((str(r.doc_id), r.text.split(" ")[0]) for r in kept)
    assert groups == [("2", ""), ("7", "no"), ("7", "w0"), ("None", "alone"), ("None", "v0")]


@pytest.mark.parametrize("step", ["homes", "visits"])
def test_vector_lengths_without_a_codebook_have_one_cell(spark, step):
    nodes = spark.createDataFrame(
        [(0, len(v), bytes([i]), 1, v) for i, v in enumerate([[1.0], [2.0, 1.0], [3.0, 1.0, 2.0], [1.0, 0.0, 0.0]])],
        "label int, dim long, node binary, weight long, vector array<float>")
    found = embedding_dedup._homes(nodes, {})
    if step == "visits":
        index = embedding_dedup.Index()
        found = embedding_dedup._visits(embedding_dedup._blocks(found, index), {}, {}, index).withColumns(
            {"i": F.col("i2"), "j": F.col("j2")})
    found = found.collect()
    if step == "visits":  # one block of each length
        assert sorted((r.dim, r.i, r.j) for r in found) == [(1, 0, 0), (2, 0, 0), (3, 0, 0)]
        return
    assert sorted((r.dim, r.i, r.j) for r in found) == [(1, 0, 0), (2, 0, 0), (3, 0, 0), (3, 0, 0)]


def test_a_hot_cell_meets_in_blocks_and_extra_columns_may_clash(spark):
    """A third of the vectors in one cell: pairs of its parts, each pair once, keys only."""
    rng = np.random.default_rng(11)
    middle = rng.normal(size=16)
    near = [middle + rng.normal(size=16) * 0.02 for _ in range(60)]
    rows = [(i, [float(x) for x in v], 0, 1, "x") for i, v in enumerate(near + list(rng.normal(size=(120, 16))))]
    table = spark.createDataFrame(
        rows, "vec_id long, embedding array<float>, label int, weight int, node string")
    index = embedding_dedup.Index(block=16)
    found = {r.vec_id: r for r in embedding_dedup.near_embeddings(table, index=index).collect()}
    unit = [np.float32(v) / np.linalg.norm(np.float32(v).astype(float)) for _, v, *_ in rows]
    for i in range(60):
        assert found[i].n_links == sum(float(unit[i] @ unit[j]) >= 0.98 for j in range(180) if j != i)
    nodes = spark.createDataFrame(
        [(0, 16, i.to_bytes(2, "big"), 1, v) for i, v, *_ in rows[:60]],
        "label int, dim long, node binary, weight long, vector array<float>")
    blocks = embedding_dedup._blocks(embedding_dedup._homes(nodes, {}), index)
    parts = blocks.count()
    pairs = embedding_dedup._pairs(embedding_dedup._visits(blocks, {}, {}, index), blocks)
    assert parts > 2 and pairs.count() == parts * (parts + 1) // 2
