"""Counts and digests of op8 and op11 against plain matches, on rows with several spans of a kind."""

from __future__ import annotations

import re

from causeway.llm import queries
from helpers import sha

SCHEMA = "doc_id long, text string"
HEX = "0123456789abcdef"


def written(spark, folder, texts):
    path = f"{folder}/documents.parquet"
    spark.createDataFrame(list(enumerate(texts)), SCHEMA).coalesce(1).write.parquet(path)
    return str(folder)


def secrets(text):
    """(start, kind, end) of the contract's patterns."""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                        re.I | re.A)
    return sorted(
        [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
        + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def test_op8_counts_every_kind(spark, tmp_path):
    texts = [None, "", f"{HEX} {HEX} {HEX}", f"AKIA{'Q' * 16} AKIA{'Z' * 16}",
             f"token={HEX} and {HEX} {HEX}", f"é𝔸 api_key: '{'x' * 12}' PASSWORD={'y' * 11} AKIA{'1' * 14} {HEX}"]
    found = queries.op8_secret_scan(spark, written(spark, tmp_path, texts)).collect()
    names = ("assign", "access", "hex")
    for row in found:
        spans = secrets(texts[row.doc_id] or "")
        assert [row[f"n_{n}"] for n in names] == [sum(k == i for _, k, _ in spans) for i in range(3)], row
        assert row.base_sha256 == sha(",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans))
    assert len(found) == len(texts)


def luhn(digits):
    turned = [int(d) for d in reversed(digits)]
    return sum(turned[::2] + [d // 5 + d * 2 % 10 for d in turned[1::2]]) % 10 == 0


def personal(text):
    """(kind, start, end) of the contract's patterns."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = (
        [m for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        [m for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
         if all(int(p) <= 255 for p in m[0].split("."))],
        [m for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))],
        [m for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15])
    return [(k, *m.span()) for k, kind in enumerate(found) for m in kind]


def test_op11_counts_every_kind(spark, tmp_path):
    card = "4111 1111 1111 1111"
    texts = [None, "", "a@b.cd e@f.gh i@j.kl", f"{card}, {card}", "1.2.3.4 and 255.0.0.1 and 256.1.1.1",
             f"é𝔸 +44 20 7946 0958 and +1 (202) 555-0143; {card} x@y.z 10.0.0.1", "@@a@b@c.de +1"]
    found = queries.op11_personal_data(spark, written(spark, tmp_path, texts)).collect()
    names = ("email", "ip", "card", "phone")
    for row in found:
        spans = personal(texts[row.doc_id] or "")
        assert [row[f"n_{n}"] for n in names] == [sum(k == i for k, _, _ in spans) for i in range(4)], row
        assert row.base_sha256 == sha(",".join(f"{names[k]}:{s}:{e}" for k, s, e in spans))
    assert len(found) == len(texts)
