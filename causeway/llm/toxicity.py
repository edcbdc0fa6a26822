"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Words are folded first: case, homoglyphs of other scripts, digits and signs that stand for letters;
a word whose accents hide a plain lexicon word matches it too. The lexicon is learned: smoothed log-odds of folded words and word beginnings between toxic
and other training texts. A text's evidence is the weight of its hits, without those inside
exception phrases, taken as it is and normalised by length; a small logistic model turns it into a
score. Fitting uses at most ``sample`` labelled rows; scoring is one pass over all texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

# Letters that look like Latin ones, and signs written for letters.
HOMOGLYPHS = str.maketrans(
    "абвгеёзиіїјкмнорстухѕԁԛԝαβεικνορτυχηω", "abbreezniijkmhopctyxsdqwabeiknoptuxnw")
SIGNS = str.maketrans("013456789@$!|+€", "oieasgtbgasilte")

_WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")
_EDGE = re.compile(r"^[^\w@$]+|[^\w]+$")
_INNER = re.compile(r"[^\w@$!|+€]|_")


@dataclass(frozen=True)
class Fit:
    """``sample`` bounds the labelled rows used, ``terms`` the lexicon, ``phrases`` the exceptions."""

    sample: int = 30_000
    terms: int = 5_000
    phrases: int = 1_000
    shortest: int = 4
    longest: int = 7
    support: int = 5
    weight: float = 3.0


@dataclass(frozen=True)
class Model:
    """Lexicon (``=word`` whole, ``word`` as a beginning), exceptions, and logistic weights."""

    lexicon: dict[str, float]
    exceptions: frozenset[str]
    weights: tuple[float, ...]


def plain(word: str) -> str:
    """The word without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def fold(word: str) -> str:
    """The folded word, empty if it holds no letters. Accents stay: they tell words apart."""
    word = _EDGE.sub("", word.lower())
    if not word.isascii():
        word = unicodedata.normalize("NFKC", word).translate(HOMOGLYPHS)
    if not word.isalpha():
        word = _INNER.sub("", word)
        if sum(map(str.isalpha, word)) >= 2:
            word = word.translate(SIGNS)
    return word if word.isalpha() else ""


class Folded:
    """A batch of texts as codes of distinct folded words; ``first`` has n + 1 word offsets."""

    def __init__(self, texts: list[str]) -> None:
        words, cuts = [], [0]
        for text in texts:
            words += _WORD.findall(text)
            cuts.append(len(words))
        code, distinct = pd.factorize(np.array(words, object))
        number, self.values = pd.factorize(np.array([fold(w) for w in distinct], object))
        self.code = number[code] if len(code) else code
        self.first = np.array(cuts)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))


def _terms(word: str, fit: Fit) -> list[str]:
    if not word:
        return []
    return ["=" + word] + [word[:n] for n in range(fit.shortest, min(fit.longest, len(word)) + 1)]


def _term_counts(rows: DataFrame, fit: Fit) -> DataFrame:
    """(term, toxic, clean): texts that hold the term, summed per batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            folded = Folded(part.column(0).fill_null("").to_pylist())
            toxic = part.column(1).to_numpy().astype(bool)
            names: dict[str, int] = {}
            lists = [[names.setdefault(t, len(names)) for t in _terms(w, fit)] for w in folded.values]
            size = np.array([len(x) for x in lists], np.int64)
            flat = np.array([t for x in lists for t in x], np.int64)
            once = np.unique(folded.text * max(len(lists), 1) + folded.code)
            text, code = np.divmod(once, max(len(lists), 1))
            each = size[code] if len(code) else np.zeros(0, np.int64)
            begin = (np.cumsum(size) - size)[code] if len(code) else each
            places = np.repeat(begin - (np.cumsum(each) - each), each) + np.arange(each.sum())
            pair = np.unique(np.repeat(text, each) * max(len(names), 1) + flat[places])
            text, term = np.divmod(pair, max(len(names), 1))
            yes = np.bincount(term, weights=toxic[text], minlength=len(names)).astype(np.int64)
            every = np.bincount(term, minlength=len(names))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(names), pa.string()), pa.array(yes), pa.array(every - yes)],
                names=["term", "toxic", "clean"])

    return rows.mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _lexicon(rows: DataFrame, fit: Fit, toxic: int, clean: int) -> dict[str, float]:
    """Terms of high log-odds. Of a chain of beginnings with the same texts the longest stays."""
    weight = F.log((F.col("toxic") + 0.5) / (F.lit(toxic) - F.col("toxic") + 0.5)) - F.log(
        (F.col("clean") + 0.5) / (F.lit(clean) - F.col("clean") + 0.5))
    best = _term_counts(rows, fit).withColumn("weight", weight).filter(
        (F.col("toxic") >= fit.support) & (F.col("weight") >= fit.weight)).orderBy(
        F.desc("toxic"), "term").limit(fit.terms).collect()
    count = {r.term: r.toxic for r in best}
    longer = {t[:-1] for t, c in count.items() if not t.startswith("=") and count.get(t[:-1], 0) <= 1.05 * c}
    return {r.term: float(r.weight) for r in best if r.term not in longer}


class Matcher:
    """Scores distinct folded words with one automaton over all of them."""

    def __init__(self, model: Model) -> None:
        import ahocorasick

        self.model = model
        self.automaton = ahocorasick.Automaton()
        for term, weight in model.lexicon.items():
            pattern = f"\n{term[1:]}\n" if term.startswith("=") else f"\n{term}"
            self.automaton.add_word(pattern, (weight, len(pattern)))
        if model.lexicon:
            self.automaton.make_automaton()
        self.whole = {t[1:]: w for t, w in model.lexicon.items() if t.startswith("=") and t.isascii()}

    def weights(self, values) -> np.ndarray:
        """Per word the largest weight of a lexicon entry it matches, else 0."""
        found = np.zeros(len(values))
        if not self.model.lexicon or not len(values):
            return found
        joined = "\n" + "\n".join(values) + "\n"
        size = np.fromiter(map(len, values), np.int64, len(values))
        begin = np.cumsum(size + 1) - size  # where each word begins in the joined text
        hits = [(end - length + 1, weight) for end, (weight, length) in self.automaton.iter(joined)]
        if hits:
            place, weight = np.array(hits).T
            np.maximum.at(found, np.searchsorted(begin, place.astype(np.int64) + 1), weight)
        for i, word in enumerate(values):
            if not found[i] and not word.isascii():
                found[i] = self.whole.get(plain(word), 0.0)
        return found

    def features(self, texts: list[str]) -> tuple[np.ndarray, list[tuple[int, str]]]:
        """Per text: evidence, evidence by length, strongest hit; and (text, phrase) of all hits."""
        folded = Folded(texts)
        by_word = self.weights(folded.values)
        weight = by_word[folded.code] if len(folded.code) else np.zeros(0)
        phrases = []
        values = folded.values
        for at in np.flatnonzero(weight).tolist():
            text = folded.text[at]
            around = []
            if at > folded.first[text]:
                around.append(f"{values[folded.code[at - 1]]} {values[folded.code[at]]}")
            if at + 1 < folded.first[text + 1]:
                around.append(f"{values[folded.code[at]]} {values[folded.code[at + 1]]}")
            if self.model.exceptions.intersection(around):
                weight[at] = 0
            phrases += [(int(text), p) for p in around]
        n = len(texts)
        total = np.bincount(folded.text, weights=weight, minlength=n)
        length = np.maximum(np.diff(folded.first), 1)
        strongest = np.zeros(n)
        np.maximum.at(strongest, folded.text, weight)
        return np.stack([np.log1p(total), np.log1p(1000 * total / length), strongest], 1), phrases


def _phrases(rows: DataFrame, model: Model, fit: Fit) -> frozenset[str]:
    """Two-word phrases around a hit that training shows to be harmless."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for part in batches:
            found = sorted(set(matcher.features(part.column(0).fill_null("").to_pylist())[1]))
            toxic = part.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for _, p in found], pa.string()),
                 pa.array([int(toxic[t]) for t, _ in found], pa.int64())], names=["phrase", "toxic"])

    counted = rows.mapInArrow(run, "phrase string, toxic long").groupBy("phrase").agg(
        F.sum("toxic").alias("toxic"), F.count("*").alias("n"))
    harmless = counted.filter((F.col("n") >= fit.support) & (10 * F.col("toxic") <= F.col("n")))
    return frozenset(r.phrase for r in harmless.orderBy(F.desc("n"), "phrase").limit(fit.phrases).collect())


def _features(rows: DataFrame, model: Model) -> DataFrame:
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(model)
        for column in texts:
            found, _ = matcher.features(column.fill_null("").to_pylist())
            yield pa.array(list(found), pa.list_(pa.float64()))

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return rows.withColumn("_features", F.arrow_udf(run, "array<double>")("text"))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps; last entry is the intercept."""
    design = np.concatenate([x, np.ones((len(x), 1))], 1)
    ridge = np.diag([0.1] * x.shape[1] + [1e-6])
    w = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge,
                               design.T @ (p - y) + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def fit_model(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), key: str = "doc_id",
              text: str = "text", target: str = "toxic", exceptions: tuple[str, ...] = ()) -> Model:
    """Learn from rows whose crc32 of the key is not divisible by 5 and whose target is set.

    The sample is those labelled keys of smallest hash, which no property of a text can influence.
    A key that several rows share gives one row, that of its smallest text (a null is smallest).
    Without both classes in it the model scores every text alike, by the share of toxic ones.
    """
    prepare(docs.sparkSession)
    open_ = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{target}`").alias("toxic")).filter(
        F.col("toxic").isNotNull() & (F.crc32(F.col("key").cast("string")) % 5 != 0))
    chosen = open_.groupBy("key").agg(F.max("toxic").alias("toxic")).orderBy(
        F.xxhash64("key"), "key").limit(fit.sample)  # at most ``sample`` rows of two numbers
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).join(
        F.broadcast(chosen), "key").groupBy("key", "toxic").agg(
        F.min(F.struct("text")).getField("text").alias("text")).select(
        "text", F.col("toxic").cast("int").alias("toxic"))
    rows = rows.persist()  # read four times below
    try:
        sizes = {bool(r.toxic): r["count"] for r in rows.groupBy("toxic").count().collect()}
        toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
        if not toxic or not clean:
            share = (toxic + 0.5) / (toxic + clean + 1)
            return Model({}, frozenset(exceptions), (0.0, 0.0, 0.0, float(np.log(share / (1 - share)))))
        model = Model(_lexicon(rows, fit, toxic, clean), frozenset(exceptions), (0.0,) * 4)
        model = Model(model.lexicon, _phrases(rows, model, fit) | model.exceptions, model.weights)
        seen = _features(rows, model).select("_features", "toxic").toPandas()
        x = np.array(seen["_features"].tolist())
        return Model(model.lexicon, model.exceptions, _logistic(x, seen["toxic"].to_numpy(float)))
    finally:
        rows.unpersist()


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score and predicted added (replaced if there).

    A null or empty text has no evidence and gets the score of the intercept. Rows are scored by
    their text alone, so repeated rows score alike; other columns pass through.
    """
    prepare(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"),
                       F.col(f"`{text}`").alias("text"))
    linear = F.lit(model.weights[3])
    for i, w in enumerate(model.weights[:3]):
        linear = linear + F.col("_features")[i] * w
    scored = _features(rows, model).select("_row", (1 / (1 + F.exp(-linear))).alias("score"))
    return scored.select(*[F.col("_row")[c].alias(c) for c in kept], "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
