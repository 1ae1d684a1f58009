"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton on folded text.

Folding lower-cases, drops zero-width characters, maps look-alike letters of other scripts to Latin ones and digits and
signs that stand for letters to these. Entries match whole words, or word beginnings if they are stems; a hit inside an
exception phrase doesn't count. The weighted hits and their rate by length are calibrated to a probability.

The lexicon is learned from a bounded sample of labelled rows (`per_class` of each label): terms are taken greedily, each
for the toxic texts that no earlier term covers. Terms are whole words of any length and word beginnings of STEMS letters.
Exception phrases are given, or learned: a term with the word before or after it that stands in clean texts far more often
than in toxic ones. Scoring is a map over the documents, without a shuffle.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import logistic
from .common import drop, map_arrow, save, text_column
from .sampling import bounded

PER_CLASS, STEMS = 4000, range(3, 8)
#: Sampled rows from which a term or phrase is told from chance.
LEAST = 4

# Letters that look like Latin ones, digits and signs that stand for letters, characters without width.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h",
    "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ѐ": "e", "ї": "i",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ϲ": "c", "ϳ": "j", "ո": "n", "օ": "o", "ս": "u", "հ": "h", "ɡ": "g", "ı": "i", "ɑ": "a", "ʟ": "l", "ⅼ": "l",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}
WIDTHLESS = "­​‌‍⁠﻿"
EXCEPTIONS = ("clown fish", "trash can", "trash bin", "pathetic fallacy")

_WORD = re.compile(r"[^\W\d_]+")
_WIDTHLESS = re.compile(f"[{WIDTHLESS}]")


@functools.cache
def _folds() -> tuple[dict[int, str], dict[int, str]]:
    alike = {ord(a): b for a, b in LOOK_ALIKES.items()}
    for first, last in ((0x2100, 0x214F), (0x2460, 0x24FF), (0xFF21, 0xFF5A), (0x1D400, 0x1D7FF), (0x1F130, 0x1F189)):
        for c in range(first, last + 1):
            plain = unicodedata.normalize("NFKC", chr(c)).lower()
            if len(plain) == 1 and plain.isascii() and plain.isalnum():
                alike.setdefault(c, plain)
    return alike, {**{ord(a): b for a, b in SUBSTITUTES.items()}, 9: " ", 10: " ", 13: " "}


@functools.cache
def _accents() -> dict[int, str]:
    out = {}
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(c))[0]
        if base.isascii() and base.isalpha():
            out[c] = base.lower()
    return out


def fold(text: str) -> tuple[str, str]:
    """(text with letters folded, the same with substitutes folded too); both of one length."""
    alike, substitutes = _folds()
    text = text.lower()
    if not text.isascii():
        text = _WIDTHLESS.sub("", text).translate(alike)
    return text, text.translate(substitutes)


@dataclass(frozen=True)
class Lexicon:
    """terms: (folded term, is it a stem, occurrences from which it counts, weight).

    probability = sigmoid(weights . features + intercept)."""

    terms: tuple[tuple[str, bool, int, float], ...]
    weights: tuple[float, float] = (1.0, 0.0)
    intercept: float = -3.0
    exceptions: tuple[str, ...] = EXCEPTIONS


def automaton(terms: list[tuple[str, bool]], exceptions: tuple[str, ...] = ()) -> ahocorasick.Automaton:
    entries: dict[str, list[tuple[int, bool]]] = {}
    for k, (term, stem) in enumerate(terms):
        entries.setdefault(term, []).append((k, stem))
    for phrase in exceptions:
        entries.setdefault(phrase, []).append((-1, False))
    made = ahocorasick.Automaton()
    for term, uses in entries.items():
        made.add_word(term, (len(term), uses))
    if entries:
        made.make_automaton()
    return made


def hits(text: str, made: ahocorasick.Automaton, least: list[int]) -> dict[int, int]:
    """Occurrences of each term by number, outside exception phrases, for the terms with their `least` number of them.

    Accented spellings of unaccented terms count too.
    """
    if not text or not len(made):
        return {}
    plain, substituted = fold(text)
    found = _spans(plain, substituted, made)
    if not plain.isascii():
        found |= _spans(plain, substituted.translate(_accents()), made)
    # of the exception phrases that begin at a place or before it, the farthest end
    excepted = sorted((a, b) for k, a, b in found if k < 0)
    begins, ends = [a for a, _ in excepted], list(accumulate((b for _, b in excepted), max))
    counts: dict[int, int] = {}
    for k, a, b in found:
        before = bisect_right(begins, a)
        if k >= 0 and not (before and b <= ends[before - 1]):
            counts[k] = counts.get(k, 0) + 1
    return {k: c for k, c in counts.items() if c >= least[k]}


def _spans(plain: str, folded: str, made: ahocorasick.Automaton) -> set[tuple[int, int, int]]:
    out, n = set(), len(folded)
    for last, (length, uses) in made.iter(folded):
        start, end = last + 1 - length, last + 1
        if start and plain[start - 1].isalnum():
            continue
        closed = end == n or not plain[end].isalnum()
        for k, stem in uses:
            if stem or closed:
                out.add((k, start, end))
    return out


def _features(total: float, words: int) -> tuple[float, float]:
    return math.log1p(total), math.log1p(100 * total / max(words, 1))


def _terms_of(text: str) -> set[str]:
    """The words of a text and their beginnings (`x*`, from two occurrences on also `x*2`)."""
    plain, substituted = fold(text)
    words = Counter(_WORD.findall(plain))
    if substituted != plain:
        for word in _WORD.findall(substituted):
            words.setdefault(word, 1)
    out, stems = set(words), Counter()
    for word, n in words.items():
        for k in STEMS:
            if k < len(word):
                stems[word[:k]] += n
    out.update(x + "*" for x in stems)
    out.update(x + "*2" for x, n in stems.items() if n > 1)
    return out


def _parsed(term: str) -> tuple[str, bool, int]:
    base, star, least = term.partition("*")
    return base, bool(star), int(least or 1)


def _candidates(batch: pa.RecordBatch) -> pa.RecordBatch:
    counts: dict[str, list[int]] = {}
    for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        for term in _terms_of(text or ""):
            counts.setdefault(term, [0, 0])[label] += 1
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([x[0] for x in counts.values()], pa.int64()), pa.array([x[1] for x in counts.values()], pa.int64())], ["term", "n0", "n1"])


def _presence(terms: list[str]):
    index = {t: k for k, t in enumerate(terms)}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [sorted(index[t] for t in _terms_of(x or "") if t in index) for x in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], ["terms"])

    return run


def phrases(text: str, made: ahocorasick.Automaton) -> set[str]:
    """Each matched term with the word before it and with the word after it, one blank between."""
    plain, folded = fold(text)
    size, out = len(folded), set()
    for _, start, end in _spans(plain, folded, made):
        while end < size and folded[end].isalnum():  # a stem's whole word
            end += 1
        first, last = start - 1, end + 1
        while first > 0 and _is_word(folded[first - 1]):
            first -= 1
        while last < size and _is_word(folded[last]):
            last += 1
        if start and folded[start - 1] == " " and first < start - 1:
            out.add(f"{folded[first : start - 1]} {folded[start:end]}")
        if end < size and folded[end] == " " and last > end + 1:
            out.add(f"{folded[start:end]} {folded[end + 1 : last]}")
    return out


def _is_word(c: str) -> bool:
    return c == "_" or c.isalnum()


def _phrases(terms: list[tuple[str, bool]]):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made, counts = automaton(terms), {}
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for phrase in phrases(text or "", made) if len(made) else ():
                counts.setdefault(phrase, [0, 0])[label] += 1
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([x[0] for x in counts.values()], pa.int64()), pa.array([x[1] for x in counts.values()], pa.int64())], ["phrase", "n0", "n1"])

    return run


def _counts(terms: list[tuple[str, bool, int]], exceptions: tuple[str, ...]):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = automaton([t[:2] for t in terms], exceptions)
        texts = [x or "" for x in batch.column(1).to_pylist()]
        found = [hits(t, made, [x[2] for x in terms]) for t in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t.split()) for t in texts], pa.int64()), pa.array([list(x) for x in found], pa.list_(pa.int32())), pa.array([list(x.values()) for x in found], pa.list_(pa.int32()))],
            ["y", "words", "terms", "counts"],
        )

    return run


def select(terms: list[str], rows: list[list[int]], against: np.ndarray, cover: int = 3) -> list[int]:
    """Greedy choice of terms: each for the toxic rows that have fewer than `cover` terms so far, three times less for every
    clean row that it hits (`against`), which must be LEAST at least. Of nested terms only one is taken, a whole word or a longer stem before others that
    gain as much. `rows` are the terms of each toxic row; terms are taken until none gains."""
    if not terms:
        return []
    at_row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at_term = np.fromiter((t for r in rows for t in r), dtype=np.int64, count=len(at_row))
    needed = np.full(len(rows), cover)
    parsed = [_parsed(t) for t in terms]
    specific = np.array([(0 if stem else 100) + len(base) for base, stem, _ in parsed])
    usable = np.ones(len(terms), dtype=bool)
    chosen: list[int] = []
    while True:
        new = np.bincount(at_term, weights=needed[at_row] > 0, minlength=len(terms))
        gain = np.where(usable & (new >= LEAST) & (new > 3 * against), new - 3 * against, 0)
        best = int(np.lexsort((specific, gain))[-1])
        if gain[best] <= 0:
            return chosen
        chosen.append(best)
        needed[at_row[at_term == best]] -= 1
        base = parsed[best][0]
        for k, (other, _, _) in enumerate(parsed):
            if base.startswith(other) or parsed[best][1] and other.startswith(base):
                usable[k] = False


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Learn a lexicon from labelled documents; rows with a null id, text or label are skipped, an id counts once.

    At most `per_class` rows of each label are used, the ones with the smallest id hashes; what reaches the driver is bounded
    by them: all terms that stand in four toxic rows or more, and in more than three times as many as clean ones. `exceptions`
    are added to the learned phrases. Without both labels the result is an empty lexicon that gives every text the observed
    share of label 1 (or 0 without labels).
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    shares = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    prior = shares.get(1, 0) / max(sum(shares.values()), 1)
    if len(shares) < 2:
        return Lexicon((), intercept=50.0 if prior == 1 else -50.0, exceptions=exceptions)
    chosen = F.broadcast(bounded(known, "id", "y", per_class).dropDuplicates(["id"]))  # 2 * per_class rows of 12 bytes
    sample = save(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(chosen, "id").select("y", "text"), "toxic-sample")

    counted = map_arrow(sample, _candidates, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    top = sorted((r["term"], r["n0"]) for r in counted.where(f"n1 >= {LEAST} and n1 > 3 * n0").collect())
    names = [term for term, _ in top]
    rows = [r["terms"] for r in map_arrow(sample.where("y = 1").select("text"), _presence(names), "terms array<int>").collect()]
    terms = [_parsed(names[k]) for k in select(names, rows, np.array([n0 for _, n0 in top]))]
    around = map_arrow(sample, _phrases([t[:2] for t in terms]), "phrase string, n0 long, n1 long").groupBy("phrase").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    learned = [r["phrase"] for r in around.where(f"n0 >= {LEAST} and n0 > 3 * n1").select("phrase").collect()]
    exceptions = tuple(sorted({*exceptions, *learned}))
    found = map_arrow(sample, _counts(terms, exceptions), "y int, words long, terms array<int>, counts array<int>").collect()
    drop(sample)

    y = np.array([r["y"] for r in found])
    if len(set(y.tolist())) < 2:  # the labelled rows of one class have no texts
        return Lexicon((), intercept=50.0 if prior == 1 else -50.0, exceptions=exceptions)
    n1, n0 = max(int((y == 1).sum()), 1), max(int((y == 0).sum()), 1)
    with_term = np.zeros((2, len(terms)))
    for r in found:
        for k in r["terms"]:
            with_term[r["y"], k] += 1
    weight = np.maximum(np.log((with_term[1] + 0.5) / (n1 + 1)) - np.log((with_term[0] + 0.5) / (n0 + 1)), 0.1)
    x = np.array([_features(sum(weight[k] * c for k, c in zip(r["terms"], r["counts"], strict=True)), r["words"]) for r in found]).reshape(-1, 2)
    beta, intercept = logistic.fit(x, y, prior)
    if beta.min() < 0:  # a score must not fall with more hits
        keep = int(np.argmax(beta))
        one, intercept = logistic.fit(x[:, [keep]], y, prior)
        beta = np.zeros(2)
        beta[keep] = max(float(one[0]), 0.0)
    return Lexicon(tuple((*t, float(w)) for t, w in zip(terms, weight, strict=True)), (float(beta[0]), float(beta[1])), intercept, exceptions)


def scorer(lexicon: Lexicon):
    def score(texts: list[str | None]) -> list[pa.Array]:
        made = automaton([t[:2] for t in lexicon.terms], lexicon.exceptions)
        least = [t[2] for t in lexicon.terms]
        x = np.zeros((len(texts), 2))
        total = []
        for k, text in enumerate(texts):
            found = hits(text or "", made, least)
            if found:
                x[k] = _features(sum(lexicon.terms[t][3] * c for t, c in found.items()), len(text.split()))
            total.append(sum(found.values()))
        p = logistic.sigmoid(x @ np.array(lexicon.weights) + lexicon.intercept)
        return [pa.array(p, pa.float64()), pa.array(total, pa.int64())]

    return score


def toxicity(df: DataFrame, text: Column, lexicon: Lexicon) -> Column:
    """A struct (score, hits); a null or empty text has no hits and the score of the intercept."""
    return text_column(df.sparkSession, scorer(lexicon), "score double, hits long")(text)


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, hits, predicted), a row for each input row, repeated ones too; other columns are not read.

    Null and empty texts have the lexicon's base score; a score equal to the threshold predicts 1. An empty input gives no rows.
    """
    found = docs.select(F.col(id_col), toxicity(docs, F.col(text_col), lexicon).alias("found"))
    return found.select(id_col, "found.score", "found.hits", (F.col("found.score") >= threshold).cast("int").alias("predicted"))
