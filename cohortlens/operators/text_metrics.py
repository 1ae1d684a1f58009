"""Text overlap metrics: ROUGE-L by rows, CIDEr by blocks of texts that ask for the frequencies of their n-grams."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.stemming import rouge_stem
from cohortlens.operators import ngrams
from cohortlens.sources.shared import bounded_batches, written

_TOKEN = re.compile("[a-z0-9]+")
#: Words whose stems a task keeps from batch to batch.
STEMS = 1 << 18


def lcs_length(a: list[str], b: list[str]) -> int:
    """The length of a longest common subsequence, 64 and more cells at a time in the bits of an integer."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for k, token in enumerate(a):
        places[token] = places.get(token, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for at in map(places.get, b):
        if at:
            hit = row & at
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def rouge_l_f(reference: str | None, hypothesis: str | None, stem: Callable[[str], str] | None = None) -> float:
    """The F measure of the longest common subsequence of tokens; 0 if either side has none."""
    a, b = (_TOKEN.findall((x or "").lower()) for x in (reference, hypothesis))
    if stem:
        a, b = list(map(stem, a)), list(map(stem, b))
    common = lcs_length(a, b)
    return 2 * common / (len(a) + len(b)) if common else 0.0


def rouge_l(reference: Column, hypothesis: Column, stem: Callable[[str], str] | None = rouge_stem) -> Column:
    """ROUGE-L's F measure by rows over Porter stems; `stem` None compares the tokens as they are. A task stems a word once, as long
    as there are no more than STEMS at the end of a batch; a stem that one batch needs is made once in any case."""

    limit = STEMS

    @F.pandas_udf("double")
    def score(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        once = functools.cache(stem) if stem else None
        for refs, hyps in pairs:
            if once and once.cache_info().currsize > limit:
                once.cache_clear()
            yield pd.Series([rouge_l_f(r, h, once) for r, h in zip(refs, hyps, strict=True)], dtype="float64")

    return score(reference, hypothesis)


#: Words of both sides that a block of texts holds.
WORDS = 1 << 21
#: Without effect since no n-gram is sent to every task; tests set it.
COMMON = 0


def cider(df: DataFrame, id_col: str, reference: str, hypothesis: str, n: int = 4, sigma: float = 6.0) -> DataFrame:
    """(id, cider): consensus of TF-IDF n-grams (1 to n words) of a hypothesis with its reference, times 10. Ids are unique.

    Document frequencies come from all references. Counts are clipped to the reference's, and a difference in length is
    damped by a Gaussian. Words and n-grams are 64-bit hashes.

    The texts are read once and written as blocks of word numbers. Blocks ask for the frequencies of their distinct n-grams
    (`ngrams.frequencies`), so neither a key nor a table has rows for n-grams, and each block scores its own texts.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    texts = df.select(F.col(id_col).alias("id"), text(reference).alias("r"), text(hypothesis).alias("h"))
    blocks = ngrams.blocks_of(texts, WORDS)
    number, rows = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    *first, last = ngrams.frequencies(blocks, number, n)
    with ngrams.released(spark):
        last = written(last.select(F.struct("block", "k", "g").alias("g"), "n"))
    answers = reduce(DataFrame.unionAll, [*first, last.select("g.*", "n")])

    kind = dict(texts.dtypes)["id"]

    def scored(block, answers):
        known, words = ngrams.answers_of(answers), ngrams.Words(*(block[c].as_py() for c in ngrams.COLUMNS))
        total, delta = np.zeros(words.rows), np.zeros(words.rows)
        for k, keys, at in words.sizes(n):
            order, dense = ngrams.numbered(keys)
            found = words.known(k, keys, at, order, dense, known.get(k, np.zeros(0, dtype=np.int64)))
            gram, row, r, h = words.counted(order, dense, at)
            idf = np.where(found < rows, math.log(rows) - np.log(np.maximum(found, 1)), 0.0)[gram]
            dot, of_r, of_h = (np.bincount(row, weights=x * idf * idf, minlength=words.rows) for x in (np.minimum(h, r) * r, r * r, h * h))
            both = (of_r > 0) & (of_h > 0)
            total[both] += dot[both] / (np.sqrt(of_r[both]) * np.sqrt(of_h[both]))
            if k == 2:  # a sentence's length is its number of bigrams, as in the usual implementation
                delta = np.bincount(row, weights=h - r, minlength=words.rows)
            if k % 2 == 0:
                words.learn(k, at, order, dense, found)
        return pa.table([block["ids"].values, pa.array(10.0 * total / n * np.exp(-(delta * delta) / (2 * sigma * sigma)))], names=["id", "cider"])

    found = ngrams.together(blocks, answers, scored, f"id {kind}, cider double")
    return found.select(F.col("id").alias(id_col), "cider")
