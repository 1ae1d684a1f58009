"""Periodic runs of words, from a suffix array, its longest-previous-factor array and the LZ blocks that this gives.

A run is a stretch of words with smallest period q (words q apart are identical) that no neighbouring word extends. The
words of a piece of the input (many documents, each followed by a word of its own, or one long document) become one
sequence of numbers. Prefix doubling sorts its suffixes; the classes of every round stay, so that common extensions of any
two places, forwards or backwards, are a few vector steps. The suffix array and the LCP of its neighbours give the
longest previous factor of every place, and these the LZ blocks.

A run touches a border of two blocks or lies inside one block. At each border Main's extensions find the runs that touch it;
only periods up to 2 / (exponent - 1) of the longer neighbouring block can have one that no other border finds: behind a run's
first period, a block that begins in it reaches its end. A run inside a block is a copy of one inside the block's earlier
occurrence, so runs, bucketed by their start, are copied block by block from left to right.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

Levels = list[np.ndarray]


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, Levels]:
    """The suffix array and, for every k, the classes of the stretches of 2**k codes at each place, until all differ.

    The class of a place is the first slot of its group in the suffix array; only groups of several places are sorted again.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    head = np.append(True, np.diff(codes[order]) != 0) if n else np.zeros(0, dtype=bool)
    rank = np.empty(n, dtype=np.int32)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0)) if n else 0
    levels, width = [rank], 1
    while True:
        alone = head & np.append(head[1:], True)
        slots = np.flatnonzero(~alone)
        if not len(slots):
            return order, levels
        at = order[slots]
        behind = at + width
        second = np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        key = rank[at].astype(np.int64) * (n + 1) + second
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[slots] = at
        head[slots] = new = np.append(True, np.diff(key) != 0)
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        levels.append(rank)
        width *= 2


def forward(levels: Levels, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many codes from i on equal those from j on, i < j."""
    n = len(levels[0])
    i, start = i.copy(), j
    j = j.copy()
    for k in range(len(levels) - 1, -1, -1):
        inside = j + (1 << k) <= n
        step = np.where(inside & (levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)]), 1 << k, 0)
        i += step
        j += step
    return j - start


def backward(levels: Levels, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many codes before i equal those before j, i < j."""
    start = i
    i, j = i.copy(), j.copy()
    for k in range(len(levels) - 1, -1, -1):
        width = 1 << k
        step = np.where((i >= width) & (levels[k][np.maximum(i - width, 0)] == levels[k][np.maximum(j - width, 0)]), width, 0)
        i -= step
        j -= step
    return start - i


def previous_factors(order: np.ndarray, levels: Levels) -> tuple[list[int], list[int]]:
    """(LPF, where): the longest factor from each place on that also begins earlier, and a place where it does.

    Places leave a list in the suffix array's order from the last one to the first, so a place's neighbours in it lie before
    it. Factors of a single word are left out (0): a block of one word is one either way.
    """
    n = len(order)
    lpf, source = [0] * n, [0] * n
    pairs = levels[1] if len(levels) > 1 else levels[0]
    counts = np.bincount(pairs, minlength=n + 1)
    places = order[counts[pairs[order]] > 1]
    if not len(places):
        return lpf, source
    lcp = np.zeros(len(places) + 2, dtype=np.int64)
    low, high = np.minimum(places[:-1], places[1:]), np.maximum(places[:-1], places[1:])
    lcp[2:-1] = forward(levels, low, high)
    lcp[lcp == 1] = 0
    common = lcp.tolist()
    before, after = list(range(-1, len(places) + 1)), list(range(1, len(places) + 3))
    at = [0, *places.tolist(), 0]
    for slot in (np.argsort(places, kind="stable")[::-1] + 1).tolist():
        p, q = before[slot], after[slot]
        a, b = common[slot], common[q]
        if a < b:
            lpf[at[slot]], source[at[slot]] = b, at[q]
            common[q] = a  # the neighbours' common part is the smaller one
        elif a:
            lpf[at[slot]], source[at[slot]] = a, at[p]
        after[p] = q
        before[q] = p
    return lpf, source


def blocks(lpf: list[int]) -> np.ndarray:
    """Where the LZ blocks begin."""
    inside, end = np.zeros(len(lpf) + 1, dtype=np.int8), 0
    for i in np.flatnonzero(lpf).tolist():
        if i >= end:
            end = i + lpf[i]
            inside[i + 1] += 1
            inside[end] -= 1
    return np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8) == 0)


def _at_borders(codes: np.ndarray, levels: Levels, starts: np.ndarray, length: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs that touch a border of blocks, by start."""
    n = len(codes)
    sizes = np.diff(np.append(starts, n))
    reach = 2 * np.maximum(sizes, np.append(0, sizes[:-1])) // (exponent - 1)
    border = np.repeat(starts, reach)
    period = np.arange(len(border)) - np.repeat(np.cumsum(reach) - reach, reach) + 1
    found = []
    # one half of a run at least lies on one side of the border, so a word there equals the one a period further
    for shift, probe in ((0, 0), (-1, -1)):
        left, right = border + shift * period, border + (1 + shift) * period
        some = np.flatnonzero((left + probe >= 0) & (right + probe < n))
        some = some[codes[left[some] + probe] == codes[right[some] + probe]]
        i, j, q = left[some], right[some], period[some]
        start, end = i - backward(levels, i, j), j + forward(levels, i, j)
        long = end - start >= np.maximum(length, exponent * q)
        found.append((start[long], end[long], q[long]))
    start, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    first = np.append(True, (np.diff(start) != 0) | (np.diff(end) != 0)) if len(start) else np.zeros(0, dtype=bool)
    return start[first], end[first], period[first]  # a multiple of the period spans the same words


def all_runs(codes: np.ndarray, length: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, end, period) of every run of at least `length` codes and `exponent` periods, by start, then period.

    The last code must occur only once.
    """
    order, levels = suffix_array(codes)
    lpf, source = previous_factors(order, levels)
    starts = blocks(lpf)
    touching = list(zip(*(x.tolist() for x in _at_borders(codes, levels, starts, length, exponent)), strict=True))
    found, begins, waiting = [], [], 0

    def take(until: int) -> None:
        nonlocal waiting
        while waiting < len(touching) and touching[waiting][0] <= until:
            found.append(touching[waiting])
            begins.append(touching[waiting][0])
            waiting += 1

    if touching:
        for block in starts.tolist():
            size = lpf[block]
            if size < length + 2:
                continue
            take(block)
            shift, last = block - source[block], source[block] + size
            k = bisect_right(begins, source[block])
            while k < len(found) and found[k][0] < last:
                start, end, period = found[k]
                if end < last:
                    take(start + shift)
                    found.append((start + shift, end + shift, period))
                    begins.append(start + shift)
                k += 1
        take(len(codes))
    return sorted(found, key=lambda run: (run[0], run[2]))


def _found(length: int, exponent: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        words = [(t or b"").split() for t in texts]  # bytes are split at 0x20 and 0x09-0x0D
        sizes = np.fromiter((len(some) for some in words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes + 1)
        firsts = (ends - sizes - 1).tolist()
        codes = np.repeat(-1 - np.arange(len(words)), sizes + 1)  # each document's last code is its own
        is_word = np.ones(len(codes), dtype=bool)
        is_word[ends - 1] = False
        codes[is_word] = pa.array([w for some in words for w in some], pa.binary()).dictionary_encode().indices.to_numpy()
        spans: list[list] = [[] for _ in words]
        found = all_runs(codes, length, exponent)
        owners = np.searchsorted(firsts, [r[0] for r in found], side="right") - 1
        for (start, end, period), k in zip(found, owners.tolist(), strict=True):
            spans[k].append((start - firsts[k], end - start, period))
        kept = []
        for some, mine in zip(words, spans, strict=True):
            if mine:
                gone = np.zeros(len(some) + 1, dtype=np.int64)
                for start, size, period in mine:
                    gone[start + period] += 1
                    gone[start + size] -= 1
                some = [w for w, x in zip(some, np.cumsum(gone).tolist(), strict=False) if not x]
            kept.append(b" ".join(some))
        flat = np.array([x for mine in spans for x in mine], dtype=np.int64).reshape(-1, 3)
        offsets = np.cumsum([0, *(len(mine) for mine in spans)]).astype(np.int32)
        items = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"])
        counts = pa.array(sizes)
        return pa.RecordBatch.from_arrays([batch.column(0), counts, pa.ListArray.from_arrays(pa.array(offsets), items), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])

    return run


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 6, exponent: int = 4) -> DataFrame:
    """(id, n_words, runs, collapsed) of every row: all maximal runs of at least `length` words and `exponent` periods as
    array<struct<start, length, period>> by start, then period; and the words, joined by one space, without those that a run
    repeats (what a run holds behind its first period).

    Words are runs of anything but 0x20 and 0x09-0x0D. Null, empty and blank texts have no words and no runs; ids may be null or
    repeat, every row stands for itself; other columns are not read; an empty table gives an empty result. `exponent` must be
    3 or more.
    """
    if exponent < 3 or length < 1:
        raise ValueError("runs of fewer than three periods, or of no length, are not enumerated")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = map_arrow(source, _found(length, exponent), f"id {dict(source.dtypes)['id']}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return found.withColumnRenamed("id", id_col)
