"""How many references hold each n-gram, for tasks that ask for the n-grams of their own blocks of texts.

A block is one row: ids and words of many pairs of texts. It asks, in ranges of the hash, for its distinct n-grams, as sorted
differences of hashes, with the number of its references that hold each (0 for an n-gram of hypotheses only). A range adds these up and
answers in the same order, so no row is made for an n-gram. Sizes come two at a time: an n-gram that holds a shorter one of fewer than
two references is of fewer than two references itself, and isn't asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.sources.shared import written

#: Bytes that Java's \s matches.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_STEPS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A block's columns beside its number and ids, and those of what it asks.
COLUMNS = ("names", "lengths", "r", "h")
ASKED = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("k", pa.int32()), ("g", pa.binary()), ("n", pa.binary())])


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a table that is written go when it is there, not when the driver happens to collect its garbage. Its DataFrame is
    made inside, as it takes the setting when it is made."""
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.unset(_RELEASE) if before is None else spark.conf.set(_RELEASE, before)


def packed(x: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes: length and width in front, planes of nothing but zeros left out."""
    x = np.ascontiguousarray(x, dtype=np.int64)
    planes = x.view(np.uint8).reshape(-1, 8).T
    width = 0 if not len(x) else 8 if x.min() < 0 else (int(x.max()).bit_length() + 7) // 8
    head = np.array([len(x), width], dtype="<i4").tobytes()
    return head + pa.compress(planes[:width].tobytes(), codec="zstd", asbytes=True) if width else head


def unpacked(data: bytes) -> np.ndarray:
    size, width = np.frombuffer(data[:8], dtype="<i4").tolist()
    planes = np.zeros((size, 8), dtype=np.uint8)
    if width:
        planes[:, :width] = np.frombuffer(pa.decompress(data[8:], size * width, codec="zstd", asbytes=True), dtype=np.uint8).reshape(width, size).T
    return planes.view(np.int64).reshape(-1)


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, between white space, and the number of words of each text."""
    column = column.cast(pa.string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int32)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begins[first] = inside[first]
    at = np.flatnonzero(begins)
    starts = np.append((np.cumsum(inside, dtype=np.int32) - 1)[at], int(inside.sum())).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(starts.tobytes()), pa.py_buffer(data[inside].tobytes()))
    return words, np.diff(np.searchsorted(at, offsets))


def blocks_of(texts: DataFrame, limit: int) -> DataFrame:
    """(block, ids, ...) from (id, r, h): blocks of about `limit` words, or of one pair of texts, written. Words are places in the block's
    list of hashes, the most frequent first; a word of a hypothesis that is the reference's at its place is a zero."""
    kind = dict(texts.dtypes)["id"]

    def block(held):
        ids = pa.concat_arrays([b[0] for b in held])
        r_sizes, h_sizes = (np.concatenate([b[k] for b in held]) for k in (2, 4))
        known = pa.chunked_array([b[k] for k in (1, 3) for b in held], pa.string()).dictionary_encode().combine_chunks()
        known = known.chunk(0) if isinstance(known, pa.ChunkedArray) else known
        places = known.indices.to_numpy(zero_copy_only=False)
        names = pd.util.hash_array(known.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(places) else np.zeros(0, dtype=np.uint64)
        order = np.argsort(-np.bincount(places, minlength=len(names)), kind="stable") if len(places) else np.zeros(0, dtype=np.int64)
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        r, h = np.split(rank[places], [int(r_sizes.sum())])
        same = same_place(r, r_sizes, h_sizes)
        h = np.where(same == h, 0, h + 1)
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([lists, *(pa.array([packed(x)], pa.binary()) for x in (names[order].view(np.int64), np.concatenate([r_sizes, h_sizes]), r, h))], ["ids", *COLUMNS])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            (r, r_sizes), (h, h_sizes) = split_words(batch["r"]), split_words(batch["h"])
            ends = np.cumsum(r_sizes + h_sizes)
            r_ends, h_ends = np.append(0, np.cumsum(r_sizes)), np.append(0, np.cumsum(h_sizes))
            start = 0
            while start < batch.num_rows:
                before = int(ends[start - 1]) if start else 0
                end = max(int(np.searchsorted(ends, before + limit - size, "right")), start if held else start + 1)
                if end > start:
                    parts = [x[e[start] : e[end]] if isinstance(x, np.ndarray) else x.slice(e[start], e[end] - e[start]) for x, e in ((r, r_ends), (h, h_ends))]
                    held.append((batch["id"].slice(start, end - start), parts[0], r_sizes[start:end], parts[1], h_sizes[start:end]))
                    size += int(ends[end - 1]) - before
                if end < batch.num_rows:
                    yield block(held)
                    held, size = [], 0
                start = end
        if held:
            yield block(held)

    rows = texts.mapInArrow(run, f"ids array<{kind}>, " + ", ".join(f"{c} binary" for c in COLUMNS))
    return written(rows.select(F.monotonically_increasing_id().alias("block"), "ids", *COLUMNS))


def same_place(r: np.ndarray, r_sizes: np.ndarray, h_sizes: np.ndarray) -> np.ndarray:
    """For each word of the hypotheses the reference's word at its place, or -1."""
    row = np.repeat(np.arange(len(h_sizes)), h_sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(h_sizes) - h_sizes, h_sizes)
    at = np.repeat(np.cumsum(r_sizes) - r_sizes, h_sizes) + place
    return np.where(place < r_sizes[row], np.append(r, -1)[np.minimum(at, len(r))], -1)


class Words:
    """The words of a block: hashes, the texts that they stand in (a reference, then its hypothesis), and n-grams size by size."""

    def __init__(self, names: bytes, lengths: bytes, r: bytes, h: bytes):
        sizes = unpacked(lengths)
        self.rows = len(sizes) // 2
        r, h = unpacked(r), unpacked(h)
        h = np.where(h == 0, same_place(r, sizes[: self.rows], sizes[self.rows :]), h - 1)
        sides = sizes.reshape(2, -1)
        both = sides.T.reshape(-1)
        begins = (np.cumsum(both) - both).reshape(-1, 2).T
        place = [np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(len(x)) for begin, size, x in zip(begins, sides, (r, h), strict=True)]
        self.words, known = np.empty(len(r) + len(h), dtype=np.uint64), unpacked(names).view(np.uint64)
        for at, x in zip(place, (r, h), strict=True):
            self.words[at] = known[x]
        self.text = np.repeat(np.arange(2 * self.rows, dtype=np.int32), both)
        self.good, self.base = np.ones(len(self.words), dtype=bool), 1  # by place: does an n-gram of `base` words of several references begin there

    def sizes(self, n: int):
        """(k, hashes of the n-grams of k words, where they begin)."""

        def mixed(x):
            x = (x ^ (x >> np.uint64(30))) * _STEPS[1]
            x = (x ^ (x >> np.uint64(27))) * _STEPS[2]
            return x ^ (x >> np.uint64(31))

        rolled = np.zeros(len(self.words), dtype=np.uint64)
        for k in range(1, min(n, len(self.words)) + 1):
            rolled = mixed(rolled[: len(self.words) - k + 1] * _STEPS[0] + self.words[k - 1 :] + np.uint64(k))
            at = np.flatnonzero(self.text[: len(rolled)] == self.text[k - 1 :])
            yield k, rolled[at], at

    def askable(self, k: int, at: np.ndarray) -> np.ndarray:
        """Which n-grams hold only shorter ones that several references hold, as far as these are known."""
        found = np.ones(len(at), dtype=bool)
        for j in range(k - self.base + 1 if self.base > 1 else 0):
            found &= self.good[at + j]
        return found

    def counted(self, order: np.ndarray, dense: np.ndarray, at: np.ndarray):
        """(n-gram, row, count in the reference, count in the hypothesis) for n-grams numbered by `dense` in the order given."""
        text = self.text[at][order]
        row, side = text >> 1, text & 1
        first = np.flatnonzero(np.append(True, (dense[1:] != dense[:-1]) | (row[1:] != row[:-1]))) if len(row) else np.zeros(0, dtype=np.int64)
        h = np.add.reduceat(side, first, dtype=np.int64) if len(first) else first
        return dense[first], row[first], np.diff(np.append(first, len(row))) - h, h

    def known(self, k: int, keys: np.ndarray, at: np.ndarray, order: np.ndarray, dense: np.ndarray, answers: np.ndarray) -> np.ndarray:
        """References that hold each n-gram of `dense`: as answered, 1 for others (there are 0 or 1, which count alike)."""
        first = order[np.flatnonzero(np.append(True, dense[1:] != dense[:-1]))] if len(order) else order
        found = np.ones(len(first), dtype=np.int64)
        found[self.askable(k, at[first])] = answers
        return found

    def learn(self, k: int, at: np.ndarray, order: np.ndarray, dense: np.ndarray, found: np.ndarray) -> None:
        good = np.zeros(len(self.words), dtype=bool)
        several = np.empty(len(at), dtype=bool)
        several[order] = (found > 1)[dense]
        good[at] = several
        self.good, self.base = good, k


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of the keys, and numbers of equal keys in that order. Values of a key's high bits and its place are sorted, which
    takes a fraction of the time that an order of keys takes; keys that differ in their low bits only are put right after it."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    low = np.uint64((1 << (len(keys) - 1).bit_length()) - 1)
    values = (keys & ~low) | np.arange(len(keys), dtype=np.uint64)
    values.sort()
    order = (values & low).astype(np.int64)
    values &= ~low
    found = keys[order]
    alike = values[1:] == values[:-1]
    mixed = alike & (found[1:] != found[:-1])
    if mixed.any():
        run = np.cumsum(np.append(True, ~alike))
        hit = np.flatnonzero(np.isin(run, run[1:][mixed]))
        order[hit] = order[hit][np.lexsort((order[hit], found[hit]))]
        found = keys[order]
    return order, np.cumsum(np.append(True, found[1:] != found[:-1])) - 1


def answers_of(table: pa.Table) -> dict[int, np.ndarray]:
    """What a block was answered, by size, in the order of the n-grams' hashes."""
    rows = sorted(zip(table["k"].to_pylist(), table["g"].to_pylist(), table["n"].to_pylist(), strict=True), key=lambda x: x[:2])
    return {k: np.concatenate([unpacked(n) for j, _, n in rows if j == k]) for k in {x[0] for x in rows}}


def together(blocks: DataFrame, answers: DataFrame, run: Callable[[dict[str, pa.Scalar], pa.Table], pa.Table], schema: str) -> DataFrame:
    """run(block, its answers) for each block, which needs none."""

    def both(table):
        answer = pc.is_valid(table["k"])
        own = table.filter(pc.invert(answer))
        return run({c: own[c][0] for c in own.column_names}, table.filter(answer).select(["k", "g", "n"]))

    return blocks.unionByName(answers, allowMissingColumns=True).groupBy("block").applyInArrow(both, schema)


def frequencies(blocks: DataFrame, number: int, n: int) -> list[DataFrame]:
    """Tables (block, k, g, n) of `number` blocks: for the n-grams of k words that a block asks for in the range g of hashes, how many references
    hold each, in the order of their hashes. The last table isn't written."""
    spark = blocks.sparkSession
    parts = max(number // 2, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    edges = np.array([(k << 64) // parts for k in range(parts)], dtype=np.uint64)
    shared = np.uint64(parts.bit_length() - 1)  # bits that the distance to a range's edge leaves free

    def asked(words, block, sizes, answers):
        """Rows for each range of hashes."""
        for k, keys, at in words.sizes(sizes[-1]):
            if k < sizes[0] and k % 2 == 0:
                order, dense = numbered(keys)
                words.learn(k, at, order, dense, words.known(k, keys, at, order, dense, answers.get(k, np.zeros(0, dtype=np.int64))))
            if k < sizes[0]:
                continue
            wanted = np.flatnonzero(words.askable(k, at)) if k > 1 else np.arange(len(at))
            keys, at = keys[wanted], at[wanted]
            order, dense = numbered(keys)
            gram, _, r, _ = words.counted(order, dense, at)
            keys = keys[order][np.flatnonzero(np.append(True, dense[1:] != dense[:-1]))] if len(keys) else keys
            counts = np.bincount(gram, weights=r > 0, minlength=len(keys)).astype(np.int64)
            cuts = np.append(np.searchsorted(keys, edges), len(keys))
            some = np.flatnonzero(np.diff(cuts))
            steps = np.diff(keys, prepend=np.uint64(0))
            steps[cuts[some]] = keys[cuts[some]] - edges[some]
            data = [(int(p), block, k, packed(steps[cuts[p] : cuts[p + 1]].view(np.int64)), packed(counts[cuts[p] : cuts[p + 1]])) for p in some]
            yield pa.RecordBatch.from_pylist([dict(zip(ASKED.names, x, strict=True)) for x in data], ASKED)

    def added(table):
        """Counts of all blocks in a range, to each block that asked."""
        keys = [np.cumsum(unpacked(x).view(np.uint64), dtype=np.uint64) << shared for x in table["g"].to_pylist()]
        sizes = [len(x) for x in keys]
        order, dense = numbered(np.concatenate(keys))
        del keys
        counts = np.concatenate([unpacked(x) for x in table["n"].to_pylist()])[order]
        counts[order] = np.add.reduceat(counts, np.flatnonzero(np.append(True, dense[1:] != dense[:-1])))[dense]
        return pa.table([table["block"], table["k"], table["part"], pa.array([packed(x) for x in np.split(counts, np.cumsum(sizes)[:-1])], pa.binary())], names=["block", "k", "g", "n"])

    schema = "part int, block long, k int, g binary, n binary"
    found: list[DataFrame] = []
    for low in range(1, n + 1, 2):
        sizes = list(range(low, min(low + 1, n) + 1))
        if low == 1:

            def first(batches, sizes=sizes):
                for batch in batches:
                    for row in batch.to_pylist():
                        yield from asked(Words(*(row[c] for c in COLUMNS)), row["block"], sizes, {})

            rows = blocks.drop("ids").mapInArrow(first, schema)
        else:

            def later(block, answers, sizes=sizes):
                return pa.Table.from_batches(asked(Words(*(block[c].as_py() for c in COLUMNS)), block["block"].as_py(), sizes, answers_of(answers)), ASKED)

            rows = together(blocks.drop("ids"), reduce(DataFrame.unionAll, found).where(F.col("k") % 2 == 0), later, schema)
        found.append(rows.groupBy("part").applyInArrow(added, "block long, k int, g int, n binary"))
        if low + 2 <= n:
            with released(spark):
                found[-1] = written(found[-1].select("*"))
    return found
