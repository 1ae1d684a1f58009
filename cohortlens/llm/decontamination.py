"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters, digits and bytes beyond ASCII, in lower case. The runs of WIDTH words of a test item are its seeds;
an item of fewer words is its own only seed. A rare seed, one of RARE items at most, joins a document to its items one by one.
A seed of more items can't be left out, as in an edited copy it may be the only one that stands, but it is not worth a
comparison with each of them either: the words around it are looked up in all its items at once, and only items of which
enough words stand there to reach the threshold in any order go on. The document's words around an item's implied place are
then aligned with the item; the score is the local alignment's, divided by that of a perfect copy.

Test items are compiled in blocks of at most BLOCK_WORDS words into index files in the shared folder, which executors fetch
and memory-map, one copy for all their workers. Each block is a map over the corpus without a shuffle of texts.
"""

from __future__ import annotations

import functools
import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import map_arrow, save_bytes, text_column
from .hashing import gather, grams, words

WIDTH, BLOCK_WORDS, THRESHOLD = 3, 4_000_000, 0.5
#: Items of one seed up to which they are looked at one by one.
RARE = 8
MATCH, MISMATCH, GAP = 2, -1, -1

SEPARATORS = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return words([t.lower() for t in texts], SEPARATORS)


@dataclass
class Block:
    """Test items and their seeds of WIDTH words, sorted by hash: of which item and at which of its words.

    Items of fewer words are seeds themselves; `short` are the numbers of words that such items have.
    """

    bounds: np.ndarray  # first word of each item, and the end
    words: np.ndarray
    seeds: np.ndarray
    of: np.ndarray
    at: np.ndarray
    short: np.ndarray

    @classmethod
    def of_items(cls, texts: list[str]) -> Block:
        """Items without a word get no seeds."""
        words_, owner = word_hashes(texts)
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        lengths = np.diff(bounds)
        parts = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for width in (WIDTH, *range(1, WIDTH)):
            start = np.flatnonzero(lengths[owner] == width if width < WIDTH else lengths[owner] >= WIDTH)
            start = start[start + width <= bounds[owner[start] + 1]]
            parts[0].append(grams(words_, width)[start])
            parts[1].append(owner[start])
            parts[2].append(start - bounds[owner[start]])
        seeds, of, at = (np.concatenate(x) for x in parts)
        order = np.argsort(seeds, kind="stable")
        return cls(bounds, words_, seeds[order], of[order], at[order], np.unique(lengths[(lengths > 0) & (lengths < WIDTH)]))

    def item(self, k: int) -> np.ndarray:
        return self.words[self.bounds[k] : self.bounds[k + 1]]

    @functools.cached_property
    def filter(self) -> np.ndarray:
        """A table that tells by 20 bits of a hash that it isn't a seed."""
        out = np.zeros(1 << 20, dtype=bool)
        out[(self.seeds >> np.uint64(44)).astype(np.int64)] = True
        return out

    def found(self, hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of the texts' word runs that are seeds, number of the first equal seed)."""
        places, numbers = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for width in (*self.short.tolist(), WIDTH) if len(self.seeds) else ():
            g = grams(hashes, width)
            where = np.flatnonzero(self.filter[(g >> np.uint64(44)).astype(np.int64)] & (owner[: len(g)] == owner[width - 1 :]))
            first = np.minimum(np.searchsorted(self.seeds, g[where]), len(self.seeds) - 1)
            ok = self.seeds[first] == g[where]
            places.append(where[ok])
            numbers.append(first[ok])
        return np.concatenate(places), np.concatenate(numbers)

    @functools.cached_property
    def vocabulary(self) -> tuple[np.ndarray, np.ndarray]:
        """(the distinct words of all items, each item's words by their numbers in it)."""
        distinct, numbers = np.unique(self.words, return_inverse=True)
        return distinct, numbers.astype(np.int32)

    def around(self, hashes: np.ndarray, items: np.ndarray, begin: int, threshold: float) -> np.ndarray:
        """Those of the items of which enough words to reach the threshold stand about the place where they would begin."""
        distinct, numbers = self.vocabulary
        lengths = self.bounds[items + 1] - self.bounds[items]
        slack = slack_of(int(lengths.max()))
        some = hashes[max(0, begin - slack) : max(0, begin + int(lengths.max()) + slack)]
        at = np.minimum(np.searchsorted(distinct, some), len(distinct) - 1)
        there = np.zeros(len(distinct), dtype=np.int32)
        there[at[distinct[at] == some]] = 1
        standing = np.add.reduceat(there[gather(numbers, self.bounds[items], lengths)], np.cumsum(lengths) - lengths)
        return items[standing >= threshold * lengths]

    def payload(self) -> bytes:
        out = io.BytesIO()
        for x in (self.bounds, self.words, self.seeds, self.of, self.at, self.short):
            out.write(struct.pack("<q", len(x)) + x.astype("<u8").tobytes())
        return out.getvalue()

    @classmethod
    def map(cls, path: str) -> Block:
        """The block of an index file, memory-mapped."""
        flat, at, parts = np.memmap(path, dtype="<u8", mode="r"), 0, []
        for k in range(6):
            n = int(flat[at])
            part = flat[at + 1 : at + 1 + n]
            parts.append(part if k in (1, 2) else part.view(np.int64))
            at += n + 1
        return cls(*parts)


@functools.lru_cache(16)
def _mapped(name: str) -> Block:
    return Block.map(SparkFiles.get(name))


def shipped(spark, block: Block) -> str:
    """Write a block to the shared folder; the name under which executors find their copy."""
    path = save_bytes(spark, block.payload(), "items")
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(score, end) of the best local alignment; the first of equal ones. A row of the matrix is one pass over `text`."""
    slope = np.arange(1, len(text) + 1) * -GAP
    row = np.zeros(len(text) + 1, dtype=np.int64)
    best, end = 0, 0
    for word in item:
        step = np.maximum(row[:-1] + np.where(text == word, MATCH, MISMATCH), row[1:] + GAP)
        np.maximum(step, 0, out=step)
        row[1:] = np.maximum.accumulate(step + slope) - slope  # gaps in the item
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def slack_of(length: int) -> int:
    """How many words before and after its implied place an edited copy of an item is looked for."""
    return max(4, length // 2)


def _places(block: Block, hashes: np.ndarray, owner: np.ndarray, bounds: np.ndarray, threshold: float) -> dict[tuple[int, int], set[int]]:
    """{(text, item): where the item would begin} as its seeds say, as places among all words of the texts."""
    where, first = block.found(hashes, owner)
    many = np.searchsorted(block.seeds, block.seeds[first], side="right") - first
    places: dict[tuple[int, int], set[int]] = {}
    rare = many <= RARE
    for position, k, n in zip(where[rare].tolist(), first[rare].tolist(), many[rare].tolist(), strict=True):
        for j in range(k, k + n):
            places.setdefault((int(owner[position]), int(block.of[j])), set()).add(position - int(block.at[j]))
    common: dict[tuple[int, int], list[np.ndarray]] = {}
    for position, k, n in zip(where[~rare].tolist(), first[~rare].tolist(), many[~rare].tolist(), strict=True):
        begins = position - block.at[k : k + n]
        by = np.argsort(begins, kind="stable")
        cuts = np.flatnonzero(np.diff(begins[by])) + 1
        for group in np.split(by, cuts):
            common.setdefault((int(owner[position]), int(begins[group[0]])), []).append(block.of[k + group])
    for (doc, begin), items in common.items():
        a, b = int(bounds[doc]), int(bounds[doc + 1])
        for item in block.around(hashes[a:b], np.unique(np.concatenate(items)), begin - a, threshold).tolist():
            places.setdefault((doc, item), set()).add(begin)
    return places


def _matches(block: Block, texts: list[str], threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(text, item, score, first word, word after the last) of each text and item at or above the threshold."""
    hashes, owner = word_hashes(texts)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    places = _places(block, hashes, owner, bounds, threshold)
    for (doc, item), begins in sorted(places.items()):
        wanted = block.item(item)
        slack = slack_of(len(wanted))
        a, b = int(bounds[doc]), int(bounds[doc + 1])
        best, span = -1, (0, 0)
        windows: list[list[int]] = []
        for begin in sorted(begins):
            low, high = max(a, begin - slack), min(b, begin + len(wanted) + slack)
            if windows and low <= windows[-1][1] and high - windows[-1][0] <= 4 * len(wanted) + 4 * slack:
                windows[-1][1] = max(high, windows[-1][1])
            else:
                windows.append([low, high])
        for low, high in windows:
            if np.count_nonzero(np.isin(hashes[low:high], wanted)) / len(wanted) < threshold:
                continue  # an alignment matches each word of the text once at most
            score, end = align(wanted, hashes[low:high])
            if score > best and score / (MATCH * len(wanted)) >= threshold:
                back = align(wanted[::-1], hashes[low : low + end][::-1])[1]
                best, span = score, (low + end - back - a, low + end - a)
            if best == MATCH * len(wanted):
                break
        share = best / (MATCH * len(wanted))
        if share >= threshold:
            yield doc, item, share, *span


def blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple]]:
    """Items in blocks of at most `limit` words (or one item), one block at a time on the driver."""
    held, size = [], 0
    for row in benchmark.select(F.col(id_col), F.col(text_col)).where(F.col(text_col).isNotNull()).orderBy(id_col, text_col).toLocalIterator():
        n = len(row[1]) // 2 + 1
        if held and size + n > limit:
            yield held
            held, size = [], 0
        held.append((row[0], row[1]))
        size += n
    if held:
        yield held


def _aligned(name: str, item_ids: pa.Array, threshold: float):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = list(_matches(_mapped(name), [t or "" for t in batch.column(1).to_pylist()], threshold))
        ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
        columns = [ids, item_ids.take(pa.array([f[1] for f in found], pa.int64())), *[pa.array([f[k] for f in found], t) for k, t in ((2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]]
        return pa.RecordBatch.from_arrays(columns, ["doc", "item", "score", "start", "stop"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, score, first_word, after_word): documents that hold a copy of a test item, exact or edited.

    A row for each document row and item whose best alignment scores `threshold` of a perfect copy or more, with the place
    of the alignment in the document's words, the first of equal ones. Null texts hold nothing, null and wordless items match
    nothing, items of one or two words match where they stand as a whole, repeated rows give repeated results, and a null
    doc_id is carried along. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    schema = f"doc {rows.dtypes[0][1]}, item {dict(benchmark.dtypes)[item_col]}, score double, start long, stop long"
    kind = to_arrow_type(benchmark.schema[item_col].dataType)
    result = None
    for items in blocks(benchmark, item_col, item_text_col, block_words):
        name = shipped(spark, Block.of_items([t for _, t in items]))
        part = map_arrow(rows, _aligned(name, pa.array([k for k, _ in items], kind), threshold), schema)
        result = part if result is None else result.unionByName(part)
    if result is None:
        result = spark.createDataFrame([], schema)
    return result.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "score", F.col("start").alias("first_word"), F.col("stop").alias("after_word"))


def contamination(df: DataFrame, text: Column, block: str, threshold: float = 0.0) -> Column:
    """A struct (score): the best score of a text against the items of a shipped() block, 0 if no seed occurs in it or none reaches the threshold."""

    def run(texts: list[str | None]) -> list[pa.Array]:
        best = np.zeros(len(texts))
        for doc, _, score, _, _ in _matches(_mapped(block), [t or "" for t in texts], threshold):
            best[doc] = max(best[doc], score)
        return [pa.array(best, pa.float64())]

    return text_column(df.sparkSession, run, "score double")(text)


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of `docs`, all columns, that hold no copy of a test item: null texts stay, repeated rows go or stay together.

    Null and wordless items match nothing; without items all rows stay.
    """
    kept = docs
    for items in blocks(benchmark, item_col, item_text_col, block_words):
        name = shipped(docs.sparkSession, Block.of_items([t for _, t in items]))
        kept = kept.where(contamination(docs, F.col(text_col), name, threshold)["score"] < threshold)
    return kept
