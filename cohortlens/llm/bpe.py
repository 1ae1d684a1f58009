"""Byte-level BPE encoding and decoding with a transducer lexicon of frequent words.

The corpus' words (pretokens) are counted over all documents by lossy counting: each task keeps the words that may exceed
a share of its input and sends only these, so no word above that share is missed and little is shuffled. The most frequent
ones are merged once, compiled with their ids into a minimal acyclic transducer, written to the shared folder, fetched by
each executor as a file and memory-mapped. Encoding walks all words of a chunk at once; words that the lexicon lacks are merged exactly. The result
is that of the `tokenizers` library, whatever the lexicon holds.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pretokens
from .common import CHUNK, chunks, hold, save_bytes, ship, text_column
from .hashing import _BASE, _BASE_INVERSE, _CODES, gather, mix, powers
from .transducer import Transducer

LEXICON, TRACKED = 100_000, 400_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _byte_letters() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes, as byte-level tokenizer files write them: printable Latin-1 characters stand
    for themselves, the others follow from U+0100 on in order."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Merges, ids and byte strings of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], _byte_letters()
        kind = spec["pre_tokenizer"]
        if model["type"] != "BPE" or kind["type"] != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True) or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("a byte-level BPE file without normalizer and prefix blank is needed")
        ids = model["vocab"]
        size = max([*ids.values(), *[t["id"] for t in spec["added_tokens"]]]) + 1
        self.pieces: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.pieces[i] = bytes(letters[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.added.items():
            self.pieces[i] = content.encode()
        self.single = [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        lengths = np.array([len(p) for p in self.pieces])
        self.piece_starts = np.concatenate([[0], np.cumsum(lengths)])
        self.piece_bytes = np.frombuffer(b"".join(self.pieces), dtype=np.uint8)

        pairs = np.array(list(self.merges), dtype=np.uint64)
        keys, made = pairs[:, 0] << np.uint64(32) | pairs[:, 1], np.array(list(self.merges.values()), dtype=np.int32)
        bits = max(6, (4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.pair_keys, self.pair_made = np.full(1 << bits, 2**64 - 1, dtype=np.uint64), np.zeros((1 << bits, 2), dtype=np.int32)
        slot = (keys * _ODD) >> self.shift
        while len(keys):
            first = np.zeros(len(slot), dtype=bool)
            first[np.unique(slot, return_index=True)[1]] = True
            placed = first & (self.pair_keys[slot] == 2**64 - 1)
            self.pair_keys[slot[placed]], self.pair_made[slot[placed]] = keys[placed], made[placed]
            keys, made, slot = keys[~placed], made[~placed], (slot[~placed] + np.uint64(1)) & np.uint64((1 << bits) - 1)
        self.single_array = np.array(self.single, dtype=np.int32)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of pairs of ids in the table of merges, -1 where there is no such merge."""
        key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        slot = (key * _ODD) >> self.shift
        found = self.pair_keys[slot]
        lost = np.flatnonzero((found != key) & (found != 2**64 - 1))
        while len(lost):
            slot[lost] = (slot[lost] + np.uint64(1)) & np.uint64(len(self.pair_keys) - 1)
            found[lost] = self.pair_keys[slot[lost]]
            lost = lost[(found[lost] != key[lost]) & (found[lost] != 2**64 - 1)]
        return np.where(found == key, slot.astype(np.int64), -1)

    def merge_all(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of the words data[start:end]: (all ids, first of each word, number of each word), many words at a time."""
        lengths = ends - starts
        first, size, out, at = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64), [], 0
        for low, high in ((0, 4), (4, 7), (7, 10), (10, 16), (16, 32)):
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            for k in range(0, len(rows), 1 << 16):
                some = rows[k : k + (1 << 16)]
                ids, n = self._merge_rows(data, starts[some], lengths[some])
                first[some] = at + np.arange(len(some)) * ids.shape[1]
                size[some] = n
                out.append(ids.reshape(-1))
                at += ids.size
        for k in np.flatnonzero(lengths > 32).tolist():
            ids = np.array(self.merge(data[starts[k] : ends[k]].tobytes()), dtype=np.int32)
            first[k], size[k] = at, len(ids)
            out.append(ids)
            at += len(ids)
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int32), first, size

    def _merge_rows(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = int(lengths.max())
        column = np.arange(width)
        parts = self.single_array[data[np.minimum(starts[:, None] + column, len(data) - 1)]]
        none = np.int32(2**31 - 1)
        ranks = np.full(parts.shape, none, dtype=np.int32)
        rows, columns = np.nonzero(column[None, 1:] < lengths[:, None])
        slot = self._pairs(parts[rows, columns], parts[rows, columns + 1])
        ranks[rows, columns] = np.where(slot >= 0, self.pair_made[slot, 0], none)
        result, left = np.zeros_like(parts), lengths.copy()
        who = np.arange(len(starts))
        size = lengths.copy()
        while len(who):
            best = ranks.argmin(axis=1)
            line = np.arange(len(who))
            more = ranks[line, best] != none
            if not more.all():
                result[who[~more], : parts.shape[1]] = parts[~more]
                size[who[~more]] = left[~more]
                who, parts, ranks, left, best = who[more], parts[more], ranks[more], left[more], best[more]
                if not len(who):
                    break
                line = np.arange(len(who))
            slot = self._pairs(parts[line, best], parts[line, best + 1])
            made = self.pair_made[slot, 1]
            width = parts.shape[1] - 1
            keep = column[None, :width] <= best[:, None]
            parts = np.where(keep, parts[:, :width], parts[:, 1:])
            ranks = np.where(keep, ranks[:, :width], ranks[:, 1:])
            parts[line, best] = made
            left = left - 1
            for at in (best, best - 1):
                ok = (at >= 0) & (at + 1 < left)
                row, col = line[ok], at[ok]
                slot = self._pairs(parts[row, col], parts[row, col + 1])
                ranks[row, col] = np.where(slot >= 0, self.pair_made[slot, 0], none)
            end = best + 1 >= left
            ranks[line[end], best[end]] = none
        return result, size

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: the pair of the lowest rank is merged, the leftmost first, until none is left."""
        parts = [self.single[b] for b in word]
        if len(parts) > 48:
            return self._merge_long(parts)
        merges = self.merges.get
        while len(parts) > 1:
            best = None
            for k in range(len(parts) - 1):
                found = merges((parts[k], parts[k + 1]))
                if found is not None and (best is None or found[0] < best[0]):
                    best, at = found, k
            if best is None:
                break
            parts[at : at + 2] = [best[1]]
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(found[0], k, parts[k], parts[k + 1], found[1]) for k in range(n - 1) if (found := self.merges.get((parts[k], parts[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, new = heapq.heappop(heap)
            j = after[k]
            if not alive[k] or parts[k] != a or j >= n or parts[j] != b:
                continue
            parts[k], alive[j], after[k] = new, False, after[j]
            if after[j] < n:
                before[after[j]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right < n and (found := self.merges.get((parts[left], parts[right]))):
                    heapq.heappush(heap, (found[0], left, parts[left], parts[right], found[1]))
        return [p for p, keep in zip(parts, alive, strict=True) if keep]


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_CODES[data] * powers(_BASE, len(data)), dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_BASE_INVERSE, max(len(data), 1))[starts] + (ends - starts).astype(np.uint64))


def differing(data: np.ndarray, starts: np.ndarray, other: np.ndarray, others: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of the words data[start : start + length] and other[other start : other start + length] differ, eight bytes at a time."""
    eights = [np.ndarray(len(x) + 1, dtype="<u8", buffer=np.concatenate([x, np.zeros(8, dtype=np.uint8)]), strides=(1,)) for x in ((data, other) if other is not data else (data,))]
    out, left = np.zeros(len(starts), dtype=bool), np.arange(len(starts))
    at = 0
    while len(left):
        drop = (8 * np.maximum(8 + at - lengths[left], 0)).astype(np.uint64)  # bits beyond the word's end
        out[left] |= (eights[0][starts[left] + at] ^ eights[-1][others[left] + at]) << drop != 0
        at += 8
        left = left[lengths[left] > at]
    return out


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows of distinct words, number among them of each word, their counts and hashes); words of one hash are compared in full."""
    hashes, one, same, counts = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True, return_counts=True)
    lengths = ends - starts
    other = one[same]
    if (lengths != lengths[other]).any() or differing(data, starts, data, starts[other], lengths).any():
        return np.arange(len(starts)), np.arange(len(starts)), np.ones(len(starts), dtype=np.int64), word_hashes(data, starts, ends)
    return one, same, counts, hashes


class SeenWords:
    """Merged words that this process has met twice in a chunk, up to a bound; found by hash and compared byte by byte."""

    def __init__(self, limit: int = 200_000):
        self.limit = limit
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.starts = self.lengths = self.first = self.size = np.zeros(0, dtype=np.int64)
        self.data, self.ids = np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.int32)

    def merge(self, vocab: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As Vocabulary.merge_all, equal words being merged once and words seen before not at all."""
        one, same, counts, hashes = distinct(data, starts, ends)
        a, lengths = starts[one], ends[one] - starts[one]
        first, size = np.zeros(len(one), dtype=np.int64), np.zeros(len(one), dtype=np.int64)
        new = np.ones(len(one), dtype=bool)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = np.flatnonzero((self.hashes[at] == hashes) & (self.lengths[at] == lengths))
            hit = hit[~differing(data, a[hit], self.data, self.starts[at[hit]], lengths[hit])]  # two words may have one hash
            new[hit] = False
            first[hit], size[hit] = self.first[at[hit]], self.size[at[hit]]
        fresh = np.flatnonzero(new)
        ids, begin, size[fresh] = vocab.merge_all(data, a[fresh], ends[one][fresh])
        known = self.ids
        first[fresh] = begin + len(known)
        often = fresh[(counts[fresh] > 1) & (lengths[fresh] <= 64)][: max(self.limit - len(self.hashes), 0)]
        if len(often):
            bytes_, own = gather(data, a[often], lengths[often]), gather(np.concatenate([known, ids]), first[often], size[often])
            order = np.argsort(np.concatenate([self.hashes, hashes[often]]), kind="stable")
            grown = lambda old, more: np.concatenate([old, more])[order]
            self.starts = grown(self.starts, len(self.data) + np.cumsum(lengths[often]) - lengths[often])
            self.first = grown(self.first, len(known) + np.cumsum(size[often]) - size[often])
            self.hashes, self.lengths, self.size = grown(self.hashes, hashes[often]), grown(self.lengths, lengths[often]), grown(self.size, size[often])
            self.data, self.ids = np.concatenate([self.data, bytes_]), np.concatenate([known, own])
        return np.concatenate([known, ids]), first[same], size[same]


class Encoder:
    def __init__(self, vocab: Vocabulary, lexicon: Transducer | None = None):
        self.vocab, self.lexicon, self.seen = vocab, lexicon, SeenWords()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text plus the end)."""
        added = [s for s in self.vocab.added if any(s in t for t in texts)]
        if not added:
            return self._plain(texts)
        import re

        pieces, special, of = [], [], []
        for k, text in enumerate(texts):
            parts = re.split("(" + "|".join(re.escape(s) for s in sorted(added, key=len, reverse=True)) + ")", text)
            for j, part in enumerate(parts):
                pieces.append("" if j % 2 else part)
                special.append(self.vocab.added[part] if j % 2 else -1)
                of.append(k)
        ids, bounds = self._plain(pieces)
        out = [ids[bounds[j] : bounds[j + 1]] if special[j] < 0 else np.array([special[j]], dtype=np.uint32) for j in range(len(pieces))]
        lengths = np.bincount(of, weights=[len(x) for x in out], minlength=len(texts)).astype(np.int64)
        return np.concatenate(out), np.concatenate([[0], np.cumsum(lengths)])

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data, where, counts = pretokens.cut(texts)
        starts, ends = where[:-1], where[1:]
        number = self.lexicon.numbers(data, starts, ends) if self.lexicon else np.full(len(starts), -1, dtype=np.int64)
        seen = number >= 0
        source = np.zeros(len(starts), dtype=np.int64)
        length = np.zeros(len(starts), dtype=np.int64)
        values = np.zeros(0, dtype=np.uint32)
        if self.lexicon:
            source[seen] = self.lexicon.starts[number[seen]]
            length[seen] = self.lexicon.starts[number[seen] + 1] - source[seen]
            values = self.lexicon.ids
        unseen = np.flatnonzero(~seen)
        if len(unseen):
            a, b = starts[unseen], ends[unseen]
            if self.lexicon is None:  # equal words are merged once
                ids, first, size = self.seen.merge(self.vocab, data, a, b)
            else:
                ids, first, size = self.vocab.merge_all(data, a, b)
            source[unseen], length[unseen] = len(values) + first, size
            values = np.concatenate([values, ids.astype(np.uint32)])
        ids = gather(values, source, length)
        offsets = np.concatenate([[0], np.cumsum(length)])
        return ids, offsets[counts]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a list of ids; what isn't valid UTF-8 in them is a text's replacement character."""
        begin = self.vocab.piece_starts[ids]
        return gather(self.vocab.piece_bytes, begin, self.vocab.piece_starts[ids.astype(np.int64) + 1] - begin).tobytes()


def decoded_text(raw: bytes) -> bytes:
    """UTF-8 of the text that the bytes stand for."""
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace").encode("utf-8")
    return raw


def _counted(batches):
    """Lossy counting of pretokens in one task: a bucket is a chunk, a word seen once in its first bucket is let go."""
    counts: dict[bytes, list[int]] = {}
    bucket = 0
    for piece in chunks(batches, 2 * CHUNK):
        bucket += 1
        data, where, _ = pretokens.cut([x or "" for x in piece.column(0).to_pylist()])
        starts, ends = where[:-1], where[1:]
        if not len(starts):
            continue
        _, first, n = np.unique(word_hashes(data, starts, ends), return_index=True, return_counts=True)
        often = n > 1
        raw = data.tobytes()
        for a, b, c in zip(starts[first[often]].tolist(), ends[first[often]].tolist(), n[often].tolist(), strict=True):
            entry = counts.get(word := raw[a:b])
            if entry is None:
                counts[word] = [c, bucket - 1]
            else:
                entry[0] += c
        if len(counts) > TRACKED:
            counts = {w: e for w, e in counts.items() if e[0] + e[1] > bucket}
    kept = [(w, e[0]) for w, e in counts.items() if len(w) <= 64]
    for k in range(0, len(kept), 50_000):
        part = kept[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()), pa.array([c for _, c in part], pa.int64())], ["word", "n"])


def learn_lexicon(docs: DataFrame, text_col: str, path: str, size: int = LEXICON) -> str:
    """Compile the most frequent words of all documents, `size` at most; the name under which executors find the file."""
    spark = docs.sparkSession
    ship(spark)
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_counted, "word binary, n long")
    counts = hold(counted.groupBy("word").agg(F.sum("n").alias("n")))
    # whole levels of frequency from the top, as many as fit, then the next level's words by hash: a list of levels reaches
    # the driver, then about `size` words
    level, place = F.floor(F.log2("n") * 16), F.xxhash64("word")
    lowest, total, share = None, 0, 0.0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("c")).collect(), key=lambda r: -r["level"]):
        lowest, share = r["level"], min(1.0, (size - total) / r["c"])
        total += r["c"]
        if total >= size:
            break
    top = [] if lowest is None else counts.where((level > lowest) | ((level == lowest) & (place <= min(int(share * 2**64) - 2**63, 2**63 - 1)))).select("word").collect()
    counts.unpersist()
    vocab = vocabulary(path)
    made = Transducer.build((bytes(r["word"]), vocab.merge(bytes(r["word"]))) for r in top)
    path = save_bytes(spark, made.payload(), "lexicon")
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


@functools.lru_cache(2)
def encoder(path: str, lexicon: str | None = None) -> Encoder:
    """The encoder of this process: the vocabulary file is read once, the lexicon mapped."""
    return Encoder(vocabulary(path), Transducer.map(SparkFiles.get(lexicon)) if lexicon else None)


def _round_trip(path: str, lexicon: str | None):
    def run(texts: list[str | None]) -> list[pa.Array]:
        coder = encoder(path, lexicon)
        ids, bounds = coder.encode([t or "" for t in texts])
        raw = ids.astype("<u4").tobytes()
        lengths = coder.vocab.piece_starts[1:] - coder.vocab.piece_starts[:-1]
        ends = np.concatenate([[0], np.cumsum(lengths[ids])])[bounds]
        back = coder.decode(ids)
        return [
            pa.array(np.diff(bounds), pa.int64()),
            pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.string()),
            pa.array([hashlib.sha256(decoded_text(back[a:b])).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string()),
        ]

    return run


def _ids(path: str, lexicon: str | None):
    def run(texts: list[str | None]) -> list[pa.Array]:
        ids, bounds = encoder(path, lexicon).encode([t or "" for t in texts])
        return [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32), pa.int32()))]

    return run


def encode(df: DataFrame, text: Column, path: str, lexicon: str | None = None) -> Column:
    """A struct (ids): the token ids of a text, none for a null or empty one."""
    return text_column(df.sparkSession, _ids(path, lexicon), "ids array<int>", 2 * CHUNK)(text)


def decode(df: DataFrame, ids: Column, path: str) -> Column:
    """The text of a list of ids; null for null."""
    from pyspark.sql.functions import arrow_udf

    ship(df.sparkSession)

    def run(lists: pa.Array) -> pa.Array:
        coder = encoder(path, None)
        return pa.array([None if x is None else decoded_text(coder.decode(np.array(x, dtype=np.int64))).decode("utf-8") for x in lists.to_pylist()], pa.string())

    run.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return arrow_udf(run, "string")(ids)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = LEXICON) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded and decoded, a row for each row, repeated ids too.

    A null text is the empty one, with no ids; an empty input gives no rows; other columns are not read.
    """
    lexicon = learn_lexicon(docs, text_col, path, size)
    coded = text_column(docs.sparkSession, _round_trip(path, lexicon), "n_tokens long, ids_sha256 string, decoded_sha256 string", 2 * CHUNK)(F.col(text_col))
    return docs.select(F.col(id_col), coded.alias("found")).select(id_col, "found.*")
