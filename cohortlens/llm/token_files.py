"""Token-id files with Re-Pair grammar compression.

Documents are dealt into ranges of ascending id and sorted. Each range is written as shards of about SHARD ids; a shard
replaces its repeated id pairs by nonterminals, again and again, and stores the rules, the length to which each rule
expands, and the remaining symbols, so any run of ids is decoded without the rest. Rules never cross a document's end.

A round replaces all pairs at once that are at least 1/STEP as frequent as the most frequent one (in a chain of overlapping
occurrences every second one), which changes little against replacing one pair at a time. Rounds go on until no pair of a
shard repeats, with as many rules as that takes. A pair that stands at one place only can't become frequent later, so its place
is looked at again only when a neighbour is replaced: late rounds cost little. Shards are rows of a Parquet table in the
shared folder: the table's commit makes the writing safe against lost executors.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import encoder
from .common import CHUNK, chunks, save, ship
from .hashing import gather

SHARD, STEP, LEAST = 1 << 20, 64, 2
END, BITS = 0, 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _bucket(pairs: np.ndarray) -> np.ndarray:
    return ((pairs * _ODD) >> np.uint64(64 - BITS)).view(np.int64)


def _frequent(pairs: np.ndarray, size: np.ndarray, least: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(the round's pairs, most frequent first, ties by value; places that may hold one). `size`: pairs in the place's bucket."""
    cut = max(least, int(size.max(initial=0)) // step)
    while True:
        places = np.flatnonzero(size >= cut)
        found, counts = np.unique(pairs[places], return_counts=True)
        top = int(counts.max(initial=0))
        if top >= cut or cut == least:
            break
        cut = max(least, top // step)  # the fullest buckets hold different pairs: look again from the pairs' own top
    ok = counts >= max(cut, top // step)
    return found[ok][np.argsort(-counts[ok], kind="stable")], places


def compress(ids: np.ndarray, ends: np.ndarray, first: int, least: int = LEAST, step: int = STEP) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray]:
    """Re-Pair: (symbols, rules, rules of each round, symbols of each document).

    `ends` marks the last id of each document; nonterminals are numbered from `first` in the order of their rules. No pair
    that is left stands at `least` places that don't overlap.
    """
    symbols, last = ids.astype(np.uint32), ends.copy()
    live = ~last  # places whose pair may repeat
    number = np.full(1 << BITS, -1, dtype=np.int32)
    rules: list[np.ndarray] = []
    while True:
        at = np.flatnonzero(live)
        pairs = symbols[at].astype(np.uint64)
        pairs <<= np.uint64(32)
        pairs |= symbols[1:][at]
        bucket = _bucket(pairs)
        size = np.bincount(bucket, minlength=1 << BITS)[bucket]
        chosen, places = _frequent(pairs, size, least, step)
        if not len(chosen):
            break
        live[at[np.flatnonzero(size < least)]] = False
        number[_bucket(chosen)[::-1]] = np.arange(len(chosen), dtype=np.int32)[::-1]  # of one bucket the first; others wait
        which = number[bucket[places]]
        number[_bucket(chosen)] = -1
        same = np.flatnonzero(which >= 0)
        same = same[chosen[which[same]] == pairs[places[same]]]
        at, which = at[places[same]], which[same]
        follows = np.flatnonzero(np.diff(at) == 1)
        if len(follows):
            new_run = np.ones(len(at), dtype=bool)
            new_run[follows + 1] = False
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            take = (np.arange(len(at)) - run_start) % 2 == 0
            at, which = at[take], which[take]
        used = np.bincount(which, minlength=len(chosen)) > 0  # others lost all their places to overlapping pairs
        if not used.all():
            chosen, which = chosen[used], (np.cumsum(used) - 1)[which]
        symbols[at] = which + (first + sum(len(r) for r in rules))
        last[at] = last[at + 1]
        live[at] = ~last[at]
        before = at[at > 0] - 1
        live[before] = ~last[before]
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        left = np.flatnonzero(keep)
        symbols, last, live = symbols[left], last[left], live[left]
        rules.append(chosen)
    flat = np.concatenate(rules) if rules else np.zeros(0, dtype=np.uint64)
    halves = np.stack([flat >> np.uint64(32), flat & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
    return symbols, halves, [len(r) for r in rules], np.diff(np.flatnonzero(last), prepend=-1)


def _planes(values: np.ndarray, bits: int) -> bytes:
    """The low 16 bits of each value, then each higher bit of all values, eight to a byte."""
    return b"".join([(values & 0xFFFF).astype("<u2").tobytes(), *[np.packbits((values >> b & 1).astype(bool)).tobytes() for b in range(16, bits)]])


def _from_planes(raw: memoryview, count: int, bits: int) -> tuple[np.ndarray, int]:
    """(values, bytes read)."""
    out, at, plane = np.frombuffer(raw, dtype="<u2", count=count).astype(np.uint32), 2 * count, -(-count // 8)
    for b in range(16, bits):
        out |= np.unpackbits(np.frombuffer(raw, dtype=np.uint8, count=plane, offset=at), count=count).astype(np.uint32) << np.uint32(b)
        at += plane
    return out, at


def pack(ids: np.ndarray, ends: np.ndarray, first: int) -> bytes:
    """A shard's payload: a line of JSON, then symbols, rules, expansion lengths and symbols of each document."""
    symbols, rules, sizes, per_doc = compress(ids, ends, first)
    lengths = np.ones(first + len(rules), dtype=np.uint32)
    at = first
    for size in sizes:
        own = rules[at - first : at - first + size]
        lengths[at : at + size] = lengths[own[:, 0]] + lengths[own[:, 1]]
        at += size
    bits = max(16, (first + len(rules)).bit_length())
    kind = "<u4" if lengths.max() >= 1 << 16 else "<u2"
    head = json.dumps({"first": first, "sizes": sizes, "symbols": len(symbols), "docs": len(per_doc), "bits": bits, "lengths": kind}).encode() + b"\n"
    return b"".join([head, _planes(symbols, bits), _planes(rules.reshape(-1), bits), lengths[first:].astype(kind).tobytes(), per_doc.astype("<u4").tobytes()])


class Shard:
    """A payload opened for reading; ids(start, stop) expands only the symbols that hold them."""

    def __init__(self, payload: bytes):
        at = payload.index(b"\n") + 1
        head = json.loads(payload[:at])
        self.first, self.sizes, n, view = head["first"], head["sizes"], sum(head["sizes"]), memoryview(payload)
        self.symbols, size = _from_planes(view[at:], head["symbols"], head["bits"])
        at += size
        rules, size = _from_planes(view[at:], 2 * n, head["bits"])
        self.rules, at = rules.reshape(-1, 2), at + size
        lengths = np.frombuffer(payload, dtype=head["lengths"], count=n, offset=at)
        self.lengths = np.concatenate([np.ones(self.first, dtype=np.int64), lengths])
        self.per_doc = np.frombuffer(payload, dtype="<u4", count=head["docs"], offset=at + lengths.nbytes).astype(np.int64)

    @functools.cached_property
    def grammar(self) -> tuple[np.ndarray, np.ndarray]:
        """(expansions of all symbols one after the other, where each begins)."""
        values, starts = np.arange(self.first, dtype=np.uint32), np.arange(self.first, dtype=np.int64)
        at = self.first
        for size in self.sizes:
            own = self.rules[at - self.first : at - self.first + size].reshape(-1)
            new = gather(values, starts[own], self.lengths[own])
            begin = len(values) + np.cumsum(self.lengths[at : at + size]) - self.lengths[at : at + size]
            values, starts = np.concatenate([values, new]), np.concatenate([starts, begin])
            at += size
        return values, starts

    @functools.cached_property
    def symbol_ends(self) -> np.ndarray:
        return np.cumsum(self.lengths[self.symbols])

    @property
    def doc_ends(self) -> np.ndarray:
        return self.symbol_ends[np.cumsum(self.per_doc) - 1] if len(self.per_doc) else np.zeros(0, dtype=np.int64)

    def expanded(self, symbols: np.ndarray) -> np.ndarray:
        """What the symbols stand for, rule by rule from the top: only the rules that they use are looked at."""
        out = symbols.astype(np.uint32)
        while len(inner := np.flatnonzero(out >= self.first)):
            rules = self.rules[out[inner] - self.first]
            out = np.insert(out, inner + 1, rules[:, 1])
            out[inner + np.arange(len(inner))] = rules[:, 0]
        return out

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids from `start` to before `stop`, by default all of them."""
        if stop is None:
            values, starts = self.grammar
            return gather(values, starts[self.symbols], self.lengths[self.symbols])[start:]
        if stop <= start:
            return np.zeros(0, dtype=np.uint32)
        a, b = np.searchsorted(self.symbol_ends, [start, stop - 1], side="right")
        skipped = start - int(self.symbol_ends[a] - self.lengths[self.symbols[a]])
        return self.expanded(self.symbols[a : b + 1])[skipped : skipped + stop - start]


def _written(path: str, end: int, shard: int, batches: Iterator[pa.RecordBatch]):
    """Encode a range's documents in order and yield its shards."""
    coder, part, offset = encoder(path), TaskContext.get().partitionId(), 0
    doc_ids: list[pa.Array] = []
    held: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    total = 0

    def row() -> pa.RecordBatch:
        ids, lengths = np.concatenate(held), np.concatenate(sizes)
        ends = np.zeros(len(ids), dtype=bool)
        ends[np.cumsum(lengths) - 1] = True
        names = pa.concat_arrays(doc_ids)
        payload = pack(ids, ends, max(len(coder.vocab.pieces), end + 1))
        columns = [pa.array([part], pa.int32()), pa.array([offset], pa.int64()), pa.array([len(ids)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), pa.array([payload], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["part", "offset", "n_ids", "doc_ids", "payload"])

    for piece in chunks(batches, 2 * CHUNK):
        ids, bounds = coder.encode([t or "" for t in piece.column(1).to_pylist()])
        docs = len(bounds) - 1
        ids = np.insert(ids, bounds[1:], end)
        doc_ids.append(piece.column(0))
        held.append(ids)
        sizes.append(np.diff(bounds) + 1)
        total += len(ids)
        assert docs == piece.num_rows
        if total >= shard:
            yield row()
            offset += total
            doc_ids, held, sizes, total = [], [], [], 0
    if total:
        yield row()


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, shard: int = SHARD) -> DataFrame:
    """Write the token-id files of `docs` in ascending id order; the table of shards (part, offset, n_ids, doc_ids, payload).

    A null text is empty and has just its end id; null ids come first, rows of one id are ordered by their text; an empty
    input gives no shards. Ids are of any type that has an order. Only the cut points of the ranges reach the driver. Other
    columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if isinstance(rows.schema["id"].dataType, T.IntegralType):
        cuts = rows.agg(F.percentile_approx(F.col("id").cast("long"), [i / parts for i in range(1, parts)] or [0.5], 10000).alias("c")).first()["c"] or []
        dealt = rows.repartitionById(len(set(cuts)) + 1, range_of(F.col("id"), sorted(set(cuts))))
    else:
        dealt = rows.repartitionByRange(parts, "id")
    schema = f"part int, offset long, n_ids long, doc_ids array<{rows.dtypes[0][1]}>, payload binary"
    return save(dealt.sortWithinPartitions(F.col("id").asc_nulls_first(), "text").mapInArrow(functools.partial(_written, path, end, shard), schema), "token-ids")


def range_of(value, cuts: list[int]):
    """How many of the sorted `cuts` lie below the value, found block by block; 0 for null."""
    if not cuts:
        return F.lit(0)
    block = max(1, int(len(cuts) ** 0.5))
    heads = F.lit(cuts[block - 1 :: block]) if cuts[block - 1 :: block] else F.array().cast("array<bigint>")
    lower = F.size(F.filter(heads.cast("array<bigint>"), lambda c: c < value)) * block
    below = lower + F.size(F.filter(F.slice(F.lit(cuts).cast("array<bigint>"), lower + 1, F.lit(block)), lambda c: c < value))
    return F.when(value.isNull(), F.lit(0)).otherwise(below)


def _read(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for k in range(batch.num_rows):
            part, offset, doc_ids, payload = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(2)[k].values, batch.column(3)[k].as_py()
            opened = Shard(payload)
            ids = opened.ids()
            ends = opened.doc_ends
            begins = np.concatenate([[0], ends[:-1]])
            raw = ids.astype("<u4").tobytes()
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            columns = [pa.array([part] * len(doc_ids), pa.int32()), doc_ids, pa.array(begins + offset, pa.int64()), pa.array(ends - begins, pa.int64()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "offset", "n_tokens", "ids_crc32"])


def _kind(shards: DataFrame) -> str:
    return shards.schema["doc_ids"].dataType.elementType.simpleString()


def read(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the shards' payloads.

    start counts the ids of all documents before; it adds the totals of the ranges before (one number for each range) to
    the offset that is stored within the range. Null and repeated ids have a row for each written row; no shards give no rows.
    """
    ship(shards.sparkSession)
    totals = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    base, offsets = 0, [0] * (max(totals, default=0) + 1)
    for part in range(len(offsets)):
        offsets[part] = base
        base += totals.get(part, 0)
    found = shards.select("part", "offset", "doc_ids", "payload").mapInArrow(_read, f"part int, doc_id {_kind(shards)}, offset long, n_tokens long, ids_crc32 long")
    start = F.element_at(F.lit(offsets).cast("array<bigint>"), F.col("part") + 1) + F.col("offset")
    return found.select(F.col("doc_id").alias(id_col), start.alias("start"), "n_tokens", "ids_crc32")


def documents(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids): the ids of every document, its end id included, decoded from the shards; a row for each written row."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for k in range(batch.num_rows):
                opened = Shard(batch.column(1)[k].as_py())
                bounds = np.concatenate([[0], opened.doc_ends])
                ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(opened.ids().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[k].values, ids], ["doc_id", "ids"])

    ship(shards.sparkSession)
    return shards.select("doc_ids", "payload").mapInArrow(run, f"doc_id {_kind(shards)}, ids array<int>").withColumnRenamed("doc_id", id_col)
