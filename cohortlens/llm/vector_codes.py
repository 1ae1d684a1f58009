"""Product quantisation of vectors in whole numbers, with partial-distance search.

A component x becomes floor(256 * x); a vector is cut into equal parts, each with a codebook of its own. A part's nearest entry
is searched dimension by dimension, those in which the codebook varies most first: every entry's distance grows by one
squared difference, and a mask drops the entries whose sum strictly exceeds the best complete distance known so far, which is
that of the entry in front. Ties go to the lower index. All arithmetic is exact, so results don't depend on the partitions.

Scale: a codebook is entries x parts x width numbers, whatever the table's size; training rounds send sums of that size from each
task, merged before they reach the driver. Rows are read once a round and once to be coded.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.skew import one_for_each

from .common import map_arrow, save

SCALE = 256
#: Vectors that a worker codes at once.
ROWS = 4096


@dataclass
class Codebooks:
    """entries[p]: the entries (rows) of part p; dims: the length of the vectors that have a code."""

    dims: int
    entries: list[np.ndarray]

    def digest(self) -> str:
        """sha256 of all components, decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for x in part.reshape(-1).tolist()).encode()).hexdigest()


def nearest(vectors: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance) of each row's nearest entry, the lower index where several are, and how many
    (row, entry) differences were taken."""
    rows = np.arange(len(vectors))
    if not entries.shape[1]:
        return np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64), 0
    by = np.argsort(-entries.var(axis=0), kind="stable")
    first = (vectors[:, by[0], None] - entries[None, :, by[0]]) ** 2
    front = first.argmin(axis=1)
    best = ((vectors - entries[front]) ** 2).sum(axis=1)
    row, entry = np.nonzero(first <= best[:, None])
    sums, taken = first[row, entry], first.size
    for d in by[1:].tolist():
        sums = sums + (vectors[row, d] - entries[entry, d]) ** 2
        taken += len(sums)
        # the entry that leads now may be nearer than the best one known
        begins = np.searchsorted(row, rows)
        least = np.minimum.reduceat(sums, begins)
        leads = np.flatnonzero(sums == least[row])
        front = entry[leads[np.searchsorted(row[leads], rows)]]
        best = np.minimum(best, ((vectors - entries[front]) ** 2).sum(axis=1))
        alive = sums <= best[row]
        row, entry, sums = row[alive], entry[alive], sums[alive]
    # what is left of a row has its least distance, by rising index
    whole = sums == best[row]
    row, entry = row[whole], entry[whole]
    return entry[np.searchsorted(row, rows)], best, taken


def whole_numbers(vector: Column) -> Column:
    """array<long> of floor(SCALE * x); null for a null vector and for one with a null, NaN or infinite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE)))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def _sums(books: Codebooks):
    width = books.dims // len(books.entries)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors = _matrix(batch.column(0), books.dims)
        out = []
        for p, entries in enumerate(books.entries):
            part = vectors[:, p * width : (p + 1) * width]
            index, _, _ = nearest(part, entries)
            counts = np.bincount(index, minlength=len(entries))
            sums = np.zeros(entries.shape, dtype=np.int64)
            np.add.at(sums, index, part)
            out += [(p, e, int(counts[e]), sums[e].tolist()) for e in np.flatnonzero(counts).tolist()]
        columns = list(zip(*out, strict=True))
        types = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["part", "entry", "n", "sums"])

    return run


def _coded(books: Codebooks):
    width = books.dims // len(books.entries)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors = _matrix(batch.column(2), books.dims)
        index, error = [], np.zeros(len(vectors), dtype=np.int64)
        for p, entries in enumerate(books.entries):
            found, distance, _ = nearest(vectors[:, p * width : (p + 1) * width], entries)
            index.append(found)
            error += distance
        codes = [bytes(c).hex() for c in np.stack(index, axis=1).astype(np.uint8)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    return run


def _usable(vectors: DataFrame, column: str, dims: int) -> DataFrame:
    """The rows whose vector has `dims` components, none so large that a squared distance leaves 64 bits."""
    bound = math.isqrt(2**61 // max(dims, 1)) // 2
    return vectors.where((F.size(column) == dims) & F.forall(column, lambda x: F.abs(x) <= bound))


def fit(vectors: DataFrame, id_col: str, vector_col: str, parts: int = 16, entries: int = 64, rounds: int = 2) -> Codebooks | None:
    """Codebooks that begin as the parts of the `entries` vectors of the smallest ids (null ids last; repeated ids by their
    components), moved `rounds` times to the floor of the mean of the parts nearest to each entry. An entry that no part is
    nearest to stays. None if no vector can be used.

    Vectors are used and dropped as `encode` says.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits")
    whole = vectors.select(F.col(id_col).alias("id"), whole_numbers(F.col(vector_col)).alias("v")).where("v is not null")
    dims = whole.agg(F.max(F.size("v")).alias("n")).first()["n"]
    if dims is None:
        return None
    if dims % parts:
        raise ValueError(f"vectors of {dims} components can't be cut into {parts} equal parts")
    usable = _usable(whole, "v", dims)
    start = [r["v"] for r in usable.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    if not start:
        return None
    width = dims // parts
    first = np.array(start, dtype=np.int64).reshape(len(start), dims)
    books = Codebooks(dims, [first[:, p * width : (p + 1) * width].copy() for p in range(parts)])
    for _ in range(rounds if width else 0):
        moved = map_arrow(usable.select("v"), _sums(books), "part int, entry int, n long, sums array<long>", ROWS * (8 * dims + 2048))
        summed = moved.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)])
        for r in summed.collect():  # a row for each entry of each part at most
            books.entries[r["part"]][r["entry"]] = [r[f"s{k}"] // r["n"] for k in range(width)]
    return books


def encode(vectors: DataFrame, books: Codebooks | None, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, code, error, label_error): the index of the nearest entry of each part, two hex digits each, the sum of
    the squared distances, and the sum of these over the rows of equal labels (null labels together).

    Dropped are null vectors, those with a null or non-finite component, those of another length than the longest kept one,
    and those with a component too large for squared distances of 64 bits (beyond 2**26 units at 64 components: 262,144 or
    more). Empty vectors, where all are, have parts without components: index 0, error 0. Ids may be null or repeat. An empty
    table gives an empty result. The coded rows are written to the shared folder, as they are read twice.
    """
    ids, labels = dict(vectors.dtypes)[id_col], dict(vectors.dtypes)[label_col]
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), whole_numbers(F.col(vector_col)).alias("v")).where("v is not null")
    rows = _usable(rows, "v", books.dims) if books else rows.where(F.lit(False))
    schema = f"id {ids}, label {labels}, code string, error long"
    if books:
        rows = map_arrow(rows, _coded(books), schema, ROWS * (8 * books.dims + 2048))
    else:
        rows = rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    coded = save(rows, "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("__n"))
    return one_for_each(coded, sums, "label", "__n").select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error")
