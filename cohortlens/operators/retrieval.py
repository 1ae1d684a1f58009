"""Exact eligibility-filtered top-k retrieval by inner product."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.hashing import hamming
from cohortlens.operators.gates import GateError, require_empty
from cohortlens.sources.shared import written

BROADCAST_QUERIES = 64 << 20  # bytes of query vectors that may be sent to every executor at once


def dot(a: Column, b: Column) -> Column:
    """The inner product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12)))


# The fields that a query and its neighbour must not share.
SHARED = ("record_id", "study_id", "image_id", "image_sha256", "report_sha256")


def _rules(query: dict[str, Column], other: dict[str, Column], threshold: int) -> dict[str, Column]:
    """Why a neighbour may not serve a query, by reason. Blank and missing fields are never equal; the patient's key counts
    if either side has one, else the id."""
    value = lambda side, f: F.nullif(F.trim(side[f].cast("string")), F.lit(""))
    both = lambda f: f in query and f in other
    rules = {f"same_{f}": value(query, f) == value(other, f) for f in SHARED if both(f)}
    patient = [value(query, f) == value(other, f) for f in ("patient_key", "patient_id") if both(f)]
    if both("patient_key") and both("patient_id"):
        keyed = value(query, "patient_key").isNotNull() | value(other, "patient_key").isNotNull()
        rules["same_patient_or_group"] = F.when(keyed, patient[0]).otherwise(patient[1])
    elif patient:
        rules["same_patient_or_group"] = patient[0]
    if both("hi") and both("lo"):
        rules[f"image_phash_distance<={threshold}"] = hamming(query["hi"], query["lo"], other["hi"], other["lo"]) <= threshold
    return {reason: F.coalesce(met, F.lit(False)) for reason, met in rules.items()}


def ineligible_reasons(query: dict[str, Column], other: dict[str, Column], threshold: int = 4) -> Column:
    """The reasons for which a neighbour may not serve a query, in a fixed order; an empty array means that it may."""
    marks = [F.when(met, reason) for reason, met in _rules(query, other, threshold).items()]
    return F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>")


def eligible(query: dict[str, Column], other: dict[str, Column], threshold: int = 4) -> Column:
    """True where there is no reason: one condition for a join."""
    return ~reduce(lambda a, b: a | b, _rules(query, other, threshold).values(), F.lit(False))


def fields(df: DataFrame, prefix: str) -> dict[str, Column]:
    """The columns `prefix`name of a table by name, for the rules above."""
    return {c[len(prefix) :]: F.col(c) for c in df.columns if c.startswith(prefix)}


#: Gallery rows that a task arranges into blocks at once, and how many more than k neighbours are looked up where some may not serve.
ROWS, SPARE = 8192, 24


def block_search(queries: np.ndarray, k: int, groups: list | None = None) -> Callable:
    """search(ids, vectors, groups) over one stretch of the gallery after another, and best() with what is found:
    (query number, gallery id, score) of the k best of each query, ties by the smaller id. search() returns how many pairs it
    multiplied.

    A stretch is cut into about sqrt(n) blocks around rows of its own. A block with centre c and radius r holds no better score
    for q than q.c + |q| r, so blocks, most promising first, are multiplied with those queries only whose k-th score so far
    lies below that. Scores of what passes are summed again from the first component to the last, as `dot` does.
    """
    norms = np.sqrt((queries * queries).sum(axis=1))
    least = np.full(len(queries), -np.inf)
    held: list[list] = [[] for _ in queries]
    groups = [None] * len(queries) if groups is None else groups
    of_group: dict = {}
    for at, group in enumerate(groups):
        of_group.setdefault(group, []).append(at)

    def take(q, numbers, ids, vectors):
        exact = np.add.accumulate(queries[q] * vectors[numbers], axis=1)[:, -1] if vectors.shape[1] else np.zeros(len(numbers))
        held[q] = sorted([*held[q], *zip((-exact).tolist(), [ids[i] for i in numbers.tolist()], strict=True)])[:k]
        if len(held[q]) == k:
            least[q] = -held[q][-1][0]

    def search(ids, vectors, own=None):
        taken, members = 0, {}
        for i, group in enumerate([None] * len(ids) if own is None else own):
            members.setdefault(group, []).append(i)
        for group, some in members.items():
            asked = np.array(of_group.get(group, []), dtype=np.int64)
            if not len(asked):
                continue
            rows = np.array(some)
            part = vectors[rows]
            pivots = part[:: max(1, int(len(rows) ** 0.5))]
            nearest = (part @ pivots.T - (pivots * pivots).sum(axis=1) / 2).argmax(axis=1)
            blocks = [np.flatnonzero(nearest == b) for b in range(len(pivots))]
            blocks = [b for b in blocks if len(b)]
            centres = np.stack([part[b].mean(axis=0) for b in blocks])
            radius = np.array([np.sqrt(((part[b] - c) ** 2).sum(axis=1).max()) for b, c in zip(blocks, centres, strict=True)])
            slack = 1e-9 * (1 + norms[asked] * np.sqrt((part * part).sum(axis=1).max()))
            bound = queries[asked] @ centres.T + norms[asked][:, None] * radius + slack[:, None]
            for b in np.argsort(-bound.max(axis=0)).tolist():
                wanted = np.flatnonzero(bound[:, b] >= least[asked])
                if not len(wanted):
                    continue
                scores = queries[asked[wanted]] @ part[blocks[b]].T
                taken += scores.size
                floor = least[asked[wanted]]
                if scores.shape[1] > k:
                    floor = np.maximum(floor, -np.partition(-scores, k - 1, axis=1)[:, k - 1])
                hits = scores >= (floor - 2 * slack[wanted])[:, None]
                for w in np.flatnonzero(hits.any(axis=1)).tolist():
                    take(int(asked[wanted[w]]), rows[blocks[b][hits[w]]], ids, vectors)
        return taken

    def best():
        return [(q, found, -score) for q, some in enumerate(held) for score, found in some]

    return search, best


def _nearest(queries: DataFrame, gallery: DataFrame, k: int, within: str | None, dims: int) -> DataFrame:
    """(query_id, gallery_id, score): the k best gallery rows of each query within each task. The queries' vectors go to every
    executor; the gallery streams through Arrow batches."""
    spark = gallery.sparkSession
    sides = queries.select("query_id", "q", *[f"query_{within}"] * bool(within)).toArrow()
    asked, groups = sides["query_id"].to_pylist(), sides[f"query_{within}"].to_pylist() if within else None
    matrix = np.array(sides["q"].to_pylist(), dtype=np.float64).reshape(len(asked), dims)
    shared, make, rows = spark.sparkContext.broadcast((matrix, groups)), block_search, ROWS
    kinds = {"query_id": sides.schema.field("query_id").type}

    def run(batches):
        search, best = make(shared.value[0], k, shared.value[1])
        waiting, count, kind = [], 0, None

        def flush():
            table = pa.Table.from_batches(waiting).combine_chunks()
            vectors = table["g"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)
            search(table["gallery_id"].to_pylist(), vectors, table["w"].to_pylist() if "w" in table.column_names else None)

        for batch in batches:
            kind = batch.schema.field("gallery_id").type
            for start in range(0, batch.num_rows, rows):
                waiting.append(batch.slice(start, rows))
                count += waiting[-1].num_rows
                if count >= rows:
                    flush()
                    waiting, count = [], 0
        if waiting:
            flush()
        found = best()
        if found:
            number, other, score = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([asked[q] for q in number], kinds["query_id"]), pa.array(other, kind), pa.array(score, pa.float64())], ["query_id", "gallery_id", "score"])

    columns = gallery.where(F.size("g") == dims).select("gallery_id", "g", *[F.col(f"gallery_{within}").alias("w")] * bool(within))
    types = dict(queries.dtypes)["query_id"], dict(gallery.dtypes)["gallery_id"]
    return columns.mapInArrow(run, f"query_id {types[0]}, gallery_id {types[1]}, score double")


def top_k(queries: DataFrame, gallery: DataFrame, k: int, eligible: Column | None = None, block_bytes: int = BROADCAST_QUERIES, within: str | None = None) -> DataFrame:
    """(query_id, rank, gallery_id, score): the k best gallery rows of each query, ties by gallery id.

    `queries` and `gallery` have unique ids and vectors (query_id, q, ... and gallery_id, g, ...); rows without a vector of the
    queries' length are left out. `eligible` is a condition on both sides' other columns. `within` names a column (query_x,
    gallery_x) that must be equal; ids are unique within its values.

    The queries are a stated set: their size is counted first, and they are sent to the gallery's partitions in blocks of at
    most `block_bytes`. A task keeps its k best per query (block_search), so the shuffle is queries x k x tasks rows, however
    large the gallery is. With `eligible`, SPARE more are looked up and those that may serve stay; only a query that
    then lacks some is compared with the whole gallery pair by pair.
    """
    if k < 1:
        raise GateError("k must be positive")
    asked = queries.where("q is not null")
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("q")).alias("d")).first()
    dims, blocks = size["d"] or 0, max(1, -(-(size["n"] * ((size["d"] or 1) * 8 + 200)) // block_bytes))
    asked = asked.where(F.size("q") == dims)
    best, wide = Window.partitionBy("query_id").orderBy(F.desc("score"), "gallery_id"), k + (0 if eligible is None else SPARE)
    found = None
    for b in range(blocks):
        some = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        part = _nearest(some, gallery, wide, within, dims)
        found = part if found is None else found.unionByName(part)
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= wide)
    if eligible is None:
        return ranked.select("query_id", "rank", "gallery_id", "score")
    sides = ranked.join(asked.drop("q"), "query_id").join(gallery.drop("g"), "gallery_id")
    same = F.col(f"query_{within}") == F.col(f"gallery_{within}") if within else F.lit(True)
    served = written(sides.where(same).select("query_id", "gallery_id", "score", "rank", F.coalesce(eligible, F.lit(False)).alias("serves")))
    enough = served.groupBy("query_id").agg(F.count_if("serves").alias("n"), F.count(F.lit(1)).alias("seen")).where((F.col("n") >= k) | (F.col("seen") < wide))
    first = served.where("serves").join(enough.select("query_id"), "query_id", "left_semi").select("query_id", "gallery_id", "score")
    pairs = gallery.where(F.size("g") == dims).join(F.broadcast(asked.join(served.select("query_id"), "query_id", "left_semi").join(enough, "query_id", "left_anti")), eligible & same)
    rest = pairs.select("query_id", "gallery_id", dot(F.col("q"), F.col("g")).alias("score"))
    return first.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "gallery_id", "score")


def safe_top_k(queries: DataFrame, gallery: DataFrame, k: int = 10, threshold: int = 4, within: str | None = None, block_bytes: int = BROADCAST_QUERIES) -> DataFrame:
    """top_k over the gallery rows that may serve a query: no shared record, study, image, report or patient, no near image.

    Metadata stand in columns query_* and gallery_* beside the vectors. `within` names a column (query_x, gallery_x) that must
    be equal: a batch of bundles is one search. A k below 1 or a gallery of fewer than k rows raises at once, a query with
    fewer than k eligible rows when the result is read.
    """
    if k < 1:
        raise GateError("k must be positive")
    if len(gallery.select("gallery_id").limit(k).collect()) < k:
        raise GateError(f"the gallery has fewer than {k} rows")
    sides = [{n: c for n, c in fields(df, p).items() if n != "id"} for df, p in ((queries, "query_"), (gallery, "gallery_"))]
    found = top_k(queries, gallery, k, eligible(*sides, threshold), block_bytes, within)
    every = queries.select("query_id").join(found, "query_id", "left").withColumn("__n", F.count("gallery_id").over(Window.partitionBy("query_id")))
    enough = F.when(F.col("__n") == k, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"fewer than {k} eligible neighbours for "), F.col("query_id").cast("string"))).cast("boolean"))
    return every.where(enough).select("query_id", "rank", "gallery_id", "score")


def neighbor_audit(queries: DataFrame, neighbors: DataFrame, gallery: DataFrame, k: int, threshold: int = 4) -> DataFrame:
    """(query_id, n_neighbors, reasons) of the queries whose saved neighbours aren't k, or aren't all eligible or known.

    Queries and gallery carry their metadata as query_* and gallery_*; the neighbours are looked up by id.
    """
    sides = [{n: c for n, c in fields(df, p).items() if n != "id"} for df, p in ((queries, "query_"), (gallery, "gallery_"))]
    both = neighbors.select("query_id", "gallery_id").join(queries, "query_id").join(gallery.withColumn("__known", F.lit(True)), "gallery_id", "left")
    why = F.when(F.col("__known").isNull(), F.array(F.lit("unknown_neighbor"))).otherwise(ineligible_reasons(*sides, threshold))
    found = both.select("query_id", why.alias("why")).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("why")))).alias("reasons"))
    every = queries.select("query_id").join(found, "query_id", "left")
    rows = every.select("query_id", F.coalesce("n", F.lit(0)).alias("n_neighbors"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))
    return rows.where((F.col("n_neighbors") != k) | (F.size("reasons") > 0))


def content_differences(neighbors: DataFrame, gallery: DataFrame, key: str, ignored: tuple[str, ...] = ("query_id", "rank", "score")) -> DataFrame:
    """(key, differing): saved copies of gallery rows that aren't the gallery's, with the fields that differ; a row that the
    gallery lacks differs in its key."""
    compared = [c for c in neighbors.columns if c != key and c not in ignored and c in gallery.columns]
    own = gallery.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in compared])
    both = neighbors.join(own, F.col(key) == F.col("__key"), "left")
    marks = [F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in compared]
    found = F.when(F.col("__key").isNull(), F.array(F.lit(key))).otherwise(F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>"))
    return both.select(key, found.alias("differing")).where(F.size("differing") > 0)


def require_full(neighbors: DataFrame, queries: DataFrame, k: int) -> None:
    """Every query has exactly k neighbours."""
    counted = neighbors.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    require_empty(queries.select("query_id").join(counted, "query_id", "left").where(F.coalesce("n", F.lit(0)) != k), f"fewer than {k} eligible neighbours")


def for_review(neighbors: DataFrame, least: float = 0.9999) -> DataFrame:
    """First neighbours so close that a person should look at them."""
    return neighbors.where((F.col("rank") == 1) & (F.col("score") >= least))


def nested(neighbors: DataFrame, *fields: str) -> DataFrame:
    """(query_id, neighbors): an array of structs by rank, for prompts and exports."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "gallery_id", "score", *fields)))
    return neighbors.groupBy("query_id").agg(rows.alias("neighbors"))
