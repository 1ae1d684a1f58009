"""Jaccard join on word n-grams: small sets by subsets of a fixed size, large ones by inverted lists, a boundary chosen by cost.

Two sets of n1 and n2 shingles that reach `percent` share at least t = ceil(percent * max(n1, n2) / 100) of them. In any order of
all shingles the first c that they share stand among the first n - t(n) + c of each, t(n) = ceil(percent * n / 100). So

* a light set, of fewer shingles than the boundary, enumerates the subsets of c among these: two light sets that link have
  an equal subset, and few others have;
* a heavy set stands in the inverted lists of the first n - t(n) + 1, which are scanned for the sets to compare it with; so do light
  sets that a heavy one may link with.

The order is from rare to common, shingles that no task saw repeated often standing first, by their hash: what many documents
share comes last and hardly ever becomes a key. The boundary has the least cost: subsets written for the sets below it, list
entries written and scanned for the others (lists are counted on a sixty-fourth of all shingles, whatever the table).

Equal sets are one node. No pairs are listed within a list or bucket: its members are held against a hub of it. A pair is
compared on full sets if it shares a subset, or enough list entries: what a set has behind its entries is no more than t - 1,
so the entries must hold the rest of the least intersection. Where a bucket then still holds different classes, other hubs are
taken as long as they leave many pairs of different classes and make them fewer, and what is then open is counted pair by pair, in
blocks, unless size or class settle it; no link is lost. A list of a common shingle is dealt to as many tasks as it needs.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.skew import one_for_each

from .common import chunks, drop, map_arrow, save, ship, texts_of
from .hashing import mix, shingles, wrap
from .near_dedup import _confirm, _sets, all_of, by_document, components, contracted
from .pairs import SLICE, can_link, likely, one_by_one, open_pairs

#: Shingles that a task counts at once, and how often one must occur among them to be reported.
UNIT, REPEATS = 1 << 22, 4
#: Shingles whose counts are known to every task, 16 bytes each: the most frequent ones.
COMMON = 1 << 18
#: Sets of more shingles than this are heavy in any case.
LARGEST = 1000
#: Open buckets of more than LONG members get rounds of hubs, one at first, then so many at once, CENTRES of them by how many others
#: share their lists, while they hold more than OPEN pairs of different classes a row and PATIENCE rounds have made these a quarter fewer.
LONG, HUBS, CENTRES, OPEN, PATIENCE = 16, 8, 4, 4, 3
#: One in so many shingles is looked at to estimate the lists' lengths.
PROBE = 64


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _repeated(width: int, unit: int, repeats: int):
    def run(batches):
        held, size, seen = [], 0, set()

        def flush():
            items, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= repeats
            return pa.RecordBatch.from_arrays([pa.array(items[often].view(np.int64)), pa.array(counts[often])], ["item", "n"])

        for piece in chunks(batches):
            for s in shingles(texts_of(piece, 0), width):
                digest = xxhash.xxh3_128_digest(s.tobytes())
                if len(s) and digest not in seen:
                    seen.add(digest)
                    held.append(s)
                    size += len(s)
                    if size >= unit:
                        yield flush()
                        held, size, seen = [], 0, set()
        if held:
            yield flush()

    return run


class Order:
    """The most frequent shingles and how often they were seen, by hash; shingles are ordered by that number, then by hash."""

    def __init__(self, items: np.ndarray, counts: np.ndarray):
        by = np.argsort(items)
        self.items, self.counts = items[by], counts[by]

    def seen(self, items: np.ndarray) -> np.ndarray:
        if not len(self.items):
            return np.zeros(len(items), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.items, items), len(self.items) - 1)
        return np.where(self.items[at] == items, self.counts[at], 0)


def common_order(texts: DataFrame, width: int) -> Order:
    """Counts of the COMMON most frequent shingles (all of a frequency or none) of those that repeat within a task."""
    ship(texts.sparkSession)
    counted = save(texts.mapInArrow(_repeated(width, UNIT, REPEATS), "item long, n long").groupBy("item").agg(F.sum("n").alias("n")), "repeated")
    # one row for each power of two of a frequency
    steps = sorted(((r["p"], r["k"]) for r in counted.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    least, total = None, 0
    for p, k in steps:
        total += k
        if total > COMMON:
            break
        least = 2**p
    top = counted.where(F.col("n") >= (least if least is not None else 2**62)).toPandas()
    drop(counted)
    return Order(top["item"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64))


def _first(sets: list[np.ndarray], order: Order, percent: int, more: int) -> tuple[np.ndarray, np.ndarray]:
    """(the first n - t(n) + more shingles of each set, one set after the other; how many each has)."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    flat = flat[np.lexsort((order.seen(flat), owner))]
    lengths = np.array([min(n, n - least_overlap(n, percent) + more) for n in sizes.tolist()], dtype=np.int64)
    return flat[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < np.repeat(lengths, sizes)], lengths


def _described(width: int, percent: int, order):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingles(texts_of(batch), width)
        digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        items, lengths = _first(sets, order.value, percent, 1)
        some = items % np.uint64(PROBE) == 0
        ends = np.append(0, np.cumsum(lengths))
        offsets = np.append(0, np.cumsum(some))[ends].astype(np.int32)
        probe = pa.ListArray.from_arrays(pa.array(offsets), pa.array(items[some].view(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), probe], ["id", "n", "digest", "probe"])

    return run


def boundary(nodes: DataFrame, percent: int, subset: int) -> int:
    """The number of shingles from which sets are heavy: the one of least cost, in rows written and list entries scanned. `probe` are
    the entries of a set that are looked at."""
    small = nodes.where(F.col("n") <= LARGEST)
    entries = nodes.select("n", F.explode("probe").alias("item"))
    lists = entries.groupBy("item", "n").agg(F.count(F.lit(1)).alias("k")).groupBy("item").agg(F.sum("k").alias("f"), F.map_from_entries(F.collect_list(F.when(F.col("n") <= LARGEST, F.struct("n", "k")))).alias("by"))
    scans = lists.where("f > 1").select("f", F.explode("by").alias("n", "k")).groupBy("n").agg(F.sum(F.col("k") * (F.col("f") - 1)).alias("s"))
    scanned = {r["n"]: PROBE * r["s"] for r in scans.collect()}
    counts = {r["n"]: r["k"] for r in small.groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}
    light = heavy = 0
    for n, k in counts.items():
        heavy += k * (n - least_overlap(n, percent) + 1) + scanned.get(n, 0)
    best, at = heavy, 0
    for n in sorted(counts):
        spare = n - least_overlap(n, percent)
        light += counts[n] * math.comb(min(n, spare + subset), subset)
        heavy -= counts[n] * (spare + 1) + scanned.get(n, 0)
        if light + heavy < best:
            best, at = light + heavy, n + 1
    return at


def _keys(width: int, percent: int, subset: int, heavy: int, order):
    chosen: dict[int, np.ndarray] = {}
    list_key, subset_key = ~np.uint64(1), np.uint64(1)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingles(texts_of(batch), width)
        digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        first, lengths = _first(sets, order.value, percent, subset)
        known = order.value.seen(first)
        ends, keys, parts = np.cumsum(lengths), [], []
        for n, end, length in zip([len(s) for s in sets], ends.tolist(), lengths.tolist(), strict=True):
            items, seen = first[end - length : end], known[end - length : end]
            mine, often = [], []
            if n < heavy and len(items) >= subset:
                if len(items) not in chosen:
                    chosen[len(items)] = np.array(list(combinations(range(len(items)), subset)), dtype=np.int64)
                some = chosen[len(items)]
                key = np.zeros(len(some), dtype=np.uint64)
                for k in range(subset):
                    key = mix(key + items[some[:, k]] * wrap(2 * k + 0x9E3779B97F4A7C15))
                mine.append(key | subset_key)
                often.append(seen[some].min(axis=1))
            # lists of single shingles: heavy sets, light ones that may link with one, and sets that can link without c in common
            if n and (n >= heavy or 100 * n >= percent * heavy or least_overlap(n, percent) < subset):
                alone = n - least_overlap(n, percent) + 1
                mine.append(items[:alone] & list_key)
                often.append(seen[:alone])
            keys.append(np.concatenate(mine).view(np.int64) if mine else None)
            parts.append((1 + np.concatenate(often) // SLICE).astype(np.int32) if mine else None)
        columns = [batch.column(0), pa.array(digest, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, ["id", "digest", "n", "keys", "parts"])

    return run


def _open(members: DataFrame, roots: DataFrame, weight: Column) -> DataFrame:
    """(key, node, n, root, weight) of the buckets that still hold different classes, written as a table; a node's `weight` is an
    aggregate of its rows."""
    sizes = members.groupBy("node").agg(F.count(F.lit(1)).alias("__n"), weight.alias("weight"))
    facts = sizes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "weight", "__n")
    placed = save(one_for_each(members.select("key", "node", "n"), facts, "node", "__n"), "placed")
    counted = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("__n")).where("low <> high")
    mixed = save(counted.select("key", "__n"), "mixed")
    found = save(one_for_each(placed, mixed, "key", "__n"), "members")
    drop(placed)
    drop(mixed)
    return found


def _by_hub(members: DataFrame, turn: int, percent: int) -> DataFrame:
    """(a, b): the hubs of this turn of each long open bucket with the members of other classes that may link with them.

    A node's weight is how many members all its buckets hold together, open or not. What a copy's edits bring stands in no long
    list, so of a group of near copies the one with the fewest edits, with which the most others link, is the heaviest, and comes first.
    """
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > LONG)
    long = save(one_for_each(members, sizes, "key", "__n"), "long")
    member, order = F.struct("node", "n", "root"), F.struct("weight", F.xxhash64("node"))
    chosen = [F.max_by(member, order)]
    if turn:
        # the heaviest ones of CENTRES different sets of classes, others at random
        own = lambda k: F.pmod(F.xxhash64("root", F.lit(turn)), F.lit(CENTRES)) == k
        chosen = [F.max_by(F.when(own(k), member), F.when(own(k), order)) for k in range(CENTRES)]
        chosen += [F.min_by(member, F.xxhash64("node", F.lit(turn * HUBS + k))) for k in range(HUBS - CENTRES)]
    facts = long.groupBy("key").agg(F.array_distinct(F.array(*chosen)).alias("hubs"), F.count(F.lit(1)).alias("__n"))
    # a row for each pair of different classes only, not for each member and hub
    other = lambda hub: (F.col("root") != hub["root"]) & can_link(percent, F.col("n"), hub["n"])
    both = one_for_each(long, facts, "key", "__n").select("key", "node", "n", F.explode(F.filter("hubs", other)).alias("hub"))
    low = F.col("node") < F.col("hub.node")
    pick = lambda x, y, name: F.when(low, F.col(x)).otherwise(F.col(y)).alias(name)
    pairs = both.select("key", pick("node", "hub.node", "a"), pick("n", "hub.n", "n1"), pick("hub.node", "node", "b"), pick("hub.n", "n", "n2"))
    # two members of a bucket may both be hubs of it
    found = save(likely(pairs.distinct(), percent), "hubs")
    drop(long)
    return found


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, subset: int = 2) -> DataFrame:
    """(id, n_shingles, component_id) of every row: documents link where 100 * intersection >= percent * union of their sets, and
    component_id is the smallest id that links lead to, itself included.

    Words are runs of anything but 0x20 and 0x09-0x0D with A-Z in lower case; a set holds the distinct shingles of `width` words, or
    the whole sequence if there are fewer words. Null, empty and blank texts have no shingles and link with nothing. Rows that
    repeat an id are one document that has all their sets. Rows with a null id are never linked: component_id null. Other columns
    are not read. An empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(source.dtypes)["id"]
    order = source.sparkSession.sparkContext.broadcast(common_order(source.select("text"), width))
    known = save(map_arrow(source, _described(width, percent, order), f"id {kind}, n long, digest binary, probe array<long>"), "sets")
    with_id = known.where(F.col("id").isNotNull() & F.col("digest").isNotNull())
    nodes = save(with_id.groupBy("digest").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("probe").alias("probe"), F.count(F.lit(1)).alias("__n")), "nodes")
    again = not with_id.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty()

    def compared(pairs: DataFrame) -> DataFrame:
        """The pairs that link, on their full sets, which are made anew for the documents in question."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        some = map_arrow(source.join(wanted, "id", "left_semi"), _sets(width), f"node {kind}, items array<long>")
        items = save(some.distinct() if again else some, "items")
        found = _confirm(pairs, items, percent)
        drop(items)
        return found

    heavy = boundary(nodes, percent, subset)
    listed = map_arrow(source, _keys(width, percent, subset, heavy, order), f"id {kind}, digest binary, n long, keys array<long>, parts array<int>")
    once = listed.dropDuplicates(["id", "digest"]) if again else listed
    own = once.join(nodes.select(F.col("node").alias("id"), "digest"), ["id", "digest"], "left_semi")
    each = own.select(F.col("id").alias("node"), "n", F.explode(F.arrays_zip("keys", "parts")).alias("x"))
    entries = each.select("node", "n", F.col("x.keys").alias("key"), F.col("x.parts").alias("parts"), F.pmod(F.xxhash64("node"), F.col("x.parts")).cast("int").alias("part"))
    bucket = Window.partitionBy("key", "part")
    # parts of a list that are alone in theirs still belong to the list
    shared = entries.withColumn("hub", F.min(F.struct("node", "n")).over(bucket)).withColumn("size", F.count(F.lit(1)).over(bucket)).where("size > 1 or parts > 1")
    shared = save(shared.select("key", "node", "n", "hub", "size"), "lists")
    both = shared.where((F.col("node") != F.col("hub.node")) & can_link(percent, "n", "hub.n"))
    tested = save(likely(both.select("key", F.col("hub.node").alias("a"), F.col("hub.n").alias("n1"), F.col("node").alias("b"), F.col("n").alias("n2")), percent), "pairs")
    edges = [compared(tested)]
    several = with_id.groupBy("id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("id")
    edges.append(save(with_id.join(several, "id").join(nodes, "digest").select(F.col("id").alias("a"), F.col("node").alias("b")).where("a <> b").distinct(), "owners"))
    roots = components(all_of(edges))
    left = _open(shared.select("key", "node", "n", "size"), roots, F.sum("size"))
    drop(shared)
    turn, counts, by_hub = 0, [], True
    while by_hub and not left.isEmpty():
        crossing, rows = open_pairs(left, percent, LONG)
        counts.append(crossing)
        by_hub = crossing > OPEN * rows and (turn < PATIENCE or 4 * crossing < 3 * counts[-1 - PATIENCE])
        likely_pairs = _by_hub(left, turn, percent) if by_hub else one_by_one(left, percent)
        pairs = save(likely_pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        edges.append(compared(pairs))
        before = roots, tested, left
        roots, tested = contracted(roots, edges[-1]), save(tested.union(pairs), "pairs")
        if by_hub:
            left = _open(left.select("key", "node", "n", "weight"), roots, F.max("weight"))
        for table in (*before, pairs, likely_pairs):
            drop(table)
        turn += 1
    for table in (tested, *edges):
        drop(table)

    return by_document(known, nodes, roots).withColumnsRenamed({"id": id_col, "n": "n_shingles"})
