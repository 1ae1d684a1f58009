"""Near duplicates by fast similarity sketching, banding, exact verification and connected components.

A document's set holds the hashes of its distinct word shingles. Fast similarity sketching fills t coordinates: in round
i = 0 .. t-1 every element goes to one hashed bin with the value i + a hashed fraction and each bin keeps its minimum;
bins still empty after t rounds are given, in round t + j, the minimum over all elements for bin j. So every coordinate
fills, two sets agree in a coordinate with a probability equal to their resemblance, and the agreement is concentrated.
The coordinates are cut into bands; documents that share a band key are candidates, and a link is confirmed on the full
sets. 60 bands of 7 rows miss a pair of resemblance 0.8 with a probability below 1e-6.

Scale: equal sets are first collapsed to one representative by a 128-bit digest (partial aggregation, so a hot group of
copies costs one row per task). Within a band bucket no pairs are enumerated: members are compared with one hub of the
bucket, then, where a bucket still holds different components, with a second hub. What is then undecided is joined exactly
on prefixes of rare shingles, without any cap.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.skew import one_for_each

from .common import drop, map_arrow, save, texts_of
from .hashing import U, mix, shingles, wrap
from .pairs import can_link, one_by_one

BANDS, ROWS = 60, 7
#: Pairs of one hub that a task compares; the hub's set is sent to as many tasks as that takes.
SLICE = 4096
_EMPTY = U(0xFFFFFFFFFFFFFFFF)


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches, one row of `t` coordinates for each non-empty set of 64-bit elements."""
    count = len(sets)
    out = np.full((count, t), _EMPTY, dtype=np.uint64)
    flat = out.reshape(-1)
    elements = np.concatenate(sets) if count else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(count), [len(s) for s in sets])
    open_rows = np.arange(count)
    for i in range(t):
        if not len(open_rows):
            return out
        h = mix(elements + wrap((i + 1) * 0x9E3779B97F4A7C15))
        bins = ((h >> U(32)) * U(t)) >> U(32)
        np.minimum.at(flat, owner * t + bins.astype(np.int64), (h & U(0xFFFFFFFF)) | wrap(i << 32))
        still = (out[open_rows] == _EMPTY).any(axis=1)
        if not still.all():
            is_open = np.zeros(count, dtype=bool)
            is_open[open_rows[still]] = True
            open_rows = open_rows[still]
            keep = is_open[owner]
            elements, owner = elements[keep], owner[keep]
    for k in open_rows:
        for j in np.flatnonzero(out[k] == _EMPTY):
            h = mix(sets[k] + wrap((t + int(j) + 1) * 0x9E3779B97F4A7C15))
            out[k, j] = (h & U(0xFFFFFFFF)).min() | wrap((t + int(j)) << 32)
    return out


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band, different bands having different keys."""
    keys = np.zeros((len(sketches), bands), dtype=np.uint64)
    blocks = sketches.reshape(len(sketches), bands, rows)
    for r in range(rows):
        keys = mix(keys * U(0x9FB21C651E98DF25) + blocks[:, :, r])
    return mix(keys + np.arange(1, bands + 1, dtype=np.uint64) * U(0xD6E8FEB86659FD93))


def _sketched(width: int, bands: int, rows: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingles(texts_of(batch), width)
        digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        full = [k for k, s in enumerate(sets) if len(s)]
        keys = band_keys(sketch([sets[k] for k in full], bands * rows), bands, rows).view(np.int64)
        where = dict(zip(full, range(len(full)), strict=True))
        counts = pa.array([len(s) for s in sets], pa.int64())
        lists = pa.array([keys[where[k]] if k in where else None for k in range(len(sets))], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array(digest, pa.binary()), lists], ["id", "n", "digest", "bands"])

    return run


def _digests(width: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingles(texts_of(batch), width)
        digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary())], ["id", "n", "digest"])

    return run


def _sets(width: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [s.view(np.int64) for s in shingles(texts_of(batch), width)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "items"])

    return run


def _are_stars(links: DataFrame) -> bool:
    """Whether every node has one link at most, and none to a node that has one."""
    ends = links.select("v", F.lit(1).alias("has"), F.lit(0).alias("of")).union(links.select("u", F.lit(0), F.lit(1)))
    return ends.groupBy("v").agg(F.sum("has").alias("has"), F.max("of").alias("of")).where("has > 1 or has + of > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node with a link (a, b) reaches.

    Alternating large-star and small-star steps until every node is linked with its root alone; each step is two
    aggregations or joins on the links, written to the shared folder, so lineage stays short and no driver memory is used.
    """
    links = save(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct(), "links")
    while not _are_stars(links):
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = save(both.join(least, "u").where("v > u").select("v", F.col("m").alias("u")).distinct(), "large")
        lower = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(lower, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("x"))
        following = save(small.select("x.v", "x.u").where("u <> v").distinct(), "links")
        drop(large)
        drop(links)
        links = following
    return links.select(F.col("v").alias("node"), F.col("u").alias("root"))


def contracted(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """`roots` after more links (a, b) between nodes: the links join the roots so far, which is a smaller graph."""
    at = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    between = edges.join(at("a"), "a", "left").join(at("b"), "b", "left")
    more = components(between.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    moved = more.select(F.col("node").alias("root"), F.col("root").alias("__root"))
    old = roots.join(moved, "root", "left").select("node", F.coalesce("__root", "root").alias("root"))
    done = save(old.union(more.join(roots, "node", "left_anti")), "roots")
    drop(more)
    return done


def _confirm(pairs: DataFrame, items: DataFrame, percent: int, name: str = "edges") -> DataFrame:
    """The distinct pairs (a, b) for which 100 * intersection >= percent * union on the full sets, written as a table.

    The pairs of a hub `a` that has many are dealt to several tasks, each with a copy of the hub's set.
    """
    many = save(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("parts")).where("parts > 1"), "hubs")
    dealt = pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    hubs = items.select(F.col("node").alias("a"), F.col("items").alias("x")).join(pairs.select("a").distinct(), "a", "left_semi")
    first = hubs.join(many, "a", "left").select("a", "x", copies.alias("part"))
    second = items.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = dealt.join(first, ["a", "part"]).join(second, "b")
    common = F.size(F.array_intersect("x", "y"))
    shared = both.select("a", "b", common.alias("c"), (F.size("x") + F.size("y")).alias("s"))
    found = save(shared.where(F.lit(100) * F.col("c") >= F.lit(percent) * (F.col("s") - F.col("c"))).select("a", "b").distinct(), name)
    drop(many)
    return found


def _of_sizes(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets can reach the threshold by their sizes."""
    size = lambda c, n: nodes.select(F.col("node").alias(c), F.col("n").alias(n))
    return pairs.join(size("a", "n1"), "a").join(size("b", "n2"), "b").where(can_link(percent, "n1", "n2")).select("a", "b")


def _undecided(keys: DataFrame, hubs: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, root) of the buckets of three members or more that still hold different components; none without buckets."""
    crowded = one_for_each(keys, hubs.where("size > 2").select("key", "size"), "key", "size")
    placed = save(crowded.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "placed")
    counted = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high")
    mixed = save(counted.select("key", "size"), "mixed")
    found = save(one_for_each(placed, mixed, "key", "size"), "members")
    drop(placed)
    drop(mixed)
    return found


def _rare_pairs(nodes: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """The pairs of nodes of different roots that may reach the threshold, by an exact join on prefixes; none without nodes.

    With each set's shingles ordered from rare to frequent, two sets that reach the threshold share some of their first
    n - ceil(percent * n / 100) + 1 shingles, and what stands behind these bounds how many at least. What many documents share
    stands last in this order, so a common passage makes no pairs; a shingle of many prefixes is dealt in blocks.
    """
    own = save(items.join(nodes, "node").select("node", "root", F.size("items").alias("n"), F.explode("items").alias("item")), "own")
    counted = own.groupBy("item").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    common = own.join(counted, "item", "left").select("node", "root", "n", F.struct(F.coalesce("f", F.lit(1)).alias("f"), "item").alias("x"))
    ordered = common.groupBy("node", "root", "n").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    prefix = ordered.select("node", "root", F.col("n").cast("long").alias("n"), F.explode(F.slice("xs", F.lit(1), F.expr(f"n - cast(ceil({percent} * n / 100) as int) + 1"))).alias("x"))
    members = save(prefix.where("x.f > 1").select(F.shiftleft("x.item", 1).alias("key"), "node", "n", "root"), "members")
    drop(own)
    found = one_by_one(members, percent)
    drop(members)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Classes of near-duplicate documents: (doc_id, n_shingles, component_id, kept), a row for each input row.

    Words are runs of anything but 0x20 and 0x09-0x0D with A-Z in lower case; a set holds the distinct shingles of `width`
    words, or the whole sequence if there are fewer words. component_id is the smallest id reachable over links of
    100 * intersection >= percent * union. Null or blank texts have no shingles and stand alone. Rows that repeat an id are
    one document that has all their sets. Rows with a null id are never linked: component_id null, kept true. Other columns
    of `docs` are not read. An empty input gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(source.dtypes)["id"]
    has_set = F.col("id").isNotNull() & F.col("digest").isNotNull()
    known = save(map_arrow(source, _digests(width), f"id {kind}, n long, digest binary"), "known")
    with_id = known.where(has_set)
    sketched = map_arrow(source, _sketched(width, bands, rows), f"id {kind}, n long, digest binary, bands array<long>").where(has_set)
    whole = save(sketched.groupBy("digest").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.count(F.lit(1)).alias("__n"), F.first("bands").alias("bands")), "sketches")
    nodes = save(whole.drop("bands"), "nodes")
    keys = whole.select("node", F.explode("bands").alias("key"))
    again = not with_id.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty()

    # Round 1: a hub for each bucket.
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top"), F.count(F.lit(1)).alias("size")).where("hub <> top")
    hubs = save(hubs.select("key", "hub", "size"), "hubs")
    shared = save(one_for_each(keys, hubs, "key", "size"), "shared")
    drop(whole)
    tested = save(_of_sizes(shared.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), nodes, percent), "pairs")
    keys = shared.select("key", "node")
    wanted = shared.select(F.col("node").alias("id")).distinct()
    items = map_arrow(source.join(wanted, "id", "left_semi"), _sets(width), f"node {kind}, items array<long>")
    items = save(items.distinct() if again else items, "sets")
    edges = [_confirm(tested, items, percent)]
    several = with_id.groupBy("id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("id")
    owners = with_id.join(several, "id").join(nodes.select("digest", "node"), "digest")
    edges.append(save(owners.select(F.col("id").alias("a"), F.col("node").alias("b")).where("a <> b").distinct(), "owners"))

    # A second hub for buckets whose members are still in different components, then a join on rare shingles for the rest.
    roots = components(all_of(edges))
    members = _undecided(keys, hubs, roots)
    second = members.groupBy("key").agg(F.min_by(F.struct("node", "root"), F.xxhash64("node")).alias("hub"), F.count(F.lit(1)).alias("size"))
    placed = one_for_each(members, second, "key", "size").where("root <> hub.root")
    new = placed.select(F.least("hub.node", "node").alias("a"), F.greatest("hub.node", "node").alias("b"))
    new = save(_of_sizes(new.distinct().join(tested, ["a", "b"], "left_anti"), nodes, percent), "pairs")
    drop(members)
    drop(tested)
    edges.append(_confirm(new, items, percent))
    drop(new)
    roots = contracted(roots, edges[-1])
    members = _undecided(keys, hubs, roots)
    for table in (shared, hubs):
        drop(table)
    rest = save(members.select("node", "root").distinct(), "undecided")
    drop(members)
    rare = _rare_pairs(rest, items, percent)
    edges.append(_confirm(rare, items, percent))
    for table in (rest, rare, items):
        drop(table)

    roots = contracted(roots, edges[-1])
    done = save(by_document(known, nodes, roots).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept")), "classes")
    for table in (roots, nodes, known, *edges):
        drop(table)
    return done


def all_of(edges: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, edges)


def by_document(known: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, n, component_id) of each row of `known`: the root of its set's node; alone without an id (null) or a set (its own id,
    or the component of the id's other rows). nodes: (digest, node, __n), the rows of each set; roots: (node, root)."""
    with_set = F.col("id").isNotNull() & F.col("digest").isNotNull()
    facts = save(nodes.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("component_id"), "__n"), "facts")
    linked = one_for_each(known.where(with_set).select("id", "n", "digest"), facts, "digest", "__n").select("id", "n", "component_id")
    alone = known.where(~with_set).select("id", "n")
    placed = linked.join(alone.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("component_id").alias("root"))
    return linked.unionByName(alone.join(placed, "id", "left").select("id", "n", F.coalesce("root", "id").alias("component_id")))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, all columns, whose document is the smallest id of its class; rows with a null id stay."""
    found = near_duplicates(docs, id_col, text_col, width, percent)
    gone = found.where(~F.col("kept")).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
