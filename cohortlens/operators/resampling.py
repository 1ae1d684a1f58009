"""Clustered resampling inference on additive totals, with hash-derived draws.

Rows are reduced to one wide row per stratum and cluster first; a replicate then weighs, swaps or flips whole clusters.
Draws depend on the seed, the replicate and the slot alone, so results don't depend on partitioning and any SQL engine
can repeat them.

No row is made for a draw. Clusters meet blocks of replicates in Arrow tables: a matrix of weights, swaps or signs
(replicates x clusters) times the clusters' totals gives the totals of all replicates of the block, and partial sums by
(stratum, replicate) are what is shuffled. Totals are whole numbers, which stay exact, or doubles.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.hashing import MIXERS, draw

SEED = 20260831
#: Replicates in a block, clusters that a task weighs at once, cells of one matrix.
BLOCK, CLUSTERS, CELLS = 1000, 1 << 16, 1 << 21
#: Tasks that the blocks of replicates are dealt to at least.
TASKS = 32


def numbered(stats: DataFrame, strata: list[str], cluster: str) -> DataFrame:
    """Clusters numbered from 0 within their stratum (by the first ten bits of their hash, then by name), with the stratum's
    number of clusters.

    Clusters are counted by those bits and then numbered within each value of them, so no task holds a whole stratum.
    """
    keyed = stats.withColumn("__h", draw(F.col(cluster))).withColumn("__bits", F.shiftright("__h", 22))
    whole = Window.partitionBy(*strata)
    before = F.coalesce(F.sum("__c").over(whole.orderBy("__bits").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = keyed.groupBy(*strata, "__bits").agg(F.count(F.lit(1)).alias("__c")).withColumn("__before", before).withColumn("__n", F.sum("__c").over(whole)).drop("__c")
    place = F.row_number().over(Window.partitionBy(*strata, "__bits").orderBy(cluster)) - 1
    keys = [*strata, "__bits"]
    other = counts.withColumnsRenamed({c: f"__of_{c}" for c in keys})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in keys])
    return keyed.withColumn("__r", place).join(other, same).withColumn("__i", F.col("__before") + F.col("__r")).drop("__bits", "__before", "__r", *[f"__of_{c}" for c in keys])


def draws(seed: int) -> tuple[Callable, Callable]:
    """(weights, odd), the arithmetic of functions.hashing.spread on a block of replicates that begins with `first`.

    weights(first, count, n): how often n draws with replacement hit each of n clusters, replicates x n.
    odd(first, count, hashes): 1 where a cluster's draw is odd, replicates x clusters.
    They are closures, so that tasks bring them along.
    """
    mixers, low = MIXERS, np.uint64(0xFFFFFFFF)

    def mixed(x):
        for shift, factor in ((16, mixers[0]), (15, mixers[1])):
            x = ((x ^ (x >> np.uint64(shift))) * np.uint64(factor)) & low
        return x ^ (x >> np.uint64(15))

    def states(first, count):
        start = mixed(np.array([seed], dtype=np.uint64) & low)
        return mixed((start + np.arange(first, first + count, dtype=np.uint64)) & low)[:, None]

    def weights(first, count, n):
        hit = mixed((states(first, count) + np.arange(n, dtype=np.uint64)) & low) % np.uint64(n)
        cell = hit + np.arange(count, dtype=np.uint64)[:, None] * np.uint64(n)
        return np.bincount(cell.astype(np.int64).reshape(-1), minlength=count * n).reshape(count, n)

    def odd(first, count, hashes):
        return (mixed((states(first, count) + hashes.astype(np.uint64)) & low) & np.uint64(1)).astype(np.int64)

    return weights, odd


def replicated(stats: DataFrame, strata: list[str], cluster: str, sums: list[str], n: int, matrix: Callable) -> DataFrame:
    """(strata..., b, sums...): for each replicate the sum over clusters of what `matrix` says times their totals.

    matrix(first, count, size, numbers, hashes) is a matrix of `count` replicates from `first` on by the clusters of a task:
    `size` is the stratum's number of clusters, `numbers` and `hashes` are those of the task's clusters, CLUSTERS at most. As few
    rows become many sums, a cluster's row goes to a task for each block of replicates. Missing totals count as 0.
    """
    kinds = dict(stats.dtypes)
    fractional = [c for c in sums if kinds[c] in ("double", "float")]
    whole = [c for c in sums if c not in fractional]
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in strata] + ["b long"] + [f"`{c}` {'double' if c in fractional else 'long'}" for c in sums])
    block, cells = BLOCK, CELLS

    def values(table, names):
        columns = [table[c].fill_null(0).to_numpy() for c in names]
        return np.stack(columns, axis=1) if names else np.zeros((table.num_rows, 0))

    def run(table: pa.Table) -> pa.Table:
        size, first = table["__n"][0].as_py(), table["__k"][0].as_py() * block
        numbers, hashes = table["__i"].to_numpy(), table["__h"].to_numpy()
        counts, parts = values(table, whole).astype(np.int64), values(table, fractional)
        # doubles hold every whole number that a product can reach, or the product is made of whole numbers
        if float(np.abs(counts).max(initial=0)) * size < 2.0**53:
            counts = counts.astype(np.float64)
        step, out = max(1, cells // size), []
        for begin in range(first, min(first + block, n), step):
            cell = matrix(begin, min(step, first + block - begin, n - begin), size, numbers, hashes)
            out.append((np.rint(cell.astype(counts.dtype) @ counts).astype(np.int64), cell.astype(np.float64) @ parts))
        sums_whole, sums_parts = (np.concatenate(x) for x in zip(*out, strict=True))
        columns = {c: pa.array([table[c][0].as_py()] * len(sums_whole), table.schema.field(c).type) for c in strata} | {"b": pa.array(np.arange(first, first + len(sums_whole)))}
        columns |= {c: pa.array(sums_whole[:, i]) for i, c in enumerate(whole)} | {c: pa.array(sums_parts[:, i]) for i, c in enumerate(fractional)}
        return pa.table({c: columns[c] for c in [*strata, "b", *sums]})

    marked = numbered(stats, strata, cluster).select(*strata, *sums, "__n", "__i", "__h", F.floor(F.col("__i") / CLUSTERS).alias("__part"))
    blocks = -(-n // BLOCK)
    dealt = marked.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # a number of tasks of its own: by their bytes these rows would be one task
    tasks = max(min(blocks, TASKS), int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartition(tasks, *strata, "__part", "__k")
    return dealt.groupBy(*strata, "__part", "__k").applyInArrow(run, schema).groupBy(*strata, "b").agg(*[F.sum(c).alias(c) for c in sums])


def weighted_totals(stats: DataFrame, strata: list[str], cluster: str, sums: list[str], n: int, seed: int = SEED) -> DataFrame:
    """(strata..., b, sums...): the totals of every bootstrap replicate, as many clusters drawn with replacement as there are.

    Strata of equal size share their draws. A task makes the draws of all slots of its stratum and keeps those of its clusters.
    """
    weights, _ = draws(seed)
    return replicated(stats, strata, cluster, sums, n, lambda first, count, size, numbers, hashes: weights(first, count, size)[:, numbers])


def long(df: DataFrame, keys: list[str], values: Mapping[str, Column], name: str = "metric", value: str = "value") -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias(name), c.cast("double").alias(value)) for k, c in values.items()])
    return df.select(*keys, F.explode(rows).alias("x")).select(*keys, f"x.{name}", f"x.{value}")


def intervals(point: DataFrame, drawn: DataFrame, keys: list[str], values: Mapping[str, Column], level: float = 0.95) -> DataFrame:
    """(keys..., metric, estimate, ci_low, ci_high, n_valid): percentile intervals of `values` over the replicates in which they are
    defined; `point` and `drawn` hold the totals, one row and a row for each replicate of a stratum."""
    tail = (1 - level) / 2
    wide = drawn.select(*keys, *[c.cast("double").alias(k) for k, c in values.items()])
    found = wide.groupBy(*keys).agg(*[F.struct(F.percentile(k, [tail, 1 - tail]).alias("q"), F.count(k).alias("n")).alias(k) for k in values])
    each = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(f"{k}.q").alias("q"), F.col(f"{k}.n").alias("n_valid")) for k in values])
    spread = found.select(*keys, F.explode(each).alias("x")).select(*keys, "x.*")
    both = long(point, keys, values).join(spread, [*keys, "metric"], "left")
    return both.select(*keys, "metric", F.col("value").alias("estimate"), F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), F.coalesce("n_valid", F.lit(0)).alias("n_valid"))


def bootstrap(stats: DataFrame, strata: list[str], cluster: str, sums: list[str], values, n: int = 10_000, seed: int = SEED, level: float = 0.95) -> DataFrame:
    """Cluster bootstrap intervals of `values` (a function from a column getter to named metrics)."""
    point = stats.groupBy(*strata).agg(*[F.sum(c).alias(c) for c in sums])
    return intervals(point, weighted_totals(stats, strata, cluster, sums, n, seed), strata, values(F.col), level)


def _differences(values) -> Callable:
    def differences(of) -> dict[str, Column]:
        first, second = values(lambda c: of(f"a_{c}")), values(lambda c: of(f"b_{c}"))
        return {k: second[k] - first[k] for k in first}

    return differences


def paired_bootstrap(arms: DataFrame, strata: list[str], cluster: str, sums: list[str], values, n: int = 10_000, seed: int = SEED, level: float = 0.95) -> DataFrame:
    """Intervals of metric differences, second arm less first, with the same weights in both arms.

    `arms` holds one row for each stratum and cluster with sums a_* and b_*.
    """
    return bootstrap(arms, strata, cluster, [f"{t}_{c}" for t in "ab" for c in sums], _differences(values), n, seed, level)


def paired_permutation(arms: DataFrame, strata: list[str], cluster: str, sums: list[str], values, n: int = 10_000, seed: int = SEED) -> DataFrame:
    """(strata..., metric, difference, p_value, valid): whole clusters swap arms with probability 1/2.

    p = (replicates whose difference is as large or larger in size + 1) / (defined replicates + 1).
    """
    both = [f"{t}_{c}" for t in "ab" for c in sums]
    point = arms.groupBy(*strata).agg(*[F.sum(c).alias(c) for c in both])
    # a swap adds what the arms differ by to one arm and takes it from the other, so that is all a replicate adds up
    apart = arms.select(*strata, cluster, *[(F.coalesce(f"b_{c}", F.lit(0)) - F.coalesce(f"a_{c}", F.lit(0))).alias(f"__{c}") for c in sums])
    _, odd = draws(seed)
    moved = replicated(apart, strata, cluster, [f"__{c}" for c in sums], n, lambda first, count, size, numbers, hashes: odd(first, count, hashes))
    differences = _differences(values)
    observed = point.select(*strata, *both, F.struct(*[c.cast("double").alias(k) for k, c in differences(F.col).items()]).alias("__seen"))
    mixed = moved.join(observed, strata).select(*strata, "__seen", *[(F.col(f"{t}_{c}") + sign * F.col(f"__{c}")).alias(f"{t}_{c}") for t, sign in (("a", 1), ("b", -1)) for c in sums])
    null = mixed.select(*strata, "__seen", *[c.cast("double").alias(k) for k, c in differences(F.col).items()])
    names = list(differences(F.col))
    reached = [F.struct(F.count_if(F.abs(k) >= F.abs(F.col(f"__seen.{k}")) - 1e-15).alias("e"), F.count(k).alias("valid")).alias(k) for k in names]
    found = null.groupBy(*strata).agg(*reached)
    each = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(f"{k}.e").alias("e"), F.col(f"{k}.valid").alias("valid")) for k in names])
    counted = found.select(*strata, F.explode(each).alias("x")).select(*strata, "x.*")
    p = F.when(F.col("difference").isNotNull(), (F.coalesce("e", F.lit(0)) + 1) / (F.coalesce("valid", F.lit(0)) + 1))
    whole = long(point, strata, differences(F.col), value="difference").join(counted, [*strata, "metric"], "left")
    return whole.select(*strata, "metric", "difference", p.alias("p_value"), F.coalesce("valid", F.lit(0)).alias("valid"))


def sign_flip(stats: DataFrame, strata: list[str], cluster: str, nets: list[str], n: int = 10_000, seed: int = SEED) -> DataFrame:
    """(strata..., metric, net, p_value): the sign of each cluster's net count flips with probability 1/2."""
    point = stats.groupBy(*strata).agg(*[F.sum(c).alias(c) for c in nets])
    _, odd = draws(seed)
    flipped = replicated(stats, strata, cluster, nets, n, lambda first, count, size, numbers, hashes: 2 * odd(first, count, hashes) - 1)
    observed = long(point, strata, {c: F.col(c) for c in nets}, value="net")
    null = long(flipped, strata, {c: F.col(c) for c in nets})
    counted = null.join(observed, [*strata, "metric"]).groupBy(*strata, "metric", "net").agg(F.count_if(F.abs("value") >= F.abs("net")).alias("e"), F.count(F.lit(1)).alias("n"))
    return counted.select(*strata, "metric", "net", ((F.col("e") + 1) / (F.col("n") + 1)).alias("p_value"))


def cluster_column(df: DataFrame, candidates: list[str]) -> str:
    """The first candidate that has a value in every row."""
    blank = df.agg(*[F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(c) for c in candidates if c in df.columns]).first()
    for c in candidates:
        if c in df.columns and blank[c] == 0:
            return c
    raise ValueError(f"none of {candidates} identifies every row's cluster")
