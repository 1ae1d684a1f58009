"""Exact quantiles of groups of any size, by selection.

Values become whole numbers of 64 bits in the same order. Small groups are sorted in one aggregation buffer. In large ones
the wanted ranks are narrowed down by counting: a pass counts a rank's remaining values by their next DIGIT bits, keeps the
part that holds the rank and the number of values before it, until what remains fits a buffer. A pass moves counts alone,
2**DIGIT for each rank and task at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.sources.shared import written

#: Values that one aggregation buffer may hold, and bits that a pass settles.
WHOLE, DIGIT = 1 << 16, 16


def _ordered(value: Column) -> Column:
    """A double as a long of the same order; NaN comes last, as in Spark's own order."""

    @F.arrow_udf("long")
    def bits(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            raw = array.fill_null(0.0).to_numpy(zero_copy_only=False).astype("float64").view("int64")
            yield pa.array(raw ^ ((raw >> 63) & 0x7FFFFFFFFFFFFFFF), mask=array.is_null().to_numpy(zero_copy_only=False))

    return bits(value.cast("double"))


def _restored(key: Column) -> Column:
    @F.arrow_udf("double")
    def values(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            raw = array.fill_null(0).to_numpy(zero_copy_only=False)
            yield pa.array((raw ^ ((raw >> 63) & 0x7FFFFFFFFFFFFFFF)).view("float64"), mask=array.is_null().to_numpy(zero_copy_only=False))

    return values(key)


def _same(groups: list[str], left: DataFrame, right: DataFrame) -> Column:
    return reduce(lambda a, b: a & b, [left[g].eqNullSafe(right[g]) for g in groups], F.lit(True))


def _selected(rows: DataFrame, ranks: DataFrame, groups: list[str]) -> DataFrame:
    """(groups..., rank, x): of each group the value of each wanted rank, counted from 0; `rows` has the values `x` as longs."""
    found = None
    # `before`: the group's values below the remaining ones, which share all bits above `shift`
    ranks = written(ranks.select(*groups, "rank", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"), F.col("n").alias("left")))
    for shift in range(64, -1, -DIGIT):
        remaining = lambda some: rows.join(some, _same(groups, rows, some) & (F.lit(shift == 64) | (F.shiftright("x", min(shift, 63)) == F.col("prefix")))).drop(*[rows[g] for g in groups])  # noqa: E731, B023
        small = F.col("left") <= (WHOLE if shift else 2**62)
        done = ranks.where(small)
        if shift:
            sorted_ = remaining(done).groupBy(*groups, "rank", "before").agg(F.sort_array(F.collect_list("x")).alias("xs"))
            part = sorted_.select(*groups, "rank", F.get("xs", (F.col("rank") - F.col("before")).cast("int")).alias("x"))
        else:
            part = done.select(*groups, "rank", F.col("prefix").alias("x"))  # all bits are known: equal values
        found = part if found is None else found.unionByName(part)
        open_ = ranks.where(~small)
        if not shift or open_.isEmpty():
            return found
        # signed at the top, unsigned below: the order of the digits is that of the values
        following = remaining(open_).groupBy(*groups, "rank", "before", F.shiftright("x", shift - DIGIT).alias("next")).agg(F.count(F.lit(1)).alias("c"))
        by = Window.partitionBy(*groups, "rank").orderBy("next")
        below = F.col("before") + F.coalesce(F.sum("c").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        holds = following.withColumn("below", below).where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("c")))
        ranks = written(holds.select(*groups, "rank", F.col("next").alias("prefix"), F.col("below").alias("before"), F.col("c").alias("left")))
    raise AssertionError("the last pass knows all bits")


def quantiles(df: DataFrame, value: str, groups: list[str], levels: list[float]) -> DataFrame:
    """(groups..., q): an array of the linearly interpolated quantiles of the non-null values of each group, at each level.

    A group without values, or an empty table, has no row. Ties, infinities and NaN (the largest value) are values like others.
    """
    some = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("__v"))
    counts = some.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    large = written(counts.where(F.col("n") > WHOLE))
    whole = lambda rows: rows.groupBy(*groups).agg(F.percentile("__v", list(levels)).alias("q")).where("q is not null")
    if large.isEmpty():
        return whole(some)
    rest = some.join(large, _same(groups, some, large), "left_anti")
    at = lambda level: (F.col("n") - 1) * F.lit(float(level))
    sides = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(at(x)).cast("long"), F.ceil(at(x)).cast("long")) for x in levels])))
    ranks = large.select(*groups, "n", F.explode(sides).alias("rank"))
    rows = some.join(large.drop("n"), _same(groups, some, large), "left_semi").select(*groups, _ordered(F.col("__v")).alias("x"))
    chosen = _selected(rows, ranks, groups).withColumn("v", _restored(F.col("x")))
    values = chosen.groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("v"))

    def between(level: float) -> Column:
        low, high = F.floor(at(level)).cast("long"), F.ceil(at(level)).cast("long")
        a, b = F.element_at("v", low), F.element_at("v", high)
        return F.when(low == high, a).otherwise((high - at(level)) * a + (at(level) - low) * b)

    both = large.join(values.withColumnsRenamed({g: f"__{g}" for g in groups}), reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups], F.lit(True)))
    return whole(rest).unionByName(both.select(*groups, F.array(*[between(x) for x in levels]).alias("q")))
