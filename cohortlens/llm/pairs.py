"""Pairs of sets that may reach a resemblance, from the shingles at the rare end of both that they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.skew import one_for_each

from .common import drop, save

#: Members of a bucket that a task compares with as many others.
SLICE = 4096


def can_link(percent: int, a: str | Column, b: str | Column) -> Column:
    """Whether sets of these sizes can reach the threshold at all."""
    return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)


def _needed(percent: int, n1: str = "n1", n2: str = "n2") -> Column:
    """How many of the first n - t(n) + 1 shingles sets of n1 and n2 must share to reach the threshold: their least intersection,
    less what can stand behind these in either, t(n) - 1 with t(n) = ceil(percent * n / 100)."""
    whole = f"(({percent} * ({n1} + {n2}) + {99 + percent}) div {100 + percent})"
    return F.expr(f"{whole} - (({percent} * greatest({n1}, {n2}) + 99) div 100) + 1")


def likely(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the rows (key, a, n1, b, n2) whose pair may reach the threshold: it shares a key that is odd, the hash of a subset,
    or as many even ones, shingles among the first of both, as are needed."""
    counted = pairs.groupBy("a", "b", "n1", "n2").agg(F.count_if(F.col("key").bitwiseAND(F.lit(1)) == 0).alias("c"), F.count(F.lit(1)).alias("all"))
    return counted.where((F.col("all") > F.col("c")) | (F.col("c") >= _needed(percent))).select("a", "b")


def _with_spare(members: DataFrame) -> DataFrame:
    """`members` with m, how many their bucket holds, and spare: how many of a node's lists, from short to long, follow from this one
    on; without a bound for subsets."""
    facts = members.groupBy("key").agg(F.count(F.lit(1)).alias("__n")).withColumn("m", F.col("__n"))
    is_list = F.col("key").bitwiseAND(F.lit(1)) == 0
    own = Window.partitionBy("node", is_list)
    spare = F.when(is_list, F.count(F.lit(1)).over(own) - F.row_number().over(own.orderBy("m", "key")) + 1).otherwise(F.lit(2**62))
    return one_for_each(members, facts, "key", "__n").withColumn("spare", spare)


def open_pairs(members: DataFrame, percent: int, least: int) -> tuple[float, int]:
    """(about how many rows one_by_one's join makes for the buckets of more than `least` members, how many rows of `members` these
    have), counted by bucket and class."""
    some = _with_spare(members).withColumn("late", F.col("spare") < _needed(percent, "n", "n"))
    held = some.groupBy("key", "root").agg(F.count_if(~F.col("late")).cast("double").alias("k"), F.count(F.lit(1)).alias("rows"))
    by_key = held.groupBy("key").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("same"), F.sum("rows").alias("rows")).where(F.col("rows") > least)
    found = by_key.agg(F.sum((F.col("k") * F.col("k") - F.col("same")) / 2).alias("pairs"), F.sum("rows").alias("rows")).first()
    return found["pairs"] or 0.0, found["rows"] or 0


def one_by_one(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): the members (key, node, n, root) of different classes of all buckets that may link.

    A node's lists are ordered from short to long. The first one that it shares with another is followed, in the lists of both,
    by as many as they must share besides, or else the pair isn't made: lists of what many documents share stand last. All
    lists that two sets of different classes share must be among the buckets. A long list is compared in blocks of SLICE.
    """
    sized = _with_spare(members).withColumn("blocks", F.ceil(F.col("m") / SLICE).cast("int"))
    dealt = save(sized.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")), "dealt")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = dealt.select("key", F.col("block").alias("i"), every.alias("j"), F.col("node").alias("a"), F.col("n").alias("n1"), F.col("root").alias("r1"), F.col("spare").alias("s1"))
    right = dealt.select("key", every.alias("i"), F.col("block").alias("j"), F.col("node").alias("b"), F.col("n").alias("n2"), F.col("root").alias("r2"), F.col("spare").alias("s2"))
    both = left.join(right, ["key", "i", "j"]).where(F.expr("a < b and r1 <> r2") & can_link(percent, "n1", "n2") & (F.least("s1", "s2") >= _needed(percent)))
    found = save(both.select("a", "b").distinct(), "pairs")
    drop(dealt)
    return found
