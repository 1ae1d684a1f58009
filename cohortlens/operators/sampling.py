"""Grouped splits, stratified allocation, case samples and blinded orders, all by hash."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.hashing import draw
from cohortlens.operators.skew import one_for_each
from cohortlens.sources.shared import written


def greedy_split(sizes: list[tuple[str, int]], fractions: tuple[float, ...], seed_order) -> dict[str, int]:
    """Assign groups to splits: largest first (equal sizes in seeded order), each to the split with the most room left among
    those it fits in, or else to the one with the most room; of equal rooms to the split that holds less so far."""
    total = sum(n for _, n in sizes)
    room = [f * total for f in fractions]
    out = {}
    for group, n in sorted(sizes, key=lambda x: (-x[1], seed_order(x[0]))):
        fits = [k for k in range(len(room)) if room[k] >= n] or range(len(room))
        best = max(fits, key=lambda k: (room[k], -fractions[k], -k))
        out[group] = best
        room[best] -= n
    return out


def level_turns(levels: list[tuple[int, int]], fractions: tuple[float, ...]) -> list[tuple[int, int, int, list[int]]]:
    """greedy_split over (size, number of groups of that size), a level at a time: (size, begin, end, splits) tells that the
    groups of that size from rank `begin` to before `end` go to `splits` in turn.

    Whenever a group fits anywhere it fits where the most room is, so the fold always takes that split. Groups of one size
    lower the rooms by equal steps: the splits within a step of the fullest take turns until the next one is reached. Splits are
    numbered by their fraction here, as of equal rooms that of the smaller fraction holds less.
    """
    names = sorted(range(len(fractions)), key=lambda k: (fractions[k], k))
    shares = [Fraction(str(fractions[k])) for k in names]
    unit = math.lcm(*[f.denominator for f in shares])
    total = sum(size * count for size, count in levels)
    room = [int(f * unit) * total for f in shares]
    out = []
    for size, count in sorted(levels, reverse=True):
        step, begin = size * unit, 0
        while begin < count:
            order = sorted(range(len(room)), key=lambda k: (-room[k], k))
            top, lead = room[order[0]], order[0]
            turns = [k for k in order if k == lead or (room[k], -k) > (top - step, -lead)]
            end = count
            if len(turns) < len(order):
                following = order[len(turns)]
                apart = top - room[following]
                rounds = apart // step if lead < following else (apart - 1) // step
                end = min(count, begin + rounds * len(turns))
            out.append((size, begin, end, [names[k] for k in turns]))
            full, rest = divmod(end - begin, len(turns))
            for i, k in enumerate(turns):
                room[k] -= step * (full + (i < rest))
            begin = end
    return out


def grouped_split(df: DataFrame, group: str, names: tuple[str, ...] = ("train", "validation", "test"), fractions: tuple[float, ...] = (0.8, 0.1, 0.1), seed: int = 20260831, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """`df` with `split`: a group lies in one split, and split sizes follow the fractions.

    The assignment is greedy_split's at all sizes, equal sizes in the order of their hashes. Only the histogram of group
    sizes reaches the driver (its levels grow with the square root of the rows); ranks within a level are counted by
    buckets of the hash. An assignment of at most `broadcast_bytes` is sent to the rows, a larger one joined by the group.
    """
    spark = df.sparkSession
    hashed = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("__group").cast("string"), F.lit("None"))))
    sizes = df.groupBy(F.col(group).alias("__group")).agg(F.count(F.lit(1)).alias("__n")).withColumn("__h", hashed).withColumn("__bucket", F.substring("__h", 1, 3))
    counted = sizes.groupBy("__n").agg(F.count(F.lit(1)).alias("c"), F.sum(F.coalesce(F.octet_length(F.col("__group").cast("string")), F.lit(0)) + 32).alias("bytes")).collect()
    levels = [(r["__n"], r["c"]) for r in counted]
    turns = spark.createDataFrame([(n, a, b, [names[k] for k in t]) for n, a, b, t in level_turns(levels, fractions)], "__n long, __begin long, __end long, __turns array<string>")
    before = Window.partitionBy("__n").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.groupBy("__n", "__bucket").agg(F.count(F.lit(1)).alias("__c")).withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0))).drop("__c")
    ranked = sizes.join(offsets, ["__n", "__bucket"]).withColumn("__rank", F.col("__before") + F.row_number().over(Window.partitionBy("__n", "__bucket").orderBy("__h", "__group")) - 1)
    place = (F.col("__rank") - F.col("__begin")) % F.size("__turns")
    within = (ranked["__n"] == turns["__n"]) & (F.col("__rank") >= F.col("__begin")) & (F.col("__rank") < F.col("__end"))
    assigned = ranked.join(turns, within).select("__group", F.get("__turns", place).alias("split"))
    if sum(r["bytes"] for r in counted) <= broadcast_bytes:
        assigned = F.broadcast(assigned)
    return df.join(assigned, df[group].eqNullSafe(assigned["__group"]), "left").select(*[df[c] for c in df.columns], assigned["split"])


def hash_split(group: Column, names: tuple[str, ...], fractions: tuple[float, ...], seed: int) -> Column:
    place = F.pmod(draw(seed, group), F.lit(10_000))
    out, edge = F.when(F.lit(False), F.lit("")), 0.0
    for name, f in zip(names, fractions, strict=True):
        edge += f
        out = out.when(place < round(edge * 10_000), name)
    return out.otherwise(names[-1])


def proportional_sample(df: DataFrame, strata: list[str], id_col: str, n: int, seed: int = 20260831) -> DataFrame:
    """`n` rows over all strata: one seat for each, then seats by the largest size / (seats + 1) (equal quotients to the larger
    key), within a stratum the rows of the smallest hashes.

    A stratum's i-th row by hash stands for its i-th seat with the quotient size / i, the first seat first of all; the n
    largest quotients get a seat. Every stratum offers n seats at most, so no stratum is more than n rows in the last step.
    """
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in strata])
    keyed = df.withColumn("__key", key)
    # the rank is bounded, so each task sends at most n rows of a stratum
    seats = keyed.withColumn("__seat", F.row_number().over(Window.partitionBy("__key").orderBy(draw(seed, F.col(id_col)), id_col))).where(F.col("__seat") <= n)
    sized = seats.join(keyed.groupBy("__key").agg(F.count(F.lit(1)).alias("__size")), "__key")
    quotient = F.when(F.col("__seat") == 1, F.lit(float("inf"))).otherwise(F.col("__size") / F.col("__seat"))
    return sized.withColumn("__q", quotient).orderBy(F.desc("__q"), F.desc("__key"), "__seat").limit(n).select(*df.columns)


def _ranked(work: DataFrame, keys: list[str], top: DataFrame) -> DataFrame:
    """The rows of `top`, some of those of `work`, with `__rank`: their place from 1 by (__h, __id) among the rows of their keys.

    Every row is counted by the number of chosen rows before it, so a task sends that many numbers for each group, and no
    group is sorted.
    """
    marks = F.sort_array(F.collect_list(F.struct("__h", "__id")))
    facts = top.groupBy(*keys).agg(marks.alias("__marks")).join(work.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), keys)
    before = F.expr("size(filter(__marks, m -> m < struct(__h, __id)))")
    slots = one_for_each(work.select(*keys, "__h", "__id"), facts, keys, "__n").groupBy(*keys, before.alias("__slot")).agg(F.count(F.lit(1)).alias("__c"))
    rank = F.sum("__c").over(Window.partitionBy(*keys).orderBy("__slot"))
    places = slots.withColumn("__rank", rank).drop("__c")
    return top.join(facts.drop("__n"), keys).withColumn("__slot", before).join(places, [*keys, "__slot"]).drop("__marks", "__slot")


def case_sample(cases: DataFrame, id_col: str, tags: str, groups: list[str], n: int = 60, seed: int = 20260831) -> DataFrame:
    """Half rescued and half harmed cases (a case with both tags counts as rescued), strict ones first, spread over groups by
    rank within the group, then filled up from what is left; with the direction and a case number. Ids are unique, groups not null.

    Of a direction and group only the n strict and the n other cases of the smallest hashes can be picked: tasks send no more of
    each, and the ranks of these are counted, so no task holds a group. Cases are computed once and written, as counts, picks,
    ranks and the rest read them all.
    """
    h = draw(seed, F.col(id_col))
    work = cases.withColumn("direction", F.when(F.col(tags).contains("rescue"), "rescue").otherwise("harm")).withColumn("strict", F.when(F.col(tags).contains("strict_"), 0).otherwise(1)).withColumn("__h", h)
    work = written(work)
    counts = {r["direction"]: r["n"] for r in work.groupBy("direction").agg(F.count(F.lit(1)).alias("n")).collect()}
    rescue = min((n + 1) // 2, counts.get("rescue", 0))
    harm = min(n - rescue, counts.get("harm", 0))
    keyed = work.withColumn("__id", F.col(id_col))
    least = Window.partitionBy("direction", "strict", *groups).orderBy("__h", "__id")
    top = written(keyed.withColumn("__r", F.row_number().over(least)).where(F.col("__r") <= n).drop("__r"))
    order = Window.partitionBy("direction").orderBy("strict", "__rank", *groups, "__h", id_col)
    placed = _ranked(keyed, ["direction", *groups], top).withColumn("__p", F.row_number().over(order)).where(F.col("__p") <= n)
    picked = placed.where(((F.col("direction") == "rescue") & (F.col("__p") <= rescue)) | ((F.col("direction") == "harm") & (F.col("__p") <= harm)))
    if rescue + harm < n:
        rest = work.join(picked.select(id_col), id_col, "left_anti").orderBy("strict", "__h", id_col).limit(n - rescue - harm)
        picked = picked.unionByName(rest, allowMissingColumns=True)
    # at most n rows are numbered
    number = F.row_number().over(Window.orderBy("direction", "strict", "__h", id_col))
    return picked.limit(n).withColumn("case_number", F.format_string("QR-%04d", number)).drop("__h", "__id", "__rank", "__p")


def blinded_forms(sample: DataFrame, id_col: str, shown: list[str], seed: int = 20260831, forms: int = 2) -> tuple[DataFrame, list[DataFrame]]:
    """(crosswalk, forms): blinded ids by hash; each form holds only the blinded id and what is shown, in an order of its own."""
    blinded = sample.withColumn("blinded_id", F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")), 256), 1, 12))
    crosswalk = blinded.select("blinded_id", *sample.columns)
    made = []
    for k in range(forms):
        order = draw(seed + 1 + k, F.col("blinded_id"))
        made.append(blinded.select("blinded_id", *shown, order.alias("position")).orderBy("position", "blinded_id"))
    return crosswalk, made


def arm_letters(df: DataFrame, case: str, arm: str, seed: int = 20260831, letters: str = "XYZ") -> DataFrame:
    """`df` with `letter`: the arms of each case in an order drawn for that case."""
    place = F.row_number().over(Window.partitionBy(case).orderBy(draw(seed, F.col(case), F.col(arm)), arm))
    return df.withColumn("letter", F.element_at(F.array(*[F.lit(x) for x in letters]), place))


def counterbalanced(seed: Column | int, *parts: Column) -> Column:
    """True where the second arm goes first."""
    return F.pmod(draw(seed, *parts), F.lit(2)) == 1
