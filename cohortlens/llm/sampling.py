"""Bounded, repeatable samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Classes up to which their bounds (16 bytes each) are broadcast; more are joined.
FEW = 1 << 16


def bounded(rows: DataFrame, id_col: str, class_col: str, per_class: int) -> DataFrame:
    """The rows of each class with the `per_class` smallest id hashes (more if an id repeats); none without a class.

    No rows are ranked: they are counted by class and magnitude of their hash, those below the bound that this gives by 1024
    parts of it, and the hashes of the part that holds the last wanted row are listed. Each count is at most 1024 numbers a
    class; rows themselves are filtered in place.
    """
    hashed = F.xxhash64(F.col(id_col)).bitwiseAND(F.lit(2**63 - 1))
    known = rows.select(F.col(class_col).alias("c"), hashed.alias("h")).where("c is not null")
    counted = F.count(F.lit(1)).alias("n")

    bits = _reached(known.groupBy("c", F.length(F.bin("h")).alias("at")).agg(counted), {}, per_class)
    if not bits:
        return rows.where(F.lit(False))
    near = known.join(bits, F.expr("c = k and length(bin(h)) <= bound")).withColumn("at", F.expr("shiftright(h, greatest(bound - 10, 0))"))
    part = _reached(near.groupBy("c", "at").agg(counted), {}, per_class)
    near = near.drop("k", "bound")
    before = {r["c"]: r["n"] for r in near.join(part, F.expr("c = k and at < bound")).groupBy("c").agg(counted).collect()}
    edge = near.join(part, F.expr("c = k and at = bound")).groupBy("c", F.col("h").alias("at")).agg(counted)
    cut = _reached(edge, before, per_class).select(F.col("k").alias("__class"), F.col("bound").alias("__cut"))
    return rows.join(cut, (F.col(class_col) == F.col("__class")) & (hashed <= F.col("__cut")), "left_semi")


def _reached(counts: DataFrame, before: dict, wanted: int) -> DataFrame | None:
    """(k, bound): for each class the value `at` with which its rows, `before` included, are as many as wanted, or the last."""
    found: dict = {}
    for r in counts.collect():
        found.setdefault(r["c"], []).append((r["at"], r["n"]))
    bounds = []
    for c, values in found.items():
        total = before.get(c, 0)
        for at, n in sorted(values):
            total += n
            if total >= wanted:
                break
        bounds.append((c, at))
    if not bounds:
        return None
    table = counts.sparkSession.createDataFrame(bounds, f"k {counts.schema['c'].dataType.simpleString()}, bound long")
    return F.broadcast(table) if len(bounds) <= FEW else table
