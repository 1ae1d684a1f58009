"""Step-down adjustment of p-values within families."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def holm(df: DataFrame, p: str, family: list[str], order: list[str], out: str = "p_holm", count_missing: bool = False) -> DataFrame:
    """Holm's adjustment: the running maximum of (m - rank + 1) * p by ascending p, at most 1.

    Missing p-values stay missing. They count in the family's size m only with `count_missing` (as p = 1). `order` breaks
    ties, which doesn't change the result. A family is one partition of a window: families are lists of tests.
    """
    q = F.coalesce(F.col(p), F.lit(1.0)) if count_missing else F.col(p)
    whole = Window.partitionBy(*family)
    ranked = whole.orderBy(F.col("__q").asc_nulls_last(), *order)
    work = df.withColumn("__q", q).withColumn("__m", F.count("__q").over(whole)).withColumn("__k", F.row_number().over(ranked))
    step = F.max((F.col("__m") - F.col("__k") + 1) * F.col("__q")).over(ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return work.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), step))).drop("__q", "__m", "__k")
