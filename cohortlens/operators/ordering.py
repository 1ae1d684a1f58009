"""Row numbers of a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.sources.shared import written

#: Rows that one range can hold, as the lower bits of monotonically_increasing_id.
INSIDE = 33


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """`df` with the number from 0 of each row in the order of `order`; rows that tie are numbered in any order.

    Rows are dealt by ranges, sorted within them, and written to the checkpoint folder with their place: the bounds of ranges come
    from a sample that Spark draws anew for each plan, so rows and counts must come from one drawing. Each range then starts at
    the number of rows before it, a row for each range.
    """
    place = F.monotonically_increasing_id()
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", place))
    at = F.shiftrightunsigned("__place", INSIDE)
    inside = F.col("__place").bitwiseAND(F.lit((1 << INSIDE) - 1))
    sizes = placed.groupBy(at.alias("__range")).agg(F.count(F.lit(1)).alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(F.broadcast(sizes.select("__range", before.alias("__before"))), at == F.col("__range")).withColumn(name, F.col("__before") + inside).drop("__range", "__before", "__place")
