"""Joins that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than one row in so many, so there are fewer hot keys than this.
SHARE = 1000


def hot_keys(facts: DataFrame, n: str, total: int) -> list:
    """The rows of `facts` (one for each key, with its number of rows in `n`) of keys that hold more than 1 / SHARE of all rows."""
    return facts.where(F.col(n) * SHARE > total).collect()


def one_for_each(rows: DataFrame, facts: DataFrame, keys: str | list[str], n: str) -> DataFrame:
    """`rows` with the other columns of `facts`, which has one row for each key (nulls are one) and its number of rows in `n`.

    The facts of hot keys, fewer than SHARE by their definition, are sent to where their rows are; all other rows are shuffled,
    and of these no key has more than 1 / SHARE. Keys without facts are left out. The rows are counted first, and the hot keys
    looked up, so both sides are best tables that were written.
    """
    keys = [keys] if isinstance(keys, str) else keys
    renamed = facts.withColumnsRenamed({c: f"__key_{c}" for c in keys})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__key_{c}")) for c in keys])
    extra = [f"__key_{c}" for c in keys]
    found = hot_keys(renamed, n, rows.count())
    if not found:
        return rows.join(renamed, same).drop(*extra, n)
    many = F.broadcast(rows.sparkSession.createDataFrame(found, renamed.schema))
    hot = rows.join(many, same).drop(*extra, n)
    cold = rows.join(many.select(*extra), same, "left_anti").join(renamed, same).drop(*extra, n)
    return hot.unionByName(cold)
