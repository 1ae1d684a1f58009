"""Fail-closed gates: small actions that raise, and audits that return the rows in question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GateError(ValueError):
    """A gate found rows that must not be there."""


def require_empty(rows: DataFrame, message: str, examples: int = 5) -> None:
    """Raise if there is any row; only a few are fetched."""
    found = rows.limit(examples).collect()
    if found:
        raise GateError(f"{message}: {[r.asDict() for r in found]}")


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise GateError(f"missing columns: {missing}")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: list[str]) -> None:
    require_empty(duplicates(df, keys), f"repeated {keys}")


def require_binary_vectors(df: DataFrame, columns: list[str], size: int) -> None:
    """Every vector has `size` entries, all 0 or 1."""
    for c in columns:
        good = (F.size(c) == size) & F.forall(c, lambda x: x.isin(0, 1))
        require_empty(df.where(~F.coalesce(good, F.lit(False))).select(c), f"{c} isn't a 0/1 vector of {size}")


def group_disjoint(df: DataFrame, group: str, split: str) -> None:
    """No group lies in two splits."""
    require_empty(df.groupBy(group).agg(F.count_distinct(split).alias("n")).where("n > 1"), f"{group} in several splits")


def completeness(present: DataFrame, keys: list[str], *dimensions: DataFrame) -> DataFrame:
    """(keys..., problem): combinations of the dimension tables that are missing from, extra in or repeated in `present`.

    Dimensions are small tables of distinct keys; their product is the expected key set.
    """
    expected = dimensions[0]
    for d in dimensions[1:]:
        expected = expected.crossJoin(d)
    counted = present.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    both = expected.select(*keys, F.lit(True).alias("__wanted")).join(counted, keys, "full_outer")
    problem = F.when(F.col("__n").isNull(), "missing").when(F.col("__wanted").isNull(), "unexpected").when(F.col("__n") > 1, "repeated")
    return both.withColumn("problem", problem).where("problem is not null").select(*keys, "problem")


def equivalent_duplicates(df: DataFrame, key: str, order: str, compared: list[str]) -> DataFrame:
    """One row for each key, the first by `order`; repeats that differ in a compared column raise when they are read."""
    digest = F.sha2(F.to_json(F.struct(*compared)), 256)
    kept = df.withColumn("__d", digest).groupBy(key).agg(F.min_by(F.struct(*df.columns), F.struct(order, "__d")).alias("__row"), F.min("__d").alias("__low"), F.max("__d").alias("__high"), F.count(F.lit(1)).alias("n_rows"))
    same = F.when(F.col("__low") == F.col("__high"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("conflicting rows for "), F.col(key).cast("string"))).cast("boolean"))
    return kept.where(same).select("__row.*", "n_rows")


def pairing_audit(df: DataFrame, strata: list[str], unit: str, arm: str, arms: int) -> DataFrame:
    """(strata..., n_units, n_bad): units of each stratum that don't occur exactly once in each arm."""
    units = df.groupBy(*strata, unit).agg(F.count_distinct(arm).alias("a"), F.count(F.lit(1)).alias("n"))
    bad = F.count_if((F.col("a") != arms) | (F.col("n") != arms))
    return units.groupBy(*strata).agg(F.count(F.lit(1)).alias("n_units"), bad.alias("n_bad"))


def digest_mismatches(df: DataFrame, stored: str, *columns: Column) -> DataFrame:
    """Rows whose stored digest isn't the digest of their columns."""
    from cohortlens.functions.text import record_digest

    return df.where(~F.col(stored).eqNullSafe(record_digest(*columns)))


def table_digest(df: DataFrame, keys: list[str]) -> DataFrame:
    """(n_rows, digest) of a whole table, whatever its partitioning: XOR and sums of row hashes, computed in one pass.

    The digest is order-free, so it needs no global sort; repeated rows count as often as they occur.
    """
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns))))
    parts = df.select(row.alias("h"), F.xxhash64(row, F.lit(1)).alias("g"))
    return parts.agg(F.count(F.lit(1)).alias("n_rows"), F.hex(F.expr("bit_xor(h)")).alias("xor"), F.sum(F.col("g").cast("decimal(38,0)")).cast("string").alias("total"))


def group_digest(df: DataFrame, groups: list[str], column: str) -> DataFrame:
    """(groups..., n_rows, xor, total): a digest of a column's values by group that doesn't depend on their order; partial sums
    only, however large a group is."""
    from cohortlens.functions.hashing import draw

    h = draw(F.col(column))
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(h).alias("xor"), F.sum(h).alias("total"))


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], equal: list[str] = ()) -> DataFrame:
    """The inner join of two tables that must match row by row; columns in `equal` must agree and are taken once.

    A key that is missing or repeated on a side, or a difference in `equal`, raises when the result is read.
    """
    side = lambda df, tag: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"__n{tag}"), F.first(F.struct(*[c for c in df.columns if c not in keys])).alias(f"__{tag}"))
    both = side(left, "l").join(side(right, "r"), keys, "full_outer")
    good = (F.coalesce("__nl", F.lit(0)) == 1) & (F.coalesce("__nr", F.lit(0)) == 1)
    for c in equal:
        good = good & F.col(f"__l.{c}").eqNullSafe(F.col(f"__r.{c}"))
    checked = F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no one-to-one match for "), F.to_json(F.struct(*keys)))).cast("boolean"))
    columns = [F.col(f"__l.{c}").alias(c if c in equal else f"{c}_a") for c in left.columns if c not in keys]
    columns += [F.col(f"__r.{c}").alias(f"{c}_b") for c in right.columns if c not in keys and c not in equal]
    return both.where(checked).select(*keys, *columns)


def set_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., side): keys that only one table has, each once; empty if the key sets are equal."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("right")))


def require_close(left: DataFrame, right: DataFrame, keys: list[str], column: str, tolerance: float = 1e-9) -> None:
    """Two tables have the same keys, each once, and values that agree within the tolerance (or are both null)."""
    both = left.select(*keys, F.col(column).alias("__a"), F.lit(1).alias("__l")).join(right.select(*keys, F.col(column).alias("__b"), F.lit(1).alias("__r")), keys, "full_outer")
    good = F.col("__l").isNotNull() & F.col("__r").isNotNull() & (F.col("__a").eqNullSafe(F.col("__b")) | F.coalesce(F.abs(F.col("__a") - F.col("__b")) <= tolerance, F.lit(False)))
    require_empty(both.where(~good).select(*keys, "__a", "__b"), f"{column} differs")
    require_unique(left, keys)
    require_unique(right, keys)
