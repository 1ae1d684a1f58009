"""Multi-label error metrics from additive totals.

All metrics are ratios of sums, so one wide row of sums for each group (or cluster) is all that grouping, bootstrap and
permutation need: rows are aggregated once, below any resampling.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.labels import LABELS, errors, total
from cohortlens.operators.quantiles import quantiles

SIZE = len(LABELS)
NAMES = [x.replace(" ", "_") for x in LABELS]
COUNTS = [f"{kind}_{i}" for kind in ("tp", "fp", "fn") for i in range(SIZE)]
SCALARS = ["n_records", "matching_labels", "normal_abnormal_correct", "fp_abnormal", "predicted_positive_abnormal"]
TOTALS = COUNTS + SCALARS


def plus(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def row_totals(reference: Column, prediction: Column) -> dict[str, Column]:
    """The contributions of one record to the totals."""
    r, p = [reference[i] for i in range(SIZE)], [prediction[i] for i in range(SIZE)]
    out = {f"tp_{i}": r[i] * p[i] for i in range(SIZE)} | {f"fp_{i}": (1 - r[i]) * p[i] for i in range(SIZE)} | {f"fn_{i}": r[i] * (1 - p[i]) for i in range(SIZE)}
    abnormal = (total(reference) > 0).cast("int")
    predicted = total(prediction)
    false = plus([(1 - r[i]) * p[i] for i in range(SIZE)])
    return out | {
        "n_records": F.lit(1), "matching_labels": F.lit(SIZE) - errors(reference, prediction),
        "normal_abnormal_correct": ((total(reference) == 0) == (predicted == 0)).cast("int"),
        "fp_abnormal": abnormal * false, "predicted_positive_abnormal": abnormal * predicted,
    }


def sums(means: Iterable[str] = ()) -> list[str]:
    """The names of all totals: those of labels, and of each optional metric the sum and number of its finite values."""
    return [*TOTALS, *[f"{kind}_{c}" for c in means for kind in ("sum", "finite")]]


def _mean_totals(means: Iterable[str]) -> list[Column]:
    """Additive pairs for the means of optional metrics: missing, NaN and infinite values add nothing to either."""
    out = []
    for c in means:
        value = F.col(c).cast("double")
        finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
        out += [F.coalesce(F.sum(F.when(finite, value)), F.lit(0.0)).alias(f"sum_{c}"), F.count_if(finite).alias(f"finite_{c}")]
    return out


def totals(df: DataFrame, groups: list[str], reference: str = "reference", prediction: str = "prediction", means: Iterable[str] = ()) -> DataFrame:
    """One wide row of totals for each group; map-side partial sums, one shuffle of group rows."""
    labels = [F.sum(c).cast("long").alias(n) for n, c in row_totals(F.col(reference), F.col(prediction)).items()]
    return df.groupBy(*groups).agg(*labels, *_mean_totals(means))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def metrics(of=F.col, means: Iterable[str] = ()) -> dict[str, Column]:
    """All metrics from totals. `of` gives the column of a total's name. macro_f1 is over the labels whose F1 is defined, the mean of
    an optional metric over its finite values: null where there are none."""
    tp, fp, fn = ([of(f"{k}_{i}") for i in range(SIZE)] for k in ("tp", "fp", "fn"))
    f1 = [ratio(2 * t, 2 * t + p + n) for t, p, n in zip(tp, fp, fn, strict=True)]
    stp, sfp, sfn = plus(tp), plus(fp), plus(fn)
    defined = plus([F.when(x.isNotNull(), 1).otherwise(0) for x in f1])
    return {
        "fer": ratio(sfp, stp + sfp), "fer_abnormal": ratio(of("fp_abnormal"), of("predicted_positive_abnormal")), "omission": ratio(sfn, stp + sfn),
        "macro_f1": F.try_divide(plus([F.coalesce(x, F.lit(0.0)) for x in f1]), defined.cast("double")), "micro_f1": ratio(2 * stp, 2 * stp + sfp + sfn),
        "hamming_accuracy": ratio(of("matching_labels"), of("n_records") * SIZE), "normal_abnormal_accuracy": ratio(of("normal_abnormal_correct"), of("n_records")),
        "false_positive_events": sfp.cast("double"), "predicted_positive_events": (stp + sfp).cast("double"),
        "false_negative_events": sfn.cast("double"), "reference_positive_events": (stp + sfn).cast("double"),
    } | {f"f1_{n}": x for n, x in zip(NAMES, f1, strict=True)} | {c: ratio(of(f"sum_{c}"), of(f"finite_{c}")) for c in means}


def defined_labels(of=F.col) -> Column:
    return plus([F.when(2 * of(f"tp_{i}") + of(f"fp_{i}") + of(f"fn_{i}") > 0, 1).otherwise(0) for i in range(SIZE)])


def grouped_metrics(df: DataFrame, groups: list[str], means: Iterable[str] = ()) -> DataFrame:
    """One wide row of metrics for each group, with the means of optional columns over their finite values."""
    wide = totals(df, groups, means=means)
    return wide.select(*groups, "n_records", defined_labels().alias("n_defined_labels"), *[c.alias(n) for n, c in metrics(F.col, means).items()])


def per_label(df: DataFrame, groups: list[str]) -> DataFrame:
    """(groups..., label, tp, fp, fn, tn, sensitivity, specificity, precision, f1)."""
    wide = totals(df, groups)
    rows = F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"tp_{i}").alias("tp"), F.col(f"fp_{i}").alias("fp"), F.col(f"fn_{i}").alias("fn"), (F.col("n_records") - F.col(f"tp_{i}") - F.col(f"fp_{i}") - F.col(f"fn_{i}")).alias("tn")) for i, x in enumerate(LABELS)])
    long = wide.select(*groups, F.explode(rows).alias("x")).select(*groups, "x.*")
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return long.select("*", ratio(tp, tp + fn).alias("sensitivity"), ratio(tn, tn + fp).alias("specificity"), ratio(tp, tp + fp).alias("precision"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def binary_confusion(df: DataFrame, truth: str, prediction: str, groups: list[str]) -> DataFrame:
    """Confusion counts and rates of a binary decision; rows with a missing verdict are counted apart."""
    t, p = F.col(truth), F.col(prediction)
    wide = df.groupBy(*groups).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"), F.count_if(t.isNull() | p.isNull()).alias("n_missing"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return wide.select("*", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fn).alias("sensitivity"), ratio(tn, tn + fp).alias("specificity"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def _with_quantiles(df: DataFrame, value: str, groups: list[str], levels: list[float], *others: Column) -> DataFrame:
    """One row for each group: the aggregates `others`, and the array `q` of exact quantiles (null without values)."""
    wide = df.groupBy(*groups).agg(*others)
    found = quantiles(df, value, groups, levels).withColumnsRenamed({g: f"__{g}" for g in groups})
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups], F.lit(True))
    return wide.join(found, same, "left").drop(*[f"__{g}" for g in groups])


def runtime_summary(df: DataFrame, value: str, groups: list[str]) -> DataFrame:
    v = F.col(value)
    wide = _with_quantiles(df, value, groups, [0.5], F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    return wide.select(*groups, "n", "mean", F.col("q")[0].alias("median"), "std", "min", "max")


def timing_quantiles(df: DataFrame, value: str, groups: list[str]) -> DataFrame:
    """Exact linear quantiles."""
    wide = _with_quantiles(df, value, groups, [0.25, 0.5, 0.75, 0.95], F.avg(value).alias("mean"))
    return wide.select(*groups, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "mean", F.col("q")[3].alias("p95"))
