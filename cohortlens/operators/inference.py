"""Families of tests and joint summaries: compositions of the resampling operators, a row for each stratum and metric."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators import metrics, multiplicity, resampling, transitions
from cohortlens.operators.resampling import SEED
from cohortlens.sources.shared import written

# Metrics of which less is better, the contrasts within a model, and the one that a later analysis adds.
LESS_IS_BETTER = ("fer", "fer_abnormal", "omission")
CONTRASTS = (("A", "B"), ("A", "C"), ("A", "D"), ("C", "D"))
ADDED = ("B", "C")


def direction(metric: Column, difference: Column) -> Column:
    """Whether the second arm is better or worse, or a tie, as the metric counts."""
    gain = F.when(metric.isin(*LESS_IS_BETTER), -difference).otherwise(difference)
    return F.when(gain > 0, "better").when(gain < 0, "worse").when(gain == 0, "tie")


def percentage_points(difference: Column) -> Column:
    return 100 * difference


def contrast_arms(stats: DataFrame, strata: list[str], cluster: str, condition: str, contrasts, sums: list[str] = metrics.TOTALS) -> DataFrame:
    """(contrast, strata..., cluster, a_*, b_*): cluster totals of both arms of every contrast, side by side, in one aggregation.

    Clusters that lack an arm are left out: paired arms hold the same units, so they have the same clusters.
    """
    pairs = [F.struct(F.lit(f"{a}-{b}").alias("contrast"), F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in contrasts]
    rows = stats.withColumn("__x", F.explode(F.array(*pairs))).where((F.col(condition) == F.col("__x.a")) | (F.col(condition) == F.col("__x.b")))
    side = [F.max(F.when(F.col(condition) == F.col(f"__x.{t}"), F.col(c))).alias(f"{t}_{c}") for t in "ab" for c in sums]
    both = rows.groupBy(F.col("__x.contrast").alias("contrast"), *strata, cluster).agg(F.count(F.lit(1)).alias("__n"), *side)
    return both.where("__n = 2").drop("__n")


def within_model(stats: DataFrame, strata: list[str], cluster: str, condition: str, values, contrasts=CONTRASTS, n: int = 10_000, seed: int = SEED, sums: list[str] = metrics.TOTALS) -> DataFrame:
    """Tests of all contrasts with Holm's adjustment over the contrasts of each stratum and metric."""
    arms = contrast_arms(stats, strata, cluster, condition, contrasts, sums)
    tests = resampling.paired_permutation(arms, ["contrast", *strata], cluster, sums, values, n, seed)
    return multiplicity.holm(tests, "p_value", [*strata, "metric"], ["contrast"])


def five_contrasts(stats: DataFrame, strata: list[str], cluster: str, condition: str, values, n: int = 10_000, seed: int = SEED, sums: list[str] = metrics.TOTALS) -> DataFrame:
    """within_model with the added contrast, its interval and direction: the family is adjusted anew over all five."""
    tests = within_model(stats, strata, cluster, condition, values, (*CONTRASTS, ADDED), n, seed, sums)
    added = contrast_arms(stats, strata, cluster, condition, (ADDED,), sums)
    spread = resampling.paired_bootstrap(added, ["contrast", *strata], cluster, sums, values, n, seed).drop("estimate", "n_valid")
    return tests.join(spread, ["contrast", *strata, "metric"], "left").withColumn("direction", direction(F.col("metric"), F.col("difference")))


def contrast_summary(tests: DataFrame, contrast: str, by: list[str], level: float = 0.05) -> DataFrame:
    """Of one contrast: strata, significant ones by direction, median and range of the differences."""
    some = tests.where(F.col("contrast") == contrast)
    found = F.col("p_holm") < level
    d = F.col("difference")
    return some.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_strata"), F.count_if(found).alias("n_significant"), F.count_if(found & (F.col("direction") == "better")).alias("n_better"),
        F.count_if(found & (F.col("direction") == "worse")).alias("n_worse"), F.median(d).alias("median_difference"), F.min(d).alias("min_difference"), F.max(d).alias("max_difference"),
    )


def ensemble_tests(singles: DataFrame, ensemble: DataFrame, strata: list[str], model: str, cluster: str, values, n: int = 10_000, seed: int = SEED) -> DataFrame:
    """Each single model against the ensemble, from cluster totals: tests with Holm's adjustment over the models of a stratum
    and metric; `is_best` marks the best single model by macro F1. Totals are computed once and written, a row for each cluster."""
    singles, ensemble = written(singles), written(ensemble)
    side = lambda df, t, keys: df.select(*keys, *[F.col(c).alias(f"{t}_{c}") for c in metrics.TOTALS])
    arms = side(singles, "a", [*strata, model, cluster]).join(side(ensemble, "b", [*strata, cluster]), [*strata, cluster])
    tests = resampling.paired_permutation(arms, [*strata, model], cluster, metrics.TOTALS, values, n, seed)
    points = singles.groupBy(*strata, model).agg(*[F.sum(c).alias(c) for c in metrics.TOTALS]).select(*strata, model, metrics.metrics()["macro_f1"].alias("macro_f1"))
    best = transitions.best_single(points, strata, model, "macro_f1").select(*strata, model, F.lit(True).alias("is_best"))
    adjusted = multiplicity.holm(tests, "p_value", [*strata, "metric"], [model])
    return adjusted.join(best, [*strata, model], "left").withColumn("is_best", F.coalesce("is_best", F.lit(False)))


def joint_summary(clusters: DataFrame, strata: list[str], cluster: str, family: list[str], n: int = 10_000, seed: int = SEED) -> DataFrame:
    """Joint rescue and harm of each stratum in one table: clusters, the twelve counts, every rate with its interval, sign-flip p
    of both net counts, and these adjusted over the strata of a family."""
    counts = clusters.groupBy(*strata).agg(F.count(F.lit(1)).alias("n_clusters"), *[F.sum(c).cast("long").alias(c) for c in transitions.JOINT_COUNTS])
    rates = resampling.bootstrap(clusters, strata, cluster, list(transitions.JOINT_COUNTS), transitions.joint_rates, n, seed)
    nets = clusters.select(*strata, cluster, (F.col("event_rescue") - F.col("event_harm")).alias("event_net"), (F.col("strict_rescue") - F.col("strict_harm")).alias("strict_net"))
    flips = resampling.sign_flip(nets, strata, cluster, ["event_net", "strict_net"], n, seed)
    p = flips.groupBy(*strata).agg(*[F.max(F.when(F.col("metric") == k, F.col("p_value"))).alias(f"{k}_p") for k in ("event_net", "strict_net")])
    for k in ("event_net", "strict_net"):
        p = multiplicity.holm(p, f"{k}_p", family, strata, f"{k}_p_holm")
    return rates.join(counts, strata).join(p, strata)


def pooled_summary(counts: DataFrame, model: str, cluster: str, n: int = 10_000, seed: int = SEED) -> DataFrame:
    """joint_summary over all models together and for each, from the counts of records; a cluster that lies in several strata is
    one cluster in each scope. Adjusted p-values are those of the models; the whole is no part of their family."""
    whole = transitions.cluster_counts(counts, [], cluster).select(F.lit("all models").alias("scope"), F.lit(0).alias("__family"), "*")
    each = transitions.cluster_counts(counts, [model], cluster).select(F.col(model).alias("scope"), F.lit(1).alias("__family"), cluster, *transitions.JOINT_COUNTS)
    found = joint_summary(whole.unionByName(each), ["scope", "__family"], cluster, ["__family"], n, seed)
    adjusted = [F.when(F.col("__family") == 1, F.col(f"{k}_p_holm")).alias(f"{k}_p_holm") for k in ("event_net", "strict_net")]
    return found.select(*[c for c in found.columns if c != "__family" and not c.endswith("_holm")], *adjusted)


@dataclass
class Analysis:
    estimates: DataFrame
    effects: DataFrame
    transitions: DataFrame
    cases: DataFrame


def analyze(df: DataFrame, strata: list[str], arm: str, first: str, second: str, unit: str, cluster: str, values, primary: Column, n: int = 10_000, seed: int = SEED, means: Iterable[str] = ()) -> Analysis:
    """Two paired arms in every stratum: estimates of each arm with intervals, paired effects (second less first) with tests and
    intervals, counts of errors resolved and introduced, and these by case.

    Units must be the same in both arms, with equal references and clusters. Effects are adjusted over the strata of each
    metric, in two families: strata for which `primary` holds, and the others; undefined tests count in their family. `means` are
    the optional metrics' columns, which `values` may use.
    """
    sums = metrics.sums(means)
    stats = metrics.totals(df, [*strata, arm, cluster], means=means)
    estimates = resampling.bootstrap(stats, [*strata, arm], cluster, sums, values, n, seed)
    sizes = df.groupBy(*strata, arm).agg(F.count(F.lit(1)).alias("n_records"))
    wide = stats.groupBy(*strata, arm).agg(*[F.sum(c).alias(c) for c in metrics.TOTALS])
    defined = wide.select(*strata, arm, metrics.defined_labels().alias("n_defined_labels"), F.when(metrics.defined_labels() == metrics.SIZE, metrics.metrics()["macro_f1"]).alias("strict_macro_f1"))
    arms = contrast_arms(stats, strata, cluster, arm, ((first, second),), sums).drop("contrast")
    tests = resampling.paired_permutation(arms, strata, cluster, sums, values, n, seed)
    spread = resampling.paired_bootstrap(arms, strata, cluster, sums, values, n, seed).drop("estimate")
    effects = tests.join(spread, [*strata, "metric"]).withColumn("family", F.when(primary, "primary").otherwise("secondary"))
    effects = multiplicity.holm(effects, "p_value", ["family", "metric"], strata, count_missing=True)
    effects = effects.withColumn("percentage_points", percentage_points(F.col("difference"))).withColumn("direction", direction(F.col("metric"), F.col("difference")))
    pairs = transitions.paired(df.drop(*means), arm, first, second, [*strata, unit], ["reference", cluster])
    return Analysis(estimates.join(sizes, [*strata, arm]).join(defined, [*strata, arm]), effects, transitions.resolved_introduced(pairs, strata), transitions.case_changes(pairs, [*strata, unit]))


def all_contrasts(tables: list[DataFrame]) -> DataFrame:
    """Test tables of several contrasts as one."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
