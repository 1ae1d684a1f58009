"""Hooks for scores that need models: batches of texts through a plain callable, checked, in chunks that are kept by digest.

A scorer takes lists of references and hypotheses and returns a number for each pair, a labeler takes reports and returns a
state for each label. Neither is part of this package; without one the column is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.labels import LABELS, NO_FINDING, vector_of_states
from cohortlens.operators.gates import GateError, require_empty
from cohortlens.operators.provenance import digest

Scorer = Callable[[list[str], list[str]], list[float]]
Labeler = Callable[[list[str]], list[dict[str, int | None]]]


def scored(df: DataFrame, scorer: Scorer | None, reference: str, hypothesis: str, out: str, low: float = 0.0, high: float = 1.0, batch: int = 128) -> DataFrame:
    """`df` with a score of each pair, null without a scorer. A batch whose scores are fewer or more than its pairs, not finite,
    or outside [low, high] raises: scores are never filled in."""
    if scorer is None:
        return df.withColumn(out, F.lit(None).cast("double"))

    @F.pandas_udf("double")
    def run(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for refs, hyps in pairs:
            values: list[float] = []
            for k in range(0, len(refs), batch):
                some = list(scorer(refs[k : k + batch].fillna("").tolist(), hyps[k : k + batch].fillna("").tolist()))
                if len(some) != len(refs[k : k + batch]) or not all(low <= float(x) <= high for x in some):
                    raise ValueError(f"{out}: missing or impossible scores")
                values += [float(x) for x in some]
            yield pd.Series(values, dtype="float64")

    return df.withColumn(out, run(F.col(reference), F.col(hypothesis)))


STATES = "map<string,int>"


def labeled(df: DataFrame, labeler: Labeler, text: str, batch: int = 128) -> DataFrame:
    """`df` with `states` (a map of label to 1, 0, -1 or null, the state without findings included) and `prediction`. A batch
    that comes back shorter or longer, or lacks a label, raises."""

    @F.pandas_udf(STATES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            found: list[dict] = []
            for k in range(0, len(series), batch):
                texts = series[k : k + batch].fillna("").tolist()
                some = list(labeler(texts))
                if len(some) != len(texts) or any(not {*LABELS, NO_FINDING} <= set(x) for x in some):
                    raise ValueError("the labeler left out rows or labels")
                found += some
            yield pd.Series(found, dtype=object)

    states = df.withColumn("states", run(F.col(text)))
    return states.withColumn("prediction", vector_of_states(F.col("states")))


# The reports of the sentinel cases, and the labels that each must have or lack.
SENTINELS = (
    ("SANITY-negation", "No pleural effusion or pneumothorax.", {"pleural effusion": 0, "pneumothorax": 0}),
    ("SANITY-uncertainty", "Possible mild pulmonary edema.", {"edema": 1}),
    ("SANITY-resolved", "Previously seen pneumothorax has resolved.", {"pneumothorax": 0}),
    ("SANITY-device", "Right PICC tip projects over the lower superior vena cava.", {"support devices": 1}),
)


def sentinel_problems(rows: DataFrame, key: str) -> DataFrame:
    """(key, label, bit) of sentinel cases whose labels aren't the expected ones; a missing case has a null bit."""
    wanted = [(k, label, LABELS.index(label), bit) for k, _, expected in SENTINELS for label, bit in expected.items()]
    table = rows.sparkSession.createDataFrame(wanted, f"{key} string, label string, at int, expected int")
    both = table.join(rows.select(key, "prediction"), key, "left").withColumn("bit", F.get("prediction", F.col("at")))
    return both.where(~F.col("bit").eqNullSafe(F.col("expected"))).select(key, "label", "bit")


def labeled_with_sentinels(df: DataFrame, labeler: Labeler, key: str, text: str) -> DataFrame:
    """labeled() with the sentinel cases scored beside the rows; wrong sentinels raise, and they are taken out again."""
    cases = df.sparkSession.createDataFrame([(k, t) for k, t, _ in SENTINELS], f"{key} string, {text} string")
    checked = labeled(cases, labeler, text)
    require_empty(sentinel_problems(checked, key), "sentinel cases labeled wrongly")
    return labeled(df, labeler, text)


def scored_in_chunks(df: DataFrame, key: str, protocol: dict, score: Callable[[DataFrame], DataFrame], folder: str, chunks: int) -> DataFrame:
    """Score `df` chunk by chunk, a Parquet folder for each, named by the digest of the protocol, the chunk and its ids; chunks
    that are there already aren't scored again, so an interrupted run goes on where it stopped.

    A chunk holds the rows whose key hashes to it; its ids enter the digest as order-free sums. The scored ids must be the
    chunk's.
    """
    if chunks < 1:
        raise GateError("there must be a chunk")
    spark = df.sparkSession
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(chunks))
    h = F.xxhash64(F.col(key), F.lit(1)).cast("decimal(38,0)")
    ids = {r["c"]: f"{r['n']}:{r['s']}" for r in df.groupBy(place.alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("s")).collect()}
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    paths = []
    for c in sorted(ids):
        path = f"{folder.rstrip('/')}/{digest([protocol, chunks, c, ids[c]])}"
        done = jvm.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            some = df.where(place == c)
            found = score(some)
            found.write.mode("overwrite").parquet(path)
            saved = spark.read.parquet(path)
            require_empty(some.select(key).exceptAll(saved.select(key)).unionByName(saved.select(key).exceptAll(some.select(key))), "scored rows aren't the chunk's")
        paths.append(path)
    return spark.read.parquet(*paths) if paths else score(df)


def end_to_end(search: DataFrame, encoding: DataFrame, keys: list[str], search_ms: str, encoding_ms: str, out: str) -> DataFrame:
    """Each search timing with the encoding timing of its query and repeat, and their sum; an encoding that is missing or there
    twice raises when the result is read."""
    counted = encoding.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.first(encoding_ms).alias(encoding_ms))
    both = search.join(counted, keys, "left")
    one = F.when(F.coalesce("__n", F.lit(0)) == 1, F.lit(True)).otherwise(F.raise_error(F.lit("not exactly one encoding for a search")).cast("boolean"))
    return both.where(one).drop("__n").withColumn(out, F.col(search_ms) + F.col(encoding_ms))
