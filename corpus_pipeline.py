"""A document pipeline from the training-data operators: toxicity, language, near duplicates, test items, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of `docs` for the rows they keep; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import bpe, decontamination, language_id, near_dedup, toxicity
from cohortlens.llm.common import crc_mod, drop, save, table
from cohortlens.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighted lexicon scores below 0.5; null and empty texts have no hits and stay."""
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic").where(crc_mod("doc_id", 5) != 0))
    return docs.where(toxicity.toxicity(docs, F.col("text"), lexicon)["score"] < 0.5)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised; null texts, texts without a letter, and texts that are too far from all profiles
    go: beyond the middle between the farthest document that profiles were learned from and a text without a known n-gram.

    Repeated rows stay or go together; an empty table stays empty. Without languages to learn from no document is recognised.
    """
    labelled = docs.where(crc_mod("doc_id", 3) != 1)
    profiles = language_id.fit(labelled, "doc_id", "text", "lang")
    limit = (1 + language_id.farthest(labelled, profiles, "doc_id", "text", "lang")) / 2
    found = docs.withColumn("__found", language_id.language(docs, F.col("text"), profiles))
    return found.where((F.col("__found.lang_pred") != language_id.UNKNOWN) & (F.col("__found.distance") <= limit)).drop("__found")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates (shingles of five words, resemblance 0.8).

    Null and blank texts and rows with a null id stay; rows that repeat an id stay or go together; empty stays empty.
    """
    return near_dedup.drop_duplicates(docs, width=5, percent=80)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no exact or edited copy of a benchmark item; null texts stay, repeated rows stay or go together, and
    without items or documents nothing changes."""
    return decontamination.remove(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document that is left, encoded and decoded again; a null text is
    empty, and every row, repeated or not, has its own."""
    return bpe.round_trip(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_test_items),
    ("bpe", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each result written to the shared folder before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        following = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            following = save(following, f"pipeline-{name}")
            if k:
                drop(docs)
        docs = following
    return docs


#: The stages learn from data and encode ids, which SQL can't express; tests hold them against brute force.
ORACLE_SQL: str | None = None
