"""Language identification by rank-order n-gram profiles.

A profile lists a language's most frequent letter n-grams (one to three letters, words padded by spaces, lower case) by
rank. A document's own ranking is compared with each profile: an n-gram costs the difference of its ranks, or the profile's
length if the profile lacks it. The language at the least out-of-place distance wins.

Profiles are fitted on all labelled rows: n-grams are counted by batches, and the counts added up by language and n-gram.
Prediction is a map over the documents, without a shuffle.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK, map_arrow, text_column
from .hashing import gather

PROFILE, DOCUMENT = 400, 300
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(key of each n-gram, index of its text). A key packs up to three code points in 21 bits each."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    owner = np.concatenate([owner[:1], owner]) if len(owner) else owner
    letter = _letters()[points]
    kept = letter | np.concatenate([[True], letter[:-1]])
    letter, owner = letter[kept], owner[: len(points)][kept]
    p = np.where(letter, points[kept], 32).astype(np.int64)
    one = np.flatnonzero(letter)
    two = np.flatnonzero(letter[:-1] | letter[1:])
    three = np.flatnonzero(letter[1:-1])
    keys = np.concatenate([p[one], (p[two] << 21) | p[two + 1], (p[three] << 42) | (p[three + 1] << 21) | p[three + 2]])
    owners = np.concatenate([owner[one], owner[np.where(letter[two], two, two + 1)], owner[three + 1]])
    return keys, owners


def ranked(keys: np.ndarray, limit: int) -> np.ndarray:
    """The most frequent keys, most frequent first, ties by key."""
    found, counts = np.unique(keys, return_counts=True)
    return found[np.argsort(-counts, kind="stable")[:limit]]


def _per_text(texts: list[str]):
    keys, owners = ngrams(texts)
    order = np.argsort(owners, kind="stable")
    keys, bounds = keys[order], np.searchsorted(owners[order], np.arange(len(texts) + 1))
    for k in range(len(texts)):
        yield keys[bounds[k] : bounds[k + 1]]


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    out: list[list] = [[], [], []]
    for lang in sorted(set(langs)):
        found, counts = np.unique(ngrams([t for t, x in zip(texts, langs, strict=True) if x == lang])[0], return_counts=True)
        out[0] += [lang] * len(found)
        out[1].append(found)
        out[2].append(counts)
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(np.concatenate(out[1]), pa.int64()), pa.array(np.concatenate(out[2]), pa.int64())], ["lang", "gram", "n"])


def _labelled(rows: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return rows.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))


def fit(rows: DataFrame, id_col: str, text_col: str, lang_col: str, profile: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles of the languages in `rows`: n-gram keys by rank, ties by key.

    Null texts and languages are skipped; all other rows count, whatever their ids, which aren't read. No rows give no profiles.
    What reaches the driver is `profile` keys for each language.
    """
    counted = map_arrow(_labelled(rows, text_col, lang_col), _counted, "lang string, gram long, n long", CHUNK // 2)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("r", rank).where(F.col("r") <= profile)
    found: dict[str, list[int]] = {}
    for x in sorted(top.select("lang", "r", "gram").collect()):
        found.setdefault(x["lang"], []).append(x["gram"])
    return {lang: np.array(keys, dtype=np.int64) for lang, keys in found.items()}


def predictor(profiles: dict[str, np.ndarray], size: int = PROFILE, limit: int = DOCUMENT):
    langs = sorted(profiles)
    # the ranks of each known n-gram, one after the other, with their languages
    grams = np.concatenate([profiles[x] for x in langs]) if langs else np.zeros(0, dtype=np.int64)
    order = np.argsort(grams, kind="stable")
    rank = np.concatenate([np.arange(len(profiles[x])) for x in langs])[order] if langs else grams
    lang = np.repeat(np.arange(len(langs)), [len(profiles[x]) for x in langs])[order]
    known, first, count = np.unique(grams[order], return_index=True, return_counts=True)
    first, count = np.append(first, 0), np.append(count, 0)  # the last entry: an n-gram of no profile
    def predict(texts: list[str | None]) -> list[pa.Array]:
        names, scores, distances = [], [], []
        for keys in _per_text([t or "" for t in texts]):
            if not len(keys) or not langs:
                names.append(UNKNOWN)
                scores.append(0.0)
                distances.append(1.0)
                continue
            top = ranked(keys, limit)
            at = np.searchsorted(known, top)
            at[(at == len(known)) | (known[np.minimum(at, len(known) - 1)] != top)] = len(known)
            place = np.repeat(np.arange(len(top)), count[at])
            use = gather(np.arange(len(rank)), first[at], count[at])
            cost = size * len(top) + np.bincount(lang[use], weights=np.abs(rank[use] - place) - size, minlength=len(langs))
            nearest = np.argsort(cost, kind="stable")
            best, rest = cost[nearest[0]], cost[nearest[1]] if len(langs) > 1 else size * len(top)
            names.append(langs[nearest[0]])
            scores.append(float((rest - best) / max(rest, 1)))
            distances.append(float(best / (size * len(top))))
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(distances, pa.float64())]

    return predict


def language(df: DataFrame, text: Column, profiles: dict[str, np.ndarray]) -> Column:
    """A struct (lang_pred, score, distance): `und`, 0 and 1 for a null text or one without a letter; the score is the relative
    margin between the two nearest profiles, 0 for a tie (the first language by name wins); the distance is the nearest
    one's, as a part of that of a text without a known n-gram."""
    return text_column(df.sparkSession, predictor(profiles), "lang_pred string, score double, distance double", CHUNK // 2)(text)


def farthest(rows: DataFrame, profiles: dict[str, np.ndarray], id_col: str, text_col: str, lang_col: str) -> float:
    """The largest distance of those rows that profiles are learned from, all of them, to their nearest profile; 0 without rows."""
    usable = _labelled(rows, text_col, lang_col)
    found = usable.select(language(usable, F.col("text"), profiles).alias("found"))
    return found.where(F.col("found.lang_pred") != UNKNOWN).agg(F.max("found.distance").alias("d")).first()["d"] or 0.0


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score), a row for each input row; other columns are not read."""
    found = docs.select(F.col(id_col), language(docs, F.col(text_col), profiles).alias("found"))
    return found.select(id_col, "found.lang_pred", "found.score")
