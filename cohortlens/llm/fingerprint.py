"""Document fingerprints: bottom-k sketches of hashed word shingles, in DataFrame expressions only.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's shingles. The sketch of a union of parts is
the bottom k of the parts' sketches, so sketches merge exactly, over rows as well as over pieces of a text. Two sketches
estimate resemblance by the share of the bottom k of their union that both hold, containment from that and the numbers
of distinct shingles, which follow from the k-th smallest hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

K, WIDTH = 64, 5
SPACES = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """body(value) with `value` computed once: a lambda's argument isn't evaluated again at each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text, in lower case; an empty array for null or blank texts."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACES), lambda w: w != "")


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Hashes of a text's shingles in order; the whole sequence is the only shingle of a text of fewer words.

    The hashes of neighbouring words are folded by shifted arrays, so the work is linear in the text.
    """

    def folded(spans: Column, step: int) -> Column:
        """Each span hashed with the one `step` words on."""

        def both(s: Column) -> Column:
            n = F.greatest(F.size(s) - step, F.lit(0))
            return F.zip_with(F.slice(s, F.lit(1), n), F.slice(s, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))

        return let(spans, both)

    def rolled(h: Column) -> Column:
        # spans of 1, 2, 4, ... words, then of `width`
        have = 1
        while have * 2 <= width:
            h, have = folded(h, have), have * 2
        return folded(h, width - have) if have < width else h

    def of(h: Column) -> Column:
        short = F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(h) >= width, rolled(h)).otherwise(short)

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """The bottom-k sketch of a text, an empty array for a null or blank one."""
    return bottom(shingle_hashes(text, width), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two shingle sets."""
    return bottom(F.concat(a, b), k)


def merged(df: DataFrame, keys: list[str], sketch_col: str, k: int = K) -> DataFrame:
    """The sketch of each group of rows: its k smallest distinct hashes. A task keeps at most k rows of a group before the
    shuffle, and the rank is bounded, so a hot group costs no more than others."""
    rows = df.select(*keys, F.explode_outer(sketch_col).alias("__h")).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("__h").asc_nulls_last()))
    return rows.withColumn("__r", rank).where(F.col("__r") <= k).groupBy(*keys).agg(F.sort_array(F.collect_list("__h")).alias(sketch_col))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of common shingles; 1 for two empty sketches, 0 if just one is empty."""

    def of(union: Column) -> Column:
        both = F.size(F.array_intersect(F.array_intersect(union, a), b))
        return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both.cast("double") / F.size(union))

    return let(merge(a, b, k), of)


def cardinality(a: Column, k: int = K) -> Column:
    """The estimated number of distinct shingles: exact below k, (k - 1) / (share of the hash range up to the k-th hash)."""
    share = (F.element_at(a, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of a's shingles that b has too: resemblance times the union's size by a's; 1 for an empty a."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * cardinality(merge(a, b, k), k) / cardinality(a, k)))


def encode(a: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def _cuts(rows: DataFrame, parts: int) -> list:
    """Ids that cut all ids into ranges of about equal size: approximate quantiles of numbers, and of other ids those that stand
    first by a hash in each of `parts` samples."""
    if isinstance(rows.schema["id"].dataType, T.NumericType):
        found = rows.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)] or [0.5], 10000).alias("c")).first()["c"] or []
        return sorted(set(found))
    hashed = rows.where("id is not null").select("id", F.xxhash64("id").alias("h"))
    drawn = hashed.groupBy(F.pmod("h", F.lit(64 * parts)).alias("of")).agg(F.min_by("id", "h").alias("id")).select("id").distinct()
    some = sorted(r["id"] for r in drawn.collect())
    return sorted({some[len(some) * i // parts] for i in range(1, parts)}) if some else []


def with_next(docs: DataFrame, id_col: str, text_col: str, parts: int | None = None) -> DataFrame:
    """(id, text, sketch, next_text, next_sketch): each document with the one that follows it by descending id.

    After the last comes the first; rows of one id are ordered by their text, null ids stand last. Texts are shuffled once:
    ids are cut into ranges of about equal size, each range is sorted by itself, and the first row of each range is also
    sent to the range before it. Only a few cut points and one id for each range reach the driver.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spark = docs.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = _cuts(rows, parts)
    # A range's number: how many cut points lie at or above the id, found block by block; nulls come after all others.
    block = max(1, int(len(cuts) ** 0.5))
    array = lambda xs, kind: F.lit(xs) if xs else F.array().cast(f"array<{kind}>")
    kind = rows.schema["id"].dataType.simpleString()
    lower = F.size(F.filter(array(cuts[block - 1 :: block], kind), lambda c: c < F.col("id"))) * block
    below = lower + F.size(F.filter(F.slice(array(cuts, kind), lower + 1, F.lit(block)), lambda c: c < F.col("id")))
    place = F.when(F.col("id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.lit(len(cuts)) - below)
    placed = rows.withColumn("range", place)
    heads = placed.groupBy("range").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n")).orderBy("range").collect()
    if not heads:
        return placed.select("id", "text", F.array().cast("array<bigint>").alias("sketch"), F.col("text").alias("next_text"), F.array().cast("array<bigint>").alias("next_sketch"))
    numbers = [h["range"] for h in heads]
    before = dict(zip(numbers, [numbers[-1], *numbers[:-1]], strict=True))
    head_ids = [None] * (len(cuts) + 2)
    targets = [0] * (len(cuts) + 2)
    for h in heads:
        head_ids[h["range"]], targets[h["range"]] = h["id"], before[h["range"]]
    is_head = F.element_at(F.array(*[F.lit(x).cast(kind) for x in head_ids]), F.col("range") + 1).eqNullSafe(F.col("id"))
    guests = F.when(is_head, F.element_at(F.lit(targets), F.col("range") + 1))
    sent = placed.withColumn("to", F.array_compact(F.array(F.struct(F.col("range").alias("at"), F.lit(False).alias("guest")), F.when(guests.isNotNull(), F.struct(guests.alias("at"), F.lit(True).alias("guest"))))))
    dealt = sent.select("id", "text", F.explode("to").alias("to")).select("id", "text", "to.at", "to.guest").repartitionById(len(cuts) + 2, F.col("at"))
    drawn = dealt.withColumn("sketch", sketch(F.col("text")))
    order = Window.partitionBy("at").orderBy("guest", F.col("id").desc_nulls_last(), "text")
    following = drawn.withColumn("next", F.lead(F.struct("text", "sketch")).over(order)).where(~F.col("guest"))
    return following.select("id", "text", "sketch", F.col("next.text").alias("next_text"), F.col("next.sketch").alias("next_sketch"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness.

    The edited text has the last third of its code points (rounded down) replaced by as many code points, or all, from the
    start of the document that follows by descending id. A null text is empty; an only document follows itself.
    """
    rows = with_next(docs, id_col, text_col)
    third = F.floor(F.char_length("text") / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 3) as int))"), F.substring("next_text", F.lit(1), third))
    cut = rows.select("*", edited.alias("edited")).withColumn("edited_sketch", sketch(F.col("edited")))
    return cut.select(
        F.col("id").alias(id_col), F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), encode(F.col("sketch")).alias("fingerprint"),
        encode(F.col("edited_sketch")).alias("edited_fingerprint"), resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        cardinality(F.col("sketch")).alias("n_shingles"), containment(F.col("sketch"), F.col("edited_sketch")).alias("held_by_edited"),
    )
