"""Label vocabulary and fixed-length label vectors."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens.functions.binding import let

# The labels in the order of a vector, the state without a finding, labels whose uncertain state counts.
LABELS = (
    "atelectasis", "cardiomegaly", "consolidation", "edema", "enlarged cardiomediastinum", "fracture", "lung lesion",
    "lung opacity", "pleural effusion", "pleural other", "pneumonia", "pneumothorax", "support devices",
)
NO_FINDING = "no finding"
UNCERTAIN_AS_PRESENT = ("atelectasis", "edema", "support devices")
UNCERTAIN_POLICY = {label: int(label in UNCERTAIN_AS_PRESENT) for label in LABELS}
# Fixed value: words that negate what follows.
NEGATION = r"\b(?:no|not|without|absent|negative\s+for|free\s+of|no\s+evidence\s+of)\b"


def canonical(value: Column) -> Column:
    """Trimmed, lower case, underscores as blanks, single blanks."""
    return F.regexp_replace(F.lower(F.trim(F.translate(value, "_", " "))), r"\s+", " ")


def vocabulary() -> Column:
    return F.array(*[F.lit(x) for x in LABELS])


def normalize_labels(labels: Column) -> Column:
    """The known labels of an array in first-seen order; unknown and null ones are dropped, null gives an empty array."""
    found = F.filter(F.transform(labels, canonical), lambda x: F.array_contains(vocabulary(), x))
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


def label_vector(labels: Column, strict: bool = False) -> Column:
    """13 zeros and ones; null or empty labels give zeros. `strict` raises for a label outside the vocabulary."""
    known = F.coalesce(F.transform(F.filter(labels, lambda x: F.trim(x) != ""), canonical), F.array().cast("array<string>"))
    vector = F.transform(vocabulary(), lambda x: F.array_contains(known, x).cast("int"))
    if not strict:
        return vector
    unknown = F.array_except(known, vocabulary())
    return F.when(F.size(unknown) == 0, vector).otherwise(F.raise_error(F.concat(F.lit("unknown labels: "), F.array_join(unknown, ", "))))


def vector_of_states(states: Column, policy: Mapping[str, int] = UNCERTAIN_POLICY) -> Column:
    """The vector of a map label -> 1, 0, -1 or null: 1 counts, -1 as the policy says; another state raises. The map is made once
    for a row, its keys are brought to their form once."""
    if set(policy) != set(LABELS) or set(policy.values()) - {0, 1}:
        raise ValueError("the policy must give 0 or 1 for every label")

    def bit(label: Column, uncertain: Column, state: Column) -> Column:
        known = F.when(state == 1, 1).when(state == -1, uncertain).when(state.isNull() | (state == 0), 0)
        return F.coalesce(known, F.raise_error(F.concat(F.lit("state of "), label, F.lit(": "), state.cast("string"))).cast("int"))

    rules = F.array(*[F.struct(F.lit(x).alias("label"), F.lit(policy[x]).alias("uncertain")) for x in LABELS])
    known = F.transform_keys(states, lambda k, _: canonical(k))
    return let(known, lambda m: F.transform(rules, lambda r: let(F.element_at(m, r["label"]), lambda s: bit(r["label"], r["uncertain"], s))))


def negation_flags(normalized_text: Column, labels: Column) -> Column:
    """The labels with an occurrence that a negating word precedes: among the last 8 tokens of the 80 characters before it.

    The text is normalized (a-z, 0-9 and single blanks). The result is sorted and distinct. The text is made once for a row, and
    cut once for each label.
    """

    def flagged(text: Column, label: Column) -> Column:
        return let(F.split(text, F.concat(F.lit(r"\b"), label, F.lit(r"\b")), -1), lambda pieces: occurs(pieces, label))

    def occurs(pieces: Column, label: Column) -> Column:
        def negated(k: Column) -> Column:
            before = F.call_function("array_join", F.slice(pieces, F.lit(1), k), label)
            tokens = F.split(F.trim(F.right(before, F.lit(80))), " +")
            last = F.slice(tokens, F.greatest(F.lit(1), F.size(tokens) - 7), F.lit(8))
            return F.array_join(last, " ").rlike(NEGATION)

        return F.exists(F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))), lambda k: (k < F.size(pieces)) & negated(k))

    found = let(normalized_text, lambda text: F.filter(labels, lambda label: flagged(text, label)))
    return F.coalesce(F.array_sort(F.array_distinct(found)), F.array().cast("array<string>"))


def errors(reference: Column, prediction: Column) -> Column:
    """The number of positions in which two vectors differ."""
    return F.aggregate(F.zip_with(reference, prediction, lambda a, b: (a != b).cast("int")), F.lit(0), lambda s, x: s + x)


def total(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0), lambda s, x: s + x.cast("int"))
