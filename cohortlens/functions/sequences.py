"""Features of causal training: prompt and target ids with the prompt masked in the labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORED = -100  # fixed value: a label that doesn't count


def causal_features(prompt: Column, target: Column, limit: int) -> Column:
    """A struct (input_ids, labels): the prompt loses ids on its left until prompt and target fit in `limit`; a target that is
    longer by itself keeps its first `limit` ids. Null counts as empty."""
    none = F.array().cast("array<int>")
    answer = F.slice(F.coalesce(target, none), 1, limit)
    room = F.lit(limit) - F.size(answer)
    asked = F.coalesce(prompt, none)
    kept = F.slice(asked, F.greatest(F.size(asked) - room, F.lit(0)) + 1, room)
    return F.struct(F.concat(kept, answer).alias("input_ids"), F.concat(F.array_repeat(F.lit(IGNORED), F.size(kept)), answer).alias("labels"))
