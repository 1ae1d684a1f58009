"""Text normalization, keys, digests, verdicts and prompts as column expressions. NULL is the only missing value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(value: Column) -> Column:
    """White space collapsed and trimmed; null as the empty text."""
    return F.trim(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"\s+", " "))


def normalize(value: Column) -> Column:
    """Lower case, everything but a-z and 0-9 as one blank, trimmed. For finding duplicates only."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value.cast("string"), F.lit(""))), "[^a-z0-9]+", " "))


def text_hash(value: Column, blank: bool = False) -> Column:
    """SHA-256 of the normalized text; null if nothing is left, so that empty texts never match. With `blank` the empty text
    has its hash as well."""
    return F.sha2(normalize(value) if blank else F.nullif(normalize(value), F.lit("")), 256)


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value.cast("string")), F.lit(""))


def first_of(*columns: Column) -> Column:
    """The first value that isn't blank."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


# Fixed value: the keys that identify a record, in order of preference.
RECORD_KEYS = ("record_id", "image_sha256", "image_path", "image_id", "uid", "study_id")


def stable_key(columns: dict[str, Column], keys: Sequence[str] = RECORD_KEYS) -> Column:
    """`key:value` of the first key with a value; a row without any raises."""
    found = [F.concat(F.lit(f"{k}:"), blank_to_null(columns[k])) for k in keys if k in columns]
    return F.coalesce(*found, F.raise_error(F.lit("the record has no stable identifier")).cast("string"))


def report_of(report: Column, findings: Column, impression: Column, caption: Column) -> Column:
    """The report, else findings and impression, else the caption; the empty text if all are blank."""
    joined = F.concat_ws(" ", blank_to_null(findings), blank_to_null(impression))
    return F.coalesce(*[F.nullif(clean(c), F.lit("")) for c in (report, joined, caption)], F.lit(""))


# Words for the two verdicts.
POSITIVE = ("true", "1", "yes", "correct", "consistent", "supported")
NEGATIVE = ("false", "0", "no", "incorrect", "inconsistent", "unsupported")


def parse_target(value: Column, strict: bool = True) -> Column:
    """A training verdict: one of the words, or `answer|label|verdict` with `:` or `=` and true or false; others raise."""
    token = F.lower(F.trim(value.cast("string")))
    named = F.regexp_extract(token, r"^(?:answer|label|verdict)\s*[:=]\s*(true|false)$", 1)
    found = F.when(token.isin(*POSITIVE), True).when(token.isin(*NEGATIVE), False).when(named == "true", True).when(named == "false", False)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unrecognized verdict: "), F.coalesce(token, F.lit("null")))).cast("boolean")) if strict else found


def parse_verdict(text: Column) -> Column:
    """A model's verdict: the first whole word true or false; null without one."""
    word = F.regexp_extract(F.lower(text), r"\b(true|false)\b", 1)
    return F.when(word == "true", True).when(word == "false", False)


def chat_messages(messages: Column) -> Column:
    """Messages array<struct<role, content>> with roles in lower case and synonyms resolved, blanks dropped."""

    def one(m: Column) -> Column:
        role = F.lower(F.trim(F.coalesce(m["role"], F.lit(""))))
        role = F.when(role.isin("human", "prompt"), "user").when(role.isin("gpt", "bot", "model"), "assistant").otherwise(role)
        return F.struct(role.alias("role"), F.trim(F.coalesce(m["content"], F.lit(""))).alias("content"))

    return F.filter(F.transform(messages, one), lambda m: (m["role"] != "") & (m["content"] != ""))


def last_content(messages: Column, role: str) -> Column:
    """The content of the last message of a role; null without one."""
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(-1))["content"]


# Fixed value: the line above a piece of evidence.
EVIDENCE_LINE = "REFERENCE %d (similarity=%s):\n"


def evidence_block(neighbors: Column, limit: int = 10) -> Column:
    """Numbered evidence from array<struct<report_text, report, caption, score>>, best first: a line with the rank and the
    similarity to six decimals, then the first report text that isn't blank; blocks are a blank line apart."""

    def block(n: Column, i: Column) -> Column:
        text = F.trim(F.coalesce(*[F.when(n[k] != "", n[k]) for k in ("report_text", "report", "caption")], F.lit("")))
        return F.concat(F.format_string(EVIDENCE_LINE, i + 1, F.format_string("%.6f", F.coalesce(n["score"], F.lit(0.0)))), text)

    return F.array_join(F.transform(F.slice(neighbors, 1, limit), block), "\n\n")


def shortened(prompt: Column, limit: int, instruction: str, omission: str, head_limit: int = 2500) -> Column:
    """A prompt cut to `limit` characters with the instruction: a third of what fits (2500 at most) from its beginning, the
    rest from its end, the omission mark between."""
    if limit < 1000:
        raise ValueError("the limit must be 1000 at least")
    room = limit - len(instruction)
    payload = max(1, room - len(omission))
    head = min(payload // 3, head_limit)
    cut = F.concat(F.substring(prompt, 1, head), F.lit(omission), F.right(prompt, F.lit(payload - head)))
    return F.concat(F.when(F.char_length(prompt) > room, cut).otherwise(prompt), F.lit(instruction))


def record_digest(*columns: Column) -> Column:
    """SHA-256 of the JSON object of the columns, in the order given; null fields are left out."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)
