"""Chat formatting with a black-box template: turn spans, loss mask and templates that rewrite history.

A template is any function from a list of turns to a string. Successive prefixes of the turns are rendered; a later output
must begin with the earlier one, and what it adds is the span of the new turn. If it doesn't, the template rewrites
history: the turn and the first changed offset are reported. The place of a turn's text within its span is found by
rendering the same prefix with a private-use sentinel as the text.

All prefixes are rendered from the first turn on, so work grows with the square of a conversation's length. A template whose
output for a turn depends on that turn alone may say so (local_to_turn); its conversations are cut into blocks of BLOCK
turns, rendered with the turn before the block as context. Rows are dealt by conversation and streamed in order; a task
holds one block, or one conversation, at a time and keeps running digests.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
BLOCK = 64
SENTINEL = "\U0010fffd"
_ESCAPE = re.compile(r"\\|###|</turn>")
_ROLE_ESCAPE = re.compile(r"\\|###|</turn>|:")
_UNESCAPE = re.compile(r"\\(\\|###|</turn>|:)")
_ROLE_END = re.compile(r"\\(?:\\|###|</turn>|:)|(: )")
_TEXT_END = re.compile(r"\\(?:\\|###|</turn>|:)|( </turn>\n)")


def escape(text: str, pattern: re.Pattern = _ESCAPE) -> str:
    """Put a backslash before every control string and every backslash; unescape() takes exactly these away."""
    return pattern.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def local_to_turn(template: Template) -> Template:
    """Declare that the template's output is that of its turns one after the other, each rendered by itself."""
    template.local_to_turn = True
    return template


def _block(template: Template, block: int | None) -> int | None:
    """Turns rendered at once; None for whole conversations."""
    local = getattr(template, "local_to_turn", False)
    if block is not None and not local:
        raise ValueError("blocks need a template declared local_to_turn")
    return BLOCK if block is None and local else block


@local_to_turn
def turn_template(turns: list[Turn]) -> str:
    """`### Role: text </turn>` and a line end for each turn, control strings inside role and text escaped."""
    return "".join(f"### {escape(_shown(role), _ROLE_ESCAPE)}: {escape(text)} </turn>\n" for role, text in turns)


def _shown(role: str) -> str:
    """A role with a capital; one that wouldn't be read back from that is marked by a tilde instead."""
    capital = role[:1].upper() + role[1:]
    return capital if role[:1].islower() and capital[:1].lower() + capital[1:] == role else "~" + role


def parse(formatted: str) -> list[Turn]:
    """The turns of an output of turn_template, read back by its control strings alone."""

    def until(mark: re.Pattern, start: int) -> re.Match | None:
        return next((m for m in mark.finditer(formatted, start) if m[1]), None)

    out, at = [], 0
    while formatted.startswith("### ", at):
        colon = until(_ROLE_END, at + 4)
        end = until(_TEXT_END, colon.end()) if colon else None
        if end is None:
            break
        name = unescape(formatted[at + 4 : colon.start()])
        out.append((name[1:] if name[:1] == "~" else name[:1].lower() + name[1:], unescape(formatted[colon.end() : end.start()])))
        at = end.end()
    return out


@dataclass
class Rendered:
    text: str
    spans: list[tuple[int, int]]  # of each turn
    content: list[tuple[int, int]]  # of each turn's text within the output
    rewrites: list[tuple[int, int]]  # (turn, first changed offset) where an output doesn't extend the one before


def incremental(template: Template, turns: list[Turn], context: int = 0) -> Rendered:
    """Render all prefixes of `turns`; the first `context` turns only stand before what is reported.

    A rewriting turn's span begins at the first changed offset; its text is then looked for from there on.
    """
    last = template(turns[:context]) if context else ""
    base, spans, content, rewrites = len(last), [], [], []
    for k in range(context, len(turns)):
        now = template(turns[: k + 1])
        start = len(last)
        if not now.startswith(last):
            start = next((i for i, (a, b) in enumerate(zip(now, last, strict=False)) if a != b), min(len(now), len(last)))
            rewrites.append((k - context, start - base))
        spans.append((start - base, len(now) - base))
        probe = template([*turns[:k], (turns[k][0], SENTINEL)])
        at = probe.rfind(SENTINEL)
        after = len(probe) - at - 1
        content.append((at - base, len(now) - after - base) if at >= 0 else (len(now) - base, len(now) - base))
        last = now
    return Rendered(last[base:], spans, content, rewrites)


class _Digest:
    """Running results of one conversation, read back from the formatted blocks."""

    def __init__(self, conv_id):
        self.conv_id, self.rendered, self.turns, self.loss_chars, self.chars, self.rewritten, self.first = conv_id, 0, 0, 0, 0, 0, None
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, rendered: Rendered, read: Callable[[str], list[Turn]], learn: frozenset[str]) -> None:
        """Count and digest what `read` finds in a block; the loss mask holds the text spans of the turns whose role it reads as learnt."""
        turns = read(rendered.text)
        for role, text in turns:
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        for (role, _), (a, b) in zip(turns, rendered.content, strict=False):
            if role in learn:
                text = unescape(rendered.text[a:b])
                self.loss_chars += len(text)
                self.loss.update(text.encode("utf-8", "surrogatepass"))
        if rendered.rewrites and self.first is None:
            self.first = self.rendered + rendered.rewrites[0][0]
        self.rewritten += len(rendered.rewrites)
        self.rendered += len(rendered.spans)
        self.turns += len(turns)
        self.chars += len(rendered.text)

    def row(self) -> tuple:
        return (self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.rewritten > 0, self.first)


COLUMNS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean, first_rewritten_turn long"


def _formatted(template: Template, read: Callable, learn: frozenset[str], block: int | None, kind: pa.DataType, batches: Iterator[pa.RecordBatch], text_rows: bool = False):
    """Stream rows sorted by conversation and turn; yield a row for each conversation (or for each block, with its text)."""
    names = ["conv_id", *[c.split()[0] for c in COLUMNS.split(", ")]]
    current: _Digest | None = None
    pending: list[Turn] = []
    before: list[Turn] = []
    done: list[tuple] = []

    def close_block() -> None:
        nonlocal before
        if pending:
            rendered = incremental(template, [*before, *pending], len(before))
            if text_rows:
                done.extend((current.conv_id, current.rendered + k, rendered.text[a:b], x, y) for k, ((a, b), (x, y)) in enumerate(zip(rendered.spans, [(p - s, q - s) for (s, _), (p, q) in zip(rendered.spans, rendered.content, strict=True)], strict=True)))
            current.add(rendered, read, learn)
            before = [pending[-1]]
            pending.clear()

    def emit() -> pa.RecordBatch:
        columns = [list(c) for c in zip(*done, strict=True)]
        done.clear()
        if text_rows:
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["conv_id", "position", "formatted", "content_start", "content_end"])
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    started = False
    for batch in batches:
        for conv, role, text in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
            if not started or conv != current.conv_id:
                if started:
                    close_block()
                    if not text_rows:
                        done.append(current.row())
                current, before, started = _Digest(conv), [], True
            pending.append((role or "", text or ""))
            if block is not None and len(pending) >= block:
                close_block()
        if len(done) >= 1000:
            yield emit()
    if started:
        close_block()
        if not text_rows:
            done.append(current.row())
    if done:
        yield emit()


def _dealt(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_digests(conversations: DataFrame, template: Template = turn_template, read: Callable[[str], list[Turn]] = parse, learn: frozenset[str] = frozenset({"assistant"}), block: int | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each conversation with what is read back from its formatted text: see COLUMNS.

    Turns are ordered by turn, role and text, so repeated turn numbers have a defined order; null roles and texts are empty,
    rows with a null conversation form one conversation. rewrites_history tells that some prefix's output wasn't kept by the
    next one, first_rewritten_turn at which turn. Turns and their roles are counted and masked as `read` finds them in the
    output; a turn that it doesn't find isn't counted. `block` is for templates declared local_to_turn only, which have BLOCK by
    default; all others see every prefix from its first turn. Other columns are not read.
    """
    ship(conversations.sparkSession)
    dealt = _dealt(conversations, conv_col, turn_col, role_col, text_col)
    run = functools.partial(_formatted, template, read, learn, _block(template, block), _arrow(dealt))
    return dealt.mapInArrow(run, f"conv_id {dealt.dtypes[0][1]}, {COLUMNS}")


def format_turns(conversations: DataFrame, template: Template = turn_template, read: Callable[[str], list[Turn]] = parse, learn: frozenset[str] = frozenset({"assistant"}), block: int | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The formatted text itself, in pieces: (conv_id, position, formatted, content_start, content_end), a row for each turn.

    Order, nulls, repeated turns and other columns are treated as in format_digests; an empty input gives no rows.
    """
    ship(conversations.sparkSession)
    dealt = _dealt(conversations, conv_col, turn_col, role_col, text_col)
    run = functools.partial(_formatted, template, read, learn, _block(template, block), _arrow(dealt), text_rows=True)
    return dealt.mapInArrow(run, f"conv_id {dealt.dtypes[0][1]}, position long, formatted string, content_start long, content_end long")


def _arrow(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[0].dataType)
