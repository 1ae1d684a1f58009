import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlens.llm import chat_format as C

PIECES = st.lists(st.sampled_from(["\\", "###", "### ", "</turn>", " </turn>\n", ": ", ":", "a", "User", "\n", C.SENTINEL[:0], "é", " "]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=5))
def test_formatting_reads_back(turns):
    assert C.parse(C.turn_template(turns)) == turns
    rendered = C.incremental(C.turn_template, turns)
    assert rendered.text == C.turn_template(turns) and not rendered.rewrites
    assert [C.unescape(rendered.text[a:b]) for a, b in rendered.content] == [t for _, t in turns]
    assert "".join(rendered.text[a:b] for a, b in rendered.spans) == rendered.text


def test_other_templates_as_black_boxes():
    header = lambda turns: "<s>" + "".join(f"[{r}]{t}[/]" for r, t in turns)
    got = C.incremental(header, [("user", "hi"), ("assistant", "yo")])
    assert [got.text[a:b] for a, b in got.content] == ["hi", "yo"] and not got.rewrites
    # the last turn is marked, so every turn rewrites the one before
    marked = lambda turns: "".join(f"[{r}{'*' if k == len(turns) - 1 else ''}]{t}\n" for k, (r, t) in enumerate(turns))
    got = C.incremental(marked, [("user", "hi"), ("assistant", "yo"), ("user", "x")])
    assert [k for k, _ in got.rewrites] == [1, 2] and got.rewrites[0][1] == len("[user")
    # system text is moved to the front
    hoisted = lambda turns: "".join(f"{t}|" for r, t in sorted(turns, key=lambda x: x[0] != "system"))
    assert [k for k, _ in C.incremental(hoisted, [("user", "a"), ("system", "b")]).rewrites] == [1]


def digest(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(C.turn_template(turns))


def test_digests_of_all_conversations(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "a ### b", "\\### Assistant: </turn> ok", "é\n"])) for c in (1, 2, 3, None) for t in range(rng.randrange(1, 9))]
    rows += [(4, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(500)]
    rows += [(5, 0, "user", "same"), (5, 0, "user", "same"), (5, None, "user", "first"), (6, 0, "user", "x" * 200000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, n_turns string").repartition(5)
    got = {r["conv_id"]: r for r in C.format_digests(df).collect()}
    for conv in {r[0] for r in rows}:
        key = lambda r: tuple((x is not None, x) for x in r[1:])
        turns = [(r or "", t or "") for _, _, r, t in sorted((r for r in rows if r[0] == conv), key=key)]
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) == digest(turns)
        assert not r["rewrites_history"] and r["first_rewritten_turn"] is None
    pieces = [r for r in C.format_turns(df.where("conv_id = 4")).orderBy("position").collect()]
    assert "".join(p["formatted"] for p in pieces) == C.turn_template([("assistant" if t % 2 else "user", f"t{t}") for t in range(500)])
    assert [p["formatted"][p["content_start"] : p["content_end"]] for p in pieces] == [f"t{t}" for t in range(500)]
    assert C.format_digests(df.limit(0)).count() == 0


def test_rewriting_templates_are_reported(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    marked = lambda turns: "".join(f"### {r}: {t}{'!' if k == len(turns) - 1 else ''} </turn>\n" for k, (r, t) in enumerate(turns))
    got = {r["conv_id"]: (r["rewrites_history"], r["first_rewritten_turn"]) for r in C.format_digests(df, marked).collect()}
    assert got == {1: (True, 1), 2: (False, None)}


def test_templates_that_depend_on_turns_far_back(spark):
    turns = [("assistant" if k % 2 else "user", f"t{k}") for k in range(150)]
    df = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    line = lambda name, t: f"### {name}: {t} </turn>\n"
    numbered = lambda turns: "".join(line(f"{k} {r}", t) for k, (r, t) in enumerate(turns))
    pieces = C.format_turns(df, numbered).orderBy("position").collect()
    assert "".join(p["formatted"] for p in pieces) == numbered(turns)
    assert [p["formatted"][p["content_start"] : p["content_end"]] for p in pieces] == [t for _, t in turns]
    # old turns are dropped once more than 65 exist
    dropping = lambda turns: "".join(line(r, t) for r, t in turns[-65:])
    got = C.format_digests(df, dropping).first()
    assert (got["rewrites_history"], got["first_rewritten_turn"]) == (True, 65)
    with pytest.raises(ValueError):
        C.format_digests(df, numbered, block=64)
    assert C.format_digests(df, block=3).first() == C.format_digests(df).first()
