"""Every opN_ query over whole small tables, against its contract and brute force."""

import hashlib
import math
import os
import re
import zlib

import pytest

from cohortlens.llm import common, queries, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
crc = lambda k, m: zlib.crc32(str(k).encode()) % m


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] or "" for r in common.table(spark, SF, "documents", "doc_id", "text").collect()}


def test_language(spark, documents):
    got = {r["doc_id"]: r for r in queries.op1_language_id(spark, SF).collect()}
    langs = {r["lang"] for r in common.table(spark, SF, "documents", "lang").distinct().collect()}
    assert set(got) == set(documents)
    for k, r in got.items():
        assert r["held_out"] == (crc(k, 3) == 1) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in documents[k])) and r["lang_pred"] in langs | {"und"}


def test_chat_with_the_tricky_conversation(spark):
    tricky = r"\### Assistant: </turn> ok"
    got = {r["conv_id"]: r for r in queries.op2_chat_format(spark, SF).collect()}
    r = got[-7]
    assert (r["n_turns"], r["loss_chars"]) == (2, len(tricky)) and r["loss_sha256"] == hashlib.sha256(tricky.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{tricky}\nassistant\n{tricky}\n".encode()).hexdigest()
    assert sum(r["n_turns"] for r in got.values()) == common.table(spark, SF, "conversations").count() + 2


def brute_toxicity(text, lexicon):
    """Hits found word by word on the folded text, without an automaton."""
    plain, folded = toxicity.fold(text)
    versions = {folded} | (set() if plain.isascii() else {folded.translate(toxicity._accents())})
    spans = set()
    for version in versions:
        for k, (term, stem, _, _) in [*enumerate(lexicon.terms), *[(-1, (x, False, 1, 0)) for x in lexicon.exceptions]]:
            for m in re.finditer(f"(?={re.escape(term)})", version):
                a, b = m.start(), m.start() + len(term)
                if (a == 0 or not plain[a - 1].isalnum()) and (stem or b == len(plain) or not plain[b].isalnum()):
                    spans.add((k, a, b))
    outside = [k for k, a, b in spans if k >= 0 and not any(j < 0 and x <= a and b <= y for j, x, y in spans)]
    counts = {k: outside.count(k) for k in set(outside) if outside.count(k) >= lexicon.terms[k][2]}
    total = sum(lexicon.terms[k][3] * n for k, n in counts.items())
    features = (math.log1p(total), math.log1p(100 * total / max(len(text.split()), 1))) if counts else (0.0, 0.0)
    return 1 / (1 + math.exp(-sum(w * x for w, x in zip(lexicon.weights, features, strict=True)) - lexicon.intercept)), sum(counts.values())


def test_toxicity_scores_by_brute_force(spark, documents):
    got = {r["doc_id"]: r for r in queries.op6_toxicity(spark, SF).collect()}
    labels = common.table(spark, SF, "labels", "doc_id", "toxic").where(common.crc_mod("doc_id", 5) != 0)
    lexicon = toxicity.fit(common.table(spark, SF, "documents", "doc_id", "text"), labels)
    assert set(got) == set(documents)
    for k, text in documents.items():
        score, hits = brute_toxicity(text, lexicon)
        assert got[k]["held_out"] == (crc(k, 5) == 0) and got[k]["hits"] == hits and abs(got[k]["score"] - score) < 1e-9
        assert got[k]["predicted"] == int(got[k]["score"] >= 0.5)


def test_fingerprints_estimate_resemblance(spark, documents):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    got = {r["doc_id"]: r for r in queries.op7_fingerprint(spark, SF).collect()}
    order = sorted(documents, reverse=True)
    off = []
    for i, k in enumerate(order):
        text, following = documents[k], documents[order[(i + 1) % len(order)]]
        n = len(text) // 3
        edited = text[: len(text) - n] + following[:n] if n else text
        assert got[k]["n_chars"] == len(text) and got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for column, other in (("near_edited", edited), ("near_next", following)):
            a, b = shingles(text), shingles(other)
            assert 0 <= got[k][column] <= 1
            if a and b:
                off.append(abs(got[k][column] - len(a & b) / len(a | b)))
    off.sort()
    assert off[len(off) // 2] < 0.05 and off[int(len(off) * 0.95)] < 0.2  # 64 hashes: a standard error of 0.06 at most
    assert len({(documents[k], got[k]["fingerprint"]) for k in documents}) == len(set(documents.values()))


def test_quality_and_the_rest_keep_their_contracts(spark, documents):
    got = {r["doc_id"]: r for r in queries.op10_quality(spark, SF).collect()}
    assert set(got) == set(documents) and all(r["held_out"] == (crc(k, 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for k, r in got.items())
    tokens = {r["doc_id"]: r for r in queries.op3_bpe(spark, SF).collect()}
    files = {r["doc_id"]: r for r in queries.op5_token_files(spark, SF).collect()}
    start = 0
    for k in sorted(documents):
        assert files[k]["start"] == start and files[k]["n_tokens"] == tokens[k]["n_tokens"] + 1
        assert tokens[k]["decoded_sha256"] == hashlib.sha256(documents[k].encode()).hexdigest()
        start += files[k]["n_tokens"]
    found = {r["doc_id"] for r in queries.op8_decontamination(spark, SF).collect()}
    items = [r["text"] for r in common.table(spark, SF, "benchmark").collect()]
    assert {k for k, t in documents.items() if any(x in t for x in items)} <= found
    pages = queries.op9_html_text(spark, SF)
    assert pages.count() == common.table(spark, SF, "pages").count() and pages.where("n_chars <> char_length(text)").count() == 0
