import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.llm import bpe, token_files
from cohortlens.llm.transducer import Transducer

tokenizers = pytest.importorskip("tokenizers")
TEXTS = st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "\t", "'s", "'ll", "é", "日本", "😀", "12", "²", "!?", "$" * 70, "<|endoftext|>", "\x1c", "\x85", "​", "́"]) | st.text(max_size=4), max_size=12).map("".join)


@pytest.fixture(scope="module")
def library(tokenizer_path):
    made = tokenizers.Tokenizer.from_file(tokenizer_path)
    made.no_truncation()
    made.no_padding()
    return made


@pytest.fixture(scope="module")
def lexicon(tokenizer_path):
    vocab = bpe.vocabulary(tokenizer_path)
    return Transducer.build((w, vocab.merge(w)) for w in (b"the", b" the", b" there", b"'s", b" a", "é".encode(), b"then", b" a"))


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(TEXTS, max_size=4))
def test_ids_and_text_are_the_librarys(texts, library, lexicon, tokenizer_path):
    wanted = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    for coder in (bpe.Encoder(bpe.vocabulary(tokenizer_path)), bpe.Encoder(bpe.vocabulary(tokenizer_path), lexicon)):
        for _ in range(2):  # the second time words are known
            ids, bounds = coder.encode(texts)
            assert [ids[bounds[k] : bounds[k + 1]].tolist() for k in range(len(texts))] == wanted
    for ids in wanted:
        assert bpe.decoded_text(coder.decode(np.array(ids, dtype=np.int64))).decode() == library.decode(ids, skip_special_tokens=False)


def test_any_ids_decode_as_the_library_does(library, tokenizer_path):
    rng, coder = random.Random(1), bpe.Encoder(bpe.vocabulary(tokenizer_path))
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(5)]
        assert bpe.decoded_text(coder.decode(np.array(ids))).decode() == library.decode(ids, skip_special_tokens=False)


def test_long_words_merge_alike(library, tokenizer_path):
    vocab = bpe.vocabulary(tokenizer_path)
    for word in ("ab" * 300, "thetionandtheing" * 9, "x" * 47, "x" * 49):
        assert vocab.merge(word.encode()) == vocab._merge_long([vocab.single[b] for b in word.encode()]) == library.encode(word, add_special_tokens=False).ids


def test_the_transducer_is_minimal_and_exact(tmp_path):
    rng = random.Random(2)
    words = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 7))) for _ in range(300)}
    made = Transducer.build((w, list(w)) for w in words)
    made.write(str(tmp_path / "x.bin"))
    mapped = Transducer.map(str(tmp_path / "x.bin"))
    others = [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(0, 8))) for _ in range(500)]
    tests = sorted(words) + others
    data = np.frombuffer(b"".join(tests) + b"#", dtype=np.uint8)
    ends = np.cumsum([len(t) for t in tests])
    numbers = mapped.numbers(data, ends - [len(t) for t in tests], ends)
    for word, k in zip(tests, numbers.tolist(), strict=True):
        assert (k >= 0) == (word in words)
        if k >= 0:
            assert mapped.ids[mapped.starts[k] : mapped.starts[k + 1]].tolist() == list(word)
    futures = {frozenset(w[k:] for w in words if w[:k] == p) for w in words for k in range(len(w) + 1) for p in [w[:k]]}
    assert len(mapped.final) == len(futures)
    assert (Transducer.build([]).numbers(data, ends[:3] - 1, ends[:3]) == -1).all()


ROWS = [None, "", "the cat's 12 hats\n\n", "<|endoftext|>x", "é日本😀", "\\n", "ab " * 40000, "the the the"]


def test_round_trip_query(docs_of, library, tokenizer_path):
    got = {r["doc_id"]: r for r in bpe.round_trip(docs_of(ROWS * 2), tokenizer_path).collect()}
    for k, text in enumerate(ROWS * 2):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[k]["n_tokens"] == len(ids) and got[k]["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.round_trip(docs_of(["x"]).limit(0), tokenizer_path).count() == 0


def test_columns_of_ids_and_texts(docs_of, library, tokenizer_path):
    docs = docs_of(ROWS)
    ids = docs.select("doc_id", "text", bpe.encode(docs, F.col("text"), tokenizer_path)["ids"].alias("ids"))
    got = ids.select("*", bpe.decode(docs, F.col("ids"), tokenizer_path).alias("back")).collect()
    assert all(r["back"] == (r["text"] or "") and r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids for r in got)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=30), min_size=1, max_size=12), st.integers(6, 70000))
def test_grammar_compression_is_exact(docs, first):
    lengths = [len(d) + 1 for d in docs]
    ids = np.array([i for d in docs for i in [*d, 0]], dtype=np.uint32)
    ends = np.zeros(len(ids), dtype=bool)
    ends[np.cumsum(lengths) - 1] = True
    shard = token_files.Shard(token_files.pack(ids, ends, first))
    assert (shard.ids() == ids).all() and (np.diff(shard.doc_ends, prepend=0) == lengths).all()
    for a, b in ((0, 0), (0, 1), (len(ids) // 2, len(ids)), (len(ids) // 3, 2 * len(ids) // 3)):
        assert (shard.ids(a, b) == ids[a:b]).all()


def test_frequent_pairs_become_rules():
    ids = np.array([1, 2, 3, 4] * 5000 + [0], dtype=np.uint32)
    ends = np.zeros(len(ids), dtype=bool)
    ends[-1] = True
    symbols, rules, sizes, per_doc = token_files.compress(ids, ends, 10)
    assert len(symbols) < len(ids) / 8 and len(rules) == sum(sizes) and per_doc.tolist() == [len(symbols)]
    assert len(token_files.pack(ids, ends, 10)) < len(ids)


def repeated(symbols, per_doc):
    """Neighbouring pairs within a document that stand at two places or more that don't overlap."""
    seen, many, begin = {}, set(), 0
    for n in per_doc.tolist():
        for k in range(begin, begin + n - 1):
            pair = (int(symbols[k]), int(symbols[k + 1]))
            if pair in seen and k - seen[pair] > 1:
                many.add(pair)
            seen.setdefault(pair, k)
        begin += n
    return many


@pytest.mark.parametrize("kind", ["passage", "rare", "bucket"])
def test_rounds_go_on_until_no_pair_repeats(kind):
    rng = np.random.default_rng(4)
    if kind == "passage":  # copies of thousands of ids
        docs = [rng.permutation(np.arange(1, 5001))] * 40
    elif kind == "rare":  # pairs that occur fewer than eight times beside a very frequent one
        docs = [np.tile([1, 2], 20_000)] + [rng.permutation(np.arange(3, 1003))] * 3
    else:  # many single pairs
        docs = [rng.integers(1, 40_000, 200_000)]
    ids = np.concatenate([np.append(d, 0) for d in docs]).astype(np.uint32)
    ends = ids == 0
    first = 70_000 if kind == "bucket" else 50_000
    symbols, rules, sizes, per_doc = token_files.compress(ids, ends, first)
    assert not repeated(symbols, per_doc) and len(rules) == sum(sizes)
    if kind == "passage":
        assert per_doc.max() <= 2 and len(sizes) > 8
    assert (token_files.Shard(token_files.pack(ids, ends, first)).ids() == ids).all()


def test_token_files(docs_of, library, tokenizer_path):
    rng = random.Random(3)
    texts = ROWS + [" ".join(rng.choice(["the", "sea", "of", "xq"]) for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    ids = [rng.randrange(10**6) for _ in texts]
    ids[3], ids[5] = None, ids[4]
    shards = token_files.write(docs_of(texts, ids), tokenizer_path, shard=3000)
    assert shards.count() >= 4
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read(shards).collect()))
    start, wanted = 0, []
    for k, text in sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        raw = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        wanted.append((start, k, len(raw), zlib.crc32(raw.tobytes())))
        start += len(raw)
    assert got == wanted
    back = {r["doc_id"]: r["ids"] for r in token_files.documents(shards).collect()}
    assert back[ids[0]] == [0] and back[ids[2]][:-1] == library.encode(texts[2], add_special_tokens=False).ids
    assert token_files.read(token_files.write(docs_of(["x"]).limit(0), tokenizer_path)).count() == 0


def test_rules_beyond_16_bits_and_small_reads():
    rng = np.random.default_rng(5)
    phrases = [rng.integers(1, 50_000, 6) for _ in range(9000)]
    docs = [np.concatenate([phrases[k] for k in rng.integers(0, 9000, 50)]) for _ in range(600)]
    ids = np.concatenate([np.append(d, 0) for d in docs]).astype(np.uint32)
    shard = token_files.Shard(token_files.pack(ids, ids == 0, 50_257))
    assert len(shard.rules) > 1 << 15 and (shard.ids() == ids).all()
    assert (shard.ids(777, 1234) == ids[777:1234]).all() and "grammar" in shard.__dict__
    again = token_files.Shard(token_files.pack(ids, ids == 0, 50_257))
    assert (again.ids(777, 1234) == ids[777:1234]).all() and "grammar" not in again.__dict__  # other rules aren't expanded


def test_token_files_of_text_ids(docs_of, tokenizer_path):
    docs = docs_of(["b", None, "a a", ""]).withColumn("doc_id", F.concat(F.lit("k"), 9 - F.col("doc_id")))
    shards = token_files.write(docs, tokenizer_path)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in token_files.read(shards).collect())
    assert got == [(0, "k6", 1), (1, "k7", 3), (4, "k8", 1), (5, "k9", 2)]
    assert {r["doc_id"]: len(r["ids"]) for r in token_files.documents(shards).collect()} == {"k6": 1, "k7": 3, "k8": 1, "k9": 2}
