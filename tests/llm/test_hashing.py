import random

from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlens.llm import hashing


def sets(text, width):
    words = text.encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbB\t\n \x0b\x1c é\x85", max_size=40), max_size=6), st.integers(1, 5))
def test_shingles_are_the_distinct_word_runs(texts, width):
    found = hashing.shingles(texts, width)
    assert [len(f) for f in found] == [len(sets(t, width)) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(set(found[i].tolist()) & set(found[j].tolist())) == len(sets(a, width) & sets(b, width))


def test_a_text_hashes_alike_wherever_it_stands():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") * rng.randrange(1, 9) for _ in range(50)) for _ in range(20)]
    together = hashing.shingles(texts, 3)
    assert all((hashing.shingles([t], 3)[0] == h).all() for t, h in zip(texts, together, strict=True))
    assert hashing.shingles([], 3) == []
