"""Byte-level pretokens over whole chunks of text, as NumPy arrays.

Cuts texts as the byte-level pre-tokenizer does with the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
by looking at the kinds of neighbouring characters, so a chunk of many texts is cut in a few passes.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
# The characters with the Unicode property White_Space.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@functools.cache
def kinds() -> np.ndarray:
    of = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((of.get(k[0], OTHER) for k in map(unicodedata.category, map(chr, range(0x110000)))), dtype=np.uint8, count=0x110000)
    out[list(WHITE)] = SPACE
    return out


def cut(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, first byte of each pretoken plus the end, first pretoken of each text plus the end)."""
    joined = "".join(texts)
    data = np.frombuffer(joined.encode("utf-8"), dtype=np.uint8)
    n = len(joined)
    if not n:
        return data, np.zeros(1, dtype=np.int64), np.zeros(len(texts) + 1, dtype=np.int64)
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32) if len(data) != n else data
    kind = kinds()[points]
    text_ends = np.cumsum([len(t) for t in texts])
    first_of_text = np.zeros(n + 1, dtype=bool)
    first_of_text[np.concatenate([[0], text_ends])] = True

    starts = np.empty(n, dtype=bool)  # a run of one kind begins here
    starts[0] = True
    np.not_equal(kind[1:], kind[:-1], out=starts[1:])
    starts |= first_of_text[:n]
    last = np.empty(n, dtype=bool)  # a run ends with this character
    last[:-1] = starts[1:]
    last[-1] = True
    # White space before something else: its last character stands alone, or joins what follows if it is a blank.
    white_last = np.flatnonzero(last & (kind == SPACE))
    inner = white_last[~first_of_text[white_last + 1]]
    starts[inner] = True
    blanks = inner[points[inner] == 0x20]
    starts[blanks + 1] = False
    # Contractions: an apostrophe alone that doesn't follow a blank, then s, t, m, d, re, ve or ll.
    quotes = np.flatnonzero((points == 0x27) & starts & last)
    if len(quotes):
        room = ~first_of_text[quotes + 1]
        q = quotes[room]
        one = points[q + 1]
        two = points[np.minimum(q + 2, n - 1)]
        two = np.where(first_of_text[np.minimum(q + 2, n)], 0, two)
        short = np.isin(one, [0x73, 0x74, 0x6D, 0x64])
        long = ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
        for chosen, length in ((q[short], 1), (q[long & ~short], 2)):
            starts[chosen + 1] = False
            after = chosen + 1 + length
            inside = after[after < n]
            starts[inside] |= True
    where = np.flatnonzero(starts)
    counts = np.searchsorted(where, np.concatenate([[0], text_ends]))
    if len(data) != n:
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        offsets = np.cumsum(width) - width
        where = offsets[where]
    return data, np.append(where, len(data)), counts
