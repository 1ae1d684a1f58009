"""Hash-derived draws and 64-bit hashes in two halves: deterministic, independent of partitioning, repeatable in any SQL."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def draw(*parts: Column | str | int) -> Column:
    """An integer in [0, 2**32) from the parts: the first 8 hexadecimal digits of the MD5 of their text, joined by `|`."""
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in columns])), 1, 8), 16, 10).cast("bigint")


def halves(hex64: Column) -> tuple[Column, Column]:
    """The high and low 32 bits of a hash of 16 hexadecimal digits; null for null or another length."""
    valid = F.when(F.length(hex64) == 16, hex64)
    return F.conv(F.substring(valid, 1, 8), 16, 10).cast("bigint"), F.conv(F.substring(valid, 9, 8), 16, 10).cast("bigint")


def hamming(hi_a: Column, lo_a: Column, hi_b: Column, lo_b: Column) -> Column:
    """The number of different bits; null (never near) if either hash is missing."""
    return F.bit_count(hi_a.bitwiseXOR(hi_b)) + F.bit_count(lo_a.bitwiseXOR(lo_b))


def blocks(hi: Column, lo: Column, threshold: int, extra: int = 4) -> Column:
    """An array of 64-bit keys: two hashes within `threshold` bits of one another have one in common at least.

    The 64 bits are cut into threshold + extra blocks; at most `threshold` of them differ, so some `extra` blocks are equal. A
    key hashes the number of such a choice of blocks with their bits, about 64 * extra / (threshold + extra) of them: 32 for
    a threshold of 4. So few hashes share a key by chance, however many there are.
    """
    count = min(threshold + extra, 64)
    edges = [64 * k // count for k in range(count + 1)]
    whole = F.shiftleft(hi, 32).bitwiseOR(lo)
    keys = []
    for number, chosen in enumerate(itertools.combinations(range(count), max(count - threshold, 1))):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << (64 - edges[k + 1]) for k in chosen)
        keys.append(F.xxhash64(F.lit(number), whole.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return F.when(hi.isNotNull() & lo.isNotNull(), F.array(*keys))


# Multipliers of the mixing steps of spread(); products stay below 2**63.
MIXERS = (0x21F0AAAD, 0x735A2D97)


def spread(df: DataFrame, name: str, *parts: Column) -> DataFrame:
    """`df` with an integer in [0, 2**32) drawn from integers: each is added to the state, which xor-shifts and odd multipliers
    then mix.

    Plain arithmetic on longs: cheap enough for a draw in each replicate, and the same in any SQL engine. Every step is a
    projection of its own, as a step uses the one before twice and nested expressions would grow with powers of two.
    """
    low, x = F.lit(0xFFFFFFFF), F.col(name)
    for k, part in enumerate(parts):
        part = part.cast("bigint")
        df = df.withColumn(name, (x + part if k else part).bitwiseAND(low))
        for shift, factor in ((16, MIXERS[0]), (15, MIXERS[1])):
            df = df.withColumn(name, (x.bitwiseXOR(F.shiftright(x, shift)) * F.lit(factor)).bitwiseAND(low))
        df = df.withColumn(name, x.bitwiseXOR(F.shiftright(x, 15)))
    return df
