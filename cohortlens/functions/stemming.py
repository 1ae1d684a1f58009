"""Porter's suffix stripping algorithm (1980) for English words."""

from __future__ import annotations

import functools

# The algorithm's suffixes and replacements for its steps 2, 3 and 4.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """`c` for each consonant and `v` for each vowel; y is a vowel after a consonant."""
    out = ""
    for x in word:
        out += "v" if x in "aeiou" or (x == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    return _shape(stem).count("vc")


def _short(stem: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest(word: str, rules) -> tuple[str, str] | None:
    found = [(s, r) for s, r in rules if word.endswith(s)]
    return max(found, key=lambda x: len(x[0])) if found else None


def stem(word: str) -> str:
    """The stem of a word in lower case; words of one or two letters stay."""
    if len(word) < 3:
        return word
    # plurals and participles
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        cut = next((s for s in ("ed", "ing") if word.endswith(s) and "v" in _shape(word[: -len(s)])), None)
        if cut:
            word = word[: -len(cut)]
            if word.endswith(("at", "bl", "iz")) or (_measure(word) == 1 and _short(word)):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    # derivations
    for rules in (STEP2, STEP3):
        rule = _longest(word, rules)
        if rule and _measure(word[: -len(rule[0])]):
            word = word[: -len(rule[0])] + rule[1]
    rule = _longest(word, [(s, "") for s in STEP4])
    if rule:
        base = word[: -len(rule[0])]
        if _measure(base) > 1 and (rule[0] != "ion" or base.endswith(("s", "t"))):
            word = base
    # final letters
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


@functools.lru_cache(1 << 16)
def rouge_stem(token: str) -> str:
    """Stems tokens of more than three letters, as is usual for ROUGE."""
    return stem(token) if len(token) > 3 else token
