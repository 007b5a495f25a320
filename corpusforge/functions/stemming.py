"""Porter stemming of token arrays (M. F. Porter, 1980, with the usual extensions)."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.functions.batches import by_slices

KEPT_STEMS = 1 << 17  # words whose stems a task keeps

# Words with a stem of their own.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}

# Suffix rules of steps 2 to 4.
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"),
]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
         ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion",
         "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _by_end(rules: list[tuple]) -> dict[str, list[tuple]]:
    """Rules by the last letter of their suffix, which comes first in them, long suffixes first."""
    found: dict[str, list[tuple]] = {}
    for rule in sorted(rules, key=lambda r: -len(r[0])):
        found.setdefault(rule[0][-1], []).append(rule)
    return found


ENDS2, ENDS3, ENDS4 = _by_end(STEP2), _by_end(STEP3), _by_end([(suffix,) for suffix in STEP4])


def _shape(stem: str) -> str:
    """The word as a string of ``c`` (consonant) and ``v`` (vowel)."""
    shape = ""
    for ch in stem:
        vowel = ch in "aeiou" or (ch == "y" and shape.endswith("c"))
        shape += "v" if vowel else "c"
    return shape


def _measure(stem: str) -> int:
    return len(re.findall("v+c", _shape(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    shape = _shape(word)
    if len(word) == 2:
        return shape == "vc"
    return shape[-3:] == "cvc" and word[-1] not in "wxy"


def _replace(word: str, ends: dict[str, list[tuple]]) -> str:
    """Apply the rule of the longest suffix that matches, where its stem is long enough."""
    for suffix, new in ends.get(word[-1:], ()):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + new if _measure(stem) > 0 else word
    return word


def _step1(word: str) -> str:
    if word.endswith("ies"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("sses"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]

    if word.endswith("ied"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            stem = word[: -len(suffix)]
            if word.endswith(suffix):
                if "v" in _shape(stem):
                    word = _restore(stem)
                break

    if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    return word


def _restore(stem: str) -> str:
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _double(stem):
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _short(stem) else stem


def _step2(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _step2(word[:-2])
    if word.endswith("logi"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    return _replace(word, ENDS2)


def _step4(word: str) -> str:
    for (suffix,) in ENDS4.get(word[-1:], ()):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                return stem
            return word
    return word


def _step5(word: str) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short(stem)):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def stem(word: str) -> str:
    """Stem of a lower-case word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    return _step5(_step4(_replace(_step2(_step1(word)), ENDS3)))


STEMS: dict[str, str] = {}


def _remembered(word: str) -> str:
    found = STEMS.get(word)
    if found is None:
        if len(STEMS) >= KEPT_STEMS:
            STEMS.clear()
        found = STEMS[word] = stem(word)
    return found


def _stemmed(tokens: pa.Array) -> pa.Array:
    """Stem the values longer than three characters, each distinct one once."""
    codes = tokens.dictionary_encode()
    stems = pa.array([_remembered(t) if t is not None and len(t) > 3 else t
                      for t in codes.dictionary.to_pylist()], pa.string())
    return stems.take(codes.indices)


def stemmed(tokens: pa.Array) -> pa.Array:
    """Stem the innermost values and put the lists back around them."""
    if not pa.types.is_list(tokens.type):
        return _stemmed(tokens)
    borders = [0]
    for n in pc.list_value_length(tokens).to_pylist():
        borders.append(borders[-1] + (n or 0))
    return pa.ListArray.from_arrays(pa.array(borders, pa.int32()), stemmed(tokens.flatten()))


def _by_slices(tokens: pa.Array) -> pa.Array:
    return by_slices(stemmed, tokens)


_stem_array = F.arrow_udf(_by_slices, T.ArrayType(T.StringType()))
_stem_lists = F.arrow_udf(_by_slices, T.ArrayType(T.ArrayType(T.StringType())))


def stem_tokens(tokens: Column, nested: bool = False) -> Column:
    """Stem the tokens longer than three characters of an array column."""
    return (_stem_lists if nested else _stem_array)(tokens)
