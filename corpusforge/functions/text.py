"""Text cleaning as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusforge.functions.binding import let
from corpusforge.values import (
    EMOJI_CLASS,
    HANGUL_CLASS,
    KEPT_CHARS,
    SPACE_CLASS,
    URL_PATTERN,
)

# Jamo in the order the syllable block U+AC00..U+D7A3 composes them.
LEADS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
TAILS = " ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"


def trim(col: Column) -> Column:
    """Strip Unicode white space from both ends."""
    return F.regexp_replace(col, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def keep_charset(col: Column, charset: str = KEPT_CHARS, rare: str = EMOJI_CLASS) -> Column:
    """Each run of characters outside ``charset`` and ``rare`` becomes one space.

    Java tries the members of a class one by one. So ASCII is left out first where ``charset``
    names all of it, and the long list of rare ones is only looked at for characters that are
    in none of the first and lie near a rare one.
    """
    near = _near(rare)
    out = f"[[^{near}][^{rare}]]" if near else f"[^{rare}]"
    first = "[^\\x00-\\x7F]&&" if "\\x00-\\x7F" in charset else ""
    return F.regexp_replace(col, f"[{first}[^{charset}]&&{out}]+", " ")


RARE_ITEM = r"\\x\{([0-9A-F]+)\}(?:-\\x\{([0-9A-F]+)\})?"
GAP = 1 << 10  # code points between rare ones that are not near each other


def _near(rare: str) -> str:
    """A short class that holds the class ``rare``; empty if it is not made of ``\\x{..}`` alone."""
    if not re.fullmatch(f"(?:{RARE_ITEM})+", rare):
        return ""
    spans = sorted((int(a, 16), int(b or a, 16)) for a, b in re.findall(RARE_ITEM, rare))
    near = [list(spans[0])]
    for first, last in spans[1:]:
        if first - near[-1][1] <= GAP:
            near[-1][1] = max(near[-1][1], last)
        else:
            near.append([first, last])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in near)


def strip_urls(col: Column) -> Column:
    return F.regexp_replace(col, URL_PATTERN, "")


def collapse_repeats(col: Column, n: int = 2) -> Column:
    """A word character repeated three or more times is kept ``n`` times.

    Runs of white space other than line breaks become one space, ends are trimmed.
    """
    kept = F.regexp_replace(col, r"([\p{L}\p{N}_])\1{2,}", "$1" * n) if n > 0 else col
    return trim(F.regexp_replace(kept, f"[{SPACE_CLASS}&&[^\\r\\n]]+", " "))


def _jamo(index: Column, table: str) -> Column:
    return F.substring(F.lit(table), index + 1, F.lit(1))


def _syllable(code: Column) -> Column:
    return F.decode(F.unhex(F.hex(code)), "UTF-16BE")


def _unfold(window: Column) -> Column:
    """One character with its neighbours, as ``normalize_emoticons`` rewrites it."""
    before, char, after = window["before"], window["char"], window["after"]
    code = F.ascii(char) - 0xAC00
    lead = _jamo(F.floor(code / 588).cast("int"), LEADS)
    vowel = _jamo(F.floor((code % 588) / 28).cast("int"), VOWELS)
    tail = _jamo((code % 28).cast("int"), TAILS)
    syllable = char.between("가", "힣")
    consonant_before = before.between("ㄱ", "ㅎ")
    return (
        F.when(syllable & consonant_before & after.between("ㅏ", "ㅣ"),
               F.when((lead == before) & (vowel == after) & (code % 28 == 0),
                      F.concat(lead, vowel)).otherwise(char))
        .when(syllable & after.between("ㄱ", "ㅎ"),
              F.when(tail == after, F.concat(_syllable(F.ascii(char) - code % 28), tail))
              .otherwise(char))
        .when(syllable & consonant_before,
              F.when(lead == before, F.concat(lead, vowel)).otherwise(char))
        .otherwise(char)
    )


def normalize_emoticons(col: Column, n: int = 2) -> Column:
    """Unfold a syllable typed into a run of jamo, then collapse the runs.

    The syllable yields to its neighbours when its lead is the consonant before
    it and its vowel the vowel after it, when its tail is the consonant after
    it, or when its lead is the consonant before it.
    """
    return collapse_repeats(let(col, _unfolded), n)


def _unfolded(text: Column) -> Column:
    windows = let(F.split(text, ""), lambda chars: F.arrays_zip(
        F.concat(F.array(F.lit("")), chars).alias("before"),
        chars.alias("char"),
        F.slice(chars, F.lit(2), F.size(chars)).alias("after")))
    named = F.filter(windows.cast("array<struct<before:string,char:string,after:string>>"),
                     lambda w: w["char"].isNotNull())
    return F.when(text.rlike(f"[{HANGUL_CLASS}]"),
                  F.array_join(F.transform(named, _unfold), "")).otherwise(text)


def clean(col: Column, charset: str = KEPT_CHARS, rare: str = EMOJI_CLASS, n: int = 2) -> Column:
    """Character filter, URL removal, trim, repeat and emoticon collapsing, in this order.

    The character filter runs first, so jamo vowels outside syllables are lost
    before emoticons are looked at, and a URL ends at its first lost character.
    """
    kept = trim(strip_urls(keep_charset(col, charset, rare)))
    # What is collapsed stays as it is when collapsed again; only unfolding makes new runs.
    once = collapse_repeats(kept, n)
    return F.when(col.rlike(f"[{HANGUL_CLASS}]"), normalize_emoticons(once, n)).otherwise(once)


def script_ratio(col: Column, char_class: str = HANGUL_CLASS) -> Column:
    """Share of characters in the class; null for empty text."""
    rest = F.length(F.regexp_replace(col, f"[{char_class}]+", ""))
    return F.when(F.length(col) > 0, 1 - rest / F.length(col))


def strip_literal_nbsp(col: Column) -> Column:
    r"""Trim, then drop the four characters ``\xa0`` (not the no-break space)."""
    return F.replace(trim(col), F.lit("\\xa0"), F.lit(""))


def remove_speaker(col: Column, speakers: int = 4) -> Column:
    """Drop the marks ``"0 : "``, ``"1 : "`` and so on, wherever they stand."""
    for i in range(speakers):
        col = F.replace(col, F.lit(f"{i} : "), F.lit(""))
    return col


def join_parts(col: Column, sep: str) -> Column:
    """The elements of a string array as one text."""
    return F.array_join(col, sep)


def parse_speaker(col: Column) -> Column:
    """Number after the first character of an id such as ``P12``, else -1."""
    digits = F.substring(col, 2, 1 << 30)
    return F.when(digits.rlike("^[0-9]+$"), digits.cast("long")).otherwise(F.lit(-1))


def utterance_or_note(form: Column, note: Column) -> Column:
    return F.when(F.length(form) == 0, note).otherwise(form)


def mark_speakers(col: Column, eos: str, speakers: int = 5) -> Column:
    """Close each line with ``eos`` and turn ``"{i} : "`` into ``<unused{i+1}>``."""
    col = F.replace(col, F.lit("\n"), F.lit(eos + "\n"))
    for i in range(speakers):
        col = F.replace(col, F.lit(f"{i} : "), F.lit(f"<unused{i + 1}>"))
    return col


# Numbered marks of a transcript and the tokens that stand for them.
NUMBERED_MARKS = {"0 : ": "<usr> ", "1 : ": "<bot> "}


def name_speakers(col: Column) -> Column:
    """Numbered marks as the tokens of user and bot, wherever they stand."""
    for mark, token in NUMBERED_MARKS.items():
        col = F.replace(col, F.lit(mark), F.lit(token))
    return col


def speaker_count(marked: Column, speakers: int = 5) -> Column:
    """Highest speaker token present in text from ``mark_speakers``, at least 1."""
    found = [F.when(F.contains(marked, F.lit(f"<unused{i + 1}>")), i + 1).otherwise(1)
             for i in range(speakers)]
    return F.greatest(*found)


def document_id(col: Column) -> Column:
    """Second part of a dotted id."""
    return F.split(col, r"\.")[1]
