"""Token arrays as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusforge.functions.binding import let
from corpusforge.values import IGNORE_LABEL, SPACE_CLASS


def score_tokens(col: Column) -> Column:
    """Lower-case and split on white space. Empty strings at the ends are kept."""
    return F.split(F.lower(col), f"{SPACE_CLASS}+", -1)


def words(col: Column) -> Column:
    """White space tokens without empty ones."""
    return F.filter(F.split(col, f"{SPACE_CLASS}+", -1), lambda w: w != "")


def sentences(col: Column, split_summaries: bool = False) -> Column:
    """Non-empty lines, or pieces after sentence punctuation."""
    # Only at white space is it worth looking back.
    pattern = f"(?={SPACE_CLASS})(?<=[.!?]){SPACE_CLASS}+" if split_summaries else "\n"
    return F.filter(F.split(col, pattern, -1), lambda s: s != "")


def truncate(col: Column, n: int | Column, side: str = "right") -> Column:
    """Keep ``n`` elements; ``side`` names the end that is cut."""
    n = F.lit(n) if isinstance(n, int) else n
    if side == "right":
        return F.slice(col, F.lit(1), n)
    return F.slice(col, F.greatest(F.size(col) - n, F.lit(0)) + 1, n)


def ngrams(tokens: Column, n: int) -> Column:
    """All n-grams of a token array, none for shorter arrays."""
    if n == 1:
        return F.transform(tokens, lambda t: F.array(t))
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(
        F.array().cast("array<int>"))
    return let(tokens, lambda bound: F.transform(starts, lambda i: F.slice(bound, i, n)))


def padded_length(n: int | Column, multiple: int | None) -> int | Column:
    if not multiple:
        return n
    if isinstance(n, int):
        return -(-n // multiple) * multiple
    return (F.ceil(n / multiple) * multiple).cast("int")


def pad(col: Column, length: int | Column, value: int, side: str = "right") -> Column:
    """Fill an array up to ``length``; a longer array stays as it is."""
    length = F.lit(length) if isinstance(length, int) else length
    filler = F.array_repeat(F.lit(value), F.greatest(length - F.size(col), F.lit(0)))
    return F.concat(col, filler) if side == "right" else F.concat(filler, col)


def ones(col: Column) -> Column:
    """Attention mask of an id array."""
    return F.array_repeat(F.lit(1), F.size(col))


def ignored(col: Column) -> Column:
    """Labels without loss, one per id."""
    return F.array_repeat(F.lit(IGNORE_LABEL), F.size(col))


def argmax(col: Column) -> Column:
    """Position of the first maximum, from 0."""
    return F.array_position(col, F.array_max(col)) - 1
