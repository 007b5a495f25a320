"""Vocabularies: learning, extending, encoding and decoding.

Vocabulary and merge tables hold at most ``vocab_size`` rows, whatever the size of
the corpus; they are the only tables this module hands to the driver or to tasks
whole, and that size is checked.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusforge.functions.batches import by_slices
from corpusforge.functions.tokens import words
from corpusforge.values import MIN_FREQUENCY, SPECIAL_TOKENS, VOCAB_SIZE

# Fixed value: pre-token pattern of byte-level BPE (GPT-2).
PRETOKEN = (r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
            r"|\s+(?!\S)|\s+")
MAX_VOCAB = 1 << 20
KEPT_TOKENS = 1 << 16  # pre-tokens whose ids a task keeps


def byte_chars() -> dict[int, str]:
    """Printable character of each byte.

    Bytes that print stand for themselves; the others take the code points from
    256 on, in order.
    """
    printing = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1),
                *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in printing]
    chars = {b: chr(b) for b in printing}
    chars.update({b: chr(256 + i) for i, b in enumerate(others)})
    return chars


def pretokens(text: Column, special: Sequence[str] = ()) -> Column:
    """Pre-tokens of a text; special tokens in it stand alone."""
    def plain(piece: Column) -> Column:
        return F.regexp_extract_all(piece, F.lit(PRETOKEN), F.lit(0))

    if not special:
        return plain(text)
    marks = "|".join("\\Q" + s + "\\E" for s in sorted(special, key=len, reverse=True))
    pieces = F.filter(F.split(text, f"(?={marks})|(?<={marks})", -1), lambda p: p != "")
    names = F.array(*[F.lit(s) for s in special])
    parts = F.transform(pieces, lambda p: F.when(
        F.array_contains(names, p), F.array(p)).otherwise(plain(p)))
    # Looking for the first characters alone passes over the other places of a text at once.
    begins = "".join(f"\\x{{{ord(c):X}}}" for c in sorted({s[0] for s in special if s}))
    found = text.rlike(f"(?=[{begins}])(?:{marks})") if all(special) else text.rlike(marks)
    return F.when(found, F.flatten(parts)).otherwise(plain(text))


def word_vocab(df: DataFrame, text: str = "text", vocab_size: int = VOCAB_SIZE,
               min_frequency: int = MIN_FREQUENCY,
               special: Sequence[str] = SPECIAL_TOKENS) -> DataFrame:
    """Vocabulary of white space words: special tokens, then words by falling count.

    A local table of at most ``vocab_size`` rows, so that using it twice does not
    count the corpus twice.
    """
    room = vocab_size - len(special)
    counted = (
        df.select(F.explode(words(F.col(text))).alias("piece"))
        .groupBy("piece").agg(F.count("*").alias("n")).where(F.col("n") >= min_frequency)
        .orderBy(F.desc("n"), "piece").limit(room)
    )
    place = F.row_number().over(Window.orderBy(F.desc("n"), "piece"))
    learned = counted.select((place + (len(special) - 1)).cast("int").alias("id"), "piece")
    pieces = [*enumerate(special), *map(tuple, learned.collect())]
    return df.sparkSession.createDataFrame(pieces, "id int, piece string")


def add_special(vocab: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add the named tokens that are missing, with ids after the highest one."""
    spark = vocab.sparkSession
    last = vocab.agg(F.max("id")).first()[0]
    wanted = spark.createDataFrame(
        list(enumerate(dict.fromkeys(names))), "_at int, piece string")
    missing = wanted.join(vocab, "piece", "left_anti")
    place = F.row_number().over(Window.orderBy("_at"))
    return vocab.unionByName(missing.select(
        (place + (-1 if last is None else last)).cast("int").alias("id"), "piece"))


def _table(df: DataFrame, *columns: str) -> list:
    """Rows of a vocabulary table, after checking its size."""
    rows = df.select(*columns).limit(MAX_VOCAB + 1).collect()
    if len(rows) > MAX_VOCAB:
        raise ValueError(f"more than {MAX_VOCAB} rows in a vocabulary table")
    return rows


def word_encoder(vocab: DataFrame, unknown: str = "<unk>"):
    """Function from a word array column to an id array column.

    Ids are looked up in place, task by task: no token is ever shuffled.
    """
    ids = {r["piece"]: r["id"] for r in _table(vocab, "id", "piece")}
    shared = vocab.sparkSession.sparkContext.broadcast(ids)

    @F.arrow_udf("array<int>")
    def lookup(tokens: pa.Array) -> pa.Array:
        known = shared.value
        other = known.get(unknown)
        return _by_token(tokens, lambda t: [known.get(t, other)])

    return lookup


def _by_token(tokens: pa.Array, encode) -> pa.Array:
    """Ids of string lists, calling ``encode`` once per distinct token of a slice of the batch."""
    return by_slices(lambda part: _ids_of(part, encode), tokens)


def _ids_of(tokens: pa.Array, encode) -> pa.Array:
    counts = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    borders = np.concatenate([[0], np.cumsum(counts)])
    codes = tokens.flatten().dictionary_encode()
    distinct = [encode(t) for t in codes.dictionary.to_pylist()]
    if not distinct:
        return pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array([], pa.int32()))
    ids = pa.array(distinct, pa.list_(pa.int32())).take(codes.indices)
    places = np.asarray(ids.offsets)
    return pa.ListArray.from_arrays(
        pa.array(places[borders] - places[0], pa.int32()), ids.flatten())


def merge_word(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Apply the merges to one word, the earliest learned first, from left to right.

    A pair that a merge makes was learned after it, so a queue of pairs by rank and place
    meets them in order: n log n steps for a word of n symbols.
    """
    symbols, n = list(symbols), len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
    heapify(queue)
    while queue:
        rank, i = heappop(queue)
        j = after[i]
        if not symbols[i] or j >= n or ranks.get((symbols[i], symbols[j])) != rank:
            continue  # one of the two has been merged meanwhile
        symbols[i] += symbols[j]
        symbols[j] = ""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for left in (before[i], i):
            if left >= 0 and after[left] < n:
                found = ranks.get((symbols[left], symbols[after[left]]))
                if found is not None:
                    heappush(queue, (found, left))
    return [s for s in symbols if s]


def bpe_encoder(vocab: DataFrame, merges: DataFrame, special: Sequence[str] = SPECIAL_TOKENS):
    """Function from a text column to an id array column.

    Pre-tokens come from a column expression; a task merges a pre-token once while it is
    among the last ``KEPT_TOKENS`` it met, in place, so no token is ever shuffled.
    """
    ids = {r["piece"]: r["id"] for r in _table(vocab, "id", "piece")}
    ranks = {(r["left"], r["right"]): r["rank"] for r in _table(merges, "rank", "left", "right")}
    shared = vocab.sparkSession.sparkContext.broadcast((ids, ranks, frozenset(special)))
    present = [s for s in special if s in ids]
    kept: dict = {}  # in each task, the function that remembers what it has encoded

    def encoder():
        known, order, names = shared.value
        chars = byte_chars()

        @lru_cache(KEPT_TOKENS)
        def encoded(token: str) -> list[int]:
            if token in names:
                return [known[token]]
            symbols = [chars[b] for b in token.encode("utf-8")]
            return [known[s] for s in merge_word(symbols, order)]

        return encoded

    @F.arrow_udf("array<int>")
    def lookup(tokens: pa.Array) -> pa.Array:
        if not kept:
            kept["encoded"] = encoder()
        return _by_token(tokens, kept["encoded"])

    return lambda text: lookup(pretokens(text, present))


def decode_words(ids: Column, vocab: DataFrame, sep: str = " ") -> Column:
    """Pieces of an id array, joined."""
    rows = {r["id"]: r["piece"] for r in _table(vocab, "id", "piece")}
    pieces = _literal_array([rows.get(i, "") for i in range(max(rows) + 1)], "\x1f")
    return F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), sep)


def decode_bpe(ids: Column, vocab: DataFrame, special: Sequence[str] = SPECIAL_TOKENS,
               skip_special: bool = False) -> Column:
    """Text of an id array of a byte-level vocabulary; broken bytes become U+FFFD."""
    byte = {c: b for b, c in byte_chars().items()}
    names = set(special)
    rows = {r["id"]: r["piece"] for r in _table(vocab, "id", "piece")}

    def spelled(i: int) -> str:
        piece = rows.get(i, "")
        if piece in names:
            return "" if skip_special else piece.encode().hex()
        return bytes(byte[c] for c in piece).hex()

    pieces = _literal_array([spelled(i) for i in range(max(rows) + 1)], " ")
    joined = F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")
    return F.make_valid_utf8(F.unhex(joined).cast("string"))


def _literal_array(values: list[str], sep: str) -> Column:
    """A constant array from one literal: Spark folds the split when it plans."""
    return F.split(F.lit(sep.join(values)), sep)
