"""Learning a byte-level BPE vocabulary in few passes over the word types.

A merge at a time would need a job per piece. Here a job yields many merges, and they are
those that merging one by one would give:

* Pairs are ranked by count, then by smaller ids. The first K of the ranking are candidates.
* A merge lowers the counts of the pairs it touches. Each pair it makes is at most as
  frequent as a pair it grew from, and has a larger id; so what grows from a pair outside
  the first K ranks below all of them.
* Hence, until the best pair ranks below the last candidate, everything happens inside
  *islands*: the longest runs of a word in which every adjacent pair is a candidate. Islands
  do not influence each other, and equal islands count as one.

Each round counts pairs, cuts islands where the words are, and sends only the distinct
islands with their counts to the driver, where merges follow one another with pair counts
kept up to date by an index from pairs to islands. K shrinks until there are at most
``ISLANDS`` distinct ones. The merges are then applied to the words in place. Corpus and
word types never leave the executors.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.operators.vocabulary import byte_chars, pretokens
from corpusforge.session import cut_lineage
from corpusforge.values import MIN_FREQUENCY, SPECIAL_TOKENS, VOCAB_SIZE

CANDIDATES = 1 << 15
FIRST_CANDIDATES = 1 << 7  # while pieces are bytes, more make whole words of the islands
ISLANDS = 1 << 18
ROOM = 1 << 31  # above all ids
TYPES = "symbols array<int>, n long"

Pair = tuple[int, int]


def byte_ids(special: Sequence[str]) -> dict[int, int]:
    """Id of each byte: after the special tokens, in the order of the printable characters."""
    chars = byte_chars()
    return {b: len(special) + i for i, b in enumerate(sorted(chars, key=lambda b: chars[b]))}


def word_types(df: DataFrame, text: str, special: Sequence[str]) -> DataFrame:
    """Distinct pre-tokens of more than one byte, as symbol ids, with their counts."""
    ids = byte_ids(special)
    known = F.split(F.lit(" ".join(str(ids[b]) for b in range(256))), " ").cast("array<int>")
    digits = F.regexp_extract_all(F.hex(F.encode("token", "utf-8")), F.lit("(..)"), F.lit(1))
    symbols = F.transform(digits, lambda d: F.get(known, F.conv(d, 16, 10).cast("int")))
    counted = df.select(F.explode(pretokens(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return counted.where(F.octet_length("token") > 1).select(symbols.alias("symbols"), "n")


def ranked_pairs(types: DataFrame, least: int, most: int) -> list[tuple[int, int, int]]:
    """The first ``most`` pairs (a, b, n) by count, then by smaller ids."""
    pairs = F.explode(F.arrays_zip(
        F.expr("slice(symbols, 1, size(symbols) - 1)").alias("a"), F.expr("slice(symbols, 2, size(symbols) - 1)").alias("b")))
    top = types.select(pairs.alias("p"), "n").groupBy("p.a", "p.b").agg(F.sum("n").alias("n")).where(
        F.col("n") >= max(least, 1)).orderBy(F.desc("n"), "a", "b").limit(most).toArrow()
    return list(zip(*(top.column(c).to_pylist() for c in ("a", "b", "n"))))


def _codes(symbols: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All symbols, where each word begins, and a number for each adjacent pair; -1 over a border."""
    offsets = np.asarray(symbols.offsets)
    flat = symbols.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    codes = (flat[:-1] << 32) | flat[1:]
    inner = offsets[1:-1] - offsets[0]
    codes[inner[(inner > 0) & (inner < len(flat))] - 1] = -1
    return flat, offsets - offsets[0], codes


def _known(codes: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which codes are among the ordered ones."""
    if not len(ordered):
        return np.zeros(len(codes), bool)
    return ordered[np.minimum(np.searchsorted(ordered, codes), len(ordered) - 1)] == codes


def islands(types: DataFrame, candidates: Sequence[Pair]) -> DataFrame:
    """(island, n): the longest runs of candidate pairs, as packed ids, with their counts."""
    spark = types.sparkSession
    sent = spark.sparkContext.broadcast(np.sort(np.array([(a << 32) | b for a, b in candidates], np.int64)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, starts, codes = _codes(batch.column(0))
            inside = np.concatenate([[False], _known(codes, sent.value), [False]])
            first = np.flatnonzero(inside[1:] & ~inside[:-1])
            last = np.flatnonzero(inside[:-1] & ~inside[1:])
            raw = flat.astype("<i4").tobytes()
            word = np.searchsorted(starts, first, "right") - 1
            yield pa.RecordBatch.from_arrays([
                pa.array([raw[4 * a : 4 * b + 4] for a, b in zip(first.tolist(), last.tolist())], pa.binary()),
                batch.column(1).take(pa.array(word)),
            ], ["island", "n"])

    return types.mapInArrow(cut, "island binary, n long").groupBy("island").agg(F.sum("n").alias("n"))


def replaced(symbols: list[int], pair: Pair, new: int) -> list[int]:
    """Occurrences of the pair merged, from left to right."""
    out, i, (a, b) = [], 0, pair
    while i < len(symbols):
        if symbols[i] == a and i + 1 < len(symbols) and symbols[i + 1] == b:
            out.append(new)
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def merges_within(parts: list[list[int]], counts: list[int], last: tuple[int, int, int],
                  next_id: int, room: int) -> list[Pair]:
    """Merges, best pair first, until the best pair (-n, a, b) ranks below ``last``.

    Pair counts are kept by the difference each merge makes; an index from pairs to parts
    finds the parts that a merge changes.
    """
    total: dict[Pair, int] = defaultdict(int)
    holders: dict[Pair, set[int]] = defaultdict(set)
    for i, part in enumerate(parts):
        for pair in zip(part, part[1:]):
            total[pair] += counts[i]
            holders[pair].add(i)
    queue = [(-n, *pair) for pair, n in total.items()]
    heapify(queue)
    merges: list[Pair] = []
    while queue and len(merges) < room:
        minus, a, b = entry = heappop(queue)
        pair, now = (a, b), total.get((a, b), 0)
        if now != -minus:  # merges have lowered it meanwhile
            if now:
                heappush(queue, (-now, a, b))
            continue
        if entry > last:
            break
        changed: set[Pair] = set()
        for i in holders.pop(pair):
            before, after = parts[i], replaced(parts[i], pair, next_id)
            if len(after) == len(before):
                continue  # another merge has taken its symbols
            for old in zip(before, before[1:]):
                total[old] -= counts[i]
            for new in zip(after, after[1:]):
                total[new] += counts[i]
                if next_id in new:
                    holders[new].add(i)
                    changed.add(new)
            parts[i] = after
        total.pop(pair, None)
        for new in changed:
            heappush(queue, (-total[new], *new))
        merges.append(pair)
        next_id += 1
    return merges


def applied(types: DataFrame, merges: Sequence[Pair], next_id: int) -> DataFrame:
    """The word types after the merges, whose pieces are numbered from ``next_id``.

    Words of one symbol have nothing left to merge and go.
    """
    learned = list(merges)
    order = {pair: rank for rank, pair in enumerate(learned)}
    sent = types.sparkSession.sparkContext.broadcast(
        (learned, order, np.sort(np.array([(a << 32) | b for a, b in learned], np.int64))))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_order, ranks, codes = sent.value
        for batch in batches:
            _, starts, pairs = _codes(batch.column(0))
            same = np.ones(batch.num_rows, bool)
            same[np.searchsorted(starts, np.flatnonzero(_known(pairs, codes)), "right") - 1] = False
            kind = pa.list_(pa.int32())
            kept = batch.filter(pa.array(same & (np.diff(starts) > 1)))
            if kept.num_rows:
                yield pa.RecordBatch.from_arrays([kept.column(0).cast(kind), kept.column(1)], ["symbols", "n"])
            words, counts = [], []
            touched = batch.filter(pa.array(~same))
            for word, n in zip(touched.column(0).to_pylist(), touched.column(1).to_pylist()):
                while found := [ranks[p] for p in zip(word, word[1:]) if p in ranks]:
                    # What a merge makes was learned after it, so the earliest merge goes first.
                    word = replaced(word, in_order[min(found)], next_id + min(found))
                if len(word) > 1:
                    words.append(word)
                    counts.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(words, kind), pa.array(counts, pa.int64())], ["symbols", "n"])

    return types.mapInArrow(rewrite, TYPES)


def train_bpe(df: DataFrame, text: str = "text", vocab_size: int = VOCAB_SIZE, min_frequency: int = MIN_FREQUENCY,
              special: Sequence[str] = SPECIAL_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Learn a byte-level BPE vocabulary: tables ``id, piece`` and ``rank, left, right``.

    The special tokens come first, then the bytes, then merged pieces, until there are
    ``vocab_size`` pieces or no pair occurs ``min_frequency`` times. The order is that of
    merging one pair at a time, by falling count, then by smaller ids. To the driver come at
    most ``CANDIDATES`` pairs and ``ISLANDS`` distinct islands a round, and the vocabulary.
    """
    spark = df.sparkSession
    chars, ids = byte_chars(), byte_ids(special)
    pieces = [*special, *(chars[b] for b in sorted(ids, key=ids.get))]
    merges: list[Pair] = []
    types = cut_lineage(word_types(df, text, special).repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    most, done = min(CANDIDATES, FIRST_CANDIDATES), False
    while len(pieces) < vocab_size and not done:
        top = ranked_pairs(types, min_frequency, most + 1)
        if not top:
            break
        found: list[Pair] = []
        while not found:
            first = top[:most]
            a, b, n = first[-1]
            # With all frequent pairs among the candidates, what is left outside is too rare.
            done = len(top) <= most
            last = (-max(min_frequency, 1), ROOM, ROOM) if done else (-n, a, b)
            room, next_id = vocab_size - len(pieces), len(pieces)
            if len(first) == 1:
                found, done = [(a, b)], False
                break
            rows = islands(types, [p[:2] for p in first]).limit(ISLANDS + 1).toArrow()
            if rows.num_rows > ISLANDS:
                most = max(1, most // 4)
                continue
            parts = [np.frombuffer(x, "<i4").tolist() for x in rows.column("island").to_pylist()]
            found = merges_within(parts, rows.column("n").to_pylist(), last, next_id, room)
            if rows.num_rows * 4 < ISLANDS:
                most = min(CANDIDATES, most * (4 if rows.num_rows * 64 < ISLANDS else 2))
        next_id = len(pieces)
        merges += found
        for a, b in found:
            pieces.append(pieces[a] + pieces[b])
        if len(pieces) < vocab_size and not done:
            types = cut_lineage(applied(types, found, next_id))

    vocab = spark.createDataFrame(list(enumerate(pieces)), "id int, piece string")
    ranked = [(r, pieces[a], pieces[b]) for r, (a, b) in enumerate(merges)]
    return vocab, spark.createDataFrame(ranked, "rank int, left string, right string")
