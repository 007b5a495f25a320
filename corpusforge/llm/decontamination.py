"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton accepts every run of words that occurs in an item. A document streams
through it word by word; the state tells the longest run ending there that some item
holds. Wherever that run covers a window (ten item words, or a whole shorter item) the
words of the window are hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.llm.common import by_slices, free_name, query, saved, small_batches, table, utf8

WINDOW = 10
LEAST_SPAN = 3  # words; shorter hit spans are not cut
# Words of items in one automaton: about 60 MB. More items take more passes.
BLOCK_WORDS = 100_000
# On UTF-8: A-Z to lower case, every other ASCII character that is in no word to a blank.
NORMAL = bytes(
    b if b >= 128 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz"
    else b + 32 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 32
    for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class Automaton:
    """Suffix automaton of several word lists, with the items that hold each window."""

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        read = []
        for name, words in items:
            if words:
                ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
                read.append((name, ids))
                state = 0
                for word in ids:
                    state = self._extend(state, word)
        # Items by the state that holds the window, and by the window's length.
        self.holders: dict[int, dict[int, set]] = {}
        for name, ids in read:
            size, state, matched = min(window, len(ids)), 0, 0
            for word in ids:
                state, matched = self.next[state][word], matched + 1
                if matched >= size:
                    self.holders.setdefault(self._holding(state, size), {}).setdefault(size, set()).add(name)
        self.up = [self._holder_above(s) for s in range(len(self.next))]
        pairs = {(a, b) for _, ids in read for a, b in zip(ids, ids[1:])}
        self.pairs = np.array(sorted(a * len(self.vocabulary) + b for a, b in pairs), np.int64)
        self.singles = np.array(sorted({ids[0] for _, ids in read if len(ids) == 1}), np.int64)
        self.shortest = min([window, *[len(ids) for _, ids in read if len(ids) > 1]])

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, parent: int, state: int, word: int) -> int:
        """A copy of ``state`` for the runs that ``parent`` plus ``word`` makes."""
        copy = self._new(self.length[parent] + 1, self.link[state], dict(self.next[state]))
        self.link[state] = copy
        while parent >= 0 and self.next[parent].get(word) == state:
            self.next[parent][word] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            exact = self.length[known] == self.length[last] + 1
            return known if exact else self._split(last, known, word)
        state = self._new(self.length[last] + 1, 0, {})
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = state
            last = self.link[last]
        if last >= 0:
            known = self.next[last][word]
            exact = self.length[known] == self.length[last] + 1
            self.link[state] = known if exact else self._split(last, known, word)
        return state

    def _holding(self, state: int, size: int) -> int:
        """The state, up the suffix links, that stands for the last ``size`` words."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _holder_above(self, state: int) -> int:
        while state > 0 and state not in self.holders:
            state = self.link[state]
        return state

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))

    def candidates(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of words in which every two neighbours are neighbours in some item."""
        if len(ids) and len(self.pairs):
            codes = ids[:-1] * len(self.vocabulary) + ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
            joined = (self.pairs[at] == codes) & (ids[:-1] >= 0) & (ids[1:] >= 0)
            edges = np.flatnonzero(np.diff(np.concatenate([[False], joined, [False]]).astype(np.int8)))
            for start, end in edges.reshape(-1, 2).tolist():
                if end - start + 1 >= self.shortest:
                    yield start, end + 1
        if len(self.singles):
            yield from ((i, i + 1) for i in np.flatnonzero(np.isin(ids, self.singles)).tolist())

    def match(self, ids: np.ndarray, start: int, end: int) -> Iterator[tuple[int, int, set]]:
        """(first word, past the last word, items) of every window inside the run."""
        state = matched = 0
        for at, word in enumerate(ids[start:end].tolist(), start):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            state = self.next[state].get(word, 0)
            matched = matched + 1 if state else 0
            above = self.up[state]
            while above > 0:
                for size, items in self.holders[above].items():
                    if size <= matched:
                        yield at + 1 - size, at + 1, items
                above = self.up[self.link[above]]


PLACES = ("start", "end", "from", "past")
OVERLAP = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.StructType([T.StructField(p, T.LongType()) for p in PLACES]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])
_spans = pa.list_(pa.struct([(p, pa.int64()) for p in PLACES]))
_overlap = pa.struct([("n_words", pa.int64()), ("hits", _spans), ("items", pa.list_(pa.string()))])
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def united(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def placed(spans: Iterable[tuple[int, int]], text: bytes) -> list[dict]:
    """United spans of words, with the code points of the text they reach over."""
    words = [m.span() for m in WORD.finditer(text.decode().translate(LOWER))] if spans else []
    return [dict(zip(PLACES, (start, end, words[start][0], words[end - 1][1]))) for start, end in united(spans)]


def overlap_of(texts: list[bytes], automaton: Automaton) -> list[dict]:
    split = [words_of(t) for t in texts]
    ends = np.cumsum([len(w) + 1 for w in split])
    # One array for all texts, with an unknown word between two of them.
    ids = automaton.ids([w for words in split for w in (*words, b"")])
    found: dict[int, tuple[set, set]] = {}
    for start, end in automaton.candidates(ids):
        text = int(np.searchsorted(ends, start, side="right"))
        first = int(ends[text]) - len(split[text]) - 1
        for begin, past, items in automaton.match(ids, start, end):
            spans, names = found.setdefault(text, (set(), set()))
            spans.add((begin - first, past - first))
            names |= items
    nothing: tuple[set, set] = (set(), set())
    return [{
        "n_words": len(words),
        "hits": placed(found.get(i, nothing)[0], texts[i]),
        "items": sorted(map(str, found.get(i, nothing)[1])),
    } for i, words in enumerate(split)]


def overlap_with(automaton: Automaton, spark: SparkSession, text: Column) -> Column:
    sent = spark.sparkContext.broadcast(automaton)  # at most BLOCK_WORDS words and one item

    def overlap(column: pa.Array) -> pa.Array:
        return by_slices(lambda texts: pa.array(overlap_of(utf8(texts), sent.value), _overlap), column)

    overlap.__annotations__ = {"column": pa.Array, "return": pa.Array}
    # Else a condition on the result would be pushed below it and every text looked through
    # twice, by two Python workers for each task.
    return F.arrow_udf(overlap, OVERLAP).asNondeterministic()(text)


def automata(items: DataFrame, item: str, text: str, window: int, block_words: int) -> Iterator[Automaton]:
    """Automata of at most ``block_words`` words plus one item; items stream to the driver."""
    block, size = [], 0
    for row in items.select(item, text).toLocalIterator():
        words = words_of((row[1] or "").encode())
        if block and size + len(words) > block_words:
            yield Automaton(block, window)
            block, size = [], 0
        block.append((row[0], words))
        size += len(words)
    yield Automaton(block, window)


@F.arrow_udf(OVERLAP["hits"].dataType)
def unite_hits(text: pa.Array, spans: pa.Array) -> pa.Array:
    return by_slices(lambda texts, found: pa.array([
        placed([(s["start"], s["end"]) for s in row or []], t) for t, row in zip(utf8(texts), found.to_pylist())
    ], _spans), text, spans)


def item_overlap(docs: DataFrame, items: DataFrame, item: str = "item_id", items_text: str = "text",
                 text: str = "text", window: int = WINDOW, out: str = "overlap",
                 block_words: int = BLOCK_WORDS) -> DataFrame:
    """Add ``out``: n_words, hits (spans of words, in order) and items (ids as texts, sorted).

    Null and empty texts have no words. Items without words match nothing; items with equal
    texts are all named. Without items nothing is hit. All rows and other columns stay; a
    column already called ``out`` is replaced. One pass over the documents for each
    ``block_words`` item words. With several passes ``docs`` must be a stored table.
    """
    spark, first, later = docs.sparkSession, None, []
    small_batches(spark)
    row = free_name(docs, "row")
    for automaton in automata(items, item, items_text, window, block_words):
        overlap = overlap_with(automaton, spark, F.col(text))
        if first is None:
            first = docs.withColumn(out, overlap)
        else:
            passed = docs.select(text, F.monotonically_increasing_id().alias(row))
            later.append(saved(passed.select(row, overlap.alias("more")).where(F.size("more.items") > 0)))
    if not later:
        return first
    more = later[0]
    for df in later[1:]:
        more = more.unionByName(df)
    hits, names = free_name(docs, "more_hits"), free_name(docs, "more_items")
    more = more.groupBy(row).agg(F.flatten(F.collect_list("more.hits")).alias(hits),
                                 F.flatten(F.collect_list("more.items")).alias(names))
    joined = first.withColumn(row, F.monotonically_increasing_id()).join(more, row, "left")
    none = F.array()
    return joined.withColumn(out, F.struct(
        F.col(f"{out}.n_words").alias("n_words"),
        unite_hits.asNondeterministic()(F.col(text), F.concat(
            f"{out}.hits", F.coalesce(hits, none.cast(OVERLAP["hits"].dataType)))).alias("hits"),
        F.array_sort(F.array_distinct(F.concat(
            f"{out}.items", F.coalesce(names, none.cast("array<string>"))))).alias("items"),
    )).drop(row, hits, names)


def cut_spans(text: Column, spans: Column) -> Column:
    """The text without the words of the spans and what stands between them."""
    start = F.transform(spans, lambda s: s["past"] + 1)
    end = F.transform(spans, lambda s: s["from"])
    starts = F.concat(F.array(F.lit(1).cast("long")), start)
    ends = F.concat(end, F.array(F.char_length(text).cast("long")))
    return F.array_join(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda p: F.substring(
        text, p["a"].cast("int"), (p["b"] - p["a"] + 1).cast("int"))), "")


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", least_words: int = WINDOW,
                  most_covered: float = 0.5, window: int = WINDOW, least_span: int = LEAST_SPAN, **options) -> DataFrame:
    """Cut hit spans out of the texts and drop texts that are mostly test items.

    A text goes if more than ``most_covered`` of its words are hit; else every run of
    ``least_words`` item words, and every whole shorter item, is cut out of it. Spans of
    fewer than ``least_span`` words are common words rather than items and stay. Texts
    without hits stay exactly as they are, null texts too.
    """
    out = free_name(docs, "overlap")
    cut = out
    found = item_overlap(docs, items, text=text, out=out, window=window, **options)
    if least_words != window:
        found = saved(found)
        cut = free_name(found, "cut")
        found = item_overlap(found, items, text=text, out=cut, window=least_words, **options)
    n_hit = hit_words(F.col(f"{out}.hits"))
    long = F.filter(f"{cut}.hits", lambda s: s["end"] - s["start"] >= least_span)
    return (
        found.where(n_hit <= F.lit(most_covered) * F.col(f"{out}.n_words"))
        .withColumn(text, F.when(F.size(long) > 0, cut_spans(F.col(text), long)).otherwise(F.col(text)))
        .select(*docs.columns)
    )


def hit_words(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


WORDS_SQL = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
OVERLAP_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce({WORDS_SQL}, []) AS w FROM documents),
items AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS n, array_to_string(w[i:i + least({WINDOW}, len(w)) - 1], ' ') AS g
    FROM (SELECT *, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), places AS (
    SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
          FROM docs CROSS JOIN (SELECT DISTINCT n FROM windows))
), found AS (SELECT doc_id, n, i, item_id FROM places JOIN windows USING (n, g)),
hits AS (
    SELECT doc_id, count(*) AS n_hit FROM (
        SELECT DISTINCT doc_id, unnest(range(i, i + n)) FROM found) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, array_to_string(list_sort(list(item)), ',') AS names
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op7_item_overlap", OVERLAP_SQL)
def item_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = item_overlap(docs, table(spark, sf_dir, "benchmark"))
    n_hit = hit_words(F.col("overlap.hits"))
    return found.select(
        "doc_id", "overlap.n_words", n_hit.alias("n_hit"),
        F.size("overlap.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("overlap.items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))
