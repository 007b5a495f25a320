"""Removal of repeated substrings, found as maximal repeats in enhanced suffix arrays.

Only substrings that can be repeated are looked at. Every 100-byte window is assigned to
an anchor, the 24-byte string inside it with the smallest hash. The choice depends on the
window's bytes alone, so equal windows have equal anchors. Windows of one text that follow
each other and share an anchor form a context. Contexts whose anchor occurs once in the
corpus hold no repeat; equal contexts are one class.

The contexts of one anchor hash are sorted by all their suffixes. A stack scan over the
common prefix lengths gives the tree of prefix intervals; an interval at least as long as a
window whose occurrences differ in the byte before is a maximal repeat, with all its
occurrences. All but the first are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusforge.llm.common import bit_filter, by_slices, filtered, mix64, query, saved, table, utf8, whole_groups

LENGTH = 100
ANCHOR = 24
# Texts are hashed in parts of this size, which overlap so that no window is torn.
PART = 1 << 20
# More contexts than this under one anchor hash are split further before they are sorted.
CROWD = 2048
FINER = 8  # windows in a part of a split context
POSITION = np.uint64(24)
FACTOR = np.uint64(0x100000001B3)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of FACTOR modulo 2**64 and their inverses, at least ``n`` of them."""
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(FACTOR), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, f, np.uint64)])) for f in (FACTOR, inverse)]
    return _powers[0], _powers[1]


def anchors(whole: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, past the last, anchor, its hash) of every context in texts laid end to end.

    A window is named by its first byte. ``sizes`` are the lengths of the texts.
    """
    n, width = len(whole), LENGTH - ANCHOR + 1
    nothing = np.zeros(0, np.int64)
    if n < LENGTH:
        return nothing, nothing, nothing, np.zeros(0, np.uint64)
    power, inverse = powers(n)
    rolled = np.zeros(n + 1, np.uint64)
    np.cumsum((whole.astype(np.uint64) + np.uint64(1)) * power[:n], out=rolled[1:])
    hashes = mix64((rolled[ANCHOR:] - rolled[:-ANCHOR]) * inverse[: n - ANCHOR + 1])
    # Hash first, place second: the least value is the leftmost smallest hash.
    least = (hashes >> POSITION << POSITION) | np.arange(len(hashes), dtype=np.uint64)
    done, step = 1, 1
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    ends = np.cumsum(sizes)
    inside = np.ones(n + 1, bool)
    for k in range(1, LENGTH):
        inside[ends[sizes >= k] - k] = False
    windows = np.flatnonzero(inside[: len(least)])
    if not len(windows):
        return nothing, nothing, nothing, np.zeros(0, np.uint64)
    place = (least[windows] & np.uint64((1 << 24) - 1)).astype(np.int64)
    new = np.flatnonzero((place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)) + 1
    first = np.concatenate([[0], new])
    last = np.concatenate([new, [len(windows)]]) - 1
    return windows[first], windows[last] + 1, place[first], hashes[place[first]]


def parts(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes end to end, sizes, text numbers, offsets in their texts) of about PART bytes each."""
    held: list[tuple[bytes, int, int]] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), PART):
            piece = text[at : at + PART + LENGTH - 1]
            held.append((piece, i, at))
            size += len(piece)
            if size >= PART:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def parts_of(column: pa.Array, rows: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The same for a column of texts, without holding all of them twice."""
    for at in range(0, len(column), rows):
        for whole, sizes, numbers, offsets in parts(utf8(column.slice(at, rows))):
            yield whole, sizes, numbers + at, offsets


def _joined(held: list[tuple[bytes, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    pieces, numbers, offsets = zip(*held)
    return (np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces]),
            np.array(numbers), np.array(offsets))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for whole, sizes, _, _ in parts_of(batch.column(0)):
            hashes = anchors(whole, sizes)[3]
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], ["h"])


def earliest(h: np.ndarray, c: np.ndarray, rank: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which rows are the first of their (h, c), by rank and then place."""
    order = np.lexsort((at, rank, c, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])
    first = np.zeros(len(order), bool)
    first[order[new]] = True
    return first


def ranks(keys: list) -> np.ndarray:
    """Places of the rows of a batch in the order of their keys, nulls first, then as they come."""
    rank = np.zeros(len(keys), np.int64)
    rank[sorted(range(len(keys)), key=lambda i: (keys[i] is not None, 0 if keys[i] is None else keys[i], i))] = \
        np.arange(len(keys))
    return rank


def _found(batch: pa.RecordBatch, number: np.ndarray, h: np.ndarray, c: np.ndarray, at: np.ndarray,
           n: np.ndarray) -> pa.RecordBatch:
    first = earliest(h, c, ranks(batch.column(1).to_pylist())[number], at)
    taken = pa.array(number)
    return pa.RecordBatch.from_arrays([
        pa.array(h), pa.array(c), batch.column(1).take(taken), batch.column(0).take(taken),
        pa.array(at), pa.array(n), pa.array(first)], ["h", "c", "key", "row", "at", "n", "first"])


class Contexts:
    """Contexts of one part of a batch whose anchor hash passes a bit array."""

    def __init__(self, bits: np.ndarray, whole: np.ndarray, sizes: np.ndarray, numbers: np.ndarray,
                 offsets: np.ndarray):
        first, past, place, hashes = anchors(whole, sizes)
        keep = filtered(bits, hashes)
        self.first, self.past, self.place, self.hashes = first[keep], past[keep], place[keep], hashes[keep]
        text = np.searchsorted(np.cumsum(sizes), self.first, side="right")
        self.number = numbers[text]
        self.shift = (offsets - (np.cumsum(sizes) - sizes))[text]  # from here to places in the text
        self.view = whole.tobytes()

    def classes(self) -> np.ndarray:
        """A hash of the bytes of each context."""
        spans = zip(self.first.tolist(), (self.past + LENGTH - 1).tolist())
        return np.fromiter((xxhash.xxh3_64_intdigest(self.view[a:b]) for a, b in spans), np.uint64,
                           len(self.first)).view(np.int64)


def _contexts(sent):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Columns row, key, text.
        for batch in batches:
            found: list[tuple] = []
            for part in parts_of(batch.column(2)):
                c = Contexts(sent.value, *part)
                found.append((c.number, c.hashes.view(np.int64), c.classes(), c.first + c.shift, c.past - c.first))
            if found:
                yield _found(batch, *map(np.concatenate, zip(*found)))

    return emit


def mark_of(c: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    return c ^ row ^ (row >> 20) ^ at


def split_context(a: int, b: int, anchor: int) -> Iterator[tuple[int, int, int]]:
    """Parts of the windows a to b - 1, on a grid that the anchor fixes.

    (first window, last window, first byte of the core): the core, LENGTH - FINER + 1 bytes,
    is inside every window that can fall into the part, so equal windows have equal cores.
    """
    for step in range((anchor - b + 1) // FINER, (anchor - a) // FINER + 1):
        low = anchor - step * FINER
        yield max(a, low - FINER + 1), min(b - 1, low), low


def _bytes(multi, hot, firsts):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            out: list[tuple] = []
            for part in parts_of(batch.column(2)):
                c = Contexts(multi.value, *part)
                marks = mark_of(c.classes(), rows[c.number], c.first + c.shift)
                keep = filtered(firsts.value, marks.view(np.uint64))
                crowded = filtered(hot.value, c.hashes)
                columns = (c.first, c.past, c.place, c.hashes.view(np.int64), crowded, c.shift, c.number)
                for a, b, anchor, h, many, by, number in zip(*(x[keep].tolist() for x in columns)):
                    if not many:
                        out.append((False, h, number, a + by, c.view[a : b + LENGTH - 1]))
                        continue
                    for low, high, at in split_context(a, b, anchor):
                        core = xxhash.xxh3_64_intdigest(c.view[at : at + LENGTH - FINER + 1], seed=1)
                        out.append((True, core - (1 << 63), number, low + by, c.view[low : high + LENGTH]))
            if out:
                part, k, number, at, context = zip(*out)
                taken = pa.array(number, pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.array(part), pa.array(k, pa.int64()), keys.take(taken), batch.column(0).take(taken),
                    pa.array(at, pa.int64()), pa.array(context, pa.binary())],
                    ["part", "k", "key", "row", "at", "context"])

    return emit


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window by itself, under a hash of all its bytes. Columns row, key, at, context."""
    for batch in batches:
        found: list[list[int]] = [[], [], [], []]
        for i, (at, context) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            for k in range(len(context) - LENGTH + 1):
                digest = xxhash.xxh3_128_intdigest(context[k : k + LENGTH])
                for column, value in zip(found, (i, (digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63), at + k)):
                    column.append(value)
        number, h, c, at = (np.array(column, np.int64) for column in found)
        yield _found(batch, number, h, c, at, np.ones(len(at), np.int64))


def maximal_repeats(contexts: list[bytes], groups: list[int]) -> Iterator[tuple[int, int, int]]:
    """(context, start, end) of every repeat but its first occurrence.

    ``groups`` numbers the contexts (equal numbers stand together), which are in corpus
    order within a group. Suffixes are sorted behind the number of their group.
    """
    sizes = [max(0, len(c) - LENGTH + 1) for c in contexts]
    heads = [g.to_bytes(8, "big") for g in groups]
    suffixes = [head + c[i:] for head, c, n in zip(heads, contexts, sizes) for i in range(n)]
    total = len(suffixes)
    if total < 2:
        return
    context_of = np.repeat(np.arange(len(contexts)), sizes)
    start_of = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = sorted(range(total), key=suffixes.__getitem__)
    width = max(map(len, suffixes))
    lcp = np.zeros(total, np.int64)  # common prefix with the suffix before, without the group
    for low in range(0, total - 1, 16384):
        block = [suffixes[i] for i in order[low : low + 16385]]
        matrix = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in block), np.uint8).reshape(len(block), width)
        same = matrix[1:] == matrix[:-1]
        length = np.where(same.all(axis=1), width, same.argmin(axis=1))
        shorter = np.minimum.reduce([np.array([len(s) for s in block[1:]]), np.array([len(s) for s in block[:-1]])])
        lcp[low + 1 : low + len(block)] = np.minimum(length, shorter) - 8
    long = np.concatenate([lcp >= LENGTH, [False]])
    edges = np.flatnonzero(long[1:] != long[:-1]) + 1
    contexts_of, starts_of = context_of.tolist(), start_of.tolist()
    for run in range(0, len(edges), 2):
        low, high = int(edges[run]) - 1, int(edges[run + 1])
        members = order[low:high]
        depths = [0, *lcp[low + 1 : high].tolist()]
        for depth, left, right in prefix_intervals(depths):
            inside = members[left : right + 1]
            before = {contexts[contexts_of[s]][starts_of[s] - 1] if starts_of[s] else -1 - s for s in inside}
            if len(before) > 1:  # no longer repeat has the same occurrences
                first = min(inside)
                for s in inside:
                    if s != first:
                        yield contexts_of[s], starts_of[s], starts_of[s] + depth


def prefix_intervals(depths: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of every node of the prefix tree, by a scan with a stack.

    ``depths[i]`` is the common prefix of entries i - 1 and i.
    """
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*depths[1:], 0], 1):
        left = i - 1
        while stack and stack[-1][0] > depth:
            above, left = stack.pop()
            yield above, left, i - 1
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, left))


SPANS = "row long, start long, end long"


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # Columns k, row, at, context, sorted by k and then corpus order.
    for whole in whole_groups(batches, 0):
        keys = whole.column("k").to_numpy()
        new = np.concatenate([[False], keys[1:] != keys[:-1]])
        groups = np.cumsum(new)
        cuts, at = [0], np.flatnonzero(new)
        for target in range(1024, len(keys), 1024):  # pieces of whole groups
            later = at[np.searchsorted(at, target):]
            if len(later) and later[0] > cuts[-1]:
                cuts.append(int(later[0]))
        for low, high in zip(cuts, [*cuts[1:], len(keys)]):
            piece = whole.slice(low, high - low)
            row, place = piece.column("row").to_pylist(), piece.column("at").to_pylist()
            spans = [(row[j], place[j] + s, place[j] + e) for j, s, e in united_by_context(
                maximal_repeats(piece.column("context").to_pylist(), groups[low:high].tolist()))]
            columns = list(zip(*spans)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "start", "end"])


def united_by_context(spans: Iterator[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    last: list[int] = []
    for j, start, end in sorted(spans):
        if last and last[0] == j and start <= last[2]:
            last[2] = max(last[2], end)
        else:
            if last:
                yield tuple(last)
            last = [j, start, end]
    if last:
        yield tuple(last)


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, start, end): bytes of ``docs`` inside a repeated window that also starts earlier.

    ``row`` is what `monotonically_increasing_id` gives, ``start`` and ``end`` are places in
    the UTF-8 text; spans of a row may overlap. Earlier means a smaller ``key`` (null first,
    then by row), or an earlier place in the same text. ``docs`` must be a stored table.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"),
                           F.col(text).alias("text"))
    twice = docs.select(text).mapInArrow(_hashes, "h long").groupBy("h").agg(
        F.count("*").alias("n")).where("n > 1").select("h")
    repeated = spark.sparkContext.broadcast(bit_filter(twice, "h"))
    place = f"h long, c long, key {kind}, row long, at long, n long, first boolean"
    corpus_order = ("key", "row", "at")
    span = ("row", F.col("at").alias("start"), (F.col("at") + F.col("n") + LENGTH - 1).alias("end"))

    def copies(found: DataFrame) -> DataFrame:
        """``found`` with ``first`` true for the first of each (h, c) in the corpus.

        Only the first of each batch takes part, so a hot class is one row per batch.
        """
        inside = Window.partitionBy("h", "c").orderBy(*corpus_order)
        return saved(found.where("first").withColumn("first", F.row_number().over(inside) == 1))

    contexts = saved(numbered.mapInArrow(_contexts(repeated), place))
    classes = copies(contexts)
    shared = saved(classes.where("first").groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    mark = F.col("c").bitwiseXOR(F.col("row")).bitwiseXOR(F.shiftright("row", 20)).bitwiseXOR(F.col("at"))
    leading = classes.where("first").join(shared.select("h"), "h", "left_semi").select(mark.alias("mark"))
    sent = [spark.sparkContext.broadcast(bits) for bits in (
        bit_filter(shared, "h"), bit_filter(shared.where(F.col("n") > CROWD), "h"), bit_filter(leading, "mark"))]
    texts = saved(numbered.mapInArrow(
        _bytes(*sent), f"part boolean, k long, key {kind}, row long, at long, context binary"))

    crowds = texts.where("part").groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("k")
    crowds = saved(crowds)
    sorted_ = texts.join(crowds, "k", "left_anti").repartition("k").sortWithinPartitions("k", *corpus_order)
    repeats = sorted_.select("k", "row", "at", "context").mapInArrow(_repeats, SPANS)
    single = saved(texts.where("part").join(crowds, "k", "left_semi").select("row", "key", "at", "context")
                   .mapInArrow(_windows, place))
    more = [single.where("NOT first"), copies(single).where("NOT first"),
            contexts.where("NOT first"), classes.where("NOT first")]
    for found in more:
        repeats = repeats.unionByName(found.select(*span))
    return repeats


REMOVED = T.StructType([
    T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
    T.StructField("kept", T.BinaryType()),
])


@F.arrow_udf(REMOVED)
def removed(text: pa.Array, spans: pa.Array) -> pa.Array:
    return by_slices(_removed, text, spans, rows=128)


def _removed(text: pa.Array, spans: pa.Array) -> pa.Array:
    rows = []
    for body, found in zip(utf8(text), spans.to_pylist()):
        out, at, gone, n, begin = [], 0, 0, 0, None
        for span in found or []:  # in order of their starts
            start, end = span["start"], span["end"]
            if begin is None or start > at:
                out.append(body[at:start])
                n, begin = n + 1, start
                gone += end - start
                at = end
            elif end > at:
                gone += end - at
                at = end
        out.append(body[at:])
        rows.append({"n_removed": gone, "n_spans": n, "kept": b"".join(out)})
    return pa.array(rows, pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]))


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept) of every row: the text without repeated bytes.

    ``kept`` is binary, as a cut may fall inside a character. Null texts are empty; texts
    under 100 bytes stay whole; repeated rows are rows of their own, the later ones lose
    what the first keeps; an empty table gives no rows; other columns are not returned.
    """
    spans = repeated_spans(docs, key, text).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))  # of one text
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key), body.alias("body"))
    joined = rows.join(spans, "row", "left").withColumn("cut", removed("body", "spans"))
    return joined.select(key, F.octet_length("body").cast("long").alias("n_bytes"), "cut.*")


@query("op8_repeated_substrings")
def repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
