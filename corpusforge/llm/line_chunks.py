"""Removal of multi-line passages that occur elsewhere, by content-defined line chunks.

A rolling hash runs over the hashes of two neighbouring lines with a word. Of every two
neighbouring values the smaller one sets a border (winnowing), so borders depend on three
lines and nothing else: a shift or other surroundings move none, and every passage of three
lines has one. The two lines under a border are the chunk that is looked up; borders are at
most two lines apart, so the chunks of a passage meet. A chunk that is repeated is grown by the
line before and by the line after it, wherever the grown chunk is repeated too. Of equal chunks,
compared byte by byte, the first stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.llm.common import (
    bit_filter, by_slices, filtered, free_name, mix64, query, saved, slices, small_batches, stored_rows, strings, table,
    utf8,
)

LONG_LINE = 50  # words; a line of more is a passage by itself

Chunk = tuple[int, int, bytes]


def borders(hashes: np.ndarray) -> np.ndarray:
    """Places i for which the lines i and i + 1 lie under a border.

    The rolling value of two lines is smaller than that of the pair before or after it; of
    equal ones the later counts. A text of two lines has one pair, under a border.
    """
    if len(hashes) < 2:
        return np.zeros(0, np.int64)
    rolled = mix64(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])
    chosen = np.zeros(len(rolled), bool)
    smaller = rolled[:-1] < rolled[1:]
    chosen[:-1] |= smaller
    chosen[1:] |= ~smaller
    return np.flatnonzero(chosen) if len(rolled) > 1 else np.zeros(1, np.int64)


class Lines:
    """The lines of a text: where they begin, and which hold a word."""

    def __init__(self, text: bytes):
        self.text = text
        lines = text.split(b"\n")
        self.begins = [0, *accumulate(len(line) + 1 for line in lines)]
        self.solid = [i for i, line in enumerate(lines) if line and not line.isspace()]
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(lines[i]) for i in self.solid), np.uint64, len(self.solid))
        self.pairs = borders(hashes).tolist()
        # A line of so many words has a byte for each and for each gap.
        self.long = [i for i in self.solid if len(lines[i]) > 2 * LONG_LINE and len(lines[i].split()) > LONG_LINE]

    def span(self, first: int, last: int) -> Chunk:
        """(first line, past the last, bytes) from one line with a word to another."""
        return first, last + 1, self.text[self.begins[first] : self.begins[last + 1] - 1]

    def chunks(self) -> list[Chunk]:
        return [self.span(self.solid[i], self.solid[i + 1]) for i in self.pairs] + [self.span(i, i) for i in self.long]

    def grown(self, at: int) -> list[Chunk]:
        """Chunk number ``at``, one line longer before and after it; long lines do not grow."""
        if at >= len(self.pairs):
            return []
        i = self.pairs[at]
        out = [self.span(self.solid[i - 1], self.solid[i + 1])] if i else []
        return out + ([self.span(self.solid[i], self.solid[i + 2])] if i + 2 < len(self.solid) else [])


def key_of(chunk: bytes) -> bytes:
    return blake2b(chunk, digest_size=16).digest()


def keys_of(chunks: list[Chunk]) -> np.ndarray:
    """Two 64-bit numbers for each chunk."""
    return np.frombuffer(b"".join(key_of(chunk) for _, _, chunk in chunks), "<i8").reshape(-1, 2)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        keys = np.concatenate([np.zeros((0, 2), np.int64), *(
            keys_of(Lines(text).chunks()) for text in utf8(batch.column(0)))])
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(keys[:, k])) for k in (0, 1)], ["k1", "k2"])


def repeated_places(numbered: DataFrame, bits: np.ndarray) -> DataFrame:
    """(k1, k2, key, row, first, past, chunk) of chunks whose key may be repeated, by the bit
    array, and of what they grow to.

    The bytes are given once for each slice of texts and null for the copies in it.
    """
    sent = numbered.sparkSession.sparkContext.broadcast(bits)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = sent.value
        for batch in slices(batches):
            rows, spans, keys, chunks = [], [], [], []
            given: set[bytes] = set()
            for i, text in enumerate(utf8(batch.column(2))):
                lines = Lines(text)
                found = lines.chunks()
                at = np.flatnonzero(filtered(mask, keys_of(found)[:, 0])).tolist()
                for first, past, chunk in {c[:2]: c for n in at for c in (found[n], *lines.grown(n))}.values():
                    rows.append(i)
                    spans.append((first, past))
                    keys.append(key_of(chunk))
                    chunks.append(None if chunk in given else chunk)
                    given.add(chunk)
            key = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            span = np.array(spans, np.int32).reshape(-1, 2)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(np.ascontiguousarray(key[:, k])) for k in (0, 1)), batch.column(0).take(take), batch.column(1).take(take),
                 *(pa.array(np.ascontiguousarray(span[:, k])) for k in (0, 1)), pa.array(chunks, pa.binary())],
                ["k1", "k2", "key", "row", "first", "past", "chunk"])

    kind = numbered.schema["key"].dataType.simpleString()
    return numbered.mapInArrow(emit, f"k1 long, k2 long, key {kind}, row long, first int, past int, chunk binary")


def repeated_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, first, past) of every chunk that equals an earlier one.

    ``row`` is the number that `monotonically_increasing_id` gives to the row of ``docs``;
    earlier means a smaller ``key``, then row, then line. Chunks are compared byte by byte:
    were there different chunks under one 128-bit BLAKE2 key, none of them would be removed.
    """
    keys = docs.select(F.col(text).alias("text")).mapInArrow(_keys, "k1 long, k2 long")
    repeated = saved(keys.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2"))
    numbered = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    places = saved(repeated_places(numbered, bit_filter(repeated, "k1")))
    # Grouping by the bytes is the comparison; a hot chunk is one row per task before the shuffle.
    kinds = places.where("chunk IS NOT NULL").groupBy("k1", "k2", "chunk").agg(F.lit(1).alias("one")).groupBy(
        "k1", "k2").agg(F.count("*").alias("kinds")).where("kinds = 1").select("k1", "k2")
    leaders = places.groupBy("k1", "k2").agg(
        F.min(F.struct("key", "row", "first")).alias("leader"), F.count("*").alias("n")).where("n > 1")
    leaders = saved(leaders.join(kinds, ["k1", "k2"]).select("k1", "k2", "leader"))
    return places.select("k1", "k2", "row", "first", "past").join(leaders, ["k1", "k2"]).where(
        (F.col("row") != F.col("leader.row")) | (F.col("first") != F.col("leader.first"))
    ).select("row", "first", "past")


LINES = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("past", T.IntegerType())]))


@F.arrow_udf(LINES)
def united(chunks: pa.Array) -> pa.Array:
    """Sorted spans of lines, with those that meet put together."""
    def unite(spans: list[dict]) -> list[dict]:
        out: list[dict] = []
        for span in spans:
            if out and span["first"] <= out[-1]["past"]:
                out[-1]["past"] = max(out[-1]["past"], span["past"])
            else:
                out.append(span)
        return out

    kind = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))
    return by_slices(lambda found: pa.array([unite(spans or []) for spans in found.to_pylist()], kind), chunks)


@F.arrow_udf(T.StringType())
def without_lines(text: pa.Array, chunks: pa.Array) -> pa.Array:
    def rest(body: str, spans: list[dict] | None) -> str:
        gone = {i for span in spans or [] for i in range(span["first"], span["past"])}
        return "\n".join(line for i, line in enumerate(body.split("\n")) if i not in gone)

    return by_slices(lambda texts, found: pa.array(
        map(rest, strings(texts), found.to_pylist()), pa.string()), text, chunks)


def drop_repeated_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text",
                         chunks: str | None = None) -> DataFrame:
    """``docs`` with the lines of repeated chunks taken out of the texts.

    All rows and columns stay; null and empty texts and single lines of at most LONG_LINE words
    are never changed. A passage of three lines with a word or more that occurs earlier goes
    whole, one of two lines if a border falls on it. Repeated rows keep their chunks once. With
    ``chunks`` a column of that name holds the removed spans of lines.
    """
    small_batches(docs.sparkSession)
    docs = stored_rows(docs)
    row, spans = free_name(docs, "row"), free_name(docs, "chunks")
    found = repeated_chunks(docs, key, text).groupBy(F.col("row").alias(row)).agg(
        united(F.sort_array(F.collect_list(F.struct("first", "past")))).alias(spans))  # chunks of one text
    joined = docs.withColumn(row, F.monotonically_increasing_id()).join(found, row, "left")
    # A text that keeps all its lines goes to no Python worker.
    changed = F.col(spans).isNotNull()
    result = joined.withColumn(text, F.when(
        changed, without_lines(F.when(changed, F.col(text)), spans)).otherwise(F.col(text)))
    names = [c for c in docs.columns if c != chunks]
    return result.select(*names, *([F.col(spans).alias(chunks)] if chunks else []))


@query("op9_line_chunks")
def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = drop_repeated_chunks(docs, chunks="chunks")
    n_lines = F.coalesce(F.aggregate("chunks", F.lit(0).cast("long"), lambda n, c: n + c["past"] - c["first"]),
                         F.lit(0).cast("long"))
    return cleaned.select(
        "doc_id", F.coalesce(F.size("chunks"), F.lit(0)).cast("long").alias("n_chunks"),
        n_lines.alias("n_removed_lines"), F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
