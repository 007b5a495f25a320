"""Helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from corpusforge.session import checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that gives the same rows if there is one."""
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again.

    Cuts the lineage: what follows is computed from the files, on any executor.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_rows(df: DataFrame) -> DataFrame:
    """``df`` itself if it is a plain reading of files, else written and read again.

    Rows of files are read in the same parts each time, so their numbers hold from one
    reading to the next; after a shuffle they would not.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() == "Project":
        plan = plan.child()
    return df if plan.nodeName() == "LogicalRelation" or plan.nodeName().startswith("Relation") else saved(df)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


BATCH_BYTES = 1 << 22
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python workers in Arrow batches of about ``BATCH_BYTES``.

    By default a batch holds 10,000 texts or 64 MB, and an executor keeps the memory in which
    batches of that size were built and received. A size that the session names is left alone.
    """
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def strings(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def utf8(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8; null is the empty text."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches cut smaller, so that what is made of their texts stays small as well."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()  # a worker lives on after its task


def by_slices(function: Callable[..., pa.Array], *columns: pa.Array, rows: int = 512) -> pa.Array:
    """``function`` of equal slices of the columns, put together again."""
    size = max(1, len(columns[0]))
    whole = pa.concat_arrays([function(*(c.slice(at, rows) for c in columns)) for at in range(0, size, rows)])
    pa.default_memory_pool().release_unused()  # a worker lives on after its task
    return whole


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def run_sets(texts: list[list[bytes]], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words of each list of words.

    Each word is hashed by itself and a run by mixing the hashes of its words, so texts made of
    one another's letters have nothing in common. Fewer words are a single run; none have none.
    """
    counts = [len(words) for words in texts]
    hashes = np.fromiter((xxh3_64_intdigest(w) for words in texts for w in words), np.uint64, sum(counts))
    places = mix64(np.arange(2 * size, dtype=np.uint64) + np.uint64(99)) | np.uint64(1)
    runs = hashes[:0]
    for place in range(size if len(hashes) >= size else 0):
        later = hashes[place : len(hashes) - size + 1 + place]
        runs = mix64((runs if place else np.uint64(0)) ^ (later * places[place]))
    sets, end = [], 0
    for count in counts:
        end += count
        if count >= size:
            sets.append(np.unique(runs[end - count : end - size + 1]))
        elif count:
            whole = np.zeros(1, np.uint64)
            for place in range(count):
                whole = mix64(whole ^ (hashes[end - count + place : end - count + place + 1] * places[size + place]))
            sets.append(mix64(whole + np.uint64(count)))
        else:
            sets.append(hashes[:0])
    return sets


def segment_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``values[start:end]``; zero for empty segments."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[starts]


FILTER_BITS = 1 << 26


def bit_filter(keys: DataFrame, column: str) -> np.ndarray:
    """An array of FILTER_BITS bits with the bit of every (long) key set.

    Its size is fixed, 8 MB, so it may be broadcast however many keys there are. A bit can
    be set by another key: what passes is a superset, to be joined with the keys.
    """
    at = F.pmod(F.col(column), F.lit(FILTER_BITS))
    bit = F.expr(f"shiftleft(1L, CAST(pmod(`{column}`, {FILTER_BITS}) & 31 AS INT))")
    words = keys.groupBy(F.shiftright(at, 5).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS >> 5, np.uint32)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return bits


def in_filter(bits: np.ndarray, key: int) -> bool:
    at = key % FILTER_BITS
    return bool(int(bits[at >> 5]) >> (at & 31) & 1)


def filtered(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys pass, for an array of 64-bit numbers."""
    at = keys.astype(np.uint64, copy=False) & np.uint64(FILTER_BITS - 1)
    return (bits[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32) & np.uint32(1)).astype(bool)


def whole_groups(batches: Iterator[pa.RecordBatch], key: int, least: int = 4096) -> Iterator[pa.Table]:
    """Sorted batches put together so that no group of equal keys is torn."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        before = held[-1].column(key)[-1].as_py() if held else None
        cut = int(change[-1]) if len(change) else 0 if before != keys[0] else -1
        if held and cut >= 0 and sum(b.num_rows for b in held) + cut >= least:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
