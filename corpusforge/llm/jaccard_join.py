"""Similarity join of texts by Jaccard similarity of their word five-grams.

Equal sets of five-grams form a class at once. Of the classes, MinHash bands name the
candidate pairs. Their MinHash values are compared sixteen at a time, and a pair is
dropped as soon as the posterior probability that it reaches the threshold (uniform
prior) is below a tolerance. What is left is verified on the whole sets.

Pairs are never rows. Classes that share a band are dealt out in blocks; a task compares
two blocks and answers with one list of partners for each class. A pair is looked at
under the first band it shares and under no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm.common import (
    bit_filter, free_name, in_filter, mix64, query, run_sets, saved, slices, small_batches, stored_rows, table, utf8,
    whole_groups,
)
from corpusforge.llm.components import components

WORDS = 5
THRESHOLD = Fraction(4, 5)
BANDS = 32
ROWS = 4
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-6
BLOCK = 1024
_seeds = mix64(np.arange(2 * HASHES, dtype=np.uint64) + np.uint64(1)).astype(np.uint32)
MULTIPLIERS, OFFSETS = _seeds[:HASHES] | np.uint32(1), _seeds[HASHES:]


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the five-word runs of each text.

    A text of one to four words is a single run; a text without words has none. Words are
    what white space separates.
    """
    return run_sets([t.split() for t in texts], WORDS)


def signature(shingles: np.ndarray) -> bytes:
    """MinHash values (low 16 bits) of a set that is not empty."""
    small = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.empty(HASHES, np.uint32)
    for k in range(0, HASHES, 8):
        part = small[:, None] * MULTIPLIERS[k : k + 8] + OFFSETS[k : k + 8]
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        least[k : k + 8] = part.min(axis=0)
    return (least ^ (least >> np.uint32(16))).astype("<u2").tobytes()


def _key(shingles: np.ndarray) -> tuple[int, int]:
    digest = blake2b(shingles.tobytes(), digest_size=16).digest()
    return (int.from_bytes(digest[:8], "little", signed=True),
            int.from_bytes(digest[8:], "little", signed=True))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # Columns row, key, text.
    for batch in slices(batches):
        sets = shingle_sets(utf8(batch.column(2)))
        keys = [_key(s) for s in sets]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array([k[0] for k in keys], pa.int64()),
            pa.array([k[1] for k in keys], pa.int64()),
            pa.array([signature(s) if len(s) else None for s in sets], pa.binary()),
        ], ["row", "key", "k1", "k2", "sig"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = mix64(np.arange(BANDS, dtype=np.uint64) + np.uint64(7))
    for batch in slices(batches, 4096):
        reps = batch.column(0).to_numpy(zero_copy_only=False)
        values = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(-1, BANDS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(mix64(values ^ salt).ravel().view(np.int64)), pa.array(np.repeat(reps, BANDS))],
            ["band", "rep"])


def least_matches(threshold: Fraction, tolerance: float) -> list[int]:
    """For each number of compared values, the fewest matches that keep a pair.

    With a uniform prior, P(similarity >= t | m of n match) is the chance of at most m
    successes in n + 1 trials of probability t.
    """
    t = float(threshold)
    least = []
    for n in range(STEP, HASHES + 1, STEP):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        least.append(m)
    return least


def surviving(values: np.ndarray, left: np.ndarray, right: np.ndarray, band: np.ndarray,
              salted: np.ndarray, least: list[int]) -> np.ndarray:
    """Which pairs meet here for the first time and pass every comparison."""
    open_ = np.arange(len(left))
    by_band = values.view("<u8")
    first = np.full(len(left), -1)
    same = np.zeros(len(left), bool)
    for k in range(BANDS):  # the first band with equal values
        rest = np.flatnonzero(first < 0)
        if not len(rest):
            break
        equal = by_band[left[rest], k] == by_band[right[rest], k]
        found = rest[equal]
        first[found] = k
        same[found] = mix64(by_band[left[found], k] ^ salted[k]).view(np.int64) == band[found]
    open_ = np.flatnonzero(same)
    matches = np.zeros(len(left), np.int64)
    for n, fewest in enumerate(least):
        part = slice(n * STEP, (n + 1) * STEP)
        matches[open_] += (values[left[open_], part] == values[right[open_], part]).sum(axis=1)
        open_ = open_[matches[open_] >= fewest]
    return open_


CANDIDATES = "home long, rep long, partners array<long>"


def _candidates(least: list[int]):
    salted = mix64(np.arange(BANDS, dtype=np.uint64) + np.uint64(7))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Columns home, band, rep, block, left, right, sig, sorted by home and rep.
        for rows in whole_groups(batches, 0):
            home, band, rep, block, low, high = (
                rows.column(c).to_numpy() for c in ("home", "band", "rep", "block", "low", "high"))
            values = np.frombuffer(b"".join(rows.column("sig").to_pylist()), "<u2").reshape(-1, HASHES)
            found_a, found_b = [], []
            for distance in range(1, len(home)):
                left = np.flatnonzero(home[distance:] == home[:-distance])
                if not len(left):
                    break
                right = left + distance
                # Homes of two blocks compare across; pairs of one block have their own home.
                across = (low[left] == high[left]) | (block[left] != block[right])
                left, right = left[across], right[across]
                keep = surviving(values, left, right, band[left], salted, least)
                found_a.append(left[keep])
                found_b.append(right[keep])
            a, b = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in (found_a, found_b))
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            met = np.unique(np.concatenate([a, b]))
            counts = np.searchsorted(a, met, "right") - np.searchsorted(a, met, "left")
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(home[met]), pa.array(rep[met]),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(rep[b])),
            ], ["home", "rep", "partners"])

    return compare


def in_homes(shared: DataFrame) -> DataFrame:
    """Rows of a band (columns band, rep, n, sig) dealt to the tasks that compare its blocks.

    A band of n classes has ceil(n / BLOCK) blocks, and every two blocks meet in one home
    of at most about 2 * BLOCK classes.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = (
        shared.withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", other)
        .withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    )
    return dealt.select(F.xxhash64("band", "low", "high").alias("home"),
                        "band", "rep", "block", "low", "high", "sig")


def _shingles(sent):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            wanted = [i for i, mark in enumerate(batch.column(2).to_pylist()) if in_filter(sent.value, mark)]
            batch = batch.take(pa.array(wanted, pa.int64()))
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([s.tobytes() for s in shingle_sets(utf8(batch.column(1)))], pa.binary()),
            ], ["row", "shingles"])

    return emit


LINKS = "a long, root long, links long"


def _verify(threshold: Fraction):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Columns home, rep, copies, shingles, partners, sorted by home and rep.
        for rows in whole_groups(batches, 0, 1):
            home = rows.column("home").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1], [True]]))
            out: list[tuple[int, int, int]] = []
            for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
                out += verified(rows.slice(start, end - start), threshold)
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                             ["a", "root", "links"])

    return verify


def verified(rows: pa.Table, threshold: Fraction) -> list[tuple[int, int, int]]:
    """(class, local root, documents linked to it) of the classes of one home."""
    reps, copies = rows.column("rep").to_pylist(), rows.column("copies").to_pylist()
    at = {rep: i for i, rep in enumerate(reps)}
    sets = [np.frombuffer(s, np.uint64) for s in rows.column("shingles").to_pylist()]
    sizes = np.array([len(s) for s in sets])
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    parts = [local[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())]
    mark = np.zeros(int(local.max()) + 1, bool)
    root, links = list(range(len(reps))), [0] * len(reps)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, partners in enumerate(rows.column("partners").to_pylist()):
        if not partners:
            continue
        others = np.array([at[p] for p in partners])
        mark[parts[i]] = True
        inside = mark[np.concatenate([parts[j] for j in others.tolist()])]
        mark[parts[i]] = False
        stops = np.cumsum(sizes[others])
        total = np.concatenate([[0], np.cumsum(inside)])
        common = total[stops] - total[stops - sizes[others]]
        union = sizes[i] + sizes[others] - common
        for j in others[common * threshold.denominator >= union * threshold.numerator].tolist():
            links[i] += copies[j]
            links[j] += copies[i]
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [(rep, reps[find(i)], n) for i, (rep, n) in enumerate(zip(reps, links)) if n]


def similar_texts(docs: DataFrame, key: str = "doc_id", text: str = "text",
                  threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(row, key, class_id, n_links, leader) of every row of ``docs``.

    ``row`` is what `monotonically_increasing_id` gives; ``class_id`` is the smallest key in
    the connected group of linked texts, ``n_links`` the number of other rows whose set of
    five-word runs has at least ``threshold`` similarity, copies included. One row of each
    group, the one with the smallest key, is its ``leader``. Null and empty texts have the
    same, empty set: they are copies of each other and like nothing else. ``row`` holds for a
    plain reading of files; what is more than that must be stored first, as ``keep_leaders`` does.

    At the threshold itself a pair shares no band with a chance of 5e-8 and fails a
    comparison with less than 1e-5. Within a band every two classes are compared, in blocks, for
    every link counts in ``n_links``: a band of n near copies costs n^2 / BLOCK signatures and
    has a list of partners for each class. Runs are 64-bit hashes of whole words; that two of the
    corpus clash in one compared pair is left to chance (some 1e-13 for sets of 1,000).
    """
    small_batches(docs.sparkSession)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"),
                           F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    profiles = saved(numbered.mapInArrow(_profile, f"row long, key {kind}, k1 long, k2 long, sig binary"))
    classes = saved(profiles.groupBy("k1", "k2").agg(
        F.min("row").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig"),
        F.min(F.struct("key", "row")).alias("first")))
    bands = classes.where("sig IS NOT NULL").select("rep", "sig").mapInArrow(_bands, "band long, rep long")
    sizes = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = bands.join(sizes, "band").join(classes.select("rep", "sig"), "rep")
    homes = in_homes(shared).repartition("home").sortWithinPartitions("home", "rep")
    least = least_matches(threshold, tolerance)
    candidates = saved(homes.mapInArrow(_candidates(least), CANDIDATES))

    mark = F.xxhash64("rep").alias("mark")
    members = saved(candidates.select("rep").distinct().join(classes.select("rep", "copies"), "rep")
                    .select("rep", "copies", mark))
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(members, "mark"))
    sets = numbered.select("row", "text", F.xxhash64("row").alias("mark")).mapInArrow(
        _shingles(sent), "row long, shingles binary")
    sets = saved(members.join(sets, members["rep"] == sets["row"]).select("rep", "copies", "shingles"))
    links = saved(
        candidates.join(sets, "rep").select("home", "rep", "copies", "shingles", "partners")
        .repartition("home").sortWithinPartitions("home", "rep").mapInArrow(_verify(threshold), LINKS))

    labels = components(links.select("a", F.col("root").alias("b")))
    counted = links.groupBy("a").agg(F.sum("links").alias("links"))
    grouped = saved(
        classes.select("k1", "k2", "rep", "copies", "first")
        .join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        .join(counted.withColumnRenamed("a", "rep"), "rep", "left")
        .select("k1", "k2", "first", F.coalesce("label", "rep").alias("group"),
                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links")))
    leaders = grouped.groupBy("group").agg(F.min("first").alias("leader"))
    # Texts meet their class by its key alone; groups are joined while copies are still one row.
    known = saved(grouped.join(leaders, "group").select("k1", "k2", "leader", "n_links"))
    return profiles.select("row", "key", "k1", "k2").join(known, ["k1", "k2"]).select(
        "row", "key", F.col("leader.key").alias("class_id"), "n_links",
        (F.col("row") == F.col("leader.row")).alias("leader"))


def keep_leaders(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of similar texts; all columns stay."""
    docs, row = stored_rows(docs), free_name(docs, "row")
    gone = saved(similar_texts(docs, key, text).where(~F.col("leader")).select(F.col("row").alias(row)))
    return docs.withColumn(row, F.monotonically_increasing_id()).join(gone, row, "left_anti").select(*docs.columns)


JOIN_SQL = r"""
WITH RECURSIVE docs AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w
    FROM documents
), sets AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
    FROM docs
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
    FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
    WHERE 5 * c >= 4 * (p.n + q.n - c)
    UNION ALL
    SELECT a.doc_id, b.doc_id FROM docs a JOIN docs b ON a.doc_id <> b.doc_id
    WHERE len(a.w) = 0 AND len(b.w) = 0
), reached AS (
    SELECT doc_id, doc_id AS other FROM docs
    UNION
    SELECT doc_id, y FROM reached JOIN links ON other = x
)
SELECT doc_id, class_id, coalesce(n, 0) AS n_links
FROM (SELECT doc_id, min(other) AS class_id FROM reached GROUP BY doc_id)
LEFT JOIN (SELECT x AS doc_id, count(*) AS n FROM links GROUP BY x) USING (doc_id)
"""


@query("op4_jaccard_join", JOIN_SQL)
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return similar_texts(docs).select(F.col("key").alias("doc_id"), "class_id", "n_links")
