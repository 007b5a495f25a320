"""Near-duplicate documents by min-max hashing of their word three-grams.

Under each permutation of the shingles both the smallest and the largest value of a set are
kept. Either one agrees between two sets with the probability of their similarity, so half
the hash evaluations give the same number of values, and their share of agreement varies
less than that of as many minima. The values are banded: minima in half of the bands, maxima
in the other half.

Equal sets form a class. In every band the members are first compared with one leader, the
member that shares the most; that is one pair a row, and joins most of a crowded band. What
is not linked then is compared within the band in blocks, by signature first, and only
across groups that are still apart. Every link is confirmed on the whole sets.
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

from corpusforge.llm.common import bit_filter, filtered, mix64, query, run_sets, saved, slices, table, utf8, whole_groups
from corpusforge.llm.components import components

WORDS = 3
THRESHOLD = Fraction(85, 100)
PERMUTATIONS = 80
VALUES = 2 * PERMUTATIONS
ROWS = 5
BANDS = VALUES // ROWS
BLOCK = 1024
# A pair at the threshold has fewer agreeing values than a comparison asks for with less than this chance.
TOLERANCE = 1e-9
_seeds = mix64(np.arange(2 * PERMUTATIONS, dtype=np.uint64) + np.uint64(1)).astype(np.uint32)
MULTIPLIERS, OFFSETS = _seeds[:PERMUTATIONS] | np.uint32(1), _seeds[PERMUTATIONS:]
_salts = mix64(np.arange(BANDS, dtype=np.uint64) + np.uint64(7))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the three-word runs of each text, A-Z as a-z.

    Words are what white space separates; each is hashed by itself and a run by mixing the
    hashes of its words. A text of one or two words is a single run; one without words has none.
    """
    return run_sets([t.lower().split() for t in texts], WORDS)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima, then maxima (low 16 bits) under each permutation, for sets that are not empty."""
    small = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    least = np.empty((PERMUTATIONS, len(sets)), np.uint32)
    most = np.empty_like(least)
    value, shifted = np.empty_like(small), np.empty_like(small)
    for k in range(PERMUTATIONS):
        np.multiply(small, MULTIPLIERS[k], out=value)
        value += OFFSETS[k]
        np.right_shift(value, np.uint32(15), out=shifted)
        value ^= shifted
        value *= np.uint32(0x2C1B3C6D)
        least[k] = np.minimum.reduceat(value, starts)
        most[k] = np.maximum.reduceat(value, starts)
    both = np.concatenate([least, most])
    return np.ascontiguousarray((both ^ (both >> np.uint32(16))).astype("<u2").T)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # Columns key, text.
    for batch in slices(batches, 256):
        sets = shingle_sets(utf8(batch.column(1)))
        solid = [s for s in sets if len(s)]
        sigs = iter(signatures(solid)) if solid else iter(())
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([_digest(s) for s in sets], pa.binary()),
            pa.array([next(sigs).tobytes() if len(s) else None for s in sets], pa.binary()),
        ], ["key", "n", "cls", "sig"])


def _digest(shingles: np.ndarray) -> bytes:
    return blake2b(shingles.tobytes(), digest_size=16).digest()


def band_keys(values: np.ndarray) -> np.ndarray:
    """A number for each band of each signature; its low bits are the band."""
    keys = np.zeros((len(values), BANDS), np.uint64)
    grouped = values.reshape(len(values), BANDS, ROWS).astype(np.uint64)
    for row in range(ROWS):
        keys = mix64((keys ^ _salts) + grouped[:, :, row])
    return (keys & ~np.uint64(BANDS - 1)) | np.arange(BANDS, dtype=np.uint64)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # Columns cls, n, sig.
    for batch in slices(batches, 4096):
        values = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u2").reshape(-1, VALUES)
        each = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
        yield pa.RecordBatch.from_arrays(
            [pa.array(band_keys(values).ravel().view(np.int64)), batch.column(0).take(each), batch.column(1).take(each)],
            ["band", "cls", "n"])


def _shingles(sent):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found: dict[bytes, bytes] = {}  # copies in a slice are sent once
            sets = shingle_sets(utf8(batch.column(0)))
            digests = [_digest(s) for s in sets]
            marks = np.array([int.from_bytes(d[:8], "big") for d in digests], np.uint64)
            for i in np.flatnonzero(filtered(sent.value, marks)).tolist():
                found[digests[i]] = sets[i].tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.binary())], ["cls", "shingles"])

    return emit


def sets_of(docs: DataFrame, text: str, members: DataFrame) -> DataFrame:
    """(cls, shingles) of the classes in ``members`` (cls), one row each, from a second reading."""
    mark = F.expr("CAST(conv(hex(substring(cls, 1, 8)), 16, -10) AS BIGINT)").alias("mark")
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(members.select(mark), "mark"))
    sets = docs.select(text).mapInArrow(_shingles(sent), "cls binary, shingles binary")
    return saved(sets.groupBy("cls").agg(F.first("shingles").alias("shingles")).join(members, "cls", "left_semi"))


def similar(common: int, a: int, b: int, threshold: Fraction) -> bool:
    return common * threshold.denominator >= (a + b - common) * threshold.numerator


def _confirm(threshold: Fraction):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Columns a, b, set_a, set_b.
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (left, right))
                merged = np.concatenate([x, y])
                merged.sort()
                keep.append(similar(int((merged[1:] == merged[:-1]).sum()), len(x), len(y), threshold))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return confirm


def least_matches(threshold: Fraction) -> int:
    """The fewest of VALUES agreeing values with which a pair stays a candidate."""
    t, below, m = float(threshold), 0.0, -1
    while below < TOLERANCE:
        m += 1
        below += comb(VALUES, m) * t**m * (1 - t) ** (VALUES - m)
    return m


def _candidates(least: int, threshold: Fraction):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Columns home, band, cls, n, label, block, low, high, sig, sorted by home.
        for rows in whole_groups(batches, 0, 1):
            home, band, n, block, low, high = (rows.column(c).to_numpy() for c in ("home", "band", "n", "block", "low", "high"))
            label = rows.column("label").to_numpy()
            values = np.frombuffer(b"".join(rows.column("sig").to_pylist()), "<u2").reshape(-1, VALUES)
            ends = np.searchsorted(home, home, "right")
            first, second = [], []
            for i in range(len(home)):
                rest = np.arange(i + 1, ends[i])
                apart = (label[rest] != label[i]) & ((low[i] == high[i]) | (block[rest] != block[i]))
                small, large = np.minimum(n[rest], n[i]), np.maximum(n[rest], n[i])
                rest = rest[apart & (small * threshold.denominator >= large * threshold.numerator)]
                equal = values[rest] == values[i]
                enough = equal.sum(axis=1) >= least
                # A pair is looked at under the first band it shares.
                shared = equal[enough].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
                rest = rest[enough][shared == band[i] % BANDS]
                first += [i] * len(rest)
                second += rest.tolist()
            a, b = np.array(first, np.int64), np.array(second, np.int64)
            met = np.unique(np.concatenate([a, b]))
            offsets = np.append(np.searchsorted(a, met, "left"), len(a)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(home[met]), rows.column("cls").take(met).combine_chunks(),
                pa.ListArray.from_arrays(pa.array(offsets), rows.column("cls").take(b).combine_chunks()),
            ], ["home", "cls", "partners"])

    return compare


def _verify(threshold: Fraction):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Columns home, cls, shingles, partners, sorted by home.
        for rows in whole_groups(batches, 0, 1):
            home = rows.column("home").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1], [True]])).tolist()
            out = [link for start, end in zip(edges, edges[1:]) for link in verified(rows.slice(start, end - start), threshold)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], ["a", "b"])

    return verify


def verified(rows: pa.Table, threshold: Fraction) -> list[tuple[bytes, bytes]]:
    """Links between the classes of one home, enough to connect what is similar.

    Partners that earlier links have joined already are not compared.
    """
    names = rows.column("cls").to_pylist()
    at = {name: i for i, name in enumerate(names)}
    sets = [np.frombuffer(s, np.uint64) for s in rows.column("shingles").to_pylist()]
    root, links = list(range(len(names))), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, partners in enumerate(rows.column("partners").to_pylist()):
        for j in map(at.__getitem__, partners):
            if find(i) != find(j):
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if similar(common, len(sets[i]), len(sets[j]), threshold):
                    root[find(j)] = find(i)
                    links.append((names[i], names[j]))
    return links


def in_blocks(rows: DataFrame) -> DataFrame:
    """Rows of a band (columns band, cls, m) dealt to the homes that compare two of its blocks."""
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    return (
        rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        .withColumn("home", F.xxhash64("band", "low", "high"))
    )


def linked_classes(docs: DataFrame, text: str, classes: DataFrame, threshold: Fraction) -> DataFrame:
    """(cls, group) of the classes (cls, n, sig) that are linked with another one."""
    bands = classes.where("sig IS NOT NULL").select("cls", "n", "sig").mapInArrow(_bands, "band long, cls binary, n long")
    sizes = bands.groupBy("band").agg(F.count("*").alias("m")).where("m > 1")
    shared = saved(bands.join(sizes, "band"))
    sets = sets_of(docs, text, shared.select("cls").distinct())

    # One pair a row: with the member of the band that meets the most others.
    met = shared.groupBy("cls").agg(F.sum("m").alias("met"))
    led = shared.join(met, "cls")
    leaders = led.groupBy("band").agg(F.max(F.struct("met", "cls", "n")).alias("leader"))
    led = saved(led.join(leaders, "band").where("cls <> leader.cls").select(
        "band", "cls", "n", "m", F.col("leader.cls").alias("leader"), F.col("leader.n").alias("leader_n")))
    close = F.least("n", "leader_n") * threshold.denominator >= F.greatest("n", "leader_n") * threshold.numerator
    pairs = led.where(close).select(F.col("cls").alias("a"), F.col("leader").alias("b")).distinct()
    ends = [sets.select(F.col("cls").alias(side), F.col("shingles").alias(f"set_{side}")) for side in "ab"]
    links = saved(pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", "set_a", "set_b")
                  .mapInArrow(_confirm(threshold), "a binary, b binary"))
    labels = components(links).withColumnRenamed("node", "cls")

    # The rest of each band, where it is not one group yet. A band of two has no rest.
    rest = led.where("m > 2").select("band", "cls", "n").join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    mixed = rest.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("m")).where("low <> high")
    open_ = rest.join(mixed.select("band", "m"), "band").withColumn("label", F.xxhash64("label")).join(classes.select("cls", "sig"), "cls")
    homes = in_blocks(open_).select("home", "band", "cls", "n", "label", "block", "low", "high", "sig")
    candidates = saved(homes.repartition("home").sortWithinPartitions("home").mapInArrow(
        _candidates(least_matches(threshold), threshold), "home long, cls binary, partners array<binary>"))
    more = candidates.join(sets, "cls").select("home", "cls", "shingles", "partners").repartition("home").sortWithinPartitions(
        "home").mapInArrow(_verify(threshold), "a binary, b binary")

    named = [labels.select(F.col("cls").alias(side), F.col("label").alias(f"label_{side}")) for side in "ab"]
    between = saved(more.join(named[0], "a", "left").join(named[1], "b", "left").select(
        F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")))
    merged = components(between)
    inner = labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("over")), "label", "left").select(
        "cls", F.coalesce("over", "label").alias("group"))
    # Classes that only the second round links were labels of their own.
    alone = merged.join(labels, merged["node"] == labels["cls"], "left_anti").select(F.col("node").alias("cls"), F.col("label").alias("group"))
    return saved(inner.unionByName(alone))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: Fraction = THRESHOLD) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row of ``docs``.

    Two texts are linked if their sets of three-word runs have a similarity of ``threshold`` or
    more; ``component_id`` is the smallest key that links lead to, and rows with that key are
    ``kept``. A text without words (null, empty, blank) is linked with nothing, not even its
    like, and is its own component. Rows without key are members of components but name none;
    where a component has no other rows, its id is null and they are kept. An empty table
    gives no rows. Texts of any length are read whole; their sets fill 8 bytes a word.

    A pair at the threshold shares no band with a chance of 7e-9. Per band, the first round
    looks at one pair a row. The second compares in blocks of 1,024: its work can grow with the
    square of a band's classes that share values but are in different groups.
    """
    kind = docs.schema[key].dataType.simpleString()
    profiles = saved(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        _profile, f"key {kind}, n long, cls binary, sig binary"))
    classes = saved(profiles.groupBy("cls").agg(
        F.min("key").alias("smallest"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    groups = linked_classes(docs, text, classes, threshold)
    named = saved(classes.where("n > 0").select("cls", "smallest").join(groups, "cls", "left").select(
        "cls", "smallest", F.coalesce("group", "cls").alias("group")))
    ids = named.groupBy("group").agg(F.min("smallest").alias("component_id"))
    # Texts meet their class by its digest; groups are joined while copies are still one row.
    known = saved(named.join(ids, "group").select("cls", "component_id"))
    placed = profiles.select("key", "n", "cls").join(known, "cls", "left").withColumn(
        "component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")))
    return placed.select("key", F.col("n").alias("n_shingles"), "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


DEDUP_SQL = r"""
WITH RECURSIVE docs AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w
    FROM documents
), sets AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g
    FROM docs
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
    FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), reached AS (
    SELECT doc_id, doc_id AS other FROM docs
    UNION
    SELECT doc_id, y FROM reached JOIN links ON other = x
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) LEFT JOIN sizes USING (doc_id)
"""


@query("op11_minmax_dedup", DEDUP_SQL)
def minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).withColumnRenamed("key", "doc_id")
