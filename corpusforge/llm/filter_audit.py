"""Audit of how filters interact, whatever the order they run in.

Each document is reduced to one bit per filter. Spark counts the documents of every part by
their bits; those counts, reshaped to one axis of length two per filter (0 passes, 1 fails),
are the contingency tensor of the part. Every figure of every step of every order is a
contraction of that tensor: along each axis a vector selects pass, fail or all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm.common import query, saved, table

FILTERS = "ABCDE"
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
MEASURES = ("docs", "good", "toxic")
STEPS = ("part string, filter_order string, step int, kept long, removed long, redundant long, "
         "unique_fails long, good_lost long, toxic_lost long, shapley long")


@cache
def selections() -> tuple[list[tuple[str, int, int]], dict[str, np.ndarray]]:
    """(order, step, axis of the step's filter) of every step of every order, and for each
    kind of figure the vector that each step puts on each axis: (steps, axes, 2).
    """
    steps, vectors = [], {"kept": [], "removed": [], "fails": [], "unique": []}
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[axis] for axis in order)
        for step, axis in enumerate(order):
            earlier = set(order[:step])
            axes = range(len(FILTERS))
            steps.append((name, step + 1, axis))
            vectors["kept"].append([PASS if a in earlier or a == axis else ALL for a in axes])
            vectors["removed"].append([FAIL if a == axis else PASS if a in earlier else ALL for a in axes])
            vectors["fails"].append([FAIL if a == axis else ALL for a in axes])
            vectors["unique"].append([FAIL if a == axis else PASS for a in axes])
    return steps, {kind: np.array(v, np.int64) for kind, v in vectors.items()}


def contract(tensors: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Tensors (m, 2, 2, 2, 2, 2) under the vectors of every step: counts (m, steps)."""
    a, b, c, d, e = (vectors[:, axis] for axis in range(len(FILTERS)))
    return np.einsum("mabcde,sa,sb,sc,sd,se->ms", tensors, a, b, c, d, e, optimize="greedy")


def audit_tensors(tensors: np.ndarray) -> dict[str, np.ndarray]:
    """Figures (parts, steps) of the tensors (parts, MEASURES, 2, 2, 2, 2, 2)."""
    steps, vectors = selections()
    docs, good, toxic = (tensors[:, m] for m in range(len(MEASURES)))
    removed = contract(docs, vectors["removed"])
    axis = np.array([s[2] for s in steps])
    by_filter = np.stack([removed[:, axis == f].sum(axis=1) for f in range(len(FILTERS))], axis=1)
    return {
        "kept": contract(docs, vectors["kept"]),
        "removed": removed,
        "redundant": contract(docs, vectors["fails"]) - removed,
        "unique_fails": contract(docs, vectors["unique"]),
        "good_lost": contract(good, vectors["removed"]),
        "toxic_lost": contract(toxic, vectors["removed"]),
        "shapley": by_filter[:, axis],
    }


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # Columns part, cells: a list of (code, docs, good, toxic), at most one per code.
    steps, _ = selections()
    for whole in batches:
        for at in range(0, whole.num_rows, 64):
            batch = whole.slice(at, 64)
            tensors = np.zeros((batch.num_rows, len(MEASURES), 1 << len(FILTERS)), np.int64)
            for part, cells in enumerate(batch.column(1).to_pylist()):
                for cell in cells:
                    tensors[part, :, cell["code"]] = [cell[m] for m in MEASURES]
            figures = audit_tensors(tensors.reshape(-1, len(MEASURES), *[2] * len(FILTERS)))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(n), len(steps)))),
                pa.array([s[0] for s in steps] * n, pa.string()),
                pa.array([s[1] for s in steps] * n, pa.int32()),
                *(pa.array(f.ravel()) for f in figures.values()),
            ], ["part", "filter_order", "step", *figures])


def failures(text: Column) -> dict[str, Column]:
    """The failure conditions that a text alone decides, by filter."""
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step, with the figures of ``STEPS``.

    A null text is the empty text and a null part the empty part. Filter E fails a row whose
    text also stands under a smaller key anywhere in ``docs``; rows of one key do not fail each
    other, and a row without key neither fails E nor makes another fail. Several labels of one
    key count as one that has all their marks; documents without label are neither good nor
    toxic. An empty table gives no rows. Columns besides these are not read.

    Texts are reduced to bits and a SHA-256 before anything moves. The smallest key of each
    text is combined in the task, and a row meets it by (text, key), so copies of one text
    are spread by their keys. What is counted is at most 32 cells a part.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    bits = {name: F.coalesce(fails, F.lit(False)).cast("int") for name, fails in failures(F.col("body")).items()}
    code = sum(bit * (1 << (len(FILTERS) - 1 - FILTERS.index(name))) for name, bit in bits.items())
    rows = saved(docs.select(F.col(key).alias("key"), F.coalesce(F.col(part), F.lit("")).alias("part"), body.alias("body"))
                 .select("key", "part", code.alias("code"), F.unhex(F.sha2("body", 256)).alias("digest")))
    firsts = rows.groupBy("digest").agg(F.min("key").alias("key")).where("key IS NOT NULL").withColumn("first", F.lit(True))
    marks = labels.groupBy(F.col("doc_id").alias("key")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # E is the last filter, so its bit is the lowest.
    copy = (F.col("first").isNull() & F.col("key").isNotNull()).cast("int")
    cells = (
        rows.join(firsts, ["digest", "key"], "left").join(marks, "key", "left")
        .groupBy("part", (F.col("code") + copy).alias("code"))
        .agg(F.count("*").alias("docs"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
             F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    )
    tensors = cells.groupBy("part").agg(F.collect_list(F.struct("code", *MEASURES)).alias("cells"))
    return tensors.mapInArrow(_audit, STEPS)


AUDIT_SQL = r"""
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
        list_filter(string_split_regex(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w
    FROM documents
), failed AS (
    SELECT part, coalesce(quality = 1, false)::INT AS good, coalesce(toxic = 1, false)::INT AS toxic,
        (len(w) < 200)::INT
        + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
        + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT
        + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS code
    FROM texts LEFT JOIN labels USING (doc_id)
), cells AS (
    SELECT part, code, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
    SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
    SELECT filter_order, step, 1 << (strpos('ABCDE', filter_order[step]) - 1) AS own,
        list_sum(list_transform(range(1, step), lambda i: 1 << (strpos('ABCDE', filter_order[i]) - 1))) AS before
    FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), figures AS (
    SELECT part, filter_order, step::INT AS step, own,
        coalesce(sum(docs) FILTER (code & (coalesce(before, 0)::INT | own) = 0), 0)::BIGINT AS kept,
        coalesce(sum(docs) FILTER (code & coalesce(before, 0)::INT = 0 AND code & own <> 0), 0)::BIGINT AS removed,
        coalesce(sum(docs) FILTER (code & coalesce(before, 0)::INT <> 0 AND code & own <> 0), 0)::BIGINT AS redundant,
        coalesce(sum(docs) FILTER (code = own), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (code & coalesce(before, 0)::INT = 0 AND code & own <> 0), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (code & coalesce(before, 0)::INT = 0 AND code & own <> 0), 0)::BIGINT AS toxic_lost
    FROM cells, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM figures
"""


@query("op13_filter_audit", AUDIT_SQL)
def filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
