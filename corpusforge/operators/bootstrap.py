"""Bootstrap intervals of mean scores."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.operators.ordered import hash_key, rank_in_order
from corpusforge.operators.overlap import PARTS

PRIME = 2**31 - 1
METHODS = ("poisson", "exact")
CELL = 1 << 16  # rows and replicates that one task of the exact method looks after
DRAWN_REPLICATES = 50  # at least so many replicates are drawn by one task
DRAWING_TASKS = 512
GOLDEN = 0x9E3779B97F4A7C15


def poisson_steps() -> list[int]:
    """The distribution function of Poisson(1), times ``PRIME``, as far as it is below it."""
    steps, total, k = [], math.exp(-1), 0
    while int(total * PRIME) < PRIME - 1:
        steps.append(int(total * PRIME))
        k += 1
        total += math.exp(-1) / math.factorial(k)
    return steps


POISSON = np.array(poisson_steps(), np.int64)


def digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def _weighted_sums(n_samples: int, seed: int):
    """Sums of weights and weighted scores per replicate, over the rows of a task.

    The weight of a row inverts the Poisson distribution at ``(k * r + c) mod p``, with
    ``r`` a hash of the row and ``k, c`` those of the replicate. Affine maps over a prime
    field make any two rows independent, which is what the variance of a mean depends
    on, and a retried task draws the same weights.
    """
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slope = np.array([digest(f"{seed}k{b}") % (PRIME - 1) + 1 for b in range(n_samples)], np.int64)
        shift = np.array([digest(f"{seed}c{b}") % PRIME for b in range(n_samples)], np.int64)
        total = None
        for batch in batches:
            values = np.column_stack([
                np.ones(batch.num_rows), *[c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]])
            row = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(row), 512):
                draw = (slope[:, None] * row[at : at + 512] + shift[:, None]) % PRIME
                weights = np.searchsorted(POISSON, draw, side="right")
                part = weights @ values[at : at + 512]
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(n_samples)), *map(pa.array, total.T.copy())],
                ["replicate", *(f"s{i}" for i in range(total.shape[1]))])

    return sums


def seed_of(*parts: int) -> int:
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:16], 16)


def draws_of_cell(n: int, cell: int, seed: int, replicate: int) -> int:
    """How many of ``n`` draws from ``n`` rows fall into a cell of CELL rows.

    The number follows the path of a tree from all cells to this one: each node deals its
    draws to its halves by a binomial draw of its own seed. So the cells of a replicate share
    out exactly ``n`` draws, and a cell takes as many steps as the tree has levels.
    """
    low, high, count = 0, -(-n // CELL), n
    while high - low > 1:
        middle = (low + high) // 2
        left, all_ = (middle - low) * CELL, min(high * CELL, n) - low * CELL
        dealt = int(np.random.Generator(np.random.Philox(key=seed_of(seed, replicate, low, high))).binomial(count, left / all_))
        low, high, count = (low, middle, dealt) if cell < middle else (middle, high, count - dealt)
    return count


def drawn(count: int, size: int, seed: int, replicate: int, cell: int) -> np.ndarray:
    """``count`` draws from ``size`` places: SplitMix64 with a seed for the replicate and the cell."""
    z = np.uint64(seed_of(seed, replicate, cell)) + np.arange(1, count + 1, dtype=np.uint64) * np.uint64(GOLDEN)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def _drawn_sums(n: int, n_samples: int, seed: int, share: int = DRAWN_REPLICATES):
    """The same for draws with replacement, over the rows of one cell."""
    def sums(rows):
        import pandas as pd

        cell = int(rows["_cell"].iloc[0])
        values = np.zeros((min(CELL, n - cell * CELL), len(rows.columns) - 2))
        at = rows["_row"].to_numpy() - cell * CELL
        values[at, 0] = 1
        values[at, 1:] = rows.iloc[:, 3:].to_numpy()
        out, low = [], int(rows["_part"].iloc[0]) * share
        for b in range(low, min(n_samples, low + share)):
            draws = drawn(draws_of_cell(n, cell, seed, b), len(values), seed, b, cell)
            out.append([b, *(np.bincount(draws, minlength=len(values)) @ values)])
        return pd.DataFrame(out, columns=["replicate", *(f"s{i}" for i in range(values.shape[1]))])

    return sums


def replicate_means(scores: DataFrame, types: Sequence[str], key: str | Column, n_samples: int,
                    seed: int, method: str) -> DataFrame:
    """One row per replicate with the mean of every part of every type.

    ``poisson`` weights every row independently, in one pass that answers with one row per
    task and replicate. ``exact`` draws as many rows as there are, with replacement: a task
    draws for its own cell of rows alone, so the work is rows times replicates, shared out.
    """
    names = [f"{t}_{p}" for t in types for p in PARTS]
    columns = [F.col(t)[p].alias(f"{t}_{p}") for t in types for p in PARTS]
    schema = ", ".join(["replicate long", *(f"s{i} double" for i in range(len(names) + 1))])
    if method == "poisson":
        row = F.conv(F.substring(hash_key(key, seed), 1, 8), 16, 10).cast("long") % PRIME
        partial = scores.select(row.alias("_row"), *columns).mapInArrow(
            _weighted_sums(n_samples, seed), schema)
    else:
        kept = scores.select(key, *columns)
        n = kept.count()
        # Rows are copied for each share of the replicates: as often as keeps DRAWING_TASKS busy.
        share = max(DRAWN_REPLICATES, -(-n_samples * -(-n // CELL) // DRAWING_TASKS))
        ranked = rank_in_order(kept, [], [key], "_row", dear=True).select(
            F.floor(F.col("_row") / CELL).alias("_cell"),
            F.explode(F.sequence(F.lit(0), F.lit((n_samples - 1) // share))).alias("_part"),
            "_row", *names)
        # Ranks may come from one task and drawing is heavy for its bytes, so the tasks are numbered here.
        tasks = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        partial = ranked.repartition(tasks, "_cell", "_part").groupBy("_cell", "_part").applyInPandas(
            _drawn_sums(n, n_samples, seed, share), schema)
    whole = partial.groupBy("replicate").agg(*[
        F.sum(f"s{i}").alias(f"s{i}") for i in range(len(names) + 1)])
    return whole.where("s0 > 0").select("replicate", *[
        (F.col(f"s{i + 1}") / F.col("s0")).alias(name) for i, name in enumerate(names)])


def bootstrap(scores: DataFrame, types: Sequence[str], key: str, confidence: float = 0.95,
              n_samples: int = 1000, seed: int = 0, method: str = "poisson") -> DataFrame:
    """``score_type`` with structs ``low``, ``mid`` and ``high`` of mean scores.

    ``mid`` is the median of the resampled means. ``method`` is "poisson", one pass over the
    scores, or "exact", which draws with replacement and ranks them first. The size of the table
    never changes the method.
    """
    if not 0 <= confidence <= 1:
        raise ValueError(f"confidence {confidence} is not a share")
    if n_samples < 1:
        raise ValueError("at least one replicate is needed")
    if method not in METHODS:
        raise ValueError(f"method is one of {', '.join(METHODS)}")
    means = replicate_means(scores, types, key, n_samples, seed, method)
    delta = (1 - confidence) / 2
    points = F.array(F.lit(delta), F.lit(0.5), F.lit(1 - delta))
    bounds = means.agg(*[F.percentile(f"{t}_{p}", points).alias(f"{t}_{p}")
                         for t in types for p in PARTS])

    def interval(t: str, i: int) -> Column:
        return F.struct(*[F.col(f"{t}_{p}")[i].alias(p) for p in PARTS])

    rows = [F.struct(F.lit(t).alias("score_type"), interval(t, 0).alias("low"),
                     interval(t, 1).alias("mid"), interval(t, 2).alias("high")) for t in types]
    return bounds.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
