"""Splits, sampling, mixing and batches.

Random order is the order of a seeded hash of the row key: runs agree, retried
tasks agree, and no row carries a random number of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.operators.ordered import first_in_order, hash_key, hash_rank, rank_in_order

COPIES_PER_CHUNK = 10_000


def train_test_split(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """Add ``split``: the first ``ceil(fraction * n)`` rows in hash order are ``test``."""
    n = df.count()
    tests = -int(-(n * fraction) // 1)
    ranked = hash_rank(df, key, seed, "_rank")
    return ranked.withColumn(
        "split", F.when(F.col("_rank") < tests, "test").otherwise("train")).drop("_rank")


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The first ``n`` rows in hash order; ``key`` is unique."""
    hashed = df.withColumn("_hash", hash_key(key, seed))
    return first_in_order(hashed, ["_hash", key], n).drop("_hash")


def head(df: DataFrame, n: int, order: Sequence[str], **options: int) -> DataFrame:
    """The first ``n`` rows in natural order; ``order`` tells all rows apart."""
    return first_in_order(df, order, n, **options)


def limit_items(df: DataFrame, n: int | None, order_by: Sequence[str], **options: int) -> DataFrame:
    """Cap on the rows of an output; None means no cap."""
    return df if n is None else head(df, n, order_by, **options)


def head_percent(df: DataFrame, percent: float, order: Sequence[str], **options: int) -> DataFrame:
    """The leading ``percent`` of the rows, the count rounded to the nearest row."""
    n = int(df.count() * percent / 100 + 0.5)
    return head(df, n, order, **options)


def concat_sources(dfs: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def _repeated(ranked: DataFrame, rank: str, size: str, limit: str, out: str,
              most: float) -> DataFrame:
    """Repeat row ``rank`` of ``size`` at ``rank, rank + size, ..`` below ``limit``.

    ``most`` is the highest ``limit / size``. Where a short source beside a long one
    repeats very often, its copies are made in chunks that are spread over the
    tasks before they are opened.
    """
    copies = F.ceil((F.col(limit) - F.col(rank)) / F.col(size))
    chunks = ranked.withColumn("_copies", copies).where(F.col("_copies") > 0).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("long"),
                                       F.floor((F.col("_copies") - 1) / COPIES_PER_CHUNK))))
    if most > COPIES_PER_CHUNK:
        chunks = chunks.repartition("_chunk", rank)
    low = F.col("_chunk") * COPIES_PER_CHUNK
    high = F.least(F.col("_copies"), low + COPIES_PER_CHUNK) - 1
    return (
        chunks.withColumn("_copy", F.explode(F.sequence(low, high)))
        .withColumn(out, F.col(rank) + F.col("_copy") * F.col(size))
        .drop("_copies", "_chunk", "_copy")
    )


def interleave(df: DataFrame, source: str, order: Sequence[str], **options: int) -> DataFrame:
    """Take sources in turn until all are exhausted; short ones start again.

    Adds ``position``, the place in the mixed sequence. Sources take turns in the
    order of their names. Sort by ``position`` to write the sequence out.
    """
    sizes = df.groupBy(source).agg(F.count("*").alias("_size"))
    longest = F.max("_size").over(Window.partitionBy())
    counts = F.count("*").over(Window.partitionBy())
    turns = sizes.select(
        source, "_size", longest.alias("_longest"), counts.alias("_sources"),
        (F.row_number().over(Window.orderBy(source)) - 1).alias("_turn"))
    ranked = rank_in_order(df, [source], order, "_rank", **options)
    most = turns.agg(F.max(F.col("_longest") / F.col("_size"))).first()[0] or 0
    rounds = _repeated(ranked.join(turns, source), "_rank", "_size", "_longest", "_round", most)
    return rounds.withColumn(
        "position", F.col("_round") * F.col("_sources") + F.col("_turn")
    ).drop("_size", "_longest", "_sources", "_turn", "_rank", "_round")


def normalize_weights(df: DataFrame, weight: str = "weight") -> DataFrame:
    """Weights of the sources (one row each) as shares that sum to 1."""
    return df.withColumn(weight, F.col(weight) / F.sum(weight).over(Window.partitionBy()))


def source_weights(df: DataFrame, source: str, size: Column | None = None) -> DataFrame:
    """Share of each source in the total size (rows by default)."""
    total = F.count("*") if size is None else F.sum(size)
    return normalize_weights(df.groupBy(source).agg(total.alias("weight")))


def weighted_mix(df: DataFrame, source: str, key: str, weights: DataFrame, n: int,
                 seed: int = 42) -> DataFrame:
    """Draw ``n`` rows, from each source in proportion to its weight.

    Quotas are ``weight * n`` by largest remainder (names break ties). Rows come in
    hash order and start again when a source is exhausted. Adds ``draw``, the
    number of the draw within its source. ``weights`` has one row per source.
    """
    everything = Window.partitionBy()
    exact = F.col("weight") * n
    shares = weights.select(
        source, F.floor(exact).alias("_floor"),
        F.round(exact - F.floor(exact), 9).alias("_rest"))
    missing = F.lit(n) - F.sum("_floor").over(everything)
    place = F.row_number().over(Window.orderBy(F.desc("_rest"), source))
    quotas = shares.select(
        source, (F.col("_floor") + F.when(place <= missing, 1).otherwise(0)).alias("_quota"))
    sizes = df.groupBy(source).agg(F.count("*").alias("_size"))
    plan = sizes.join(quotas, source)
    ranked = hash_rank(df, key, seed, "_rank", [source])
    most = plan.agg(F.max(F.col("_quota") / F.col("_size"))).first()[0] or 0
    return _repeated(ranked.join(plan, source), "_rank", "_size", "_quota", "draw", most).drop(
        "_rank", "_size", "_quota")


def train_batches(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """Add ``batch`` and ``place`` in shuffled order; the incomplete batch is dropped."""
    full = df.count() // size
    ranked = hash_rank(df, key, seed, "_rank")
    return (
        ranked.withColumn("batch", F.floor(F.col("_rank") / size))
        .withColumn("place", (F.col("_rank") % size).cast("int"))
        .where(F.col("batch") < full)
        .drop("_rank")
    )


def eval_batches(df: DataFrame, order: Sequence[str], size: int, **options: int) -> DataFrame:
    """Add ``batch``: ``ceil(n / size)`` batches in natural order, the first ones larger by one."""
    n = df.count()
    batches = max(-(-n // size), 1)
    small, larger = divmod(n, batches)
    ranked = rank_in_order(df, [], order, "_rank", **options)
    border = larger * (small + 1)
    batch = F.when(F.col("_rank") < border, F.floor(F.col("_rank") / (small + 1))).otherwise(
        larger + F.floor((F.col("_rank") - border) / max(small, 1)))
    return ranked.withColumn("batch", batch).drop("_rank")


def step_budget(df: DataFrame, batch_size: int, accumulation: int = 1, epochs: int = 1) -> DataFrame:
    """Steps of a run: fractional steps per epoch cut after multiplying, and whole ones."""
    n = F.col("examples")
    per_epoch = n / (batch_size * accumulation)
    return df.agg(F.count("*").alias("examples")).select(
        "examples",
        per_epoch.alias("steps_per_epoch"),
        F.floor(epochs * per_epoch).alias("total_steps"),
        F.floor(n / batch_size).alias("full_batches"),
        (F.floor(n / batch_size) * epochs).alias("total_full_batches"),
    )
