"""Ranks and running totals over groups of any size.

A plain window sends every row of a group to one task, which fails when a group
holds a third of a large table. Groups of up to ``ROWS_PER_SLICE`` rows take that
way, one shuffle, however many there are. Where a group is larger, the rows are
range partitioned by group and order, and each partition is a slice: a prefix scan.
Each slice is summed first (map-side combine), the small table of slice sums
gives every slice its starting value, and one window per (group, slice) does the
rest. The starting value travels as a head row of its slice, so no join is
needed and null keys stay together. Borders of slices are Spark's own affair: nothing
about them is collected, and no plan grows with their number.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.session import stored

ROWS_PER_SLICE = 1 << 18
FEWEST_ROWS = 1 << 16  # a head of so many rows is cut from the smallest of each task
SLICE = "_slice"


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str],
           rows_per_slice: int = ROWS_PER_SLICE, dear: bool = False) -> DataFrame:
    """``df`` with the slice of each row in ``_slice``, or as it is where no group is large.

    Reads the key columns once for the sizes of the groups. With a group of over
    ``rows_per_slice`` rows the table is written once, range partitioned into parts of
    about that many rows: which rows share a part then never changes, and what made the
    rows does not run again. Equal places in the order are in one slice. Range partitioning
    looks at the rows twice; ``dear`` ones are stored before, so that they are made once.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.max("_n").alias("most"), F.sum("_n").alias("rows")).first()
    if (sizes["most"] or 0) <= rows_per_slice:
        return df
    parts = -(-sizes["rows"] // rows_per_slice)
    df = stored(df) if dear else df
    return stored(df.repartitionByRange(parts, *keys, *order).withColumn(SLICE, F.spark_partition_id()))


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                   values: dict[str, Column], slices: Column | None = None,
                   aggregate: Callable[[Column], Column] = F.sum, start: int | None = 0) -> DataFrame:
    """Add one column per entry of ``values``: its sum over the earlier rows of the group.

    ``aggregate`` can be another one that may be taken in parts, such as ``F.max``; ``start`` is
    its value of no rows.

    Rows that ``sliced`` has dealt out keep their slices; ``slices`` can name others, by any
    column that never falls as the order rises. Otherwise the whole group is one slice.
    The slice stays in the result as ``_slice``.
    """
    inner = {name: f"_value_{name}" for name in values}
    source = df.withColumns({inner[name]: value for name, value in values.items()})
    drop = [*inner.values(), "_head"]
    if slices is None and SLICE not in df.columns:
        before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(
            Window.unboundedPreceding, -1)
        return source.withColumns({
            name: F.coalesce(aggregate(F.col(col)).over(before), F.lit(start)) for name, col in inner.items()
        }).withColumn(SLICE, F.lit(0)).drop(*drop)

    rows = source if slices is None else source.withColumn(SLICE, slices)
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, SLICE).agg(*[aggregate(F.col(c)).alias(c) for c in inner.values()])
    heads = sums.select(
        *keys, SLICE, F.lit(True).alias("_head"),
        *[F.coalesce(aggregate(F.col(c)).over(earlier), F.lit(start)).alias(c) for c in inner.values()],
    )
    before = Window.partitionBy(*keys, SLICE).orderBy(F.desc("_head"), *order).rowsBetween(
        Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_head", F.lit(False))
        .unionByName(heads, allowMissingColumns=True)
        .withColumns({name: aggregate(F.col(col)).over(before) for name, col in inner.items()})
        .where(~F.col("_head"))
        .drop(*drop)
    )


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column,
                  out: str, slices: Column | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one in its group."""
    return running_totals(df, keys, order, {out: value}, slices)


def previous_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str) -> DataFrame:
    """Add ``out``: a struct with field ``value`` of the row before, null for the first row.

    Slices of ``sliced`` are followed and stay in the result.
    """
    source = df.withColumn("_value", F.struct(value.alias("value")))
    if SLICE not in df.columns:
        before = Window.partitionBy(*keys).orderBy(*order)
        return source.withColumn(out, F.lag("_value").over(before)).drop("_value")

    last = source.groupBy(*keys, SLICE).agg(F.max_by("_value", F.struct(*order)).alias("_value"))
    heads = (
        last.withColumn("_value", F.lag("_value").over(Window.partitionBy(*keys).orderBy(SLICE)))
        .where(F.col("_value").isNotNull())
        .withColumn("_head", F.lit(True))
    )
    before = Window.partitionBy(*keys, SLICE).orderBy(F.desc("_head"), *order)
    return (
        source.withColumn("_head", F.lit(False))
        .unionByName(heads, allowMissingColumns=True)
        .withColumn(out, F.lag("_value").over(before))
        .where(~F.col("_head"))
        .drop("_value", "_head")
    )


def rank_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "rank",
                  **options: int) -> DataFrame:
    """Add ``out``: the position of the row in its group, from 0."""
    return running_total(sliced(df, keys, order, **options), keys, order, F.lit(1).cast(T.LongType()), out).drop(SLICE)


def hash_key(key: str | Column, seed: int) -> Column:
    """Seeded sort key of a shuffle. Runs and engines agree on it."""
    column = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(str(seed)), column.cast("string")).cast("binary"))


def hash_rank(df: DataFrame, key: str, seed: int, out: str = "rank", keys: Sequence[str] = (),
              rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Add ``out``: position from 0 in the seeded hash order of ``key``.

    Hash values are uniform, so their leading hex digits cut any table into equal
    slices: as many digits as the number of rows asks for.
    """
    digits, rows = 0, df.select(key).count()
    while rows > rows_per_slice << 4 * digits:
        digits += 1
    hashed = df.withColumn("_hash", hash_key(key, seed))
    slices = F.substring("_hash", 1, digits) if digits else None
    ranked = running_total(hashed, keys, ["_hash", key], F.lit(1).cast(T.LongType()), out, slices)
    return ranked.drop("_hash", SLICE)


def first_in_order(df: DataFrame, order: Sequence[str], n: int, **options: int) -> DataFrame:
    """The first ``n`` rows in order; ``order`` must tell all rows apart.

    Up to FEWEST_ROWS rows are the first of the first rows of every task, in one pass. For more,
    order columns alone are ranked and one row comes to the driver; the wide rows are filtered
    where they are.
    """
    if n <= FEWEST_ROWS:
        return df.orderBy(*order).limit(max(n, 0))
    ranked = rank_in_order(df.select(*order), [], order, "_rank", **options)
    last = ranked.where(F.col("_rank") == n - 1).select(*order).first()
    if last is None:
        return df
    value = F.struct(*[F.col(c).alias(c) for c in order])
    border = F.struct(*[F.lit(v).cast(ranked.schema[c].dataType).alias(c) for c, v in zip(order, last)])
    return df.where(value <= border)
