"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Equal texts form a group. A group with over 1/LOTS of all bytes, tokens or rows is a vector of
its own; the light rest is gathered into lots by the hash of the text. These vectors, at most
4 * LOTS whatever the size of the corpus, are placed on the driver: largest first, each on the
shard where its dot product with the residual capacity is highest. All rows of a group share a
shard. Only a group that is larger than a whole shard is cut, by the hash of its row keys.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm.common import free_name, query, saved, table
from corpusforge.operators.ordered import SLICE, running_total

LOTS = 1 << 14
PIECES = 1 << 12  # a group that is cut goes to pieces of 1/PIECES of all
ROWS_PER_WINDOW = 1 << 16
SLACK = 0.002
DIMENSIONS = ("bytes", "tokens", "rows")


def place(lots: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each lot (rows: bytes, tokens, rows).

    Vectors are scaled by the whole, so each shard starts with a residual of 1/shards in
    every dimension. Lots go in order of their largest share, to one of the shards that they fit
    (but for SLACK of a shard). A lot that fits nowhere goes where the most bytes are free: large
    groups can make an even share of everything impossible, and bytes come first.
    """
    whole = np.maximum(lots.sum(axis=0), 1)
    vectors = lots / whole
    residual = np.full((shards, lots.shape[1]), 1 / shards)
    chosen = np.zeros(len(lots), np.int64)
    for lot in np.argsort(-vectors.max(axis=1), kind="stable"):
        fits = (residual + SLACK / shards >= vectors[lot]).all(axis=1)
        best = int(np.argmax(np.where(fits, residual @ vectors[lot], -np.inf) if fits.any() else residual[:, 0]))
        chosen[lot] = best
        residual[best] -= vectors[lot]
    return chosen


def assign_shards(docs: DataFrame, shards: int, size: Column, key: Sequence[str] = ("doc_id",),
                  text: str = "text", lots: int = LOTS) -> DataFrame:
    """Columns ``key`` with size, tokens, text_crc32, shard and slot (gapless from 0 per shard).

    A null text weighs as an empty one and forms a group with it; repeated rows are rows of
    their own; an empty table gives no rows. Other columns are not returned. Slots follow
    the lots of a shard; the rows of a lot are numbered by as many tasks as their number asks for.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = saved(docs.select(
        *key, size.cast("long").alias("size"),
        F.regexp_count(body, F.lit(r"\S+")).cast("long").alias("tokens"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("group"), F.xxhash64(*key).alias("spread")))
    totals = {"bytes": F.sum("size"), "tokens": F.sum("tokens"), "rows": F.count("*")}
    sums = [total.cast("double").alias(name) for name, total in totals.items()]
    whole = narrow.agg(*sums).first()
    share = F.greatest(*[F.col(d) / max(1.0, whole[d] or 0) for d in DIMENSIONS])
    # At most 3 * lots groups are that heavy, so this side may be broadcast.
    heavy = narrow.groupBy("group").agg(*sums).where(share * lots > 1).select(
        "group", F.when(share * shards > 1, F.ceil(share * PIECES)).otherwise(1).cast("long").alias("pieces"))
    known = narrow.join(F.broadcast(heavy), "group", "left")
    # A heavy group has a lot of its own, named by its hash; a cut one has one for each piece.
    own = F.when(F.col("pieces") > 1, F.xxhash64("group", F.pmod("spread", F.col("pieces")))).otherwise(F.col("group"))
    lot = F.struct(F.col("pieces").isNotNull().alias("heavy"),
                   F.coalesce(F.when(F.col("pieces").isNotNull(), own), F.pmod(F.xxhash64("group"), F.lit(lots))).alias("name"))
    spread = known.withColumn("lot", lot)
    sizes = spread.groupBy("lot").agg(*sums).select("lot.*", *DIMENSIONS).toArrow()  # a few times ``lots`` rows
    numbers = np.column_stack([sizes.column(d).to_numpy() for d in DIMENSIONS]).reshape(-1, len(DIMENSIONS))
    names = list(zip(sizes.column("heavy").to_pylist(), sizes.column("name").to_pylist()))
    placed = place(numbers, shards)
    rows, at = [], [0] * shards
    for i in sorted(range(len(names)), key=lambda i: (placed[i], names[i])):
        n = int(numbers[i, DIMENSIONS.index("rows")])
        rows.append((names[i], int(placed[i]), at[placed[i]], -(-n // ROWS_PER_WINDOW)))
        at[placed[i]] += n
    plan = docs.sparkSession.createDataFrame(rows, "lot struct<heavy: boolean, name: long>, shard int, first long, parts long")
    part, inside = (free_name(docs, n) for n in ("part", "inside"))
    dealt = spread.join(F.broadcast(plan), "lot").withColumn(part, F.pmod("spread", F.col("parts")))
    order = [part, *key, "text_crc32", "size"]
    ranked = running_total(dealt, ["lot"], order, F.lit(1).cast("long"), inside, F.col(part))
    return ranked.select(*key, "size", "tokens", "text_crc32", "shard",
                         (F.col("first") + F.col(inside)).cast("long").alias("slot")).drop(SLICE)


SHARDS = 8


@query("op5_vector_shards")
def vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    return assign_shards(docs, SHARDS, size).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "tokens")
