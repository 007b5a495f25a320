"""Packing a stream of documents into blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusforge.operators.ordered import running_total, sliced
from corpusforge.operators.packing import cut_pieces, gather_pieces, join_pieces
from corpusforge.values import BLOCK_SIZE


def stream_blocks(docs: DataFrame, block_size: int = BLOCK_SIZE, lanes: int = 1) -> DataFrame:
    """Full blocks of each source as its documents arrive.

    ``docs`` has ``source, doc_id, ids``. The state of a source is the incomplete
    block, fewer than ``block_size`` ids, and the number of blocks emitted. A
    source too busy for one task is dealt over ``lanes`` by document id; each lane
    packs its own documents, in the order of their ids within a micro-batch (which
    ``files_per_trigger`` of the source bounds). Returns ``source, lane, block, input_ids``.
    """
    def pack(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState
             ) -> Iterator[pd.DataFrame]:
        block, rest = state.get if state.exists else (0, [])
        rest, done = list(rest), []
        for ids in pd.concat(frames).sort_values("doc_id")["ids"]:
            rest.extend(int(i) for i in ids)
            full = len(rest) // block_size * block_size
            done += [rest[i:i + block_size] for i in range(0, full, block_size)]
            rest = rest[full:]
        state.update((block + len(done), rest))
        yield pd.DataFrame({
            "source": key[0], "lane": key[1],
            "block": range(block, block + len(done)), "input_ids": done})

    lane = F.pmod(F.xxhash64("doc_id"), F.lit(lanes)).cast("int").alias("lane")
    return (
        docs.select("source", lane, "doc_id", "ids").groupBy("source", "lane")
        .applyInPandasWithState(
            pack, "source string, lane int, block long, input_ids array<int>",
            "block long, rest array<int>", "append", GroupStateTimeout.NoTimeout)
    )


def pack_batch(docs: DataFrame, batch_id: int, out: str, state: str,
               block_size: int = BLOCK_SIZE) -> None:
    """Pack one micro-batch with the batch operators; for ``foreachBatch``.

    The incomplete blocks that batch ``n`` leaves behind are a table below
    ``state`` (fewer than ``block_size`` ids per source) that batch ``n + 1`` reads
    as one more document per source, ahead of the others. Both outputs are written
    under the number of the batch, so a batch that runs again replaces its own
    rows. A source of any size is sliced as in the batch packer.
    """
    spark = docs.sparkSession
    rest_schema = "source string, block long, ids array<int>"
    if batch_id > 0:
        rest = spark.read.schema(rest_schema).parquet(f"{state}/batch={batch_id - 1}")
    else:
        rest = spark.createDataFrame([], rest_schema)
    zero = F.lit(0).cast("long")
    rows = docs.select(
        "source", F.lit(1).alias("_late"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("ids").alias("_ids"), zero.alias("_base"),
    ).unionByName(rest.select(
        "source", F.lit(0).alias("_late"), zero.alias("doc_id"), F.col("ids").alias("_ids"),
        (F.col("block") * block_size).alias("_base"))).persist()
    order = ["_late", "doc_id"]
    placed = running_total(sliced(rows, ["source"], order), ["source"], order, F.size("_ids") + F.col("_base"), "_start")
    placed = placed.withColumn("_start", F.col("_start") + F.col("_base"))
    blocks = gather_pieces(cut_pieces(placed, "source", block_size), ["source", "block"]).select(
        "source", "block", join_pieces(F.col("_pieces")).alias("ids"),
        (F.col("_size") == block_size).alias("full")).persist()
    blocks.where("full").select("source", "block", F.col("ids").alias("input_ids")).write.mode(
        "overwrite").parquet(f"{out}/batch={batch_id}")
    none = F.array().cast("array<int>")
    last = blocks.unionByName(
        rest.select("source", "block", none.alias("ids"), F.lit(False).alias("full"))
    ).groupBy("source").agg(F.max(F.struct(
        "block", F.size("ids").alias("size"), "full", "ids")).alias("b"))
    last.select(
        "source", (F.col("b.block") + F.col("b.full").cast("long")).alias("block"),
        F.when(F.col("b.full"), none).otherwise(F.col("b.ids")).alias("ids"),
    ).write.mode("overwrite").parquet(f"{state}/batch={batch_id}")
    blocks.unpersist()
    rows.unpersist()


def write_blocks(docs: DataFrame, out: str, state: str, checkpoint: str,
                 block_size: int = BLOCK_SIZE, **trigger):
    """Start the query that packs ``docs`` (``source, doc_id, ids``) into ``out``."""
    return (
        docs.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger)
        .foreachBatch(lambda df, n: pack_batch(df, n, out, state, block_size)).start()
    )
