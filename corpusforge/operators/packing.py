"""Packing documents into fixed-size token blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.operators.dialog import marked_dialog
from corpusforge.operators.ordered import SLICE, running_total, sliced
from corpusforge.operators.schema import min_chars
from corpusforge.values import BLOCK_SIZE


def cut_pieces(placed: DataFrame, source: str, block_size: int) -> DataFrame:
    """Cut documents with their place ``_start`` in the stream at block borders.

    The pieces are made as one small array per document, so opening it copies no ids.
    """
    start, size = F.col("_start"), F.size("_ids")

    def piece(block):
        begin = F.greatest(block * block_size - start, F.lit(0)).cast("int")
        end = F.least((block + 1) * block_size - start, size.cast("long")).cast("int")
        return F.struct(
            block.alias("block"),
            F.struct((start + begin).alias("at"),
                     F.slice("_ids", begin + 1, end - begin).alias("ids")).alias("piece"))

    blocks = F.sequence(F.floor(start / block_size), F.floor((start + size - 1) / block_size))
    return (
        placed.where(size > 0)
        .select(source, SLICE, F.explode(F.transform(blocks, piece)).alias("_p"))
        .select(source, SLICE, "_p.block", "_p.piece")
    )


def join_pieces(pieces: Column) -> Column:
    """Ids of an array of pieces, in stream order."""
    return F.flatten(F.transform(F.array_sort(pieces), lambda p: p["ids"]))


def gather_pieces(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pieces per block with their total size: at most ``block_size`` ids per row."""
    return pieces.groupBy(*keys).agg(
        F.collect_list("piece").alias("_pieces"), F.sum(F.size("piece.ids")).alias("_size"))


def pack_blocks(df: DataFrame, source: str, order: Sequence[str], ids: str,
                block_size: int = BLOCK_SIZE, bos: int | str | None = None,
                **options: int) -> DataFrame:
    """Cut the concatenated ids of each source into blocks of ``block_size``.

    Documents follow each other in order, each led by ``bos``; the incomplete
    block at the end of a source is dropped. Returns ``source, block, input_ids``.

    The place of a document in its stream is a running total of lengths, so the
    documents are shuffled once, by source and slice of the order. Blocks inside
    a slice are put together there; only the pieces of blocks that reach over a
    slice border are shuffled again. Where a source is large enough to be sliced,
    the ids are written once to the checkpoint folder: sums read the lengths only,
    and an encoder before this runs once.
    """
    kind = df.schema[ids].dataType
    lead = F.array() if bos is None else F.array(F.lit(bos).cast(kind.elementType))
    led = F.concat(lead.cast(kind), F.col(ids))
    docs = df.select(source, *order, led.alias("_ids")).withColumn("_n", F.size("_ids").cast("long"))
    docs = sliced(docs, [source], order, dear=True, **options)
    placed = running_total(docs, [source], order, F.col("_n"), "_start")
    gathered = gather_pieces(cut_pieces(placed, source, block_size), [source, SLICE, "block"])

    def full(blocks: DataFrame) -> DataFrame:
        return blocks.where(F.col("_size") == block_size).select(
            source, "block", join_pieces(F.col("_pieces")).alias("input_ids"))

    if SLICE not in docs.columns:
        return full(gathered)
    borders = (
        gathered.where(F.col("_size") < block_size).groupBy(source, "block")
        .agg(F.flatten(F.collect_list("_pieces")).alias("_pieces"), F.sum("_size").alias("_size"))
    )
    return full(gathered).unionByName(full(borders))


def pack_long_texts(df: DataFrame, source: str, order: Sequence[str], text: str, encode,
                    block_size: int = BLOCK_SIZE, bos: int | str | None = None,
                    min_length: int = 33, **options: int) -> DataFrame:
    """Pack after leaving out texts shorter than ``min_length`` characters.

    ``encode`` maps a text column to an id array column.
    """
    kept = min_chars(df, min_length, text)
    return pack_blocks(kept.withColumn("_tokens", encode(F.col(text))), source, order, "_tokens",
                       block_size, bos, **options)


def pack_dialogs(df: DataFrame, source: str, order: Sequence[str], text: str, encode,
                 eos: str = "</s>", block_size: int = BLOCK_SIZE, bos: int | str | None = None,
                 **options: int) -> DataFrame:
    """Pack dialogues after their speaker marks became tokens."""
    marked = marked_dialog(df, text, eos)
    return pack_blocks(marked.withColumn("_tokens", encode(F.col(text))), source, order,
                       "_tokens", block_size, bos, **options)
