"""Labelling tokens by character spans."""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.functions.batches import by_slices
from corpusforge.functions.binding import let
from corpusforge.operators.ordered import running_totals, sliced

WORD = re.compile(r"\S+")
OFFSETS = T.ArrayType(T.StructType([
    T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@F.arrow_udf(OFFSETS)
def word_offsets(texts: pa.Array) -> pa.Array:
    """Character offsets of the white space words of a text; ``end`` is exclusive."""
    return by_slices(_offsets, texts)


def _offsets(texts: pa.Array) -> pa.Array:
    begins, ends, borders = array("i"), array("i"), array("i", [0])
    for text in texts.to_pylist():
        for match in WORD.finditer(text or ""):
            begins.append(match.start())
            ends.append(match.end())
        borders.append(len(begins))
    words = pa.StructArray.from_arrays(
        [pa.array(np.array(places, np.int32)) for places in (begins, ends)], names=["begin", "end"])
    return pa.ListArray.from_arrays(pa.array(np.array(borders, np.int32)), words)


def label_tokens(tokens: Column, spans: Column, threshold: float = 0.5) -> Column:
    """1 for each token that touches a likely span of the same row, else 0.

    ``tokens`` are ``{begin, end}``, ``spans`` are ``{begin, end, prob}``. Both ends
    count, so a token starting where a span ends is labelled.
    """
    return let(F.filter(spans, lambda s: s["prob"] >= threshold), lambda likely: F.transform(
        tokens, lambda t: F.exists(likely, lambda s: (
            t["end"] >= s["begin"]) & (t["begin"] <= s["end"])).cast("int")))


def label_spans(tokens: DataFrame, spans: DataFrame, doc: str = "doc_id",
                threshold: float = 0.5, rows_per_slice: int | None = None) -> DataFrame:
    """The same with the spans in a table of their own.

    ``tokens``: ``doc, pos, begin, end``; ``spans``: ``doc, begin, end, prob``. A sweep over
    the places of a document: spans stand at their begin, tokens at their end, and the
    furthest end of the spans before a token says whether one of them touches it. A span is
    one row, however long, and those with one begin are reduced before they move, so
    a document has no more rows than tokens and characters. One shuffle, no join. A span
    that ends before it begins touches the tokens that reach over all of it. Tokens without
    a place or a document are labelled 0.

    ``rows_per_slice`` is for documents that are no single text: those with more rows are
    swept in slices that carry the furthest end on.
    """
    likely = (
        spans.where((F.col("prob") >= threshold) & F.col(doc).isNotNull() & F.col("begin").isNotNull())
        .groupBy(doc, F.col("begin").alias("_at")).agg(F.max("end").alias("_reach"))
    )
    # Sizes of tokens are few, so they take less of the shuffle than their begins.
    size = (F.col("end").cast("long") - F.col("begin")).alias("_size")
    places = tokens.select(doc, "pos", size, F.col("end").alias("_at"), F.lit(True).alias("_token"))
    line = places.unionByName(likely.withColumn("_token", F.lit(False)), allowMissingColumns=True)
    order = ["_at", "_token"]
    if rows_per_slice:
        line = sliced(line, [doc], order, rows_per_slice, dear=True)
    swept = running_totals(line, [doc], order, {"_furthest": F.col("_reach")}, aggregate=F.max, start=None)
    touched = F.coalesce(F.col("_furthest") >= F.col("_at") - F.col("_size"), F.lit(False))
    return swept.where("_token").select(doc, "pos", touched.cast("int").alias("label"))
