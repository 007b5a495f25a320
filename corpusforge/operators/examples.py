"""Training examples: masks, labels and padding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions.tokens import ignored, ones, pad, padded_length, truncate
from corpusforge.values import IGNORE_LABEL

# Filler of each padded column.
FILLERS = {"input_ids": 0, "attention_mask": 0, "labels": IGNORE_LABEL,
           "decoder_input_ids": 0, "decoder_attention_mask": 0}


def _example(ids: Column, labels: Column | None = None) -> dict[str, Column]:
    columns = {"input_ids": ids, "attention_mask": ones(ids)}
    if labels is not None:
        columns["labels"] = labels
    return columns


def mask_prompt(df: DataFrame, max_length: int, prompt: str = "prompt", answer: str = "answer",
                eos: int | None = None, truncation_side: str = "right") -> DataFrame:
    """Prompt and answer in one sequence, loss on the answer only.

    The answer gets ``eos`` and is cut to ``max_length`` first; what is left for
    the prompt is taken from its start, whatever side the prompt was cut on before.
    """
    target = F.col(answer) if eos is None else F.concat(F.col(answer), F.array(F.lit(eos)))
    sized = df.withColumn("_answer", truncate(target, max_length, truncation_side)).withColumn(
        "_prompt", truncate(F.col(prompt), max_length, truncation_side))
    room = F.lit(max_length) - F.size("_answer")
    cut = sized.withColumn("_prompt", truncate(F.col("_prompt"), room))
    ids = F.concat("_prompt", "_answer")
    labels = F.concat(ignored(F.col("_prompt")), F.col("_answer"))
    return cut.withColumns(_example(ids, labels)).drop("_prompt", "_answer")


def mask_turns(df: DataFrame, utterances: str, ids: str, bot_mark: str, max_length: int,
               eos: int) -> DataFrame:
    """Example of a whole conversation with loss on the bot's utterances only.

    ``utterances`` is an array of texts and ``ids`` the array of their id arrays.
    Each utterance is cut to ``max_length``, bot utterances end with ``eos``, and
    the row is cut to ``max_length`` again.
    """
    def turn(both: Column) -> Column:
        cut = truncate(both["ids"], max_length)
        bot = F.startswith(both["text"], F.lit(bot_mark))
        closed = F.concat(cut, F.array(F.lit(eos)))
        return F.when(bot, F.struct(closed.alias("ids"), closed.alias("labels"))).otherwise(
            F.struct(cut.alias("ids"), ignored(cut).alias("labels")))

    both = F.arrays_zip(F.col(utterances).alias("text"), F.col(ids).alias("ids"))
    turns = df.withColumn("_turns", F.transform(both, turn))

    def row(field: str) -> Column:
        return truncate(F.flatten(F.transform("_turns", lambda t: t[field])), max_length)

    return turns.withColumns(_example(row("ids"), row("labels"))).drop("_turns")


def causal_example(df: DataFrame, ids: str, max_length: int) -> DataFrame:
    """Plain text: the labels are the inputs."""
    cut = truncate(F.col(ids), max_length)
    return df.withColumns(_example(cut, cut))


def classification_example(df: DataFrame, ids: str, label: str, max_length: int,
                           out: str = "label") -> DataFrame:
    cut = truncate(F.col(ids), max_length)
    return df.withColumns({**_example(cut), out: F.col(label)})


def _padded(col: Column, name: str, length: int | Column, side: str, pad_id: int) -> Column:
    value = pad_id if name.endswith("input_ids") else FILLERS[name]
    return pad(col, length, value, side)


def pad_examples(df: DataFrame, max_length: int | None = None, multiple: int | None = 8,
                 side: str = "right", pad_id: int = 0, batch: Sequence[str] = (),
                 columns: Sequence[str] = ("input_ids", "attention_mask", "labels")) -> DataFrame:
    """Pad the arrays to ``max_length`` rounded up to ``multiple``.

    Without ``max_length`` the longest row of the ``batch`` (key columns) counts;
    a batch has a fixed number of rows, so that window stays small.
    """
    present = [c for c in columns if c in df.columns]
    if max_length is not None:
        length = padded_length(max_length, multiple)
    else:
        longest = F.max(F.greatest(*[F.size(c) for c in present], F.lit(0)))
        df = df.withColumn("_longest", longest.over(Window.partitionBy(*batch)))
        length = padded_length(F.col("_longest"), multiple)
    return df.withColumns({
        c: _padded(F.col(c), c, length, side, pad_id) for c in present
    }).drop("_longest")


def _pad_struct(col: str, lengths: dict[str, int | Column], side: str, pad_id: int) -> Column:
    return F.struct(*[
        _padded(F.col(col)[name], name, length, side, pad_id).alias(name)
        for name, length in lengths.items()
    ]).alias(col)


def pad_pairs(df: DataFrame, max_length: int, multiple: int | None = 8, side: str = "right",
              pad_id: int = 0) -> DataFrame:
    """Pad the structs ``chosen`` and ``rejected`` alike."""
    n = padded_length(max_length, multiple)
    lengths = {"input_ids": n, "attention_mask": n}
    return df.withColumns({c: _pad_struct(c, lengths, side, pad_id)
                           for c in ("chosen", "rejected")})


def pad_seq2seq(df: DataFrame, max_length: int, decoder_max_length: int,
                multiple: int | None = 8, side: str = "right", pad_id: int = 0) -> DataFrame:
    """Pad encoder and decoder parts of both answers to lengths of their own."""
    n, d = padded_length(max_length, multiple), padded_length(decoder_max_length, multiple)
    lengths = {"input_ids": n, "attention_mask": n,
               "decoder_input_ids": d, "decoder_attention_mask": d}
    return df.withColumns({c: _pad_struct(c, lengths, side, pad_id)
                           for c in ("chosen", "rejected")})
