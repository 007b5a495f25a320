"""Training tasks as data: from rows with texts to padded examples in one plan.

A task names what happens to its rows: steps of its own, a template, an encoder for
some columns, the shape of the example with its masks, a filter, padding. ``prepare``
makes one DataFrame of it, so Catalyst sees the whole way and reads only the columns
a task needs; the encoder is the one Arrow step in it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.binding import let
from corpusforge.functions.templates import apply_template
from corpusforge.functions.tokens import ignored, ones, truncate
from corpusforge.operators import examples as E
from corpusforge.operators.dialog import split_utterances
from corpusforge.operators.schema import has_supervision
from corpusforge.operators.spans import label_tokens, word_offsets

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Encoder:
    """Words of a text, one id for each of them, and the ids with a meaning."""

    words: Callable[[Column], Column]
    lookup: Callable[[Column], Column]
    eos: int
    pad: int

    def ids(self, text: str | Column) -> Column:
        return self.lookup(self.words(F.col(text) if isinstance(text, str) else text))


@dataclass(frozen=True)
class Task:
    """``shape`` is one of SHAPES; ``texts`` are the columns it encodes, in its order.

    ``steps`` run first (joins, filters, columns of one's own), then the ``template``
    with its ``fields``. ``keep`` are filters on the finished example, before padding.
    ``label`` is the class column of a classification, ``spans`` the array of
    {begin, end, prob} of token labels, ``marks`` the speakers' marks of a dialogue, of
    which ``bot`` is the one that is learned.
    """

    shape: str
    texts: tuple[str, ...] = ("text",)
    steps: tuple[Step, ...] = ()
    template: str | None = None
    fields: Mapping[str, str | Column] = field(default_factory=dict)
    max_length: int = 1024
    answer_length: int = 256
    multiple: int | None = 8
    cut_side: str = "right"
    pad_side: str = "right"
    label: str = "label"
    spans: str = "spans"
    marks: tuple[str, ...] = ()
    bot: str = "<bot>"
    keep: tuple[Step, ...] = ()

    def __post_init__(self) -> None:
        if self.shape not in SHAPES:
            raise ValueError(f"no shape {self.shape!r}: one of {', '.join(SHAPES)}")


def _causal(df: DataFrame, task: Task, encoder: Encoder) -> DataFrame:
    return E.causal_example(df.withColumn("_ids", encoder.ids(task.texts[0])), "_ids", task.max_length).drop("_ids")


def _prompt(df: DataFrame, task: Task, encoder: Encoder) -> DataFrame:
    prompt, answer = task.texts
    both = df.withColumns({"_p": encoder.ids(prompt), "_a": encoder.ids(answer)})
    return E.mask_prompt(both, task.max_length, "_p", "_a", encoder.eos, task.cut_side).drop("_p", "_a")


def _turns(df: DataFrame, task: Task, encoder: Encoder) -> DataFrame:
    """Utterances are encoded as one array of words and cut apart again by their sizes."""
    parts = df.withColumn("_u", split_utterances(F.col(task.texts[0]), list(task.marks)))
    words = parts.withColumn("_w", F.transform("_u", encoder.words))
    flat = words.withColumn("_flat", encoder.lookup(F.flatten("_w")))
    # Bound by ``let``: as a column of its own Spark would put the sums into the function below.
    ends = F.aggregate(F.transform("_w", F.size), F.array(F.lit(0)), lambda sums, n: F.concat(
        sums, F.array(F.element_at(sums, -1) + n)))
    cut = flat.withColumn("_ids", let(ends, lambda e: F.transform(
        F.col("_w"), lambda w, i: F.slice("_flat", F.get(e, i) + 1, F.size(w)))))
    rows = E.mask_turns(cut, "_u", "_ids", task.bot, task.max_length, encoder.eos)
    return has_supervision(rows).drop("_u", "_w", "_flat", "_ids")


def _classes(df: DataFrame, task: Task, encoder: Encoder) -> DataFrame:
    ids = df.withColumn("_ids", encoder.ids(task.texts[0]))
    return E.classification_example(ids, "_ids", task.label, task.max_length, "class_labels").drop("_ids")


def _token_labels(df: DataFrame, task: Task, encoder: Encoder) -> DataFrame:
    """One label per word; words by white space, as the offsets have them."""
    text, none = task.texts[0], F.array().cast(df.schema[task.spans].dataType)
    placed = df.withColumns({"_ids": encoder.ids(text), "_places": word_offsets(text)})
    labels = label_tokens(F.col("_places"), F.coalesce(task.spans, none))
    ids = truncate(F.col("_ids"), task.max_length)
    return placed.withColumns({
        "input_ids": ids, "attention_mask": ones(ids), "labels": truncate(labels, task.max_length),
    }).drop("_ids", "_places")


def _pairs(df: DataFrame, task: Task, encoder: Encoder) -> DataFrame:
    def side(text: str) -> Column:
        ids = truncate(encoder.ids(text), task.max_length, task.cut_side)
        return F.struct(ids.alias("input_ids"), ones(ids).alias("attention_mask"))

    chosen, rejected = task.texts
    return df.withColumns({"chosen": side(chosen), "rejected": side(rejected)})


def _ranked(df: DataFrame, task: Task, encoder: Encoder) -> DataFrame:
    prompt, chosen, rejected = task.texts
    asked = df.withColumn("_p", truncate(encoder.ids(prompt), task.max_length, task.cut_side))

    def side(text: str) -> Column:
        answer = truncate(encoder.ids(text), task.answer_length)
        return F.struct(F.col("_p").alias("input_ids"), ones(F.col("_p")).alias("attention_mask"),
                        answer.alias("decoder_input_ids"), ones(answer).alias("decoder_attention_mask"))

    return asked.withColumns({"chosen": side(chosen), "rejected": side(rejected)}).drop("_p")


def _pad_rows(df: DataFrame, task: Task, encoder: Encoder) -> DataFrame:
    return E.pad_examples(df, task.max_length, task.multiple, task.pad_side, encoder.pad)


def _pad_pairs(df: DataFrame, task: Task, encoder: Encoder) -> DataFrame:
    return E.pad_pairs(df, task.max_length, task.multiple, task.pad_side, encoder.pad)


def _pad_ranked(df: DataFrame, task: Task, encoder: Encoder) -> DataFrame:
    return E.pad_seq2seq(df, task.max_length, task.answer_length, task.multiple, task.pad_side, encoder.pad)


SHAPES = {
    "causal": (_causal, _pad_rows),
    "prompt": (_prompt, _pad_rows),
    "turns": (_turns, _pad_rows),
    "classes": (_classes, _pad_rows),
    "token_labels": (_token_labels, _pad_rows),
    "pairs": (_pairs, _pad_pairs),
    "ranked": (_ranked, _pad_ranked),
}


def prepare(df: DataFrame, task: Task, encoder: Encoder) -> DataFrame:
    """Rows of ``df`` as padded examples of ``task``; other columns stay.

    A null text has no ids: its arrays are padding alone.
    """
    for step in task.steps:
        df = df.transform(step)
    if task.template:
        # Marks of a text's ends are words of their own for the encoder.
        df = apply_template(df, task.template, task.fields, eos=" </s>", bos="<s> ")
    df = df.withColumns({t: F.coalesce(t, F.lit("")) for t in task.texts})
    encode, padded = SHAPES[task.shape]
    df = encode(df, task, encoder)
    for step in task.keep:
        df = df.transform(step)
    return padded(df, task, encoder)
