"""Grouping lines and turns into texts.

A result text is one cell: one row per document or conversation, whatever its size.
A group too large for a cell (2 GB) fails in Spark's own check of array and text sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions.binding import let
from corpusforge.functions.text import mark_speakers, speaker_count, trim
from corpusforge.operators.ordered import (
    previous_value,
    running_total,
    running_totals,
    sliced,
)


def _joined(order: Sequence[str], text: str | Column, sep: str) -> Column:
    """Aggregate: texts in order, joined by ``sep``."""
    value = F.col(text) if isinstance(text, str) else text
    rows = F.array_sort(F.collect_list(F.struct(*order, value.alias("_text"))))
    return F.array_join(F.transform(rows, lambda r: r["_text"]), sep)


def assemble_documents(df: DataFrame, doc: str, line: str, text: str, sep: str = "\n") -> DataFrame:
    """Join the lines of each document in the order of ``line``."""
    return df.groupBy(doc).agg(_joined([line], text, sep).alias("text"))


def turn_runs(df: DataFrame, conv: str, order: Sequence[str], speaker: str,
              **options: int) -> DataFrame:
    """Add ``position`` of the turn in its conversation and ``run``, both from 0.

    A run is a stretch of turns of one speaker (gaps and islands).
    """
    seen = previous_value(sliced(df, [conv], order, **options), [conv], order, F.col(speaker), "_before")
    change = F.col("_before").isNull() | ~F.col("_before.value").eqNullSafe(F.col(speaker))
    flagged = seen.withColumn("_change", change.cast("long")).drop("_before")
    counted = running_totals(flagged, [conv], order,
                             {"position": F.lit(1).cast("long"), "run": F.col("_change")})
    return counted.withColumn("run", F.col("run") + F.col("_change") - 1).drop("_change", "_slice")


def merge_runs(df: DataFrame, conv: str, order: Sequence[str], speaker: str, text: str,
               **options: int) -> DataFrame:
    """One row per run: speaker and the texts of its turns joined by a space."""
    runs = turn_runs(df, conv, order, speaker, **options)
    return (
        runs.groupBy(conv, "run")
        .agg(F.min(speaker).alias("speaker"), _joined(["position"], text, " ").alias("text"))
    )


def merge_turns(df: DataFrame, conv: str, order: Sequence[str], speaker: str, text: str,
                **options: int) -> DataFrame:
    """One row per conversation: runs joined by line breaks, and who spoke them."""
    runs = merge_runs(df, conv, order, speaker, text, **options)
    rows = F.array_sort(F.collect_list(F.struct("run", "speaker", "text")))
    return (
        runs.groupBy(conv).agg(rows.alias("_runs"))
        .select(
            conv,
            F.array_join(F.transform("_runs", lambda r: r["text"]), "\n").alias("text"),
            F.transform("_runs", lambda r: r["speaker"]).alias("speakers"),
        )
    )


def index_speakers(df: DataFrame, scope: Sequence[str], order: Sequence[str], speaker: str,
                   out: str = "speaker_index", **options: int) -> DataFrame:
    """Number the speakers of a scope (a file) by their first appearance, from 0."""
    first = df.groupBy(*scope, speaker).agg(F.min(F.struct(*order)).alias("_first"))
    numbered = running_total(sliced(first.select(*scope, speaker, "_first.*"), scope, order, **options), scope, order,
                             F.lit(1).cast("long"), out)
    return df.join(numbered.drop(*order, "_slice"), [*scope, speaker])


def render_dialog(df: DataFrame, conv: str, order: Sequence[str], speaker: str, text: str,
                  prefix: str = "", **options: int) -> DataFrame:
    """Merged turns as lines ``"{speaker}: {text}"`` with ``depth`` and a prefixed id."""
    runs = merge_runs(df, conv, order, speaker, text, **options)
    line = F.concat(F.col("speaker").cast("string"), F.lit(": "), F.col("text"))
    return (
        runs.groupBy(conv)
        .agg(_joined(["run"], line, "\n").alias("dialog"), F.count("*").alias("depth"))
        .select(F.concat(F.lit(prefix), F.col(conv).cast("string")).alias("id"),
                "dialog", "depth")
    )


def marked_dialog(df: DataFrame, col: str = "text", eos: str = "</s>") -> DataFrame:
    """Replace ``col`` by its form with speaker tokens and add ``num_users``."""
    return df.withColumn(col, mark_speakers(F.col(col), eos)).withColumn(
        "num_users", speaker_count(F.col(col)))


def _speech(role: Column, value: Column, human: str) -> Column:
    return F.concat(F.when(role == human, "Human: ").otherwise("Assistant: "), value)


def conversation_text(turns: Column, human: str = "human") -> Column:
    """An array of ``{from, value}`` as paragraphs ``Human: ..`` and ``Assistant: ..``."""
    return F.array_join(F.transform(turns, lambda t: _speech(t["from"], t["value"], human)), "\n\n")


def render_conversation(df: DataFrame, conv: str, turn: str, role: str, text: str,
                        human: str = "human") -> DataFrame:
    """The same from one row per turn, in the order of ``turn``."""
    speech = _speech(F.col(role), F.col(text), human)
    return df.groupBy(conv).agg(_joined([turn], speech, "\n\n").alias("text"))


def preference_texts(df: DataFrame) -> DataFrame:
    """Chosen and rejected conversations from ``context, instruction, chosen, rejected``."""
    def whole(answer: str) -> Column:
        return conversation_text(F.concat("context", F.array("instruction", answer)))

    return df.select(
        *[c for c in df.columns if c not in ("context", "instruction", "chosen", "rejected")],
        whole("chosen").alias("chosen"), whole("rejected").alias("rejected"))


def render_seq2seq_pair(df: DataFrame) -> DataFrame:
    """The prompt up to ``Assistant: ``, with the two answers beside it."""
    prompt = conversation_text(F.concat("context", F.array("instruction")))
    return df.select(
        *[c for c in df.columns if c not in ("context", "instruction", "chosen", "rejected")],
        F.concat(prompt, F.lit("\n\nAssistant: ")).alias("prompt"),
        F.col("chosen")["value"].alias("chosen"), F.col("rejected")["value"].alias("rejected"))


def context_response(df: DataFrame, context: str = "context", response: str = "response",
                     eos: str = "</s>") -> DataFrame:
    """Add ``prompt_text`` (line breaks and the end become ``eos``) and ``label_text``."""
    prompt = F.concat(F.replace(F.col(context), F.lit("\n"), F.lit(eos)), F.lit(eos))
    return df.withColumn("prompt_text", prompt).withColumn("label_text", F.col(response))


def turn_pairs(df: DataFrame, conv: str, order: Sequence[str], text: str,
               **options: int) -> DataFrame:
    """Each turn after the first as ``response`` to the turn before it (``context``)."""
    seen = previous_value(sliced(df, [conv], order, **options), [conv], order, F.col(text), "_before")
    return (
        seen.where(F.col("_before").isNotNull())
        .withColumn("context", F.col("_before.value"))
        .withColumn("response", F.col(text))
        .drop("_before", "_slice")
    )


def earlier_turns(df: DataFrame, conv: str, order: Sequence[str], turn: Column, out: str,
                  skip: int = 0) -> DataFrame:
    """Add ``out``: ``turn`` of all turns before this one, in order, but for the last ``skip``.

    A conversation is gathered in one task, as its longest result cell is in any case.
    """
    before = Window.partitionBy(conv).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1 - skip)
    return df.withColumn(out, F.collect_list(turn).over(before))


def context_pairs(df: DataFrame, conv: str, order: Sequence[str], text: str) -> DataFrame:
    """Each turn after the first as ``response`` to all turns before it, one per line."""
    seen = earlier_turns(df, conv, order, F.col(text), "context")
    return (
        seen.where(F.size("context") > 0).withColumn("context", F.array_join("context", "\n"))
        .withColumn("response", F.col(text))
    )


def split_utterances(col: Column, marks: Sequence[str], compat: bool = False) -> Column:
    """Trimmed utterances that start at a speaker mark, in order, empty ones left out.

    Text before the first mark is dropped. ``compat`` also drops the last
    character of the text, as a slice ending at -1 does.
    """
    escaped = "|".join("\\Q" + m + "\\E" for m in marks)
    pieces = F.filter(F.split(col, f"(?={escaped})", -1), lambda p: p.rlike(f"^(?:{escaped})"))
    if compat:
        pieces = let(pieces, lambda whole: F.transform(whole, lambda p, i: F.when(
            i == F.size(whole) - 1, F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(p)))
    return F.filter(F.transform(pieces, trim), lambda p: p != "")
