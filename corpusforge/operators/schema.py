"""Schema projections, lookups and filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.text import remove_speaker, script_ratio, trim
from corpusforge.values import DOWNLOAD_TEXT_COLUMNS, HANGUL_CLASS, IGNORE_LABEL, TEXT_COLUMNS


def unify_text(df: DataFrame, names: Sequence[str] = TEXT_COLUMNS,
               keep_speakers: bool = False) -> DataFrame:
    """Rename the first column of the priority list to ``text``.

    Speaker marks of a ``dialog`` column are removed unless ``keep_speakers``. A table that
    has both such a column and a ``text`` column of its own is an error.
    """
    found = next((n for n in names if n in df.columns), None)
    if found is None:
        return df
    if found != "text" and "text" in df.columns:
        raise ValueError(f"both {found} and text could be the text; drop or rename one")
    renamed = df.withColumnRenamed(found, "text")
    if found == "dialog" and not keep_speakers:
        renamed = renamed.withColumn("text", remove_speaker(F.col("text")))
    return renamed


def text_only(df: DataFrame, names: Sequence[str] = DOWNLOAD_TEXT_COLUMNS,
              min_length: int | None = None, keep_speakers: bool = False) -> DataFrame:
    """Just the text column, with short texts left out on request."""
    text = unify_text(df, names, keep_speakers).select("text")
    return text if min_length is None else min_chars(text, min_length)


def explode_documents(df: DataFrame, array_col: str, metadata: str | None = None,
                      **columns: Column) -> DataFrame:
    """One row per element of ``array_col``.

    The element is column ``d`` for the expressions in ``columns``; the fields
    of its ``metadata`` struct come first.
    """
    exploded = df.select("*", F.explode(array_col).alias("d"))
    chosen = [c.alias(name) for name, c in columns.items()]
    if metadata:
        chosen = [F.col(f"d.{metadata}.*"), *chosen]
    return exploded.select(*chosen)


def first_title(col: str = "d.title") -> Column:
    """First title sentence of an element."""
    return F.get(F.col(col), F.lit(0))["sentence"]


def merge_structs(df: DataFrame, cols: Sequence[str], fields: dict[str, str]) -> DataFrame:
    """Take each field from the last struct that has it, null or not.

    ``cols`` are struct columns in file order, ``fields`` maps field to output name. A struct
    that is null itself has no fields.
    """
    def value(field: str) -> Column:
        having = [c for c in cols if field in df.schema[c].dataType.fieldNames()]
        taken = F.lit(None)
        for c in having:
            taken = F.when(F.col(c).isNotNull(), F.col(c)[field]).otherwise(taken)
        return taken

    return df.select(*[value(f).alias(out) for f, out in fields.items()])


def encode_label(col: Column, classes: Sequence[str]) -> Column:
    """Position of the class name in the list; an unknown name fails the job."""
    names = F.array(*[F.lit(c) for c in classes])
    found = F.array_position(names, col)
    unknown = F.raise_error(F.concat(F.lit("unknown class: "), F.coalesce(col, F.lit("null"))))
    return F.when(found > 0, found - 1).otherwise(unknown.cast("long"))


def decode_label(col: Column, classes: Sequence[str]) -> Column:
    """Class name at a position."""
    return F.element_at(F.array(*[F.lit(c) for c in classes]), (col + 1).cast("int"))


def label_from(df: DataFrame, paths: Sequence[str], out: str = "label") -> DataFrame:
    """Add ``out`` from the first path the schema has, such as ``labels.binary-label``."""
    for path in paths:
        head, _, field = path.partition(".")
        if head not in df.columns:
            continue
        if not field:
            return df.withColumn(out, F.col(head))
        if field in getattr(df.schema[head].dataType, "names", []):
            return df.withColumn(out, F.col(head)[field])
    raise ValueError(f"none of {list(paths)} in {df.columns}")


def filter_label(df: DataFrame, col: str = "label", threshold: float = 0.5,
                 side: str = "above") -> DataFrame:
    """``above`` keeps ``>= threshold``, ``below`` the rest of the labelled rows."""
    keep = F.col(col) >= threshold if side == "above" else F.col(col) < threshold
    return df.where(keep)


def min_chars(df: DataFrame, n: int, col: str = "text") -> DataFrame:
    return df.where(F.length(col) >= n)


def dedupe_exact(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct values of ``keys``."""
    return df.select(*keys).distinct()


def valid_pairs(df: DataFrame, first: str = "chosen", second: str = "rejected") -> DataFrame:
    """Rows whose two answers are both non-blank."""
    return df.where((trim(F.col(first)) != "") & (trim(F.col(second)) != ""))


def has_supervision(df: DataFrame, col: str = "labels") -> DataFrame:
    """Rows with at least one label that carries loss."""
    return df.where(F.exists(col, lambda x: x != IGNORE_LABEL))


def filter_script(df: DataFrame, threshold: float = 0.75, col: str = "text",
                  char_class: str = HANGUL_CLASS) -> DataFrame:
    """Rows whose share of characters in the class is above the threshold."""
    return df.where(script_ratio(F.col(col), char_class) > threshold)
