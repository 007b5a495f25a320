"""Writing corpora and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

LETTERS = {"precision": "P", "recall": "R", "fmeasure": "F"}


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line, UTF-8, non-ASCII unescaped."""
    df.write.mode(mode).json(path)


def write_text(df: DataFrame, path: str, col: str = "text", mode: str = "errorifexists") -> None:
    """Plain text; a line break inside a document stays a line break."""
    df.select(col).write.mode(mode).text(path)


def write_counted(df: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """Write JSONL and return the number of rows, counted by the write itself."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).json(path)
    return seen.get["rows"]


def write_by_source(df: DataFrame, path: str, source: str = "source",
                    mode: str = "errorifexists") -> None:
    """One folder per source; ``/`` in a name becomes ``__``."""
    named = df.withColumn(source, F.replace(F.col(source), F.lit("/"), F.lit("__")))
    named.write.mode(mode).partitionBy(source).json(path)


def scores_table(scores: DataFrame, key: str, types: Sequence[str]) -> DataFrame:
    """``id`` and columns ``{type}-P``, ``-R``, ``-F`` by sorted type, six decimals."""
    columns = [
        F.format_string("%f", F.col(t)[part]).alias(f"{t}-{letter}")
        for t in sorted(types) for part, letter in LETTERS.items()
    ]
    return scores.select(F.col(key).alias("id"), *columns)


def aggregates_table(aggregates: DataFrame) -> DataFrame:
    """``score_type, low, mid, high`` with rows ``{type}-R``, ``-P``, ``-F``."""
    rows = F.explode(F.array(*[
        F.struct(
            F.concat("score_type", F.lit("-" + LETTERS[part])).alias("score_type"),
            *[F.format_string("%f", F.col(bound)[part]).alias(bound)
              for bound in ("low", "mid", "high")])
        for part in ("recall", "precision", "fmeasure")]))
    return aggregates.orderBy("score_type").select(rows.alias("r")).select("r.*")


def write_scores_csv(scores: DataFrame, key: str, types: Sequence[str], path: str,
                     mode: str = "errorifexists") -> None:
    scores_table(scores, key, types).orderBy("id").write.mode(mode).csv(path, header=True)


def write_aggregates_csv(aggregates: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Three rows per score type, so one file."""
    aggregates_table(aggregates).coalesce(1).write.mode(mode).csv(path, header=True)
