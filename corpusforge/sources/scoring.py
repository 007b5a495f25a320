"""Score jobs: text files in, score files out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.operators.bootstrap import bootstrap
from corpusforge.operators.ordered import rank_in_order
from corpusforge.operators.overlap import align_records, check_types, rouge
from corpusforge.sources.readers import list_files, read_records
from corpusforge.sources.writers import write_aggregates_csv, write_scores_csv

Scorer = Callable[[DataFrame], DataFrame]


def score_files(spark: SparkSession, target_glob: str, prediction_glob: str, output: str,
                types: Sequence[str], delimiter: str = "\n", aggregate: bool = True,
                scorer: Scorer | None = None, aggregator: Scorer | None = None) -> None:
    """Score aligned records and write per-example scores or aggregated intervals.

    ``scorer`` and ``aggregator`` replace the default ones; they map a table with
    ``file, record, target, prediction`` to scores and scores to intervals.
    """
    check_types(types)
    targets = read_records(spark, target_glob, delimiter)
    predictions = read_records(spark, prediction_glob, delimiter)
    files = [len(list_files(spark, glob)) for glob in (target_glob, prediction_glob)]
    if files[0] != files[1] or not files[0]:
        raise ValueError(f"{files[0]} target files cannot be paired with {files[1]} prediction files")
    scores = (scorer or (lambda df: rouge(df, types, ["file", "record"])))(
        align_records(targets, predictions))
    if aggregate:
        keyed = scores.withColumn("id", F.concat_ws(":", "file", "record"))
        intervals = (aggregator or (lambda df: bootstrap(df, types, "id")))(keyed)
        write_aggregates_csv(intervals, output)
    else:
        ranked = rank_in_order(scores, [], ["file", "record"], "id")
        write_scores_csv(ranked, "id", types, output)
