"""Streaming ingestion and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.operators.schema import min_chars

CORPUS_SCHEMA = "source string, doc_id long, text string"


def stream_corpus(spark: SparkSession, path: str, schema: str | T.StructType = CORPUS_SCHEMA,
                  min_length: int = 33, files_per_trigger: int = 16) -> DataFrame:
    """JSONL files of a folder as they arrive, without short texts and unreadable lines."""
    lines = (
        spark.readStream.schema(schema).option("mode", "DROPMALFORMED")
        .option("maxFilesPerTrigger", files_per_trigger).json(path)
    )
    return min_chars(lines.where(F.col("text").isNotNull()), min_length)


def stream_lines(spark: SparkSession, path: str, schema: str | T.StructType = CORPUS_SCHEMA,
                 files_per_trigger: int = 16) -> DataFrame:
    """All JSONL lines of a folder as they arrive; one that is no row of the schema is null but
    for its text in ``_line``. The file is in ``_file``.
    """
    columns = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    return (
        spark.readStream.schema(T.StructType([*columns.fields, T.StructField("_line", T.StringType())]))
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line")
        .option("maxFilesPerTrigger", files_per_trigger).json(path)
        .withColumn("_file", F.col("_metadata.file_name"))
    )


def keep_batch(lines: DataFrame, batch_id: int, out: str, rejects: str, min_length: int = 33) -> None:
    """Write the rows of a micro-batch and, beside them, the lines that are none; for ``foreachBatch``.

    Both are written under the number of the batch, so a batch that runs again after a failure
    replaces its own files, and every line is in one of the two once. Rows without text or
    with a short one are left out, as ``stream_corpus`` leaves them out.
    """
    lines.persist()  # a table of both is read twice, the source once
    broken = F.col("_line").isNotNull()
    rows = lines.where(~broken & F.col("text").isNotNull()).drop("_line", "_file")
    min_chars(rows, min_length).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    lines.where(broken).select(F.col("_file").alias("file"), F.col("_line").alias("line")).write.mode(
        "overwrite").parquet(f"{rejects}/batch={batch_id}")
    lines.unpersist()


def write_corpus(lines: DataFrame, out: str, rejects: str, checkpoint: str, **trigger):
    """Start the query that sorts ``lines`` (of ``stream_lines``) into rows and rejected lines."""
    return (
        lines.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger)
        .foreachBatch(lambda df, n: keep_batch(df, n, out, rejects)).start()
    )


def stream_metrics(steps: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """Running mean of each metric of a step log; use output mode ``complete`` or ``update``."""
    return steps.groupBy(name).agg(F.avg(value).alias("value"), F.count(value).alias("steps"))
