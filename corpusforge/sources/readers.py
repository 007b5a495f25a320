"""Reading corpora."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusforge.session import stored

BAD = "_bad"


def file_path() -> Column:
    """Path of a row's file, unescaped and with one slash after ``file:``, whatever made it."""
    escaped = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    return F.regexp_replace(F.url_decode(escaped), "^file:/+", "file:/")


def list_files(spark: SparkSession, paths: str, pattern: str | None = None) -> list[str]:
    """Sorted paths of the files a glob names, empty ones too, as `file_path` has them."""
    reader = spark.read.format("binaryFile")
    if pattern is not None:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return input_paths(reader.load(paths))


def input_paths(read: DataFrame) -> list[str]:
    """Sorted paths of the files of a scan, as `file_path` has them.

    Spark lists them on the driver in any case; its readers skip empty ones.
    """
    return sorted({re.sub("^file:/+", "file:/", unquote(f)) for f in read.inputFiles()})


def missing_files(spark: SparkSession, read: DataFrame, root: str, pattern: str) -> DataFrame:
    """``file, content`` of the files that ``read`` (``file``) has no row of: empty ones."""
    files = spark.createDataFrame([(f,) for f in list_files(spark, root, pattern)], "file string")
    empty = F.substring("file", 1, 0)  # no constant: Spark would fold what callers make of it
    return files.join(read.select("file").distinct(), "file", "left_anti").select(
        "file", empty.alias("content"))


def read_jsonl(spark: SparkSession, paths: str | Sequence[str], schema: str | T.StructType,
               mode: str = "FAILFAST") -> DataFrame:
    """One row per line of the files a glob (or list of globs) names.

    A line that is no such record fails the job; ``mode`` is Spark's.
    """
    return spark.read.schema(schema).option("mode", mode).json(
        paths if isinstance(paths, str) else list(paths))


def whole_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return (
        spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
        .select(file_path().alias("file"), F.col("value").alias("content"))
    )


def read_json_tree(spark: SparkSession, root: str, schema: T.StructType | str,
                   pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """One row per JSON file below ``root`` as ``(good, bad)``.

    A file that does not parse, an empty one too, goes to ``bad`` (``file``, ``content``) and
    the job goes on. Every file is read and parsed once: the rows are a table in the
    checkpoint folder.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    full = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    row = F.from_json("content", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    # Opening an array of one row parses it once, however often it is looked at.
    parsed = whole_files(spark, root, pattern).withColumn("_row", F.explode(F.array(row)))
    fine = F.col("_row").isNotNull() & F.col(f"_row.{BAD}").isNull()
    parsed = stored(parsed.select("file", "_row", fine.alias("_fine"),
                                  F.when(~fine, F.col("content")).alias("content")))
    good = parsed.where("_fine").select("_row.*", "file").drop(BAD)
    bad = parsed.where("NOT _fine").select("file", "content")
    return good, bad.unionByName(missing_files(spark, parsed, root, pattern))


def read_parsed(spark: SparkSession, root: str, parse: Callable[[str], Iterable[dict]],
                schema: T.StructType | str, pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """The rows that ``parse`` makes of the content of each file, as ``(good, bad)``.

    ``good`` has the columns of ``schema`` and ``file``, ``bad`` the files where ``parse``
    failed and the ``error``. Rows made before the failure are kept.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    full = T.StructType([T.StructField("row", schema), T.StructField("file", T.StringType()),
                         T.StructField("error", T.StringType())])

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = to_arrow_schema(full)
        for batch in batches:
            for file, content in zip(*(c.to_pylist() for c in batch.columns)):
                rows, error = [], None
                try:
                    rows.extend({"row": row, "file": file} for row in parse(content))
                except Exception as failure:  # any failure of the given function is reported
                    error = f"{type(failure).__name__}: {failure}"
                if error is not None:
                    rows.append({"file": file, "error": error})
                yield pa.RecordBatch.from_pylist(rows, shape)

    files = whole_files(spark, root, pattern)
    rows = stored(files.unionByName(missing_files(spark, files, root, pattern)).mapInArrow(parsed, full))
    return (rows.where("error IS NULL").select("row.*", "file"),
            rows.where("error IS NOT NULL").select("file", "error"))


def read_tsv(spark: SparkSession, path: str, columns: Sequence[str], multi_line: bool = True
             ) -> DataFrame:
    """Tab-separated file without header, all columns strings.

    Quotes enclose fields, line breaks included, and are doubled inside them. A file without
    line breaks in its fields can be read in splits with ``multi_line=False``.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, schema=schema, sep="\t", header=False, quote='"', escape='"',
                          multiLine=multi_line)


def ranked_files(spark: SparkSession, glob: str) -> DataFrame:
    """``path, file``: the files of a glob and their rank by path, empty files too."""
    return spark.createDataFrame(
        [(path, i) for i, path in enumerate(list_files(spark, glob))], "path string, file int")


def read_records(spark: SparkSession, glob: str, delimiter: str = "\n") -> DataFrame:
    """Records of text files: ``path``, ``file`` (rank of the path), ``record``, ``text``.

    Records are numbered from 0 within their file. An empty piece after the last
    delimiter is no record, whether or not that delimiter is there. An empty file has no
    records and keeps its rank. Large files are read in splits: a record's number is the
    number of records in the earlier splits plus its place in its own.
    """
    reader = spark.read if delimiter == "\n" else spark.read.option("lineSep", delimiter)
    lines = reader.text(glob).select(
        F.col("value").alias("text"), file_path().alias("path"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_line"))
    counts = lines.groupBy("path", "_split").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("path").orderBy("_split").rowsBetween(
        Window.unboundedPreceding, -1)
    splits = counts.select("path", "_split",
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("path", "_split").orderBy("_line")
    return (
        lines.withColumn("_place", F.row_number().over(inside) - 1)
        .join(splits, ["path", "_split"])
        .join(ranked_files(spark, glob), "path")
        .select("path", "file", (F.col("_base") + F.col("_place")).alias("record"), "text")
    )


def preview(df: DataFrame, n: int, order: Sequence[str]) -> tuple[int, DataFrame]:
    """Row count and the first ``n`` rows."""
    return df.count(), df.orderBy(*order).limit(n)
