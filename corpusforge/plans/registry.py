"""Register of named queries and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.session import checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# White space in SQL, as values.SPACE_CLASS has it.
WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under the name of its function."""
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt out when the scan has fewer splits than there are cores.

    That is a table below cores times ``spark.sql.files.maxPartitionBytes``, or one that
    cannot be split; a large table is read as it lies.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    cores = spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def scratch(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder, for queries about files."""
    return f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def joined(col: str | Column, sep: str = " ") -> Column:
    """An array as one text: results hold no arrays."""
    column = F.col(col) if isinstance(col, str) else col
    return F.array_join(column.cast("array<string>"), sep)


def words_sql(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{WS}'), lambda w: w <> '')"


def trim_sql(text: str) -> str:
    return f"regexp_replace({text}, '^{WS}|{WS}$', '', 'g')"
