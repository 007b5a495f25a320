"""Length statistics of token arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def length_profile(df: DataFrame, length: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum in one pass."""
    quartiles = F.percentile(length, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.agg(
        F.count(length).alias("count"), F.avg(length).alias("mean"),
        F.stddev_samp(length).alias("std"), F.min(length).alias("min"),
        quartiles.alias("_q"), F.max(length).alias("max"),
    ).select("count", "mean", "std", "min", F.col("_q")[0].alias("p25"),
             F.col("_q")[1].alias("p50"), F.col("_q")[2].alias("p75"), "max")


def length_histogram(df: DataFrame, length: str, bins: int = 20) -> DataFrame:
    """Counts of equal-width bins from minimum to maximum; the last bin is closed.

    The rows are counted by length first; the bins are made from those counts, as
    many rows as there are different lengths.
    """
    everything = Window.partitionBy()
    counts = (
        df.groupBy(F.col(length).alias("n")).agg(F.count(length).alias("rows"))
        .withColumns({"low": F.min("n").over(everything), "high": F.max("n").over(everything)})
        .withColumn("width", F.greatest(F.col("high") - F.col("low"), F.lit(1)))
    )
    at = F.least(F.floor((F.col("n") - F.col("low")) * bins / F.col("width")), F.lit(bins - 1))
    own = F.array(F.struct(at.cast("int").alias("bin"), F.col("rows").alias("rows")))
    empty = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.struct(
        b.alias("bin"), F.lit(0).cast("long").alias("rows")))
    cells = F.when(F.col("n") == F.col("low"), F.concat(own, empty)).otherwise(own)
    edge = F.col("low") + F.col("bin") * F.col("width") / bins
    return (
        counts.select("low", "width", F.explode(cells).alias("c"))
        .where(F.col("c.bin").isNotNull())
        .groupBy("low", "width", "c.bin").agg(F.sum("c.rows").alias("count"))
        .select("bin", edge.alias("begin"), (edge + F.col("width") / bins).alias("end"), "count")
    )
