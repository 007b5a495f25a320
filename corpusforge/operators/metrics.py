"""Evaluation metrics as aggregations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_counts(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Per class: true positives, false positives, false negatives.

    The rows are first counted by (label, prediction), so a class that holds most
    rows costs no more than a rare one.
    """
    cells = df.groupBy(F.col(label).alias("l"), F.col(pred).alias("p")).agg(
        F.count("*").alias("n"))
    hit = F.col("l") == F.col("p")
    zero = F.lit(0).cast("long")
    rows = F.when(hit, F.array(
        F.struct(F.col("l").alias("class"), F.col("n").alias("tp"), zero.alias("fp"),
                 zero.alias("fn")))).otherwise(F.array(
        F.struct(F.col("l").alias("class"), zero.alias("tp"), zero.alias("fp"),
                 F.col("n").alias("fn")),
        F.struct(F.col("p").alias("class"), zero.alias("tp"), F.col("n").alias("fp"),
                 zero.alias("fn"))))
    return (
        cells.select(F.explode(rows).alias("r")).select("r.*")
        .groupBy("class").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    )


def _f1() -> Column:
    whole = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return F.when(whole > 0, 2 * F.col("tp") / whole).otherwise(0.0)


METRICS = {
    "accuracy": lambda positive=None, average=None: F.sum("tp") / F.sum(F.col("tp") + F.col("fn")),
    "f1": lambda positive=1, average="binary": (
        F.avg(_f1()) if average == "macro"
        else F.coalesce(F.max(F.when(F.col("class") == positive, _f1())), F.lit(0.0))
    ),
}


def evaluate(df: DataFrame, metrics: Mapping[str, Mapping] | Sequence[str],
             label: str = "label", pred: str = "prediction") -> DataFrame:
    """One row with all metrics, each with its own settings, from one pass over the rows.

    ``metrics`` maps the output name to settings; ``metric`` among them names the
    metric when it differs from the output name.
    """
    if not isinstance(metrics, Mapping):
        metrics = {name: {} for name in metrics}
    columns = []
    for name, settings in metrics.items():
        settings = dict(settings)
        metric = settings.pop("metric", name)
        columns.append(METRICS[metric](**settings).alias(name))
    return class_counts(df, label, pred).agg(*columns)


def accuracy(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    return df.agg(F.avg((F.col(pred) == F.col(label)).cast("int")).alias("accuracy"))


def f1(df: DataFrame, average: str = "binary", label: str = "label",
       pred: str = "prediction") -> DataFrame:
    """``binary`` scores class 1, ``macro`` averages the classes seen on either side."""
    return evaluate(df, {"f1": {"average": average}}, label, pred)


def token_metrics(df: DataFrame, metrics=("accuracy", "f1"), labels: str = "labels",
                  preds: str = "predictions") -> DataFrame:
    """Metrics over the elements of two arrays, negative labels left out."""
    pairs = F.arrays_zip(F.col(labels).alias("label"), F.col(preds).alias("prediction"))
    tokens = df.select(F.explode(pairs).alias("t")).select("t.label", "t.prediction")
    return evaluate(tokens.where(F.col("label") >= 0), metrics)


def batch_losses(df: DataFrame, batch: Sequence[str], loss: str = "loss") -> DataFrame:
    """Mean loss and perplexity of each batch."""
    return df.groupBy(*batch).agg(F.avg(loss).alias("loss")).withColumn(
        "perplexity", F.exp("loss"))


def mean_loss(df: DataFrame, batch: Sequence[str], loss: str = "loss") -> DataFrame:
    """Mean of batch means; a short last batch weighs as much as a full one."""
    return batch_losses(df, batch, loss).agg(F.avg("loss").alias("loss"))


def perplexity(df: DataFrame, batch: Sequence[str], loss: str = "loss") -> DataFrame:
    """Mean loss with its exponential; infinity where that overflows."""
    return mean_loss(df, batch, loss).withColumn("perplexity", F.exp("loss"))


def preference_metrics(df: DataFrame, chosen: str = "chosen", rejected: str = "rejected",
                       batch: Sequence[str] = ()) -> DataFrame:
    """Mean of ``-log sigmoid(chosen - rejected)`` and share of ``chosen > rejected``.

    With ``batch`` keys the means are taken per batch and then averaged.
    """
    gap = F.col(chosen) - F.col(rejected)
    loss = F.log1p(F.exp(-F.abs(gap))) + F.greatest(-gap, F.lit(0.0))
    means = [F.avg(loss).alias("loss"), F.avg((gap > 0).cast("int")).alias("accuracy")]
    if not batch:
        return df.agg(*means)
    return df.groupBy(*batch).agg(*means).agg(
        F.avg("loss").alias("loss"), F.avg("accuracy").alias("accuracy"))


def collate(df: DataFrame, metrics: Sequence[str], prefix: str = "eval/") -> DataFrame:
    """Step rows with one column per metric as ``name, value`` means."""
    means = df.agg(*[
        F.struct(F.lit(prefix + m).alias("name"), F.avg(F.col(m).cast("double")).alias("value"),
                 F.count(m).alias("steps")).alias(f"_{i}") for i, m in enumerate(metrics)])
    return means.select(F.explode(F.array(*[f"_{i}" for i in range(len(metrics))])).alias("m")).select("m.*")


def log_points(df: DataFrame, every: int, step: str = "step") -> DataFrame:
    """Rows of the steps that are logged: each ``every``-th one, not step 0."""
    return df.where((F.col(step) % every == 0) & (F.col(step) > 0))


def sample_table(df: DataFrame, by: str, score: str, key: str, k: int = 10) -> DataFrame:
    """The ``k`` best-scored rows of each class with their ``place``.

    Spark keeps at most ``k`` rows per class and task before the shuffle.
    """
    best = Window.partitionBy(by).orderBy(F.desc(score), key)
    return df.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
