"""Queries about evaluation metrics.

The first ten values of an embedding serve as logits of its label.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.functions import tokens as K
from corpusforge.operators import metrics as X
from corpusforge.operators.ordered import rank_in_order
from corpusforge.plans.registry import documents, query, scratch, table, words_sql
from corpusforge.streaming.ingest import stream_metrics

LOGITS = "list_position(embedding[1:10], list_max(embedding[1:10])) - 1"
PREDICTED = f"""
p AS (SELECT vec_id, label, {LOGITS} AS prediction FROM embeddings),
classes AS (SELECT label AS c FROM p UNION SELECT prediction FROM p),
counts AS (SELECT c, count(*) FILTER (label = c AND prediction = c) AS tp,
                  count(*) FILTER (label <> c AND prediction = c) AS fp,
                  count(*) FILTER (label = c AND prediction <> c) AS fn
           FROM classes, p GROUP BY c),
scores AS (SELECT c, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1
           FROM counts)
"""


def predicted(spark, sf):
    logits = F.slice("embedding", 1, 10)
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", K.argmax(logits).alias("prediction"))


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(f"SELECT vec_id, {LOGITS} AS prediction FROM embeddings")
def argmax_predictions(spark, sf):
    return predicted(spark, sf).select("vec_id", "prediction")


@query(f"WITH {PREDICTED} SELECT round(avg(CAST(label = prediction AS INT)), 6) AS accuracy FROM p")
def accuracy(spark, sf):
    return rounded(X.accuracy(predicted(spark, sf)), "accuracy")


@query(f"WITH {PREDICTED} SELECT round(f1, 6) AS f1 FROM scores WHERE c = 1")
def f1_binary(spark, sf):
    return rounded(X.f1(predicted(spark, sf), "binary"), "f1")


@query(f"WITH {PREDICTED} SELECT round(avg(f1), 6) AS f1 FROM scores")
def f1_macro(spark, sf):
    return rounded(X.f1(predicted(spark, sf), "macro"), "f1")


@query(f"""WITH {PREDICTED}
SELECT round((SELECT avg(CAST(label = prediction AS INT)) FROM p), 6) AS accuracy,
       round((SELECT avg(f1) FROM scores), 6) AS f1,
       round((SELECT f1 FROM scores WHERE c = 3), 6) AS f1_three
""")
def metric_set(spark, sf):
    settings = {"accuracy": {}, "f1": {"average": "macro"},
                "f1_three": {"metric": "f1", "positive": 3}}
    return rounded(X.evaluate(predicted(spark, sf), settings), *settings)


@query("""
SELECT round(avg(CAST(toxic = quality AS INT)), 6) AS accuracy,
       round(2 * count(*) FILTER (toxic = 1 AND quality = 1) /
             (count(*) FILTER (toxic = 1) + count(*) FILTER (quality = 1)), 6) AS f1
FROM labels
""")
def label_agreement(spark, sf):
    pairs = table(spark, sf, "labels").select(
        F.col("toxic").alias("label"), F.col("quality").alias("prediction"))
    return rounded(X.evaluate(pairs, ["accuracy", "f1"]), "accuracy", "f1")


@query(f"""
WITH t AS (SELECT unnest(list_transform({words_sql("text")}, lambda w: length(w))) AS n
           FROM documents),
p AS (SELECT n % 2 AS label, CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END AS prediction
      FROM t WHERE n % 5 <> 0)
SELECT round(avg(CAST(label = prediction AS INT)), 6) AS accuracy,
       round(2 * count(*) FILTER (label = 1 AND prediction = 1) /
             (count(*) FILTER (label = 1) + count(*) FILTER (prediction = 1)), 6) AS f1
FROM p
""")
def token_metrics(spark, sf):
    sizes = F.transform(K.words(F.col("text")), lambda w: F.length(w))
    labels = F.transform(sizes, lambda n: F.when(n % 5 == 0, -100).otherwise(n % 2))
    preds = F.transform(sizes, lambda n: F.when(n % 3 == 0, 1).otherwise(0))
    rows = documents(spark, sf).select(labels.alias("labels"), preds.alias("predictions"))
    return rounded(X.token_metrics(rows), "accuracy", "f1")


def losses(spark, sf):
    events = table(spark, sf, "events")
    return events.select("event_type", F.floor(F.col("event_id") / 64).alias("batch"),
                         (F.col("value") / 97.0131).alias("loss"))


@query("""
SELECT round(avg(loss), 6) AS loss FROM (
  SELECT avg(value / 97.0131) AS loss FROM events GROUP BY event_type, event_id // 64)
""")
def mean_loss(spark, sf):
    return rounded(X.mean_loss(losses(spark, sf), ["event_type", "batch"]), "loss")


@query("""
SELECT round(avg(loss), 6) AS loss, round(exp(avg(loss)), 6) AS perplexity FROM (
  SELECT avg(value / 97.0131) AS loss FROM events GROUP BY event_type, event_id // 64)
""")
def perplexity(spark, sf):
    return rounded(X.perplexity(losses(spark, sf), ["event_type", "batch"]), "loss", "perplexity")


@query("""
SELECT event_type, event_id // 64 AS batch, round(avg(value / 97.0131), 6) AS loss,
       round(exp(avg(value / 97.0131)), 6) AS perplexity
FROM events GROUP BY 1, 2
""")
def batch_perplexity(spark, sf):
    return rounded(X.batch_losses(losses(spark, sf), ["event_type", "batch"]),
                   "loss", "perplexity")


@query("""
WITH g AS (SELECT a.conv_id, (length(a.text) - length(b.text)) / 300.0 AS gap
           FROM conversations a
           JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1),
m AS (SELECT avg(ln(1 + exp(-gap))) AS loss, avg(CAST(gap > 0 AS INT)) AS accuracy
      FROM g GROUP BY conv_id)
SELECT round(avg(loss), 6) AS loss, round(avg(accuracy), 6) AS accuracy FROM m
""")
def preference_metrics(spark, sf):
    turns = table(spark, sf, "conversations").select(
        "conv_id", "turn", (F.length("text") / 300.0).alias("chosen"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"),
                          F.col("chosen").alias("rejected"))
    scores = turns.join(before, ["conv_id", "turn"])
    return rounded(X.preference_metrics(scores, batch=["conv_id"]), "loss", "accuracy")


@query("""
SELECT 'eval/l_quantity' AS name, round(avg(l_quantity), 10) AS value, count(*) AS steps FROM lineitem
UNION ALL SELECT 'eval/l_discount', round(avg(l_discount), 10), count(*) FROM lineitem
UNION ALL SELECT 'eval/l_tax', round(avg(l_tax), 10), count(*) FROM lineitem
""")
def collated_metrics(spark, sf):
    steps = table(spark, sf, "lineitem")
    means = X.collate(steps, ["l_quantity", "l_discount", "l_tax"])
    return means.withColumn("value", F.round("value", 10))


@query("""
SELECT event_type, step, value FROM (
  SELECT event_type, value,
         row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS step FROM events)
WHERE step % 50 = 0 AND step > 0
""")
def logged_steps(spark, sf):
    steps = rank_in_order(table(spark, sf, "events"), ["event_type"], ["event_id"], "step")
    return X.log_points(steps, 50).select("event_type", "step", "value")


@query("""
SELECT event_type, event_id, value, CAST(r AS INT) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r
  FROM events)
WHERE r <= 10
""")
def sample_table(spark, sf):
    return X.sample_table(table(spark, sf, "events"), "event_type", "value", "event_id", 10).select(
        "event_type", "event_id", "value", "place")


@query("""
SELECT event_type AS name, round(avg(value), 6) AS value, count(*) AS steps
FROM events GROUP BY event_type
""")
def running_metrics(spark, sf):
    """The streaming mean of a step log, read to its end."""
    folder = scratch(spark)
    log = table(spark, sf, "events").select("event_id", F.col("event_type").alias("name"), "value")
    log.write.parquet(f"{folder}/log")
    stream = spark.readStream.schema(log.schema).parquet(f"{folder}/log")
    final = stream_metrics(stream).writeStream.outputMode("complete").option(
        "checkpointLocation", f"{folder}/check").foreachBatch(
        lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out")
    ).trigger(availableNow=True).start()
    final.awaitTermination()
    return rounded(spark.read.parquet(f"{folder}/out"), "value")
