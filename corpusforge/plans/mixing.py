"""Queries about splits, samples, mixes and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.operators import mixing as M
from corpusforge.plans.registry import query, table

HASH = "md5('42' || doc_id)"


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")


@query(f"""
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {HASH}, doc_id)
       <= ceil(0.1 * (SELECT count(*) FROM documents)) THEN 'test' ELSE 'train' END AS split
FROM documents
""")
def train_test_split(spark, sf):
    return M.train_test_split(docs(spark, sf), "doc_id", 0.1, 42).select("doc_id", "split")


@query(f"SELECT doc_id, source FROM documents ORDER BY {HASH}, doc_id LIMIT 200")
def sampled_rows(spark, sf):
    return M.sample_n(docs(spark, sf), "doc_id", 200, 42).select("doc_id", "source")


@query("SELECT doc_id, source FROM documents ORDER BY source, doc_id LIMIT 150")
def first_rows(spark, sf):
    return M.head(docs(spark, sf), 150, ["source", "doc_id"]).select("doc_id", "source")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def capped_rows(spark, sf):
    ordered = docs(spark, sf).withColumn("falling", -F.col("n_chars"))
    return M.limit_items(ordered, 25, ["falling", "doc_id"]).select("doc_id", "n_chars")


@query("""
SELECT doc_id FROM documents
QUALIFY row_number() OVER (ORDER BY doc_id) <= (SELECT round(count(*) * 0.1) FROM documents)
""")
def leading_percent(spark, sf):
    return M.head_percent(docs(spark, sf), 10, ["doc_id"]).select("doc_id")


SIZES = """
sizes AS (SELECT source, count(*) AS size FROM pool GROUP BY source),
turns AS (SELECT *, max(size) OVER () AS longest, count(*) OVER () AS sources,
                 row_number() OVER (ORDER BY source) - 1 AS turn FROM sizes)
"""


@query(f"""
WITH pool AS (SELECT doc_id, lang AS source FROM documents), {SIZES},
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r
           FROM pool)
SELECT doc_id, source, unnest(range(r, longest, size)) * sources + turn AS position
FROM ranked JOIN turns USING (source)
""")
def interleaved_sources(spark, sf):
    pool = docs(spark, sf).select("doc_id", F.col("lang").alias("source"))
    return M.interleave(pool, "source", ["doc_id"]).select("doc_id", "source", "position")


@query("""
SELECT doc_id AS id, text FROM documents
UNION ALL SELECT item_id, text FROM benchmark
UNION ALL SELECT conv_id, text FROM conversations
""")
def concatenated_sources(spark, sf):
    parts = [("documents", "doc_id"), ("benchmark", "item_id"), ("conversations", "conv_id")]
    return M.concat_sources([
        table(spark, sf, name).select(F.col(key).alias("id"), "text") for name, key in parts])


@query("""
SELECT source, round(count(*) / (SELECT count(*) FROM documents), 9) AS weight
FROM documents GROUP BY source
""")
def source_weights(spark, sf):
    return M.source_weights(docs(spark, sf), "source").withColumn("weight", F.round("weight", 9))


@query("""
WITH pool AS (SELECT doc_id, lang AS source, length(text) AS n FROM documents),
w AS (SELECT source, count(*) AS size, CAST(sum(n) AS DOUBLE) / (SELECT sum(n) FROM pool) AS w
      FROM pool GROUP BY source),
f AS (SELECT *, floor(w * 1500) AS low, round(w * 1500 - floor(w * 1500), 9) AS rest FROM w),
q AS (SELECT source, size, CAST(low + CASE WHEN row_number() OVER (ORDER BY rest DESC, source)
      <= 1500 - sum(low) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f),
ranked AS (SELECT doc_id, source, row_number() OVER (
             PARTITION BY source ORDER BY md5('42' || doc_id), doc_id) - 1 AS r FROM pool)
SELECT doc_id, source, unnest(range(r, quota, size)) AS draw FROM ranked JOIN q USING (source)
""")
def weighted_mix(spark, sf):
    pool = table(spark, sf, "documents").select(
        "doc_id", F.col("lang").alias("source"), F.length("text").alias("n"))
    weights = M.source_weights(pool, "source", F.col("n"))
    return M.weighted_mix(pool, "source", "doc_id", weights, 1500).select(
        "doc_id", "source", "draw")


@query(f"""
SELECT doc_id, (r // 32) AS batch, CAST(r % 32 AS INT) AS place
FROM (SELECT doc_id, row_number() OVER (ORDER BY {HASH}, doc_id) - 1 AS r FROM documents)
WHERE r // 32 < (SELECT count(*) // 32 FROM documents)
""")
def train_batches(spark, sf):
    return M.train_batches(docs(spark, sf), "doc_id", 32, 42).select("doc_id", "batch", "place")


@query("""
WITH n AS (SELECT count(*) AS n, CAST(ceil(count(*) / 48) AS BIGINT) AS b FROM documents),
r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents)
SELECT doc_id, CASE WHEN r < (n % b) * (n // b + 1) THEN r // (n // b + 1)
       ELSE n % b + (r - (n % b) * (n // b + 1)) // (n // b) END AS batch
FROM r, n
""")
def eval_batches(spark, sf):
    return M.eval_batches(docs(spark, sf), ["doc_id"], 48).select("doc_id", "batch")


@query("""
SELECT count(*) AS examples, count(*) / 24 AS steps_per_epoch,
       CAST(floor(3 * (count(*) / 24)) AS BIGINT) AS total_steps,
       count(*) // 8 AS full_batches, count(*) // 8 * 3 AS total_full_batches
FROM documents
""")
def step_budget(spark, sf):
    return M.step_budget(docs(spark, sf), 8, 3, 3)
