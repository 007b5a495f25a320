"""Queries about text overlap.

Documents are predictions, benchmark passages their targets: document ``d``
against passage ``d`` modulo the number of passages.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.functions.tokens import score_tokens
from corpusforge.operators import overlap as O
from corpusforge.operators.bootstrap import GOLDEN, POISSON, PRIME, bootstrap
from corpusforge.operators.ordered import rank_in_order
from corpusforge.plans.registry import WS, documents, query, table

PARTS = ("precision", "recall", "fmeasure")


def pairs(spark, sf, references: int = 1):
    """``doc_id, reference, target, prediction``; passages are counted by rank, gaps do no harm."""
    passages = table(spark, sf, "benchmark")
    n = passages.count()
    docs = documents(spark, sf).select("doc_id", F.col("text").alias("prediction"))
    numbered = docs.withColumn("reference", F.explode(F.sequence(
        F.lit(0), F.lit(references - 1))))
    wanted = numbered.withColumn("place", (F.col("doc_id") + F.col("reference")) % n)
    targets = rank_in_order(passages.select("item_id", F.col("text").alias("target")), [],
                            ["item_id"], "place").drop("item_id")
    return wanted.join(targets, "place").drop("place")


def rounded(df, *types):
    """Score structs as columns ``{type}_p``, ``{type}_r``, ``{type}_f``."""
    return [F.round(F.col(t)[p], 10).alias(f"{t}_{p[0]}") for t in types for p in PARTS]


def tokens_sql(text: str) -> str:
    return f"string_split_regex(lower({text}), '{WS}')"


def pairs_sql(references: int = 1) -> str:
    return f"""
pairs AS (SELECT doc_id, reference, {tokens_sql("b.text")} AS t, {tokens_sql("d.text")} AS p
          FROM documents d, (SELECT unnest(range({references})) AS reference)
          JOIN (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS place FROM benchmark) b
          ON place = (doc_id + reference) % (SELECT count(*) FROM benchmark))
"""


def grams_sql(name: str, side: str, n: int) -> str:
    gram = f"array_to_string({side}[i + 1:i + {n}], '|')"
    return f"""
{name} AS (SELECT doc_id, reference, g, count(*) AS n FROM (
  SELECT doc_id, reference, unnest(list_transform(range(len({side}) - {n} + 1),
         lambda i: {gram})) AS g FROM pairs WHERE len({side}) >= {n}) GROUP BY ALL)
"""


def score_sql(name: str, n: int) -> str:
    """CTE ``name`` with doc_id, reference, pr, re, f of ROUGE-n."""
    return f"""
{grams_sql(f"t{n}", "t", n)}, {grams_sql(f"p{n}", "p", n)},
h{n} AS (SELECT doc_id, reference, sum(least(a.n, b.n)) AS h FROM t{n} a
         JOIN p{n} b USING (doc_id, reference, g) GROUP BY ALL),
c{n} AS (SELECT doc_id, reference,
         coalesce(h, 0) / greatest(len(p) - {n - 1}, 1) AS pr,
         coalesce(h, 0) / greatest(len(t) - {n - 1}, 1) AS re
         FROM pairs LEFT JOIN h{n} USING (doc_id, reference)),
{name} AS (SELECT doc_id, reference, pr, re,
           CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f FROM c{n})
"""


@query(f"""
SELECT item_id, g AS ngram, count(*) AS count FROM (
  SELECT item_id, unnest(list_transform(range(len(t) - 1),
         lambda i: array_to_string(t[i + 1:i + 2], ' '))) AS g
  FROM (SELECT item_id, {tokens_sql("text")} AS t FROM benchmark)) GROUP BY ALL
""")
def ngram_counts(spark, sf):
    tokens = table(spark, sf, "benchmark").select(
        "item_id", score_tokens(F.col("text")).alias("t"))
    return O.ngram_counts(tokens, ["item_id"], "t", 2)


@query(f"""
WITH {pairs_sql()}, {score_sql("r1", 1)}, {score_sql("r2", 2)}
SELECT doc_id, round(a.pr, 10) AS rouge1_p, round(a.re, 10) AS rouge1_r, round(a.f, 10) AS rouge1_f,
       round(b.pr, 10) AS rouge2_p, round(b.re, 10) AS rouge2_r, round(b.f, 10) AS rouge2_f
FROM r1 a JOIN r2 b USING (doc_id)
""")
def rouge_ngrams(spark, sf):
    scores = O.rouge(pairs(spark, sf), ["rouge1", "rouge2"], "doc_id")
    return scores.select("doc_id", *rounded(scores, "rouge1", "rouge2"))


# Per target token, the thresholds of Hunt and Szymanski (1977): place k holds the
# first prediction position where a common subsequence of length k can end.
LCS = f"""
pairs AS (SELECT doc_id, {tokens_sql("b.text")} AS t, {tokens_sql("d.text")} AS p
          FROM documents d
          JOIN (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS place FROM benchmark) b
          ON place = doc_id % (SELECT count(*) FROM benchmark)),
steps AS (
  SELECT doc_id, 0 AS i, CAST([] AS BIGINT[]) AS k FROM pairs
  UNION ALL
  SELECT doc_id, i + 1, list_filter(list_transform(range(1, len(k) + 2), lambda c:
         least(coalesce(k[c], 1000000000), coalesce(list_min(list_filter(spots, lambda j:
         j > CASE WHEN c = 1 THEN 0 ELSE k[c - 1] END)), 1000000000))), lambda x: x < 1000000000)
  FROM (SELECT s.doc_id, s.i, s.k, list_filter(range(1, len(p) + 1), lambda j: p[j] = t[s.i + 1])
               AS spots
        FROM steps s JOIN pairs USING (doc_id) WHERE s.i < len(t))),
hits AS (SELECT doc_id, len(k) AS h, len(t) AS nt, len(p) AS np
         FROM steps JOIN pairs USING (doc_id) WHERE i = len(t))
"""


@query(f"""
WITH RECURSIVE {LCS}
SELECT doc_id, round(h / np, 10) AS "rougeL_p", round(h / nt, 10) AS "rougeL_r",
       round(CASE WHEN h > 0 THEN 2 * (h / np) * (h / nt) / (h / np + h / nt) ELSE 0 END, 10)
       AS "rougeL_f"
FROM hits
""")
def rouge_lcs(spark, sf):
    scores = O.rouge(pairs(spark, sf), ["rougeL"], "doc_id")
    return scores.select("doc_id", *rounded(scores, "rougeL"))


@query()
def rouge_summary(spark, sf):
    scores = O.rouge(pairs(spark, sf), ["rougeLsum"], "doc_id")
    return scores.select("doc_id", *rounded(scores, "rougeLsum"))


@query()
def rouge_stemmed(spark, sf):
    """All types in one call, with stemming and sentence splitting."""
    types = ["rouge1", "rougeL", "rougeLsum"]
    scores = O.rouge(pairs(spark, sf), types, "doc_id", stem=True, split_summaries=True)
    return scores.select("doc_id", *rounded(scores, *types))


@query(f"""
WITH {pairs_sql(3)}, {score_sql("r1", 1)},
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY f DESC, reference) AS place
         FROM r1)
SELECT doc_id, round(pr, 10) AS rouge1_p, round(re, 10) AS rouge1_r, round(f, 10) AS rouge1_f
FROM best WHERE place = 1
""")
def rouge_references(spark, sf):
    """The best of three references per document."""
    scores = O.rouge_multi(pairs(spark, sf, 3), ["rouge1"], "doc_id", "reference")
    return scores.select("doc_id", *rounded(scores, "rouge1"))


@query(f"""
WITH {pairs_sql()}, {score_sql("r1", 1)}, {score_sql("r2", 2)}
SELECT 'rouge1' AS score_type, round(avg(pr), 6) AS precision, round(avg(re), 6) AS recall,
       round(avg(f), 6) AS fmeasure, round(avg((pr + re + f) / 3), 6) AS mean FROM r1
UNION ALL SELECT 'rouge2', round(avg(pr), 6), round(avg(re), 6), round(avg(f), 6),
       round(avg((pr + re + f) / 3), 6) FROM r2
""")
def rouge_means(spark, sf):
    types = ["rouge1", "rouge2"]
    scores = O.rouge(pairs(spark, sf), types, "doc_id")
    means = O.mean_rouge(scores, types).withColumn("mean", (
        F.col("precision") + F.col("recall") + F.col("fmeasure")) / 3)
    return means.select("score_type", *[F.round(c, 6).alias(c) for c in (*PARTS, "mean")])


SAMPLES, SEED = 1000, 7
WEIGHTS = " + ".join(f"CAST(u >= {step} AS INT)" for step in POISSON.tolist())
BOUNDS = """
q AS (SELECT unnest(['low', 'mid', 'high']) AS bound)
SELECT 'rouge1' AS score_type, bound, round(CASE bound WHEN 'low' THEN pl WHEN 'mid' THEN pm
       ELSE ph END, 5) AS precision, round(CASE bound WHEN 'low' THEN rl WHEN 'mid' THEN rm
       ELSE rh END, 5) AS recall, round(CASE bound WHEN 'low' THEN fl WHEN 'mid' THEN fm
       ELSE fh END, 5) AS fmeasure
FROM q, (SELECT quantile_cont(pr, 0.025) AS pl, quantile_cont(pr, 0.5) AS pm,
                quantile_cont(pr, 0.975) AS ph, quantile_cont(re, 0.025) AS rl,
                quantile_cont(re, 0.5) AS rm, quantile_cont(re, 0.975) AS rh,
                quantile_cont(f, 0.025) AS fl, quantile_cont(f, 0.5) AS fm,
                quantile_cont(f, 0.975) AS fh FROM m)
"""


def digest_sql(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


def bounds(intervals):
    rows = F.explode(F.array(*[
        F.struct(F.lit(b).alias("bound"), F.col(b).alias("s")) for b in ("low", "mid", "high")]))
    return intervals.select("score_type", rows.alias("b")).select(
        "score_type", "b.bound", *[F.round(F.col("b.s")[p], 5).alias(p) for p in PARTS])


# Weighted means of each replicate, of scores r1 numbered by doc_id.
REPLICATES = f"""
b AS (SELECT b, {digest_sql(f"'{SEED}k' || b")} % {PRIME - 1} + 1 AS k,
             {digest_sql(f"'{SEED}c' || b")} % {PRIME} AS c
      FROM (SELECT unnest(range({SAMPLES})) AS b)),
u AS (SELECT b, pr, re, f, (k * ({digest_sql(f"'{SEED}' || doc_id")} % {PRIME}) + c) % {PRIME} AS u
      FROM r1, b),
w AS (SELECT b, pr, re, f, {WEIGHTS} AS w FROM u),
m AS (SELECT b, sum(pr * w) / sum(w) AS pr, sum(re * w) / sum(w) AS re, sum(f * w) / sum(w) AS f
      FROM w GROUP BY b)
"""


@query(f"""
WITH {pairs_sql()}, {score_sql("r1", 1)},
{REPLICATES},
{BOUNDS}
""")
def rouge_intervals(spark, sf):
    scores = O.rouge(pairs(spark, sf), ["rouge1"], "doc_id")
    return bounds(bootstrap(scores, ["rouge1"], "doc_id", 0.95, SAMPLES, SEED))


@query(f"""
WITH {pairs_sql()}, {score_sql("r1", 1)},
ranked AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n, * FROM r1),
z0 AS (SELECT b, (CAST('0x' || substr(md5('{SEED}:' || b || ':0'), 1, 16) AS UHUGEINT) + i::UHUGEINT * {GOLDEN}::UHUGEINT) % {1 << 64}::UHUGEINT AS z
       FROM (SELECT unnest(range({SAMPLES})) AS b),
            (SELECT unnest(range(1, (SELECT count(*) FROM r1) + 1)) AS i)),
z1 AS (SELECT b, xor(z::UBIGINT, z::UBIGINT >> 30)::UHUGEINT * {0xBF58476D1CE4E5B9}::UHUGEINT % {1 << 64}::UHUGEINT AS z FROM z0),
z2 AS (SELECT b, xor(z::UBIGINT, z::UBIGINT >> 27)::UHUGEINT * {0x94D049BB133111EB}::UHUGEINT % {1 << 64}::UHUGEINT AS z FROM z1),
draws AS (SELECT b, CAST(xor(z::UBIGINT, z::UBIGINT >> 31) % CAST((SELECT count(*) FROM r1) AS UBIGINT) AS BIGINT) AS r FROM z2),
m AS (SELECT b, avg(pr) AS pr, avg(re) AS re, avg(f) AS f FROM draws JOIN ranked USING (r)
      GROUP BY b),
{BOUNDS}
""")
def rouge_intervals_exact(spark, sf):
    """Draws with replacement, as many as there are documents; the SQL has one cell of draws."""
    scores = O.rouge(pairs(spark, sf), ["rouge1"], "doc_id")
    return bounds(bootstrap(scores, ["rouge1"], "doc_id", 0.95, SAMPLES, SEED, "exact"))
