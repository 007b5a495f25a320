"""Queries about files and streams.

Each writes files from the fixture tables to a new folder below the checkpoint
folder and reads them back.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusforge.functions import tokens as K
from corpusforge.operators import vocabulary as V
from corpusforge.operators.bootstrap import bootstrap
from corpusforge.operators.ordered import rank_in_order
from corpusforge.operators.overlap import align_records, rouge
from corpusforge.operators.schema import explode_documents
from corpusforge.plans.overlap import REPLICATES, SAMPLES, SEED, pairs, pairs_sql, score_sql, tokens_sql
from corpusforge.plans.registry import documents, joined, query, scratch, table, words_sql
from corpusforge.plans.tokens import BLOCK, ENCODED, WORD_VOCAB, blocks_sql, ids_sql
from corpusforge.sources import json_arrays as J
from corpusforge.sources import readers as R
from corpusforge.sources import scoring as C
from corpusforge.sources import writers as W
from corpusforge.streaming.blocks import write_blocks
from corpusforge.streaming.ingest import stream_corpus, stream_lines, write_corpus

PIECE = "source string, doc_id long, text string"


@query("SELECT doc_id, source, lang, text FROM documents")
def jsonl_files(spark, sf):
    folder = scratch(spark)
    W.write_jsonl(documents(spark, sf), f"{folder}/corpus")
    return R.read_jsonl(spark, f"{folder}/corpus/*.json",
                        "doc_id long, source string, lang string, text string")


@query("SELECT source AS name, doc_id, text FROM documents")
def files_by_source(spark, sf):
    folder = scratch(spark)
    named = documents(spark, sf).withColumn("source", F.concat(F.lit("team/"), "source"))
    W.write_by_source(named, f"{folder}/sources")
    back = spark.read.schema("doc_id long, text string, source string").json(f"{folder}/sources")
    return back.select(F.replace("source", F.lit("team__"), F.lit("")).alias("name"), "doc_id", "text")


@query("SELECT count(*) AS written FROM documents")
def counted_write(spark, sf):
    rows = W.write_counted(documents(spark, sf), f"{scratch(spark)}/counted")
    return spark.range(1).select(F.lit(rows).alias("written"))


@query("""
SELECT doc_id, line, CASE WHEN form = '' THEN NULL ELSE form END AS form FROM (
  SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS form
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
""")
def tsv_lines(spark, sf):
    """Lines of the documents through a tab-separated file without header."""
    folder = scratch(spark)
    lines = documents(spark, sf).select(
        F.concat_ws(".", F.lit("book"), "doc_id").alias("id"),
        F.posexplode(F.split("text", "\n", -1)).alias("line", "form"))
    lines.write.option("sep", "\t").option("escape", '"').option("emptyValue", "").option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(
        f"{folder}/book")
    back = R.read_tsv(spark, f"{folder}/book", ["id", "line", "form"])
    return back.select(F.split("id", r"\.")[1].cast("long").alias("doc_id"),
                       F.col("line").cast("int").alias("line"), "form")


@query("""
SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
GROUP BY line
""")
def text_files(spark, sf):
    folder = scratch(spark)
    W.write_text(documents(spark, sf), f"{folder}/plain")
    return spark.read.text(f"{folder}/plain").groupBy(F.col("value").alias("line")).agg(
        F.count("*").alias("n"))


@query("""
SELECT doc_id // 500 AS chunk, doc_id, text FROM documents WHERE doc_id // 500 % 3 <> 1
UNION ALL SELECT DISTINCT doc_id // 500, CAST(NULL AS BIGINT), 'broken' FROM documents
WHERE doc_id // 500 % 3 = 1
""")
def json_tree(spark, sf):
    """Folders of JSON files with 500 documents each; every third file is cut off.

    The documents of whole files come out, and one row per broken file.
    """
    folder = scratch(spark)
    chunks = documents(spark, sf).groupBy(F.floor(F.col("doc_id") / 500).alias("chunk")).agg(
        F.collect_list(F.struct("doc_id", "text")).alias("document"))
    body = F.to_json(F.struct("chunk", "document"))
    cut = F.when(F.col("chunk") % 3 == 1, F.substring(body, 1, 40)).otherwise(body)
    chunks.select((F.col("chunk") % 8).alias("folder"), cut.alias("body")).write.option(
        "maxRecordsPerFile", 1).partitionBy("folder").text(f"{folder}/tree")
    good, bad = R.read_json_tree(
        spark, f"{folder}/tree", "chunk long, document array<struct<doc_id long, text string>>",
        "*.txt")
    rows = explode_documents(good, "document", chunk=F.col("chunk"), doc_id=F.col("d.doc_id"),
                             text=F.col("d.text"))
    number = F.regexp_extract("content", r'"chunk":(\d+)', 1).cast("long")
    return rows.unionByName(bad.select(
        number.alias("chunk"), F.lit(None).cast("long").alias("doc_id"),
        F.lit("broken").alias("text")))


@query("""
WITH d AS (SELECT doc_id, text, doc_id // 50 AS part,
                  doc_id = max(doc_id) OVER (PARTITION BY doc_id // 50) AND doc_id // 50 % 3 = 1 AS is_open FROM documents)
SELECT part, doc_id, text FROM d WHERE NOT is_open
UNION ALL SELECT part, NULL, unnest(['the file ends inside a bracket', 'the file ends inside an element']) FROM d WHERE is_open
""")
def json_arrays(spark, sf):
    """Files of 50 documents that are one array each, read by byte ranges; every third lacks its last bracket."""
    folder = scratch(spark)
    lines = documents(spark, sf).select(F.floor(F.col("doc_id") / 50).alias("part"), "doc_id",
                                        F.to_json(F.struct("doc_id", "text")).alias("value"))
    place = Window.partitionBy("part").orderBy("doc_id")
    first = F.col("doc_id") == F.first("doc_id").over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = F.lead(F.lit(True)).over(place).isNull() & (F.col("part") % 3 != 1)
    marked = lines.where("part IS NOT NULL").repartition("part").select("part", "doc_id", F.concat(
        F.when(first, "[").otherwise(","), "value", F.when(ends, "\n]").otherwise("")).alias("value"))
    marked.sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").text(f"{folder}/arrays")
    good, bad = J.read_json_arrays(spark, f"{folder}/arrays", "doc_id long, text string", pattern="*.txt", range_bytes=1 << 15)
    part = F.regexp_extract("file", r"part=(\d+)", 1).cast("long").alias("part")
    return good.select(part, "doc_id", "text").unionByName(
        bad.select(part, F.lit(None).cast("long").alias("doc_id"), F.col("error").alias("text")))


def ordered_passages(spark, sf):
    """Benchmark passages in files of consecutive ids."""
    passages = table(spark, sf, "benchmark").select("item_id", "text")
    return passages.repartitionByRange(4, "item_id").sortWithinPartitions("item_id")


@query("SELECT item_id AS record, text, count(*) OVER () AS total FROM benchmark")
def delimited_records(spark, sf):
    """Records of files with a delimiter of several characters, numbered across files."""
    folder = scratch(spark)
    ordered_passages(spark, sf).select("text").write.option("lineSep", "<END>").text(
        f"{folder}/records")
    records = R.read_records(spark, f"{folder}/records/*.txt", "<END>")
    total = records.count()
    ranked = rank_in_order(records.drop("path").withColumnRenamed("record", "place"), [],
                           ["file", "place"], "record")
    return ranked.select("record", "text", F.lit(total).alias("total"))


@query("""
SELECT item_id AS record, text AS target, 'so: ' || text AS prediction FROM benchmark
""")
def aligned_records(spark, sf):
    folder = scratch(spark)
    passages = ordered_passages(spark, sf).persist()
    passages.select("text").write.option("lineSep", "<END>").text(f"{folder}/a")
    passages.select(F.concat(F.lit("so: "), "text")).write.option("lineSep", "<END>").text(f"{folder}/b")
    passages.unpersist()
    both = align_records(R.read_records(spark, f"{folder}/a/*.txt", "<END>"),
                         R.read_records(spark, f"{folder}/b/*.txt", "<END>"))
    return rank_in_order(both.withColumnRenamed("record", "place"), [], ["file", "place"],
                         "record").select("record", "target", "prediction")


def reply_files(spark, sf) -> str:
    """Folder with the turns that have a reply and, aligned with them, the replies."""
    folder = scratch(spark)
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    pairs = turns.join(after, ["conv_id", "turn"]).repartitionByRange(4, "conv_id", "turn") \
        .sortWithinPartitions("conv_id", "turn").persist()
    pairs.select("text").write.option("lineSep", "\x1e").text(f"{folder}/targets")
    pairs.select("reply").write.option("lineSep", "\x1e").text(f"{folder}/replies")
    pairs.unpersist()
    return folder


@query()
def score_job(spark, sf):
    """Turns against the turns before them, as files, to a CSV of intervals."""
    folder = reply_files(spark, sf)
    C.score_files(spark, f"{folder}/targets/*.txt", f"{folder}/replies/*.txt", f"{folder}/scores",
                  ["rouge1", "rougeL"], "\x1e")
    return spark.read.csv(f"{folder}/scores", header=True)


REPLIES = f"""pairs AS (
  SELECT row_number() OVER (ORDER BY a.conv_id, a.turn) - 1 AS doc_id, 0 AS reference,
         {tokens_sql("a.text")} AS t, {tokens_sql("b.text")} AS p
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"""


@query(f"""
WITH {REPLIES}, {score_sql("r1", 1)}, {REPLICATES},
q AS (SELECT 'P' AS part, quantile_cont(pr, [0.025, 0.5, 0.975]) AS q FROM m
      UNION ALL SELECT 'R', quantile_cont(re, [0.025, 0.5, 0.975]) FROM m
      UNION ALL SELECT 'F', quantile_cont(f, [0.025, 0.5, 0.975]) FROM m)
SELECT 'rouge1-' || part AS score_type, round(q[1], 4) AS low, round(q[2], 4) AS mid, round(q[3], 4) AS high FROM q
""")
def score_job_intervals(spark, sf):
    """The job with a scorer and an aggregator of its own: pairs are numbered over all files."""
    folder = reply_files(spark, sf)

    def intervals(scores):
        return bootstrap(rank_in_order(scores, [], ["file", "record"], "pair"), ["rouge1"], "pair", 0.95, SAMPLES, SEED)

    C.score_files(spark, f"{folder}/targets/*.txt", f"{folder}/replies/*.txt", f"{folder}/intervals", ["rouge1"], "\x1e",
                  scorer=lambda df: rouge(df, ["rouge1"], ["file", "record"]), aggregator=intervals)
    back = spark.read.csv(f"{folder}/intervals", header=True)
    return back.select("score_type", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("low", "mid", "high")])


@query(f"""
WITH {REPLIES}, {score_sql("r1", 1)}, {score_sql("r2", 2)}
SELECT doc_id AS id, round(a.pr, 6) AS "rouge1-P", round(a.re, 6) AS "rouge1-R", round(a.f, 6) AS "rouge1-F",
       round(b.pr, 6) AS "rouge2-P", round(b.re, 6) AS "rouge2-R", round(b.f, 6) AS "rouge2-F"
FROM r1 a JOIN r2 b USING (doc_id)
""")
def score_job_rows(spark, sf):
    """The same job without aggregation: one line per pair, numbered over all files."""
    folder = reply_files(spark, sf)
    types = ["rouge1", "rouge2"]
    C.score_files(spark, f"{folder}/targets/*.txt", f"{folder}/replies/*.txt", f"{folder}/rows",
                  types, "\x1e", aggregate=False)
    back = spark.read.csv(f"{folder}/rows", header=True)
    return back.select(F.col("id").cast("long").alias("id"), *[
        F.col(f"`{t}-{part}`").cast("double").alias(f"{t}-{part}") for t in types for part in "PRF"])


@query(f"""
WITH {pairs_sql()}, {score_sql("r1", 1)}
SELECT doc_id, round(pr, 6) AS "rouge1-P", round(re, 6) AS "rouge1-R", round(f, 6) AS "rouge1-F" FROM r1
""")
def score_table(spark, sf):
    """Scores of documents against passages, through the per-example CSV of six decimals."""
    folder = scratch(spark)
    scores = rouge(pairs(spark, sf), ["rouge1"], "doc_id")
    W.write_scores_csv(scores, "doc_id", ["rouge1"], f"{folder}/scores")
    back = spark.read.csv(f"{folder}/scores", header=True)
    return back.select(F.col("id").cast("long").alias("doc_id"), *[
        F.col(f"`rouge1-{part}`").cast("double").alias(f"rouge1-{part}") for part in "PRF"])


@query("SELECT doc_id, text, (SELECT count(*) FROM documents) AS rows FROM documents ORDER BY doc_id LIMIT 3")
def previewed(spark, sf):
    rows, top = R.preview(documents(spark, sf), 3, ["doc_id"])
    return top.select("doc_id", "text", F.lit(rows).alias("rows"))


def corpus_folder(spark, sf) -> str:
    folder = scratch(spark)
    W.write_jsonl(documents(spark, sf).select("source", "doc_id", "text"), f"{folder}/corpus")
    return folder


@query("SELECT source, doc_id, text FROM documents WHERE length(text) > 32")
def streamed_corpus(spark, sf):
    folder = corpus_folder(spark, sf)
    stream = stream_corpus(spark, f"{folder}/corpus", PIECE, files_per_trigger=3)
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/check").trigger(availableNow=True).start() \
        .awaitTermination()
    return spark.read.schema(PIECE).parquet(f"{folder}/out")


def deliveries(spark, sf, folder: str, parts: int = 6) -> None:
    """The documents as ``parts`` deliveries, one after the other in the order of their ids."""
    docs = documents(spark, sf).select("source", "doc_id", "text")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    width = (high - low) // parts + 1
    for part in range(parts):
        begin = low + part * width
        W.write_jsonl(docs.where(F.col("doc_id").between(begin, begin + width - 1)).coalesce(1), f"{folder}/in/{part}")


@query(f"WITH {WORD_VOCAB}, {ENCODED}, " + blocks_sql("SELECT * FROM encoded", "ids", BLOCK, "1"))
def streamed_blocks(spark, sf):
    """Packing over six micro-batches gives the blocks of the batch packer: a batch is sliced like
    any table, and hands over one incomplete block per source.
    """
    folder = scratch(spark)
    deliveries(spark, sf, folder)
    encode = V.word_encoder(V.word_vocab(documents(spark, sf)))
    stream = stream_corpus(spark, f"{folder}/in/*", PIECE, files_per_trigger=1)
    ids = stream.select("source", "doc_id", F.concat(F.array(F.lit(1)), encode(K.words(F.col("text")))).alias("ids"))
    write_blocks(ids, f"{folder}/out", f"{folder}/state", f"{folder}/check", BLOCK, availableNow=True).awaitTermination()
    blocks = spark.read.parquet(f"{folder}/out")
    return blocks.select("source", "block", joined("input_ids").alias("input_ids"))


@query("""
SELECT 'row' AS kind, source || ':' || doc_id AS content FROM documents WHERE lang <> 'de' AND length(text) > 32
UNION ALL SELECT 'line', substr('{"source":"' || source || '","doc_id":', 1, 20) FROM documents WHERE lang = 'de'
""")
def rejected_lines(spark, sf):
    """Lines that broke off on the way are set aside; the others arrive."""
    folder = scratch(spark)
    line = F.to_json(F.struct("source", "doc_id", "text"))
    sent = documents(spark, sf).select(F.when(F.col("lang") == "de", F.substring(line, 1, 20)).otherwise(line))
    W.write_text(sent.toDF("text"), f"{folder}/in")
    lines = stream_lines(spark, f"{folder}/in", PIECE, files_per_trigger=2)
    write_corpus(lines, f"{folder}/out", f"{folder}/rejects", f"{folder}/check", availableNow=True).awaitTermination()
    rows = spark.read.parquet(f"{folder}/out").select(
        F.lit("row").alias("kind"), F.concat_ws(":", "source", "doc_id").alias("content"))
    return rows.unionByName(spark.read.parquet(f"{folder}/rejects").select(F.lit("line").alias("kind"), F.col("line").alias("content")))


@query("WITH ids AS (SELECT source, list_concat([3], " + ids_sql("text") + """) AS ids FROM documents
WHERE length(text) > 32), n AS (SELECT source, sum(len(ids)) AS n, sum(list_sum(ids)) AS s FROM ids GROUP BY source)
SELECT source, CAST(n // 128 AS BIGINT) AS blocks, CAST(n AS BIGINT) AS ids, CAST(s AS BIGINT) AS total FROM n
""")
def streamed_batches(spark, sf):
    """Packing over several micro-batches with carried tables: every id is in a block or in the
    last rest, and there are as many blocks as in one run."""
    folder = corpus_folder(spark, sf)
    stream = stream_corpus(spark, f"{folder}/corpus", PIECE, files_per_trigger=3)
    ids = stream.select("source", "doc_id", F.concat(F.array(F.lit("<s>")), K.words(F.col("text")))
                        .alias("words"))
    numbered = ids.select("source", "doc_id", F.transform("words", lambda w: F.length(w))
                          .alias("ids"))
    write_blocks(numbered, f"{folder}/out", f"{folder}/state", f"{folder}/check", BLOCK,
                 availableNow=True).awaitTermination()
    blocks = spark.read.parquet(f"{folder}/out").select("source", F.lit(1).alias("full"), F.col("input_ids").alias("ids"))
    batches = spark.read.parquet(f"{folder}/state")
    rest = batches.where(F.col("batch") == batches.agg(F.max("batch")).first()[0]).select(
        "source", F.lit(0).alias("full"), "ids")
    return blocks.unionByName(rest).groupBy("source").agg(
        F.sum("full").alias("blocks"), F.sum(F.size("ids")).cast("long").alias("ids"),
        F.sum(F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"))
