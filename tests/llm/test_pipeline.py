import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from corpusforge.llm import common
from corpusforge.llm.common import saved
from corpusforge.llm.decontamination import decontaminate
from corpusforge.llm.jaccard_join import keep_leaders
from corpusforge.llm.line_chunks import drop_repeated_chunks
from corpusforge.llm.packing import pack_texts
from corpusforge.llm.perplexity import quality_filter
from corpusforge.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.fixture(scope="module")
def stages(spark):
    docs = saved(spark.read.parquet(f"{SF}/documents.parquet"))
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(saved(stage(spark, tables[-1], SF)))
    return tables


def test_columns_stay_until_the_last_stage(stages):
    for found in stages[1:-1]:
        assert found.dtypes == stages[0].dtypes


def test_each_stage_takes_effect(stages):
    raw, rules, lines, near, clean, packed = stages
    assert 0 < rules.count() < raw.count()
    assert rules.join(raw, raw.columns, "left_anti").isEmpty()
    assert lines.count() == rules.count()
    changed = lines.alias("a").join(rules.alias("b"), "doc_id").where("a.text <> b.text")
    assert not changed.isEmpty() and changed.where("length(a.text) >= length(b.text)").isEmpty()
    assert near.count() < lines.count()
    assert near.groupBy("text").count().where("count > 1").isEmpty()
    assert clean.where(F.length("text") != F.col("n_chars")).isEmpty()
    per = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("whole"))
    assert per.where("n <> whole").isEmpty() and per.count() == clean.count()


def test_run_is_the_chain_of_stages(spark, stages):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    found = corpus_pipeline.run(spark, SF).select(*columns)
    assert found.exceptAll(stages[-1].select(*columns)).isEmpty() and found.count() == stages[-1].count()


def test_stages_on_odd_and_empty_tables(spark, odd_documents, no_documents):
    for docs in (odd_documents.withColumn("row", F.lit(1)), no_documents):
        for _, stage in corpus_pipeline.STAGES:
            docs = saved(stage(spark, docs, SF))
        assert "sequence_id" in docs.columns


def test_texts_reach_python_in_small_batches(spark, stored, monkeypatch):
    monkeypatch.setattr(common, "BATCH_BYTES", 1 << 18)
    docs = stored([(i, f"{i} " + "word " * 1000, "en", "a", 1) for i in range(400)], parts=1)
    before = spark.conf.getAll.get(common.BATCH_SETTING)
    spark.conf.unset(common.BATCH_SETTING)

    def largest():
        return docs.select("text").mapInArrow(lambda batches: (
            pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").agg(F.max("n")).first()[0]

    try:
        assert largest() == 400
        spark.conf.set(common.BATCH_SETTING, "2m")  # the session's own size
        quality_filter(docs)
        assert spark.conf.get(common.BATCH_SETTING) == "2m" and largest() > 300
        for step in (quality_filter, drop_repeated_chunks, keep_leaders, pack_texts,
                     lambda d: decontaminate(d, docs.selectExpr("doc_id AS item_id", "text").limit(1))):
            spark.conf.unset(common.BATCH_SETTING)
            step(docs)
            assert 1 < largest() < 100
    finally:
        spark.conf.unset(common.BATCH_SETTING)
        if before is not None:
            spark.conf.set(common.BATCH_SETTING, before)
