import random

import pytest
from pyspark.sql import functions as F

from corpusforge.functions.tokens import words
from corpusforge.operators import packing as P

SLICED = {"rows_per_slice": 20}


def sequential(rows, size, bos):
    out = {}
    for source in {r[0] for r in rows}:
        stream = []
        for _, _, ids in sorted(r for r in rows if r[0] == source):
            stream += ([] if bos is None else [bos]) + ids
        for b in range(len(stream) // size):
            out[source, b] = stream[b * size:(b + 1) * size]
    return out


def docs_of(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        source = "hot" if i % 3 == 0 else f"s{rng.randint(0, 4)}"
        n = rng.choice([0, 1, 3, 8, 30, 200 if i % 50 == 0 else 5])
        rows.append((source, i, [rng.randint(10, 99) for _ in range(n)]))
    return rows


@pytest.mark.parametrize("options", [{}, SLICED])
@pytest.mark.parametrize("size,bos", [(8, 1), (16, None), (1, 1)])
def test_pack_blocks(spark, options, size, bos):
    rows = docs_of(size)
    df = spark.createDataFrame(rows, "source string, doc_id long, ids array<int>").repartition(5)
    got = P.pack_blocks(df, "source", ["doc_id"], "ids", size, bos, **options).collect()
    assert len(got) == len({(r["source"], r["block"]) for r in got})
    assert {(r["source"], r["block"]): r["input_ids"] for r in got} == sequential(rows, size, bos)


def test_short_texts_are_left_out(spark):
    rows = [("s", 0, "x" * 32), ("s", 1, "a b " * 10), ("s", 2, "c " * 20)]
    df = spark.createDataFrame(rows, "source string, doc_id long, text string")
    got = P.pack_long_texts(df, "source", ["doc_id"], "text", words, 4, "<s>").orderBy("block")
    tokens = sum((r["input_ids"] for r in got.collect()), [])
    assert tokens == (["<s>"] + ["a", "b"] * 10 + ["<s>"] + ["c"] * 20)[:40]


def test_pack_dialogs(spark):
    df = spark.createDataFrame([("s", 0, "0 : hi\n1 : yo")], "source string, doc_id long, text string")
    got = P.pack_dialogs(df, "source", ["doc_id"], "text", words, "</s>", 3, "<s>").first()
    assert got["input_ids"] == ["<s>", "<unused1>hi</s>", "<unused2>yo"]


def test_plan_shuffles_documents_once(spark):
    """Blocks inside a slice need no shuffle of their own."""
    df = spark.createDataFrame(docs_of(1), "source string, doc_id long, ids array<int>")
    plan = P.pack_blocks(df, "source", ["doc_id"], "ids", 8)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert physical.count("Exchange hashpartitioning") == 1


def test_sliced_ids_are_made_once(spark):
    """The encoder's result is stored; sums read lengths, not ids."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<int>")
    def encode(n):
        made.add(1)
        return [n] * 3

    df = spark.createDataFrame([("s", i) for i in range(60)], "source string, doc_id int")
    got = P.pack_blocks(df.withColumn("ids", encode("doc_id")), "source", ["doc_id"], "ids", 4, rows_per_slice=10)
    assert got.count() == 45 and made.value == 60
