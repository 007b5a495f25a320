import math
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusforge.operators import metrics as X
from corpusforge.operators import spans as N
from tests.oracle import compare, connect


def test_word_offsets(spark):
    df = spark.createDataFrame([(" 가나 ab\x1cc\n",), ("",), (None,)], "t string")
    got = [[tuple(w) for w in r[0]] for r in df.select(N.word_offsets("t")).collect()]
    assert got == [[(1, 3), (4, 6), (7, 8)], [], []]


def test_span_labels(spark):
    rng = random.Random(4)
    tokens, spans = [], []
    for doc in range(6):
        at = 0
        for pos in range(80):
            n = rng.randint(1, 12)
            tokens.append((doc, pos, at, at + n))
            at += n + rng.randint(1, 3)
        for _ in range(300 if doc == 0 else 4):
            b = rng.randint(0, at)
            spans.append((doc, b, b + rng.randint(-12, 150), rng.choice([0.2, 0.5, 0.9])))
    spans = [s for s in spans if s[0] != 5]
    t = spark.createDataFrame(tokens, "doc_id int, pos int, begin int, end int")
    s = spark.createDataFrame(spans, "doc_id int, begin int, end int, prob double")
    want = {(d, p): int(any(x == d and q >= 0.5 and e >= b and e2 >= a for x, b, e2, q in spans))
            for d, p, a, e in tokens}
    got = {(r["doc_id"], r["pos"]): r["label"] for r in N.label_spans(t, s).collect()}
    assert got == want
    parts = N.label_spans(t, s, rows_per_slice=50)
    assert {(r["doc_id"], r["pos"]): r["label"] for r in parts.collect()} == want
    nested = t.groupBy("doc_id").agg(F.sort_array(F.collect_list(
        F.struct("begin", "end"))).alias("tokens")).join(
        s.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end", "prob")).alias("spans")),
        "doc_id")
    rows = nested.select("doc_id", N.label_tokens(F.col("tokens"), F.col("spans")).alias("l"))
    for r in rows.collect():
        assert r["l"] == [want[r["doc_id"], p] for p in range(80)]


def test_touching_ends_count(spark):
    t = spark.createDataFrame([(0, 0, 0, 3), (0, 1, 4, 6)], "doc_id int, pos int, begin int, end int")
    s = spark.createDataFrame([(0, 3, 3, 0.5)], "doc_id int, begin int, end int, prob double")
    assert {r["pos"]: r["label"] for r in N.label_spans(t, s).collect()} == {0: 1, 1: 0}


def test_long_spans_and_tokens_without_a_place(spark):
    t = spark.createDataFrame([(0, 0, 5, 9), (0, 1, 999_000, 999_003), (0, 2, 1_000_002, 1_000_004), (0, 3, None, None),
                               (None, 0, 1, 2)], "doc_id int, pos int, begin int, end int")
    s = spark.createDataFrame([(0, 7, 1_000_000, 0.9), (0, 7, None, 0.9), (0, None, 9, 0.9), (None, 0, 9, 0.9)],
                              "doc_id int, begin int, end int, prob double")
    got = {(r["doc_id"], r["pos"]): r["label"] for r in N.label_spans(t, s).collect()}
    assert got == {(0, 0): 1, (0, 1): 1, (0, 2): 0, (0, 3): 0, (None, 0): 0}
    assert {r["label"] for r in N.label_spans(t, s.where("prob > 1")).collect()} == {0}


def test_classification(spark):
    rows = [(0, 0), (0, 1), (1, 1), (1, 1), (2, 1), (0, 3)]
    df = spark.createDataFrame(rows, "label int, prediction int")
    row = X.evaluate(df, {"accuracy": {}, "macro": {"metric": "f1", "average": "macro"},
                          "binary": {"metric": "f1"}}).first()
    f = {0: 2 / 4, 1: 4 / 6, 2: 0, 3: 0}
    assert row["accuracy"] == pytest.approx(0.5)
    assert row["macro"] == pytest.approx(sum(f.values()) / 4)
    assert row["binary"] == pytest.approx(f[1])
    assert X.f1(df.where("label = 0 and prediction = 0")).first()[0] == 0.0
    assert X.accuracy(df).first()[0] == pytest.approx(0.5)


def test_token_metrics(spark):
    df = spark.createDataFrame([([1, -100, 0], [1, 1, 1]), ([1], [0])],
                               "labels array<int>, predictions array<int>")
    row = X.token_metrics(df).first()
    assert (row["accuracy"], row["f1"]) == (pytest.approx(1 / 3), pytest.approx(0.5))


def test_losses(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 4.0)], "b int, loss double")
    assert X.mean_loss(df, ["b"]).first()[0] == 3.0
    assert X.perplexity(df, ["b"]).first()["perplexity"] == pytest.approx(math.exp(3))
    big = spark.createDataFrame([(0, 1e4)], "b int, loss double")
    assert X.perplexity(big, ["b"]).first()["perplexity"] == math.inf


def test_preference(spark):
    pairs = [(0, 2.0, 1.0), (0, 0.0, 1000.0), (1, 1.0, 1.0)]
    df = spark.createDataFrame(pairs, "b int, chosen double, rejected double")
    losses = [math.log1p(math.exp(-1)), 1000.0, math.log(2)]
    row = X.preference_metrics(df).first()
    assert row["loss"] == pytest.approx(sum(losses) / 3)
    assert row["accuracy"] == pytest.approx(1 / 3)
    row = X.preference_metrics(df, batch=["b"]).first()
    assert row["loss"] == pytest.approx(((losses[0] + losses[1]) / 2 + losses[2]) / 2)


def test_logs(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(7)], "step int, loss double")
    assert [r["step"] for r in X.log_points(df, 3).collect()] == [3, 6]
    row = X.collate(df, ["loss"]).first()
    assert tuple(row) == ("eval/loss", 3.0, 7)


def test_sample_table_limits_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("c"), "id", F.col("id").alias("s"))
    table = X.sample_table(df, "c", "s", "id", 2)
    assert {(r["c"], r["id"]) for r in table.collect()} == {(0, 98), (0, 96), (1, 99), (1, 97)}
    assert "WindowGroupLimit" in table._jdf.queryExecution().executedPlan().toString()


def test_places_of_words_are_made_in_slices(monkeypatch):
    import pyarrow as pa

    from corpusforge.operators import spans as S

    sizes, offsets = [], S._offsets
    monkeypatch.setattr(S, "_offsets", lambda texts: sizes.append(len(texts)) or offsets(texts))
    got = S.word_offsets.func(pa.array([" a bb", None, ""] * 500)).to_pylist()
    assert max(sizes) <= 512
    assert got == [[{"begin": 1, "end": 2}, {"begin": 3, "end": 5}], [], []] * 500


@pytest.mark.parametrize("name", ["span_labels", "span_labels_in_row", "task_span_tokens"])
def test_spans_of_empty_texts(spark, tmp_path, name):
    """The place of a span was a remainder by the length of its text."""
    texts = ["one two  three", *[""] * 12, None, " \n", "five"]
    pq.write_table(pa.table({
        "doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts, "lang": ["en"] * len(texts),
        "source": ["s"] * len(texts), "n_chars": pa.array([len(t or "") for t in texts], pa.int64()),
    }), tmp_path / "documents.parquet")
    con = connect(str(tmp_path))
    con.execute("SET error_on_division_by_zero = false")  # a remainder by zero is null
    assert compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], str(tmp_path)) is None
