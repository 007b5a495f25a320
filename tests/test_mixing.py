import hashlib
import math

import pytest

from corpusforge.operators import mixing as M

SLICED = {"rows_per_slice": 10}


def hashed(keys, seed=42):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{seed}{k}".encode()).hexdigest(), k))


def test_split(spark):
    df = spark.range(101).withColumnRenamed("id", "k")
    rows = M.train_test_split(df, "k", 0.1).collect()
    tests = {r["k"] for r in rows if r["split"] == "test"}
    assert tests == set(hashed(range(101))[:11]) and len(rows) == 101


def test_samples_and_heads(spark):
    df = spark.range(200).withColumnRenamed("id", "k")
    want = set(hashed(range(200))[:30])
    assert {r["k"] for r in M.sample_n(df, "k", 30).collect()} == want
    assert M.sample_n(df, "k", 0).count() == 0 and M.sample_n(df, "k", 500).count() == 200
    plan = M.head(df, 30, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # the rows themselves stay where they are
    assert {r["k"] for r in M.head(df, 30, ["k"], **SLICED).collect()} == set(range(30))
    assert {r["k"] for r in M.head_percent(df, 10, ["k"], **SLICED).collect()} == set(range(20))
    assert M.limit_items(df, None, ["k"]).count() == 200


@pytest.mark.parametrize("options", [{}, SLICED])
@pytest.mark.parametrize("chunk", [3, 10_000])
def test_interleave(spark, monkeypatch, options, chunk):
    monkeypatch.setattr(M, "COPIES_PER_CHUNK", chunk)
    sizes = {"a": 1, "b": 17, "c": 5}
    rows = [(s, i) for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "s string, o long")
    got = {r["position"]: (r["s"], r["o"])
           for r in M.interleave(df, "s", ["o"], **options).collect()}
    want = [(s, i % n) for i in range(17) for s, n in sorted(sizes.items())]
    assert [got[p] for p in range(len(want))] == want and len(got) == len(want)


def test_weighted_mix(spark):
    rows = [("a", i) for i in range(4)] + [("b", 100 + i) for i in range(30)]
    df = spark.createDataFrame(rows, "s string, k long")
    weights = spark.createDataFrame([("a", 3.0), ("b", 4.0)], "s string, weight double")
    weights = M.normalize_weights(weights)
    got = M.weighted_mix(df, "s", "k", weights, 26).collect()
    quota = {"a": 11, "b": 15}
    for s, n in quota.items():
        order = hashed([k for t, k in rows if t == s])
        drawn = {r["draw"]: r["k"] for r in got if r["s"] == s}
        assert drawn == {i: order[i % len(order)] for i in range(n)}


def test_batches(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    rows = M.train_batches(df, "k", 8).collect()
    order = hashed(range(50))
    assert {(r["batch"], r["place"]): r["k"] for r in rows} == {
        (i // 8, i % 8): order[i] for i in range(48)}
    for n, size in ((50, 8), (7, 10), (48, 8)):
        rows = M.eval_batches(spark.range(n).withColumnRenamed("id", "k"), ["k"], size,
                              **SLICED).orderBy("k").collect()
        batches = math.ceil(n / size)
        small, larger = divmod(n, batches)
        want = [b for b in range(batches) for _ in range(small + (b < larger))]
        assert [r["batch"] for r in rows] == want


def test_step_budget(spark):
    row = M.step_budget(spark.range(101), 4, 2, 3).first()
    assert tuple(row) == (101, 101 / 8, 37, 25, 75)


def test_concat(spark):
    a = spark.createDataFrame([(1, "x")], "i int, t string")
    b = spark.createDataFrame([("y", 2)], "t string, i int")
    assert sorted(map(tuple, M.concat_sources([a, b]).collect())) == [(1, "x"), (2, "y")]
