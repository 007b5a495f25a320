import random

import pytest
from pyspark.sql import functions as F

from corpusforge.operators import ordered

SMALL = {"rows_per_slice": 15}


def rows_of(spark, n=600, seed=1):
    rng = random.Random(seed)
    names = ["hot"] * (n // 3) + [rng.choice("abcd") for _ in range(n - n // 3)]
    rows = [(names[i], i * 3, rng.randint(0, 9)) for i in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, o long, v long").repartition(5)


@pytest.mark.parametrize("options", [{}, SMALL])
def test_rank_and_total(spark, options):
    rows, df = rows_of(spark)
    rows_ = ordered.sliced(df, ["g"], ["o"], **options)
    assert (ordered.SLICE in rows_.columns) == bool(options)
    got = ordered.running_totals(rows_, ["g"], ["o"], {"t": F.col("v"), "r": F.lit(1)}).collect()
    want, rank, total = {}, {}, {}
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        want[o] = (total.get(g, 0), rank.get(g, 0))
        total[g] = total.get(g, 0) + v
        rank[g] = rank.get(g, 0) + 1
    assert {r["o"]: (r["t"], r["r"]) for r in got} == want


@pytest.mark.parametrize("options", [{}, SMALL])
def test_previous_value(spark, options):
    rows, df = rows_of(spark)
    got = ordered.previous_value(ordered.sliced(df, ["g"], ["o"], **options), ["g"], ["o"], F.col("v"), "p").collect()
    last, want = {}, {}
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        want[o] = last.get(g)
        last[g] = v
    assert {r["o"]: r["p"] and r["p"]["value"] for r in got} == want


def test_null_groups_and_text_order(spark):
    rows = [(None if i % 3 else "k", f"{i:04d}", 1) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, o string, v long")
    got = ordered.rank_in_order(df, ["g"], ["o"], "r", **SMALL).collect()
    assert len(got) == 300
    assert sorted(r["r"] for r in got if r["g"] is None) == list(range(200))
    by_order = [r["r"] for r in sorted(got, key=lambda r: r["o"]) if r["g"] == "k"]
    assert by_order == list(range(100))


def test_composite_order(spark):
    rows = [(i % 5, i) for i in range(400)]
    df = spark.createDataFrame(rows, "a int, b long")
    got = ordered.rank_in_order(df, [], ["a", "b"], "r", **SMALL).orderBy("r").collect()
    assert [(r["a"], r["b"]) for r in got] == sorted(rows)
    assert [r["r"] for r in got] == list(range(400))


def test_hash_rank(spark):
    import hashlib
    df = spark.range(500).withColumnRenamed("id", "k")
    got = {r["k"]: r["rank"] for r in ordered.hash_rank(df, "k", 42).collect()}
    assert got == {r["k"]: r["rank"] for r in ordered.hash_rank(df, "k", 42, rows_per_slice=3).collect()}
    order = sorted(range(500), key=lambda k: hashlib.md5(f"42{k}".encode()).hexdigest())
    assert got == {k: i for i, k in enumerate(order)}


def test_only_large_groups_are_sliced(spark):
    rows = [("hot" if i % 2 else f"g{i}", i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, o long")
    cut = ordered.sliced(df, ["g"], ["o"], rows_per_slice=50)
    found = {r["g"]: r["n"] for r in cut.groupBy("g").agg(F.count_distinct("_slice").alias("n")).collect()}
    assert found.pop("hot") >= 3 and set(found.values()) == {1}
    assert ordered.SLICE not in ordered.sliced(df.where("g <> 'hot'"), ["g"], ["o"], rows_per_slice=50).columns


def test_plans_do_not_grow_with_the_slices(spark):
    df = spark.range(4000).select(F.col("id").alias("o"), F.lit("x").alias("g"))

    def plan(rows):
        return len(ordered.rank_in_order(df, ["g"], ["o"], rows_per_slice=rows)._jdf.queryExecution().optimizedPlan().toString())

    assert abs(plan(2000) - plan(20)) < 200
    got = ordered.rank_in_order(df, ["g"], ["o"], rows_per_slice=20)
    assert got.where("rank <> o").count() == 0


@pytest.mark.parametrize("n", [0, 1, 77, 500, 900])
def test_first_rows_in_both_ways(spark, monkeypatch, n):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("o"), (F.col("id") % 3).alias("a"))
    few = sorted(ordered.first_in_order(df, ["a", "o"], n).collect())
    monkeypatch.setattr(ordered, "FEWEST_ROWS", 0)
    assert sorted(ordered.first_in_order(df, ["a", "o"], n, rows_per_slice=30).collect()) == few
    assert [(r.a, r.o) for r in sorted(few, key=lambda r: (r.a, r.o))] == sorted((r.a, r.o) for r in df.collect())[:n]


def test_small_groups_take_one_shuffle(spark):
    df = spark.createDataFrame([(f"g{i % 40}", i) for i in range(400)], "g string, o long")
    ranked = ordered.rank_in_order(df, ["g"], ["o"], "r", rows_per_slice=20)
    assert ranked._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_slices_are_even(spark):
    df = spark.range(20000).withColumnRenamed("id", "o").withColumn("g", F.lit("x"))
    cut = ordered.sliced(df, ["g"], ["o"], rows_per_slice=1000)
    sizes = [r["count"] for r in cut.groupBy("_slice").count().collect()]
    assert 15 <= len(sizes) <= 30
    assert max(sizes) < 3 * 1000
