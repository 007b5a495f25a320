import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.functions.stemming import stem, stem_tokens
from corpusforge.functions.tokens import score_tokens
from corpusforge.operators import bootstrap as B
from corpusforge.operators import overlap as O
from corpusforge.operators.bootstrap import bootstrap

ALL = ["rouge1", "rouge2", "rougeL", "rougeLsum"]


def score(spark, types, target, prediction, **options):
    df = spark.createDataFrame([(0, target, prediction)], "k int, target string, prediction string")
    row = O.rouge(df, types, "k", **options).first()
    return {t: tuple(row[t]) for t in types}


@pytest.mark.parametrize("bad", ["rougen", "rouge0", "rouge10", "rougex"])
def test_invalid_types(spark, bad):
    with pytest.raises(ValueError):
        score(spark, [bad], "testing one two", "testing")


def test_literals(spark):
    types = ["rouge1", "rouge9", "rougeL", "rougeLsum"]
    assert list(score(spark, types, "testing one two", "testing")) == types
    one = score(spark, ["rouge1"], "testing one two", "testing")["rouge1"]
    assert one == pytest.approx((1, 1 / 3, 1 / 2))
    got = score(spark, ["rouge1", "rouge2", "rougeL"], "testing one two", "testing one")
    assert got["rouge1"] == pytest.approx((1, 2 / 3, 4 / 5))
    assert got["rouge2"] == pytest.approx((1, 1 / 2, 2 / 3))
    assert got["rougeL"] == pytest.approx((1, 2 / 3, 4 / 5))
    apart = score(spark, ["rougeL"], "testing one two", "testing two")["rougeL"]
    assert apart == pytest.approx((1, 2 / 3, 4 / 5))


def test_empty(spark):
    for values in score(spark, ALL, "testing one two", "").values():
        assert values == (0, 0, 0)


def test_korean(spark):
    got = score(spark, ALL, "안녕하세요 반가워요 오늘 뭐 먹을래요?", "안녕 ㅋ 반가워 오늘 뭐 할래?")
    for t in ("rouge1", "rougeL", "rougeLsum"):
        assert got[t] == pytest.approx((1 / 3, 0.4, 4 / 11))
    assert got["rouge2"] == pytest.approx((0.2, 0.25, 2 / 9))


def test_several_references(spark):
    rows = [(0, 0, "first text", "text first"), (0, 1, "first something", "text first")]
    df = spark.createDataFrame(rows, "k int, ref int, target string, prediction string")
    row = O.rouge_multi(df, ["rouge1", "rouge2", "rougeL"], "k", "ref").first()
    assert [row[t]["fmeasure"] for t in ("rouge1", "rouge2", "rougeL")] == [1, 0, 0.5]
    tie = spark.createDataFrame([(0, 1, "a b", "a"), (0, 0, "a c", "a")], df.schema)
    best = O.rouge_multi(tie, ["rouge1"], "k", "ref").first()["rouge1"]
    assert tuple(best) == pytest.approx((1, 1 / 2, 2 / 3))


def test_summary(spark):
    got = score(spark, ["rougeLsum"], "w1 w2 w3 w4 w5", "w1 w2 w6 w7 w8\nw1 w3 w8 w9 w5")
    assert got["rougeLsum"] == pytest.approx((0.4, 0.8, 0.8 * 0.4 * 2 / 1.2))
    for target, prediction in (("w1 w2 w3 w4 w5", ""), ("", "w1"), ("w1 w2", "/")):
        assert score(spark, ["rougeLsum"], target, prediction)["rougeLsum"] == (0, 0, 0)


def test_sentence_splitting(spark):
    def f(target, prediction, **options):
        return score(spark, ["rougeLsum"], target, prediction, stem=True, **options)[
            "rougeLsum"][2]

    target, prediction = "First sentence.\nSecond Sentence.", "Second sentence.\nFirst Sentence."
    assert f(target, prediction) == pytest.approx(1.0)
    target, prediction = target.replace("\n", " "), prediction.replace("\n", " ")
    assert f(target, prediction) == pytest.approx(0.5)
    assert f(target, prediction, split_summaries=True) == pytest.approx(1.0)


def test_own_tokenizer(spark):
    got = score(spark, ["rouge1", "rougeL"], "a,b", "A,b", tokenizer=lambda c: F.split(c, ","))
    assert got["rouge1"][2] == 0.5 and got["rougeL"][2] == 0.5


def test_stemming(spark):
    df = spark.createDataFrame([("the friends had a meeting",)], "t string")
    tokens = df.select(stem_tokens(score_tokens(F.col("t")))).first()[0]
    assert tokens == ["the", "friend", "had", "a", "meet"]
    pairs = {"caresses": "caress", "ponies": "poni", "ties": "tie", "relational": "relat",
             "conditional": "condit", "hopping": "hop", "hoping": "hope", "falling": "fall",
             "agreed": "agre", "happy": "happi", "triplicate": "triplic", "adjustment": "adjust",
             "adoption": "adopt", "controll": "control", "rate": "rate", "cease": "ceas",
             "dying": "die", "enjoy": "enjoy", "fulli": "fulli", "generalizations": "gener"}
    assert {w: stem(w) for w in pairs} == pairs


def subsequences(tokens):
    """All subsequences of a short list, as tuples."""
    return {tuple(t for i, t in enumerate(tokens) if mask >> i & 1) for mask in range(1 << len(tokens))}


def test_lcs():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.randint(0, 3) for _ in range(rng.randint(0, 8))]
        b = [rng.randint(0, 3) for _ in range(rng.randint(0, 8))]
        common = subsequences(a) & subsequences(b)
        longest = max(map(len, common))
        places = O.lcs_positions(a, b)
        assert O.lcs_length(a, b) == longest == len(places)
        assert places == sorted(set(places)) and tuple(a[i] for i in places) in common


# Which of several longest subsequences is taken, worked out by hand.
@pytest.mark.parametrize("ref,can,places", [
    ("12345", "2534", [1, 2, 3]), ("12", "89", []), ("aa", "a", [1]), ("aab", "ab", [1, 2]),
    ("abca", "a", [3]), ("ab", "ba", [0]), ("abab", "ba", [1, 2]),
])
def test_lcs_ties(ref, can, places):
    assert O.lcs_positions(ref, can) == places


def test_summary_hits():
    # Fixed values, worked out by hand.
    assert O.summary_hits(["12345"], ["12678", "13895"]) == 4
    assert O.summary_hits(["r"], [""]) == 0
    assert O.summary_hits(["ab", "ab"], ["ab"]) == 2
    assert O.summary_hits(["aaa"], ["a", "a"]) == 1
    assert O.summary_hits(["abc", "cba"], ["ac", "ca"]) == 4


def test_ngrams_against_counters(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices("abc", k=rng.randint(0, 12))),
             " ".join(rng.choices("abc", k=rng.randint(0, 12)))) for k in range(40)]
    df = spark.createDataFrame(rows, "k int, target string, prediction string")
    got = {r["k"]: r for r in O.rouge(df, ["rouge1", "rouge3"], "k").collect()}
    for k, target, prediction in rows:
        for n in (1, 3):
            def grams(text):
                tokens = text.split(" ")
                return Counter(tuple(tokens[i:i + n]) for i in range(len(tokens) - n + 1))
            t, p = grams(target), grams(prediction)
            hits = sum((t & p).values())
            want = (hits / max(sum(p.values()), 1), hits / max(sum(t.values()), 1))
            assert tuple(got[k][f"rouge{n}"])[:2] == pytest.approx(want)


def test_scores_need_no_shuffle(spark):
    df = spark.createDataFrame([(0, "a", "b")], "k int, target string, prediction string")
    for stem_them in (False, True):
        scores = O.rouge(df, ALL, "k", stem=stem_them)
        plan = scores._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan


THREE = [(0, (1.0, 1 / 3, 1 / 2)), (1, (0.0, 0.0, 0.0)), (2, (1.0, 1.0, 1.0))]
SCORES = "k int, rouge1 struct<precision:double,recall:double,fmeasure:double>"


def test_bootstrap_of_three(spark):
    df = spark.createDataFrame(THREE, SCORES)
    row = bootstrap(df, ["rouge1"], "k", 0.9, seed=123, method="exact").first()
    want = {"low": (1 / 3, 1 / 9, 1 / 6), "mid": (2 / 3, 4 / 9, 3 / 6), "high": (1, 7 / 9, 5 / 6)}
    for bound, values in want.items():
        assert tuple(row[bound]) == pytest.approx(values, abs=1e-8)
    row = bootstrap(df, ["rouge1"], "k", 0.0, seed=123, method="exact").first()
    for bound in ("low", "mid", "high"):
        assert tuple(row[bound]) == pytest.approx(want["mid"], abs=1e-8)


def test_bootstrap_arguments(spark):
    df = spark.createDataFrame(THREE, SCORES)
    with pytest.raises(ValueError):
        bootstrap(df, ["rouge1"], "k", 1.5)
    with pytest.raises(ValueError):
        bootstrap(df, ["rouge1"], "k", n_samples=0)
    with pytest.raises(ValueError):
        bootstrap(df, ["rouge1"], "k", method="auto")


def test_poisson_agrees_with_resampling(spark):
    rng = random.Random(5)
    rows = [(k, (rng.random(), rng.random() ** 2, float(rng.random() < 0.3))) for k in range(800)]
    df = spark.createDataFrame(rows, SCORES)
    exact = bootstrap(df, ["rouge1"], "k", method="exact").first()
    poisson = bootstrap(df, ["rouge1"], "k", method="poisson").first()
    for bound in ("low", "mid", "high"):
        assert tuple(poisson[bound]) == pytest.approx(tuple(exact[bound]), abs=0.006)


def test_cells_share_out_all_draws(spark, monkeypatch):
    df = spark.createDataFrame([(k, (k / 50, k % 7 / 7, .5)) for k in range(50)], SCORES)
    whole = bootstrap(df, ["rouge1"], "k", n_samples=400, method="exact").first()
    monkeypatch.setattr(B, "CELL", 7)
    for b in range(200):
        counts = [B.draws_of_cell(50, cell, 3, b) for cell in range(8)]
        assert sum(counts) == 50 and min(counts) >= 0
    shares = np.array([[B.draws_of_cell(50, cell, 3, b) for cell in range(8)] for b in range(2000)])
    sizes = np.array([7] * 7 + [1]) / 50  # multinomial: mean 50 p, variance 50 p (1 - p)
    assert shares.mean(axis=0) == pytest.approx(50 * sizes, rel=.06)
    assert shares.var(axis=0) == pytest.approx(50 * sizes * (1 - sizes), rel=.15)
    assert np.cov(shares[:, 0], shares[:, 5])[0, 1] == pytest.approx(-50 * sizes[0] * sizes[5], abs=.3)
    parts = bootstrap(df, ["rouge1"], "k", n_samples=400, method="exact").first()
    for bound in ("low", "mid", "high"):
        assert tuple(parts[bound]) == pytest.approx(tuple(whole[bound]), abs=.03)


def test_draws_are_even():
    draws = B.drawn(100_000, 10, 1, 2, 3)
    assert np.bincount(draws) == pytest.approx(np.full(10, 10_000), rel=.04)
    assert np.corrcoef(draws[:-1], draws[1:])[0, 1] == pytest.approx(0, abs=.01)
    assert (B.drawn(5, 10, 1, 2, 3) == draws[:5]).all() and (B.drawn(5, 10, 1, 3, 3) != draws[:5]).any()


def test_poisson_steps():
    assert [round(x / B.PRIME, 6) for x in B.POISSON[:4].tolist()] == [0.367879, 0.735759, 0.919699, 0.981012]
    assert len(B.POISSON) > 10 and B.POISSON[-1] < B.PRIME - 1


def test_means(spark):
    df = spark.createDataFrame(THREE, SCORES)
    row = O.mean_rouge(df, ["rouge1"]).first()
    assert row["precision"] == pytest.approx(2 / 3)
    both = O.mean_rouge(df, ["rouge1"], per_part=False).first()
    assert both["mean"] == pytest.approx((2 + 4 / 3 + 3 / 2) / 9)


def test_words_are_stemmed_once_in_a_task(monkeypatch):
    import pyarrow as pa

    from corpusforge.functions import stemming as S

    seen = []
    monkeypatch.setattr(S, "STEMS", {})
    monkeypatch.setattr(S, "stem", lambda word: seen.append(word) or stem(word))
    for _ in range(3):
        assert S.stemmed(pa.array(["running", "cat", None, "relational"])).to_pylist() == ["run", "cat", None, "relat"]
    assert sorted(seen) == ["relational", "running"]


def test_ngram_hits_of_many_pairs():
    rng = random.Random(3)
    for _ in range(50):
        sides = [[[rng.randrange(3) for _ in range(rng.randrange(8))] for _ in range(4)] for _ in range(2)]
        flat = np.array([x for side in sides for row in side for x in row], np.int64)
        for n in (1, 2, 3):
            wanted = []
            for pair in zip(*sides):
                t, p = (Counter(zip(*[row[i:] for i in range(n)])) for row in pair)
                wanted.append([(t & p).total(), t.total(), p.total()])
            sizes = [np.array([len(row) for row in side]) for side in sides]
            assert O.ngram_hits(flat, *sizes, n).T.tolist() == wanted


def test_draws_are_shared_out(spark):
    """Ranks of a small table come from one task; the draws from its rows must not."""
    scores = spark.range(50).select("id", F.struct(*[(F.col("id") / 50).alias(p) for p in O.PARTS]).alias("rouge1"))
    means = B.replicate_means(scores, ["rouge1"], "id", 1000, 7, "exact")
    plan = means._jdf.queryExecution().sparkPlan().toString()
    below = plan[plan.index("FlatMapGroupsInPandas"):]
    assert "RepartitionByExpression" in means._jdf.queryExecution().optimizedPlan().toString() or "REPARTITION_BY_NUM" in below
    assert means.count() == 1000
