import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from corpusforge.llm import jaccard_join as j


def sets_of(text):
    words = (text or "").split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows, threshold=Fraction(4, 5)):
    sets = [sets_of(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if sets[a] == sets[b] or union and Fraction(len(sets[a] & sets[b]), union) >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[x] = y
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted((rows[i][0], min(groups[find(i)]), links[i]) for i in range(len(rows)))


def edited(draw, words, rate):
    return [draw.choice("uvwxyz") * 3 + str(draw.randint(0, 99)) if draw.random() < rate else w for w in words]


def corpus():
    draw = random.Random(11)
    rows = []
    for _ in range(60):
        base = [f"w{draw.randint(0, 500)}" for _ in range(draw.randint(1, 120))]
        rows += [" ".join(edited(draw, base, draw.choice([0, 0, .005, .01, .02, .05]))) for _ in range(draw.randint(1, 8))]
    rows += ["same text again and again"] * 5 + ["", "  \n", "a b", "a b", "c"]
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [1024, 3])
def test_equals_brute_force(stored, monkeypatch, block):
    monkeypatch.setattr(j, "BLOCK", block)
    rows = corpus()
    docs = stored([(i, t, "en", "s", 0) for i, t in rows], parts=4)
    got = sorted((r.key, r.class_id, r.n_links) for r in j.similar_texts(docs).collect())
    assert got == brute(rows)


def test_shingles_are_sets_of_word_runs():
    texts = ["a b c d e f", "a  b\tc\nd e f", "a b c d e", "a b", "b a", "", "a b c d e a b c d e"]
    sets = [frozenset(s.tolist()) for s in j.shingle_sets([t.encode() for t in texts])]
    for x, a in zip(texts, sets):
        assert len(a) == len(sets_of(x))
        for y, b in zip(texts, sets):
            assert len(a & b) == len(sets_of(x) & sets_of(y))


def test_texts_whose_letters_hash_alike_stay_apart(stored):
    """Thue-Morse words agree in every polynomial hash modulo 2**64; they are different texts."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    docs = stored([(1, a, "en", "s", 0), (2, b, "en", "s", 0), (3, a, "en", "s", 0)])
    assert sorted((r.key, r.class_id, r.n_links) for r in j.similar_texts(docs).collect()) == [(1, 1, 1), (2, 2, 0), (3, 1, 1)]
    assert sorted(r.doc_id for r in j.keep_leaders(docs.repartition(2, "text")).collect()) == [1, 2]


def test_least_matches():
    least = j.least_matches(Fraction(4, 5), 1e-6)
    assert len(least) == j.HASHES // j.STEP and sorted(least) == least
    assert all(0 < m < 0.8 * n for m, n in zip(least[1:], range(32, 129, 16)))


def test_one_of_each_group_stays(odd_documents, no_documents):
    docs = odd_documents.withColumn("row", F.lit("r")).withColumn("k1", F.lit(1))
    kept = j.keep_leaders(docs)
    assert kept.columns == docs.columns
    # Null, empty and blank texts are copies; so are the three equal texts.
    texts = sorted((r.text or "").strip()[:8] for r in kept.collect())
    assert len(texts) == 6 and texts.count("") == 1 and texts.count("one two") + texts.count("one two ") == 1
    assert j.similar_texts(no_documents).count() == 0
    assert j.keep_leaders(no_documents).count() == 0


def test_pairs_are_never_rows(spark, stored):
    draw = random.Random(3)
    base = [f"w{draw.randint(0, 900)}" for _ in range(150)]
    rows = [(i, " ".join(edited(draw, base, .004)), "en", "s", 0) for i in range(150)]
    found = j.similar_texts(stored(rows)).collect()
    assert len(found) == 150 and sum(r.n_links for r in found) > 10_000
