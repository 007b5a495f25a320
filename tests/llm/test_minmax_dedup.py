import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.llm import minmax_dedup as m

BLANK = " \t\n\x0b\x0c\r"


def set_of(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else " " if c in BLANK else c for c in text or "")
    words = [w for w in text.split(" ") if w]
    return frozenset(tuple(words[i:i + 3]) for i in range(max(1, len(words) - 2))) if words else frozenset()


def brute(rows, threshold=Fraction(85, 100)):
    sets = [set_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if union and Fraction(len(sets[a] & sets[b]), union) >= threshold:
                root[find(a)] = find(b)
    smallest = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            smallest[find(i)] = min(key, smallest.get(find(i), key))
    out = []
    for i, (key, _) in enumerate(rows):
        component = smallest.get(find(i)) if sets[i] else key
        out.append((key, len(sets[i]), component, key == component))
    return sorted(out, key=str)


def found(docs):
    return sorted((tuple(r) for r in m.near_duplicates(docs).select("key", "n_shingles", "component_id", "kept").collect()), key=str)


def edited(draw, words, rate):
    return [draw.choice("uvwxyz") * 3 + str(draw.randint(0, 99)) if draw.random() < rate else w for w in words]


def corpus(seed=11):
    draw = random.Random(seed)
    rows = []
    for _ in range(50):
        base = [f"w{draw.randint(0, 500)}" for _ in range(draw.randint(1, 150))]
        rows += [draw.choice(BLANK).join(edited(draw, base, draw.choice([0, 0, .005, .01, .02, .05]))) for _ in range(draw.randint(1, 8))]
    rows += ["Same TEXT again and again", "same text\nagain  AND again", "", "  \n", "a b", "A b", "b a", "c", "C", "a b c", "ÄB c d", "äb c d"]
    draw.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [1024, 3])
def test_equals_brute_force(stored, monkeypatch, block):
    monkeypatch.setattr(m, "BLOCK", block)
    rows = corpus()
    assert found(stored([(i, t, "en", "s", 0) for i, t in rows], parts=4)) == brute(rows)


def test_chains_and_a_crowded_band(stored):
    """Copies with ever more edits: one leader cannot link them all, chains must be followed."""
    draw = random.Random(2)
    base = [f"w{i}" for i in range(100)]
    rows, words = [], base
    for i in range(60):  # each differs from the one before by one word
        words = [f"n{i}" if k == draw.randrange(100) else w for k, w in enumerate(words)]
        rows.append(" ".join(words))
    rows += [" ".join(edited(draw, base, draw.choice([.02, .05, .1]))) for _ in range(240)]
    draw.shuffle(rows)
    rows = list(enumerate(rows))
    assert found(stored([(i, t, "en", "s", 0) for i, t in rows], parts=4)) == brute(rows)


def test_both_extremes_estimate_the_similarity():
    draw = np.random.default_rng(1)
    errors = []
    for share in (.2, .5, .85):
        sets = []
        for _ in range(40):
            common = draw.integers(0, 2**63, int(300 * share), np.int64)
            own = draw.integers(0, 2**63, (2, 300 - len(common)), np.int64)
            sets += [np.unique(np.concatenate([common, o])).astype(np.uint64) for o in own]
        values = m.signatures(sets)
        same = (values[0::2] == values[1::2]).mean(axis=1)
        truth = int(300 * share) / (600 - int(300 * share))
        errors.append(abs(same.mean() - truth))
        # As many independent values would vary by this much; both ends of one permutation vary no more.
        assert same.std() < 1.3 * (truth * (1 - truth) / m.VALUES) ** .5
    assert max(errors) < .02
    assert m.VALUES == 2 * m.PERMUTATIONS and values.shape[1] == m.VALUES


def test_words_are_hashed_not_letters():
    """Texts whose rolling hashes agree modulo 2**64 (Thue-Morse words) have different shingles."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    x, y, z = m.shingle_sets([f"{a} {a} {a}".encode(), f"{b} {b} {b}".encode(), f"{a} {b}".encode()])
    assert not set(x.tolist()) & set(y.tolist()) and not set(z.tolist()) & set(x.tolist())


def test_odd_rows(stored, odd_documents, no_documents):
    docs = odd_documents.withColumns({c: F.lit(1) for c in ("key", "cls", "sig", "n", "band", "label")})
    assert found(docs) == brute([(r.doc_id, r.text) for r in odd_documents.collect()])
    assert found(no_documents) == []
    nameless = stored([(None, "only rows without a key", None, None, None)] * 2)
    assert found(nameless) == [(None, 3, None, True)] * 2


def test_copies_are_one_class(stored):
    rows = [(i, "hot text with some words in it" if i % 3 else f"other words {i} here") for i in range(3000)]
    out = m.near_duplicates(stored([(i, t, "en", "s", 0) for i, t in rows], parts=7))
    assert {(r.component_id, r["count"]) for r in out.groupBy("component_id").count().where("count > 1").collect()} == {(1, 2000)}
