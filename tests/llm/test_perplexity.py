import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusforge.llm import perplexity as p


def plain_metrics(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    windows = collections.defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i:i + 5])].append(i)
    hit = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    return [len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(hit), len(words) < 10 or 100 * len(hit) > 20 * len(words)]


def symbols_of(text):
    points = [32 if 9 <= ord(c) <= 13 else ord(c) for c in text]
    return [0] * 4 + [x if x < 4096 else 2048 + x * 40503 % 2048 for x in points]


def plain_model(texts):
    """Modified Kneser-Ney with dictionaries; returns ln P(last | four before)."""
    runs, holders = collections.Counter(), collections.Counter()
    for text in texts:
        found = symbols_of(text)
        own = [tuple(found[i:i + 5]) for i in range(len(found) - 4)]
        runs.update(own)
        holders.update(set(own))
    tables = {5: {g: n for g, n in runs.items() if holders[g] > 1}}
    for k in (4, 3, 2, 1):
        tables[k] = collections.Counter(g[1:] for g in tables[k + 1])
    everything = {**tables, 5: runs}
    cut, totals = {}, {}
    for k in range(1, 6):
        n = [sum(c == m for c in everything[k].values()) for m in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else None
        shares = [2 * y * n[2] / n[1] if n[1] else None, 3 * y * n[3] / n[2] if n[2] else None,
                  4 * y * n[4] / n[3] if n[3] else None] if y is not None else [None] * 3
        cut[k] = [max(.1 * m, min(.9 * m, m - x if x is not None else .5 * m)) for m, x in zip((1, 2, 3), shares)]
        totals[k] = collections.Counter()
        for g, c in everything[k].items():
            totals[k][g[:-1]] += c

    def probability(g):
        k = len(g)
        if not k:
            return 1 / 4096
        held = sum(c - cut[k][min(c, 3) - 1] for h, c in tables[k].items() if h[:-1] == g[:-1])
        shorter = probability(g[1:])
        if not any(h[:-1] == g[:-1] for h in tables[k]):
            return shorter
        total, c = totals[k][g[:-1]], tables[k].get(g, 0)
        return (c - cut[k][min(c, 3) - 1] if c else 0) / total + max(1 - held / total, 1e-9) * shorter

    return lambda g: math.log(probability(tuple(g)))


def test_base_metrics_against_plain_code():
    draw = random.Random(3)
    texts = ["".join(draw.choices(["a", "b", "c ", " d", "\n", "é", "#", "| ", "\x0b", "\x85", "漢 "], k=draw.randint(0, 120)))
             for _ in range(400)]
    raw = [t.encode() for t in texts]
    rows = p.measure(raw)
    assert [r["n_scored"] for r in rows] == list(map(len, texts))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert [[r[n] for n in names] for r in rows] == [plain_metrics(t) for t in texts]


TEXTS = [
    "The cat sat on the mat and the dog sat on the cat, all day.", "The dog sat on a mat with the cat; all the day long.",
    "A man, a plan, a canal: panama and the cat on the mat again!", "the the the cat cat cat sat sat mat mat day day one two.",
    "\u6f22\u5b57 and the cat on the mat, \u6f22\u5b57 on the day 12 34 56 78 90 yes no",
]


def corpus_of(stored, extra=()):
    return stored([(i, t, "en", "s", 0) for i, t in enumerate([*TEXTS, *extra])])


@pytest.mark.parametrize("most", [1 << 22, 40])
def test_equals_plain_kneser_ney(stored, monkeypatch, most):
    """In one shard or in many, scores are those of dictionaries."""
    monkeypatch.setattr(p, "MODEL_ROWS", most)
    docs = corpus_of(stored, ["too short", "", None])
    model = p.train_model(docs)
    assert (len(list(p.shards_of(model))) > 1) == (most == 40)
    score = plain_model(TEXTS)
    for r in p.measured(docs, model).collect():
        if r.text:
            found = symbols_of(r.text)
            want = -sum(score(found[i:i + 5]) for i in range(len(r.text))) / len(r.text)
            assert r.metrics.log_perplexity == pytest.approx(want, rel=1e-5)


def test_probabilities_sum_to_one(stored):
    shard = list(p.shards_of(p.train_model(corpus_of(stored))))[0][2][p.number_of("en")]
    codes = np.unique(p.grams_of([t.encode() for t in TEXTS])[0] >> p.BITS)[:60].tolist()
    for context in [*codes, 123456789]:
        grams = (context & ((1 << 4 * p.BITS) - 1)) << p.BITS | np.arange(p.SYMBOLS_KNOWN)
        assert np.exp(shard.score(grams)).sum() == pytest.approx(1, abs=1e-4)


def test_counts_and_batches(stored, monkeypatch):
    monkeypatch.setattr(p, "HELD", 50)
    docs = corpus_of(stored, ["too short", "", None])
    counts = {r.gram: (r.n, r.texts) for r in p.count_grams(docs).collect()}
    runs, holders = collections.Counter(), collections.Counter()
    for t in TEXTS:
        own = p.grams_of([t.encode()])[0].tolist()
        runs.update(own)
        holders.update(set(own))
    assert counts == {g: (runs[g], holders[g]) for g in runs}


def test_counts_are_passed_on_in_small_batches(monkeypatch):
    monkeypatch.setattr(p, "FRESH", 30, raising=False)
    monkeypatch.setattr(p, "PASSED", 7, raising=False)
    texts = [f"one two three four five six seven eight nine ten {i} {i * i}" for i in range(600)]
    langs = [["en", None, "de"][i % 3] for i in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(texts)], ["lang", "text"])
    runs, holders, got = collections.Counter(), collections.Counter(), collections.defaultdict(lambda: [0, 0])
    for lang, text in zip(langs, texts):
        own = p.grams_of([text.encode()])[0].tolist()
        runs.update((lang, g) for g in own)
        holders.update((lang, g) for g in set(own))
    for out in p._count(iter([batch])):
        assert 0 < out.num_rows <= 7
        for lang, gram, n, held in zip(*(c.to_pylist() for c in out.columns)):
            got[lang, gram][0] += n
            got[lang, gram][1] += held
    assert got == {g: [runs[g], holders[g]] for g in runs}


def prose(draw, words, n):
    sentences = []
    while n > 0:
        k = draw.randint(4, 12)
        sentences.append(" ".join(draw.choices(words, k=k)).capitalize() + ".")
        n -= k
    return " ".join(sentences)


def test_bands_reject_what_they_should(stored):
    """Above the band: letters, words, digits and languages out of place. Below it: one long word
    of the corpus over and over. The base rules are put aside.
    """
    draw = random.Random(4)
    english = ["the", "river", "stone", "under", "green", "window", "morning", "letter", "walks", "over", "a", "with", "small"]
    german = ["der", "Fluss", "unter", "dem", "Fenster", "schreibt", "einen", "Brief", "und", "geht", "langsam", "heim", "mit"]
    rows = [(i, prose(draw, english, draw.randint(60, 300)), "en") for i in range(500)]
    rows += [(1000 + i, prose(draw, german, draw.randint(60, 300)), "de") for i in range(500)]
    bad = {}
    for i in range(20):
        words = rows[i][1].split()
        letters = list(rows[i][1])
        draw.shuffle(words)
        draw.shuffle(letters)
        bad[2000 + i] = "words", " ".join(words), "en"
        bad[2100 + i] = "letters", "".join(letters), "en"
        bad[2200 + i] = "digits", " ".join(str(draw.randrange(10**6)) for _ in range(100)), "en"
        bad[2300 + i] = "language", rows[500 + i][1], "en"
        bad[2400 + i] = "phrases", " ".join(["morning"] * (200 + i)), "en"
    docs = stored([(i, t, lang, "s", 0) for i, t, lang in [*rows, *((k, *v[1:]) for k, v in bad.items())]])
    found = p.measured(docs, p.train_model(docs))
    bands = p.perplexity_bands(found)
    middle = {r.band: r.middle for r in bands.collect()}
    kept, below = set(), collections.Counter()
    for r in p.judged(found.withColumn("metrics", F.col("metrics").withField("base_failed", F.lit(False))), bands).collect():
        if r.kept:
            kept.add(r.doc_id)
        elif r.metrics.log_perplexity < middle[r.lang]:
            below[bad.get(r.doc_id, ("clean",))[0]] += 1
    gone = collections.Counter(kind for k, (kind, *_) in bad.items() if k not in kept)
    assert sum(i in kept for i, *_ in rows) >= .98 * len(rows)
    assert all(gone[kind] >= 18 for kind in ("letters", "digits", "language", "phrases")), gone
    assert gone["words"] >= 15, gone
    assert below["phrases"] >= 18 and not any(below[k] for k in ("letters", "digits", "language", "words"))
    assert {r.doc_id for r in p.quality_filter(docs).collect()} <= kept


def test_odd_rows(odd_documents, no_documents):
    docs = odd_documents.withColumn("metrics", F.lit("m")).withColumn("band", F.lit(1)).withColumn("kept", F.lit(None))
    kept = p.quality_filter(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {4, 5, 6, 10}
    assert kept.where("doc_id = 5").count() == 2
    assert p.quality_filter(no_documents).count() == 0
    assert p.quality_filter(odd_documents.drop("lang").withColumn("lang", F.lit(7))).count() > 0
    found = p.measured(odd_documents, p.train_model(odd_documents)).where("doc_id IN (1, 3)").select("metrics.*")
    assert [(r.n_words, r.base_failed, r.log_perplexity) for r in found.collect()] == [(0, True, None)] * 2


def test_a_band_changes_steadily_with_the_number_of_texts(spark):
    def bands(others, rare):
        found = spark.range(others + rare).select(
            "id", F.expr(f"CASE WHEN id < {rare} THEN 'xx' ELSE 'en' END").alias("lang"),
            F.struct(F.lit(False).alias("base_failed"), F.lit(400).cast("long").alias("n_scored"),
                     F.expr("2 + (id % 500) / 500").alias("log_perplexity")).alias("metrics"))
        return found, p.perplexity_bands(found)

    small, large = (bands(n, 40)[1].where("band = 'xx'").collect() for n in (1000, 100_000))
    assert small == large and len(large) == 1  # other languages do not matter
    widths = []
    for rare in (1, 29, 30, 31, 1000):
        row = bands(1000, rare)[1].where("band = 'xx'").first()
        widths.append(1 + p.FEW_TEXTS / row.texts)
    assert widths == sorted(widths, reverse=True) and widths[1] / widths[3] < 1.05
    found, known = bands(1000, 1)
    assert [r.kept for r in p.judged(found.where("id = 0"), known).collect()] == [True]
