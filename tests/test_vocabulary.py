import random
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from corpusforge.functions.tokens import words
from corpusforge.operators import lengths as L
from corpusforge.operators import bpe_training as B
from corpusforge.operators import vocabulary as V

PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
SPECIAL = ["<pad>", "<s>", "</s>"]


def brute_force(texts, size, min_frequency):
    """One merge at a time, by count and then by smaller ids."""
    chars = V.byte_chars()
    pieces = SPECIAL + sorted(chars.values())
    ids = {p: i for i, p in enumerate(pieces)}
    types = Counter(w for t in texts for w in PATTERN.findall(t))
    split = {w: [ids[chars[b]] for b in w.encode()] for w in types}
    merges = []
    while len(pieces) < size:
        pairs = Counter()
        for w, n in types.items():
            for p in zip(split[w], split[w][1:]):
                pairs[p] += n
        if not pairs:
            break
        (a, b), n = min(pairs.items(), key=lambda kv: (-kv[1], kv[0]))
        if n < min_frequency:
            break
        merges.append((pieces[a], pieces[b]))
        for w, s in split.items():
            out, i = [], 0
            while i < len(s):
                if tuple(s[i:i + 2]) == (a, b):
                    out.append(len(pieces))
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            split[w] = out
        pieces.append(pieces[a] + pieces[b])
    return pieces, merges


def corpus():
    rng = random.Random(7)
    parts = ["the", "then", "there", "aaaa", "aaaaaaa", "가나", "가나다", "été", "it's", "12", "!!", "x\n"]
    return [" ".join(rng.choice(parts) for _ in range(30)) + "  end" for _ in range(40)]


@pytest.mark.parametrize("candidates, islands", [(1 << 15, 1 << 18), (7, 1 << 18), (64, 5), (1, 1)])
def test_bpe_equals_one_merge_at_a_time(spark, monkeypatch, candidates, islands):
    monkeypatch.setattr(B, "CANDIDATES", candidates)
    monkeypatch.setattr(B, "ISLANDS", islands)
    texts = corpus()
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    size = len(SPECIAL) + 256 + (60 if candidates > 1 else 6)
    pieces, merges = brute_force(texts, size, 5)
    vocab, ranked = B.train_bpe(df, vocab_size=size, min_frequency=5, special=SPECIAL)
    assert [r["piece"] for r in vocab.orderBy("id").collect()] == pieces
    assert [(r["left"], r["right"]) for r in ranked.orderBy("rank").collect()] == merges


def test_bpe_learns_until_pairs_are_rare(spark):
    """Random words: ties, long runs of one letter and merges of merges, to the frequency floor."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["a" * 40, "b" * 41]
    texts = [" ".join(rng.choices(words, k=40)) for _ in range(30)]
    pieces, merges = brute_force(texts, 10_000, 3)
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    vocab, ranked = B.train_bpe(df, vocab_size=10_000, min_frequency=3, special=SPECIAL)
    assert len(merges) > 100 and [r["piece"] for r in vocab.orderBy("id").collect()] == pieces
    assert [(r["left"], r["right"]) for r in ranked.orderBy("rank").collect()] == merges


def test_islands_are_runs_of_candidates(spark):
    types = spark.createDataFrame([([1, 2, 3, 9, 1, 2], 5), ([1, 2], 1), ([9, 9], 7), ([2, 3, 1], 2)], B.TYPES).coalesce(1)
    rows = B.islands(types, [(1, 2), (2, 3)]).collect()
    assert sorted((list(memoryview(r.island).cast("i")), r.n) for r in rows) == [([1, 2], 6), ([1, 2, 3], 5), ([2, 3], 2)]


def test_bpe_stops_at_the_minimum_frequency(spark):
    df = spark.createDataFrame([("abab ab",)], "text string")
    merges = B.train_bpe(df, vocab_size=1000, min_frequency=3, special=[])[1]
    assert [(r["left"], r["right"]) for r in merges.collect()] == [("a", "b")]
    assert B.train_bpe(df, vocab_size=1000, min_frequency=9, special=[])[1].count() == 0


def test_bpe_encode_and_decode(spark):
    texts = corpus() + ["<s>the there</s>", "", "한글 \U0001f600 <pad", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    vocab, merges = B.train_bpe(df, vocab_size=330, min_frequency=5, special=SPECIAL)
    ids = {r["piece"]: r["id"] for r in vocab.collect()}
    encode = V.bpe_encoder(vocab, merges, SPECIAL)
    rows = df.select("i", "text", encode(F.col("text")).alias("ids"))
    back = {r["i"]: r for r in rows.withColumn(
        "back", V.decode_bpe(F.col("ids"), vocab, SPECIAL)).withColumn(
        "plain", V.decode_bpe(F.col("ids"), vocab, SPECIAL, skip_special=True)).collect()}
    for i, text in enumerate(texts):
        assert back[i]["back"] == (text or "")
    special = back[40]
    assert special["ids"][0] == ids["<s>"] and special["ids"][-1] == ids["</s>"]
    assert special["plain"] == "the there"
    ranks = {(r["left"], r["right"]): r["rank"] for r in merges.collect()}
    chars = V.byte_chars()
    want = []
    for w in PATTERN.findall(texts[0]):
        symbols = [chars[b] for b in w.encode()]
        for pair in sorted(ranks, key=ranks.get):
            i = 0
            while i < len(symbols) - 1:
                if (symbols[i], symbols[i + 1]) == pair:
                    symbols[i:i + 2] = ["".join(pair)]
                i += 1
        want += [ids[s] for s in symbols]
    assert back[0]["ids"] == want


def test_words(spark):
    df = spark.createDataFrame([("b b a c a b",), ("",)], "text string")
    vocab = V.word_vocab(df, vocab_size=5, min_frequency=1, special=["<unk>", "<s>"])
    assert [r["piece"] for r in vocab.orderBy("id").collect()] == ["<unk>", "<s>", "b", "a", "c"]
    few = V.word_vocab(df, vocab_size=9, min_frequency=2, special=["<unk>"])
    assert [r["piece"] for r in few.orderBy("id").collect()] == ["<unk>", "b", "a"]
    encoded = df.select(V.word_encoder(few)(words(F.col("text"))).alias("ids"))
    assert [r["ids"] for r in encoded.collect()] == [[1, 1, 2, 0, 2, 1], []]
    assert encoded.select(V.decode_words(F.col("ids"), few)).first()[0] == "b b a <unk> a b"


def test_add_special(spark):
    vocab = spark.createDataFrame([(0, "<s>"), (7, "a")], "id int, piece string")
    got = V.add_special(vocab, ["x", "<s>", "y", "x"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(0, "<s>"), (7, "a"), (8, "x"), (9, "y")]


def test_lengths(spark):
    df = spark.createDataFrame([(i,) for i in [1, 2, 2, 3, 11]], "n int")
    row = L.length_profile(df, "n").first()
    assert (row["count"], row["mean"], row["min"], row["p50"], row["max"]) == (5, 3.8, 1, 2, 11)
    bins = L.length_histogram(df, "n", 5).orderBy("bin").collect()
    assert [r["count"] for r in bins] == [3, 1, 0, 0, 1]
    assert (bins[0]["begin"], bins[-1]["end"]) == (1.0, 11.0)
    same = spark.createDataFrame([(4,), (4,)], "n int")
    assert sum(r["count"] for r in L.length_histogram(same, "n", 3).collect()) == 2


def test_merge_word_against_whole_rounds():
    def rounds(symbols, ranks):
        while True:
            known = [(ranks[p], p) for p in zip(symbols, symbols[1:]) if p in ranks]
            if not known:
                return symbols
            _, best = min(known)
            merged = []
            for s in symbols:
                if merged and (merged[-1], s) == best:
                    merged[-1] = best[0] + best[1] + "\0"  # closed to the next symbol
                else:
                    merged.append(s)
            symbols = [s.rstrip("\0") for s in merged]

    rng = random.Random(1)
    for _ in range(1000):
        pieces, ranks = list("abc"), {}
        for _ in range(rng.randint(0, 8)):
            pair = (rng.choice(pieces), rng.choice(pieces))
            if pair not in ranks:
                ranks[pair] = len(ranks)
                pieces.append(pair[0] + pair[1])
        word = [rng.choice("abc") for _ in range(rng.randint(0, 14))]
        assert V.merge_word(word, ranks) == rounds(word, ranks)
    V.merge_word(list("ab" * 100_000), {("a", "b"): 0, ("ab", "ab"): 1})


def test_ids_are_made_in_slices(monkeypatch):
    import pyarrow as pa

    sizes, ids_of = [], V._ids_of
    monkeypatch.setattr(V, "_ids_of", lambda part, encode: sizes.append(len(part)) or ids_of(part, encode))
    lists = [["a", "bb"], None, [], ["ccc"]] * 400
    got = V._by_token(pa.array(lists, pa.list_(pa.string())), lambda t: [len(t)] * len(t))
    assert max(sizes) <= 512
    assert got.to_pylist() == [[1, 2, 2], [], [], [3, 3, 3]] * 400


def test_special_tokens_are_looked_for_by_their_first_characters(spark):
    df = spark.createDataFrame([("a < b <s>c",), ("no mark",), (None,)], "t string")
    made = df.select(V.pretokens(F.col("t"), ["<s>", "[x]"]).alias("p"))
    assert "(?=[\\x{3C}\\x{5B}])" in made._jdf.queryExecution().optimizedPlan().toString()
    assert [r["p"] for r in made.collect()] == [["a", " <", " b", " ", "<s>", "c"], ["no", " mark"], None]


def test_training_starts_with_few_candidates(spark, monkeypatch):
    """The first round asked for islands of all pairs, which are whole words."""
    from corpusforge.operators import bpe_training as B

    asked, islands = [], B.islands
    monkeypatch.setattr(B, "islands", lambda types, pairs: asked.append(len(pairs)) or islands(types, pairs))
    texts = [("".join(chr(97 + (i * 7 + j * j) % 26) for j in range(9)),) for i in range(400)]
    merges = B.train_bpe(spark.createDataFrame(texts, "text string"), vocab_size=72 + 256 + 60, min_frequency=2)[1].collect()
    assert asked[0] <= B.FIRST_CANDIDATES
    monkeypatch.setattr(B, "FIRST_CANDIDATES", 1 << 15)
    assert B.train_bpe(spark.createDataFrame(texts, "text string"), vocab_size=72 + 256 + 60, min_frequency=2)[1].collect() == merges
