import random
from hashlib import md5, sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from corpusforge.llm import conversation_trie as t

CONVERSATIONS = "conv_id long, turn long, role string, text string"
NAMES = ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def digest(role, text):
    return md5((md5((role or "").encode()).hexdigest() + md5((text or "").encode()).hexdigest()).encode()).hexdigest()


def ordered(rows):
    convs = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            convs.setdefault(conv_id, []).append((turn is not None, turn or 0, digest(role, text), role or "", text or ""))
    return {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def brute(convs):
    """Nodes as a plain dictionary of prefixes."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    rows = []
    for path, ids in members.items():
        below = [p for p in members if p[:len(path)] == path]
        leaves = sum(not any(len(o) == len(p) + 1 and o[:len(p)] == p for o in below) for p in below)
        ends = ",".join(str(c) for c in sorted(ids) if len(convs[c]) == len(path))
        rows.append((len(path), min(ids), min(members[path[:-1]]) if path else None, len(ids),
                     sum(len(p) == len(path) + 1 for p in below), leaves,
                     sum((len(members[p]) - 1) * len(p[-1][1].split()) for p in below if p), sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def found(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=str)


def corpus(draw, convs=150, longest=12):
    rows, earlier = [], []
    for c in range(convs):
        turns = [(draw.choice("ua"), f"t{draw.randrange(3)} " * draw.randrange(4)) for _ in range(draw.randrange(longest))]
        if earlier and draw.random() < .6:
            turns = (start := draw.choice(earlier))[:draw.randrange(len(start) + 1)] + turns[:draw.randrange(3)]
        earlier.append(turns)
        rows += [(c, i, *turn) for i, turn in enumerate(turns)]
    return rows


@pytest.mark.parametrize("first_batch, growth", [(1, 2), (5, 3), (4096, 16)])
def test_equals_a_dictionary_of_prefixes(stored, first_batch, growth):
    rows = corpus(random.Random(first_batch))
    turns = t.turns_of(stored(rows, CONVERSATIONS, 5))
    assert found(t.prefix_trie(turns, first_batch, growth)) == brute(ordered(rows))


def test_long_edges_are_cut(stored):
    long = [("u", f"w{i}") for i in range(300)]
    convs = {1: long, 2: long[:77], 3: long[:77] + [("u", "x")], 4: long[:150] + long[:9], 5: long, 6: [], 7: long[:76] + long}
    rows = [(c, i, *turn) for c, turns in convs.items() for i, turn in enumerate(turns)]
    convs.pop(6)
    assert found(t.prefix_trie(t.turns_of(stored(rows, CONVERSATIONS)), 1, 2)) == brute(convs)


def test_shared_heads(stored):
    rows = corpus(random.Random(4), 70, 6)
    rows = [r for r in rows if r[0] != 40]  # the conversation that others would take turns from
    turns = t.with_shared_heads(t.turns_of(stored(rows, CONVERSATIONS)))
    assert found(t.prefix_trie(turns, 8, 4)) == brute(rebuilt(ordered(rows)))


def test_equal_conversations_are_one_sequence(stored):
    rows = [(c, i, "u", f"turn {i} of all" if c % 3 else f"{c} {i}") for c in range(3000) for i in range(3)]
    out = t.prefix_trie(t.turns_of(stored(rows, CONVERSATIONS)), 64, 16).where("n_convs = 2000").collect()
    ids = ",".join(str(c) for c in range(3000) if c % 3)
    assert sorted((r.depth, r.n_children, r.conv_id, r.parent_conv_id) for r in out) == [(1, 1, 1, 0), (2, 1, 1, 1), (3, 0, 1, 1)]
    assert max(out, key=lambda r: r.depth).ends_sha256 == sha256(ids.encode()).hexdigest()


def test_odd_rows(stored):
    rows = [
        (None, 1, "u", "no conversation"), (1, None, None, None), (1, None, "u", "second null"), (1, 0, "u", "a b"), (1, 0, "u", "a b"),
        (2, 3, None, ""), (2, 3, "", None), (2, 9, "u", "word " * 200_000), (3, 1, "a", " \t\n"), (-7, 1, "a", "漢字 \x00 end"), (2**62, 0, "u", "a b"),
    ]
    docs = stored(rows, CONVERSATIONS).withColumns({c: F.lit("x") for c in ("at", "digest", "words", "key", "base", "seq")})
    assert found(t.prefix_trie(t.turns_of(docs), 1, 2)) == brute(ordered(rows))
    assert found(t.prefix_trie(t.turns_of(stored([], CONVERSATIONS, 1)))) == []
    assert found(t.prefix_trie(t.with_shared_heads(t.turns_of(stored(rows[:1], CONVERSATIONS, 1))))) == []


def test_fattest(spark):
    def plain(a, b):
        return max(range(a + 1, b + 1), key=lambda x: x & -x)
    pairs = [(a, b) for a in range(20) for b in range(a + 1, 70)] + [(2**29, 2**30), (0, 2**30)]
    rows = spark.createDataFrame(pairs[:-2], "a int, b int").withColumn("f", t.fattest("a", "b")).collect()
    assert all(r.f == plain(r.a, r.b) for r in rows)
    assert spark.createDataFrame(pairs[-2:], "a int, b int").select(t.fattest("a", "b").alias("f")).collect() == [(2**30,), (2**30,)]
