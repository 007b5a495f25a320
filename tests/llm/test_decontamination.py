import random
import re

import pytest
from pyspark.sql import functions as F

from corpusforge.llm import decontamination as d

ITEMS = "item_id long, text string, overlap int"


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items, window):
    out = []
    for key, text in docs:
        w, hit, names = words(text), set(), set()
        for item, item_text in items:
            x = words(item_text)
            n = min(window, len(x))
            grams = {tuple(x[i:i + n]) for i in range(len(x) - n + 1)} if x else set()
            for i in range(len(w) - n + 1):
                if grams and tuple(w[i:i + n]) in grams:
                    hit.update(range(i, i + n))
                    names.add(str(item))
        out.append((key, len(w), len(hit), sorted(names)))
    return sorted(out, key=str)


@pytest.mark.parametrize("letters,block_words", [("ab", 100_000), ("abcdefgh", 100_000), ("abcd", 12)])
def test_equals_brute_force(stored, letters, block_words):
    draw = random.Random(len(letters))
    items = [(i, " ".join(draw.choices(letters, k=draw.choice([0, 1, 2, 3, 4, 6, 9])))) for i in range(14)]
    items += [(99, None), (100, "Ünïcode, Word! x"), (101, "ÜNÏCODE word x")]
    docs = [(i, " ".join(draw.choices(letters + "xyz", k=draw.randint(0, 40)))) for i in range(150)]
    docs += [(1000, None), (1001, "ünïcode"), (1002, "so Ünïcode. WORD: x"), (1002, "so Ünïcode. WORD: x")]
    if letters == "abcdefgh":
        items = [i for i in items if len(words(i[1])) != 1]
    found = d.item_overlap(stored([(i, t, "en", "s", 0) for i, t in docs]), stored([(*i, 1) for i in items], ITEMS),
                           window=4, block_words=block_words)
    got = [(r.doc_id, r.overlap.n_words, sum(h.end - h.start for h in r.overlap["hits"]), r.overlap["items"])
           for r in found.collect()]
    assert sorted(got, key=str) == brute(docs, items, 4)


def test_longest_matches_of_the_automaton():
    automaton = d.Automaton([(1, b"a b c d".split()), (2, b"b c a b c".split())], window=3)
    ids = automaton.ids(b"x b c d a b c a".split())
    found = [(s, e, sorted(n)) for s, e, n in automaton.match(ids, 1, len(ids))]
    assert found == [(1, 4, [1]), (4, 7, [1, 2]), (5, 8, [2])]


def test_spans_are_cut_and_covered_texts_go(stored):
    item = "This is a Test item, with exactly twelve words in it now."
    rows = [(1, f"Before. {item} After the item there are more words than inside, which is enough to stay here."),
            (2, item), (3, "Nothing of it."), (4, None), (5, "This is a test item with exactly twelve")]
    docs = stored([(i, t, "en", "s", 0) for i, t in rows])
    kept = {r.doc_id: r.text for r in d.decontaminate(docs, stored([(7, item, 0)], ITEMS)).collect()}
    assert set(kept) == {1, 3, 4, 5} and kept[3] == rows[2][1] and kept[4] is None and kept[5] == rows[4][1]
    assert kept[1].startswith("Before. . After the item") and "exactly" not in kept[1]


def test_odd_rows(odd_documents, no_documents, stored):
    items = stored([(1, "of17 word18 of18", 0), (None, "漢字", 0), (2, None, 0)], ITEMS)
    docs = odd_documents.withColumn("overlap", F.lit(1)).withColumn("row", F.lit(1))
    found = d.item_overlap(docs, items)
    assert sorted(found.columns) == sorted(docs.columns)
    hit = {r.doc_id for r in found.where(F.size("overlap.items") > 0).collect()}
    assert hit == {4, 9, 10}
    nothing = stored([], ITEMS, 1)
    assert d.item_overlap(odd_documents, nothing).where(F.size("overlap.items") > 0).count() == 0
    assert d.item_overlap(no_documents, items).count() == 0
    assert d.decontaminate(docs, items).columns == docs.columns


def test_whole_short_items_are_cut(stored):
    rest = "and many more words follow here so that only a small part of this text is an item"
    items = [(1, "Who wrote the Iliad?", 0), (2, "Paris", 0), (3, " ".join(f"t{i}" for i in range(8)), 0),
             (4, " ".join(f"u{i}" for i in range(15)), 0)]
    rows = [(1, f"Quiz: who wrote the iliad? {rest}"), (2, f"In Paris {rest}"), (3, f"{items[2][1]} {rest}"),
            (4, " ".join(f"t{i}" for i in range(7)) + f" {rest}"), (5, " ".join(f"u{i}" for i in range(8)) + f" {rest}")]
    docs, tests = stored([(i, t, "en", "s", 0) for i, t in rows]), stored(items, ITEMS)
    want = {1: f"Quiz: ? {rest}", 2: rows[1][1], 3: f" {rest}", 4: rows[3][1], 5: rows[4][1]}
    assert {r.doc_id: r.text for r in d.decontaminate(docs, tests).collect()} == want
    # A narrower window counts more words as hit; what is cut stays the same.
    assert {r.doc_id: r.text for r in d.decontaminate(docs, tests, window=4).collect()} == want
    cut = d.decontaminate(docs, tests, least_words=8).where("doc_id = 5").first()
    assert cut.text == f" {rest}"


@pytest.mark.parametrize("block_words,passes", [(100_000, 1), (12, 3)])
def test_texts_are_looked_through_once_in_a_pass(stored, tmp_path, monkeypatch, block_words, passes):
    texts = [f"{'abc'[i % 3]} text that is like no item {i}" for i in range(40)]
    docs = stored([(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    items = stored([(i, " ".join(f"{c}{k}" for k in range(12)), 0) for i, c in enumerate("pqr")], ITEMS)
    seen, look = str(tmp_path / "seen"), d.overlap_of

    def looked(found, automaton):
        with open(seen, "ab") as file:
            file.write(b"t" * len(found))
        return look(found, automaton)

    monkeypatch.setattr(d, "overlap_of", looked)
    kept = d.decontaminate(docs, items, block_words=block_words)
    assert {r.doc_id: r.text for r in kept.collect()} == dict(enumerate(texts))
    assert (tmp_path / "seen").stat().st_size == passes * len(texts)
