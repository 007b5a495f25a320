import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.llm import substrings as s


def brute(rows):
    """Rows in corpus order."""
    seen, out = set(), []
    for key, text in rows:
        body = (text or "").encode()
        gone = np.zeros(len(body), bool)
        for i in range(len(body) - 99):
            window = body[i:i + 100]
            if window in seen:
                gone[i:i + 100] = True
            seen.add(window)
        spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        out.append((key, len(body), int(gone.sum()), spans, bytes(np.frombuffer(body, np.uint8)[~gone])))
    return sorted(out, key=str)


def corpus():
    draw = random.Random(8)
    letters = "abcdefghij é"
    passages = ["".join(draw.choices(letters, k=draw.choice([60, 99, 100, 101, 130, 400]))) for _ in range(12)]
    rows = []
    for _ in range(120):
        parts = []
        for _ in range(draw.randint(0, 5)):
            parts.append(draw.choice(passages) if draw.random() < .6 else "".join(draw.choices(letters, k=draw.randint(1, 300))))
        rows.append("".join(parts))
    rows += ["x" * 350, "ab" * 200, "x" * 99, "x" * 100, "", "ab" * 200, rows[3], rows[4] + "tail", "漢" * 80, "z" + "漢" * 60]
    rows += ["hot line of text that is shorter than a window " + "".join(draw.choices(letters, k=90)) for _ in range(30)]
    return list(enumerate(rows))


@pytest.mark.parametrize("crowd,part", [(2048, 1 << 20), (2, 1 << 20), (2048, 150)])
def test_equals_brute_force(stored, monkeypatch, crowd, part):
    monkeypatch.setattr(s, "CROWD", crowd)
    monkeypatch.setattr(s, "PART", part)
    rows = corpus()
    docs = stored([(i, t, "en", "s", 0) for i, t in rows], parts=4)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in s.drop_repeats(docs).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_prefix_intervals():
    # banana's suffixes: a, ana, anana, banana, na, nana
    found = sorted(s.prefix_intervals([0, 1, 3, 0, 0, 2]))
    assert found == [(1, 0, 2), (2, 4, 5), (3, 1, 2)]


def test_only_left_diverse_repeats_are_given():
    text = bytes(np.random.default_rng(1).integers(97, 123, 130).astype(np.uint8))
    found = list(s.maximal_repeats([b"1" + text + b"2", b"3" + text + b"4", text + b"5"], [0, 0, 0]))
    assert sorted(found) == [(1, 1, 131), (2, 0, 130)]
    assert not list(s.maximal_repeats([text, text], [0, 1]))


def test_anchors_depend_on_the_window_alone():
    rng = np.random.default_rng(2)
    shared = rng.integers(0, 256, 100).astype(np.uint8)
    seen = set()
    for n in (0, 3, 50, 200):
        whole = np.concatenate([rng.integers(0, 256, n).astype(np.uint8), shared, rng.integers(0, 256, 70).astype(np.uint8)])
        first, past, place, hashes = s.anchors(whole, np.array([len(whole)]))
        i = int(np.flatnonzero((first <= n) & (n < past))[0])
        seen.add((int(place[i]) - n, int(hashes[i])))
    assert len(seen) == 1


def test_odd_rows(odd_documents, no_documents):
    docs = odd_documents.withColumn("row", F.lit(1)).withColumn("spans", F.lit(1)).withColumn("h", F.lit(1))
    rows = sorted(((r.doc_id, r.text) for r in odd_documents.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in s.drop_repeats(docs).collect()]
    assert sorted(got, key=str) == brute(rows)
    assert s.drop_repeats(no_documents).count() == 0
