import random

import numpy as np
from pyspark.sql import functions as F

from corpusforge.llm import line_chunks as c


def bounds(rows):
    """For each text the lines that must go and those that may, from the lines alone.

    Three lines with a word that stand earlier, with what is between them, must go; two may.
    """
    rows = sorted(rows, key=lambda r: r[0])
    seen, out = set(), {}
    for key, text in rows:
        lines = (text or "").split("\n")
        solid = [i for i, line in enumerate(lines) if line.strip(" \t\r\x0b\x0c")]
        must, may = set(), set()
        for at in range(len(solid)):
            for n in (1, 2, 3):
                if at + n <= len(solid) and (n > 1 or len(lines[solid[at]].split()) > 50):
                    first, last = solid[at], solid[at + n - 1]
                    run = "\n".join(lines[first:last + 1])
                    if run in seen:
                        may.update(range(first, last + 1))
                        if n != 2:
                            must.update(range(first, last + 1))
                    seen.add(run)
        out[key] = lines, must, may
    return out


def corpus():
    draw = random.Random(6)
    lines = [f"line {i} é" for i in range(60)] + [""] * 6
    passages = [[draw.choice(lines) for _ in range(draw.randint(2, 14))] for _ in range(10)]
    rows = []
    for _ in range(200):
        text = []
        for _ in range(draw.randint(0, 4)):
            text += draw.choice(passages) if draw.random() < .5 else [f"own {draw.random()}" for _ in range(draw.randint(0, 6))]
        rows.append("\n".join(text))
    for i in range(60):  # passages of two lines
        rows += [f"before {i} {k}\nfirst {i}\nsecond {i}\nafter {i} {k}" for k in range(2)]
    return list(enumerate(rows + [rows[5], "\n\n\n", "\n\n\n", "single", "single"]))


def test_passages_go_and_nothing_else(stored):
    rows = corpus()
    docs = stored([(i, t, "en", "s", 0) for i, t in rows], parts=4)
    cleaned = c.drop_repeated_chunks(docs, chunks="gone")
    changed, pairs, found_pairs = 0, 0, 0
    allowed = bounds(rows)
    for r in cleaned.collect():
        lines, must, may = allowed[r.doc_id]
        gone = {i for span in r.gone or [] for i in range(span[0], span[1])}
        assert must <= gone <= may
        assert r.text == "\n".join(x for i, x in enumerate(lines) if i not in gone)
        changed += bool(gone)
        pairs += len(may - must)
        found_pairs += len((may - must) & gone)
    assert changed > 40 and pairs >= 120
    assert found_pairs > .5 * pairs  # passages of two lines are found if a border falls on them


def test_borders_resist_shifts():
    draw = np.random.default_rng(1)
    shared = draw.integers(0, 2**63, 80).astype(np.uint64)
    found = []
    for lead in (0, 1, 7):
        hashes = np.concatenate([draw.integers(0, 2**63, lead).astype(np.uint64), shared, draw.integers(0, 2**63, 3).astype(np.uint64)])
        found.append({int(i) - lead for i in c.borders(hashes) if 1 <= i - lead < 78})
    assert found[0] == found[1] == found[2]
    for hashes in (shared, shared[:3], shared[:2], np.zeros(9, np.uint64)):
        at = c.borders(hashes).tolist()
        assert at and at[0] <= 1 and at[-1] >= len(hashes) - 3
        assert all(1 <= b - a <= 2 for a, b in zip(at, at[1:]))  # chunks of a passage meet
    assert 0.5 < len(c.borders(shared)) / 79 < 0.8 and len(c.borders(shared[:1])) == 0


def test_odd_rows(odd_documents, no_documents):
    docs = odd_documents.withColumn("row", F.lit("r")).withColumn("chunks", F.lit(1)).withColumn("k1", F.lit(1))
    cleaned = c.drop_repeated_chunks(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == 12
    before = sorted(str(r.text) for r in docs.collect())
    assert sorted(str(r.text) for r in cleaned.collect()) == before
    assert c.drop_repeated_chunks(no_documents).count() == 0


def test_every_repeated_passage_is_found_whole(stored):
    draw = random.Random(8)
    fresh = iter(range(10**9))

    def own(lines, words=12):
        return [" ".join(f"w{next(fresh)}" for _ in range(words)) for _ in range(lines)]

    shared = [own(n) for n in range(3, 41)] + [own(3, 26), own(1, 51), own(1, 300), own(4)[:2] + [""] + own(2)]
    rows = []
    for passage in shared:
        for _ in range(3):
            rows.append((len(rows), own(draw.randint(1, 6)), passage, own(draw.randint(1, 6))))
    texts = [(key, "\n".join([*before, *passage, *after])) for key, before, passage, after in rows]
    copy = texts[7][1]
    cleaned = c.drop_repeated_chunks(stored([(i, t, "en", "s", 0) for i, t in [*texts, (9999, copy)]]))
    got = {r.doc_id: r.text for r in cleaned.collect()}
    assert got.pop(9999) == ""
    for key, before, passage, after in rows:
        assert got[key].split("\n") == [*before, *(passage if key % 3 == 0 else []), *after]


def test_spans_of_lines_are_disjoint(stored):
    text = "\n".join(f"line {i}" for i in range(6))
    docs = stored([(1, text, "en", "s", 0), (2, f"own\n{text}\nend", "en", "s", 0)])
    spans = {r.doc_id: r.spans for r in c.drop_repeated_chunks(docs, chunks="spans").collect()}
    assert spans[1] is None and [tuple(s) for s in spans[2]] == [(1, 7)]


def test_shuffled_input_is_stored_first(stored):
    rows = corpus()
    docs = stored([(i, t, "en", "s", 0) for i, t in rows], parts=4)
    plain = sorted((r.doc_id, str(r.text)) for r in c.drop_repeated_chunks(docs).collect())
    assert sorted((r.doc_id, str(r.text)) for r in c.drop_repeated_chunks(docs.repartition(7, "text")).collect()) == plain


def test_texts_that_stay_go_to_no_worker(spark):
    from corpusforge.llm.line_chunks import drop_repeated_chunks

    rows = [(1, "a b\nc d\ne f"), (2, "x\na b\nc d\ne f\ny"), (3, "one\ntwo"), (4, None)]
    made = drop_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string"))
    assert "without_lines(CASE WHEN" in made._jdf.queryExecution().optimizedPlan().toString()
    assert {r["doc_id"]: r["text"] for r in made.collect()} == {1: rows[0][1], 2: "x\ny", 3: rows[2][1], 4: None}
