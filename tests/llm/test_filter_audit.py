import random
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from corpusforge.llm.filter_audit import FILTERS, audit, audit_tensors

LABELS = "doc_id long, quality int, toxic int"
FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
BLANK = " \t\n\x0b\x0c\r"


def words_of(text):
    for c in BLANK:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(rows, labels):
    """Every order run filter by filter over lists of documents."""
    docs = []
    for doc_id, text, lang in rows:
        text = text or ""
        words = words_of(text)
        marks = [m for m in labels if m[0] == doc_id and doc_id is not None]
        docs.append({
            "part": lang or "", "good": any(m[1] == 1 for m in marks), "toxic": any(m[2] == 1 for m in marks),
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), "D": any(c in "#$%&*|" for c in text),
            "E": any(o is not None and doc_id is not None and o < doc_id and (t or "") == text for o, t, _ in rows),
        })
    out = {}
    for part in {d["part"] for d in docs}:
        shapley = dict.fromkeys(FILTERS, 0)
        for order in permutations(FILTERS):
            left = [d for d in docs if d["part"] == part]
            every = left
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[f]]
                left = [d for d in left if not d[f]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(d[f] for d in every) - len(gone),
                    sum(d[f] and not any(d[o] for o in FILTERS if o != f) for d in every),
                    sum(d["good"] for d in gone), sum(d["toxic"] for d in gone), f]
        for key, row in out.items():
            if key[0] == part:
                row[6] = shapley[row[6]]
    return out


def found(docs, labels):
    rows = audit(docs, labels).collect()
    got = {(r.part, r.filter_order, r.step): [r[f] for f in FIGURES] for r in rows}
    assert len(got) == len(rows)
    return got


def corpus():
    draw = random.Random(5)
    rows = []
    for i in range(120):
        pool = draw.choice([20, 500])
        words = [f"w{draw.randrange(pool)}" for _ in range(draw.choice([5, 199, 200, 260]))]
        words = [w.upper() if draw.random() < draw.choice([0, .3]) else w for w in words]
        text = draw.choice(BLANK).join(words) + draw.choice(["", "|", "$", "é"])
        rows.append((i, text, draw.choice(["en", "de", None])))
    rows += [(200 + i, draw.choice(rows)[1], draw.choice(["en", "fr"])) for i in range(60)]
    return rows


def test_equals_running_every_order(stored):
    rows = corpus()
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 260, 2)]
    labels = [(i, q, int(t)) for i, q, t in labels] + [(4, None, 1), (6, 1, None)]
    docs = stored([(i, t, lang, "s", 0) for i, t, lang in rows])
    assert found(docs, stored(labels, LABELS)) == brute(rows, labels)


def test_odd_rows(stored, odd_documents, no_documents):
    docs = odd_documents.withColumns({c: F.lit(1) for c in ("key", "part", "code", "digest", "first", "good", "toxic")})
    rows = [(r.doc_id, r.text, r.lang) for r in odd_documents.collect()]
    labels = [(5, 1, 0), (5, 0, 1), (None, 1, 1), (1, None, None)]
    assert found(docs, stored(labels, LABELS)) == brute(rows, labels)
    assert found(docs, stored([], LABELS, 1)) == brute(rows, [])
    assert found(no_documents, stored(labels, LABELS)) == {}


def test_one_text_holds_a_third_of_the_rows(stored):
    rows = [(i, "the same # text" if i % 3 else f"other {i}", "en") for i in range(900)]
    out = found(stored([(i, t, lang, "s", 0) for i, t, lang in rows], parts=7), stored([(2, 1, 1)], LABELS, 1))
    assert out["en", "EABCD", 1][1] == 599
    assert out["en", "DEABC", 2][2] == 599 and out["en", "EDABC", 2][1] == 1


def test_tensors_of_one_cell():
    tensors = np.zeros((1, 3, 2, 2, 2, 2, 2), np.int64)
    tensors[0, 0, 1, 1, 0, 0, 0] = 7  # fails A and B
    figures = audit_tensors(tensors)
    assert figures["removed"].sum() == 7 * 120 and set(figures["shapley"][0].tolist()) == {0, 420}
    assert figures["unique_fails"].sum() == 0 and figures["redundant"].sum() == 7 * 120
