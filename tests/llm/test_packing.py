import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusforge.llm.packing import END, Limits, TOKENIZER, fill, load_encoder, pack_rows, pack_texts


def check(rows, whole, limits):
    """Every id in one piece, offsets gapless, limits held."""
    at, sequences = collections.Counter(), collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (str(r["doc_id"]), r["start"])):
        sequences[r["sequence_id"]].append(r)
    pieces = collections.Counter()
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and r["doc_tokens"] in {len(w) for w in whole[r["doc_id"]]}
        assert any(w[r["start"]:r["start"] + r["length"]] == ids for w in whole[r["doc_id"]])
        pieces[r["doc_id"]] += r["length"]
    assert pieces == {k: sum(map(len, w)) for k, w in whole.items()}
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limits.tokens and len(found) <= limits.segments
        assert sum(r["loss_tokens"] for r in found) <= limits.loss
    return len(sequences)


@pytest.mark.parametrize("limits", [Limits(64, 5, 64), Limits(64, 64, 20), Limits(7, 1, 3)])
def test_limits_and_padding(limits):
    draw = random.Random(1)
    keys, ids, loss = [], [], []
    for i in range(700):
        n = draw.choice([1, 2, 5, 20, 40, 150])
        keys.append({"doc_id": i})
        ids.append(np.array([draw.randint(1, 99) for _ in range(n)], "<u4"))
        loss.append(draw.randint(0, n))
    batches = [(keys[a:a + 100], ids[a:a + 100], loss[a:a + 100]) for a in range(0, 700, 100)]
    rows = [r for part in pack_rows(iter(batches), limits, 10) for r in part]
    n = check(rows, {k["doc_id"]: [w.tolist()] for k, w in zip(keys, ids)}, limits)
    least = max(sum(map(len, ids)) / limits.tokens, 700 / limits.segments,
                sum(len(w) - f for w, f in zip(ids, loss)) / limits.loss)
    assert n <= 1.15 * least + 3 or limits.tokens == 7


def test_fill_takes_the_highest_dot_product():
    vectors = np.array([[60, 1, 0], [30, 1, 30], [30, 1, 5], [4, 1, 4]], float)
    sequences, back = fill(vectors, Limits(64, 8, 32), keep_back=False)
    assert sequences == [[1], [0, 3], [2]]
    assert not len(back)


def test_ids_are_those_of_the_tokenizer(spark):
    texts = ["Hello world", "", "  a\n\nb\t", "naïve 漢字 \U0001f600", "x<|endoftext|>y", "#" * 3000, "don't we'll 12345"]
    exact, encode = Tokenizer.from_file(TOKENIZER), load_encoder()
    for t in texts:
        assert encode(t).tolist() == exact.encode(t, add_special_tokens=False).ids


def test_odd_rows(odd_documents, no_documents):
    encode = load_encoder()
    whole = collections.defaultdict(list)
    for r in odd_documents.collect():
        whole[r.doc_id].append([*encode(r.text or "").tolist(), END])
    docs = odd_documents.withColumn("ids", F.lit(1)).withColumn("start", F.lit(1))
    check([r.asDict() for r in pack_texts(docs).collect()], whole, Limits())
    assert pack_texts(no_documents).count() == 0


def test_prompts_bear_no_loss(stored):
    rows = [(i, f"answer {i}", "say hello " * (i % 4) or None) for i in range(50)]
    docs = stored(rows, "doc_id long, text string, prompt string")
    packed = pack_texts(docs, prompt="prompt", limits=Limits(40, 3, 12)).collect()
    encode = load_encoder()
    sums = collections.Counter()
    for r in packed:
        sums[r.doc_id] += r.loss_tokens
    assert sums == {i: len(encode(t)) + 1 for i, t, _ in rows}


def test_limits_are_positive():
    with pytest.raises(ValueError):
        Limits(10, 0, 10)


def test_sequences_do_not_depend_on_the_size_of_batches(spark, stored):
    docs = stored([(i, f"{i} " + "word " * (7 * i % 900), "en", "a", 1) for i in range(1500)], parts=1)
    setting, found = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    for rows in ("10000", "90"):
        spark.conf.set(setting, rows)
        try:
            found.append(sorted(map(tuple, pack_texts(docs).drop("ids").collect())))
        finally:
            spark.conf.unset(setting)
    assert found[0] == found[1]
