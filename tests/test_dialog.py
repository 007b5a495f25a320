import random

import pytest

from corpusforge.operators import dialog as D

SLICED = {"rows_per_slice": 15}


def turns_of(seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        conv = 0 if rng.random() < 0.4 else rng.randint(1, 9)
        rows.append((conv, i, rng.choice("aab"), f"t{i}"))
    return rows


def loop(rows):
    """Per conversation: list of (speaker, joined text)."""
    out = {}
    for conv, _, who, text in sorted(rows, key=lambda r: r[1]):
        runs = out.setdefault(conv, [])
        if runs and runs[-1][0] == who:
            runs[-1] = (who, runs[-1][1] + " " + text)
        else:
            runs.append((who, text))
    return out


@pytest.mark.parametrize("options", [{}, SLICED])
def test_merge_turns(spark, options):
    rows = turns_of()
    df = spark.createDataFrame(rows, "c long, o long, who string, t string").repartition(3)
    want = {c: ("\n".join(t for _, t in runs), [w for w, _ in runs])
            for c, runs in loop(rows).items()}
    got = D.merge_turns(df, "c", ["o"], "who", "t", **options).collect()
    assert {r["c"]: (r["text"], r["speakers"]) for r in got} == want


@pytest.mark.parametrize("options", [{}, SLICED])
def test_index_speakers_per_file(spark, options):
    rows = [("f", 0, "x"), ("f", 1, "y"), ("f", 2, "x"), ("f", 3, "z"), ("g", 0, "z"), ("g", 5, "x")]
    rows += [("h", i, f"s{i % 7}") for i in range(60)]
    df = spark.createDataFrame(rows, "f string, o long, who string")
    got = {(r["f"], r["o"]): r["speaker_index"]
           for r in D.index_speakers(df, ["f"], ["o"], "who", **options).collect()}
    assert [got["f", i] for i in range(4)] == [0, 1, 0, 2]
    assert (got["g", 0], got["g", 5]) == (0, 1)
    assert [got["h", i] for i in range(14)] == [i % 7 for i in range(14)]


def test_render_dialog(spark):
    rows = [("d1", 0, 0, "hi"), ("d1", 1, 0, "you"), ("d1", 2, 1, "a\nb")]
    df = spark.createDataFrame(rows, "c string, o long, who int, t string")
    row = D.render_dialog(df, "c", ["o"], "who", "t", "set-").first()
    assert tuple(row) == ("set-d1", "0: hi you\n1: a\nb", 2)


def test_assemble(spark):
    rows = [("d", i, f"l{i}") for i in range(7)]
    df = spark.createDataFrame(rows, "d string, line long, t string").repartition(4)
    assert D.assemble_documents(df, "d", "line", "t").first()["text"] == "\n".join(
        f"l{i}" for i in range(7))
    far = df.withColumn("line", df["line"] + 1_048_572)
    assert D.assemble_documents(far, "d", "line", "t").count() == 1


def test_preferences(spark):
    schema = ("context array<struct<from:string,value:string>>, "
              "instruction struct<from:string,value:string>, chosen struct<from:string,value:string>, "
              "rejected struct<from:string,value:string>")
    df = spark.createDataFrame(
        [([("human", "q0"), ("gpt", "a0")], ("human", "q"), ("gpt", "good"), ("gpt", "bad"))], schema)
    head = "Human: q0\n\nAssistant: a0\n\nHuman: q\n\nAssistant: "
    assert tuple(D.preference_texts(df).first()) == (head + "good", head + "bad")
    assert tuple(D.render_seq2seq_pair(df).first()) == (head, "good", "bad")


@pytest.mark.parametrize("options", [{}, SLICED])
def test_turn_pairs(spark, options):
    rows = turns_of(5)
    df = spark.createDataFrame(rows, "c long, o long, who string, t string")
    got = {r["response"]: r["context"] for r in
           D.turn_pairs(df, "c", ["o"], "t", **options).collect()}
    want, last = {}, {}
    for conv, _, _, text in sorted(rows, key=lambda r: r[1]):
        if conv in last:
            want[text] = last[conv]
        last[conv] = text
    assert got == want


def test_context_response(spark):
    df = spark.createDataFrame([("a\nb", "c")], "context string, response string")
    row = D.context_response(df, eos="</s>").first()
    assert (row["prompt_text"], row["label_text"]) == ("a</s>b</s>", "c")
