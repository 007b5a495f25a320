import pytest
from pyspark.sql import functions as F

from corpusforge.functions.tokens import words
from corpusforge.operators.schema import has_supervision
from corpusforge.operators.tasks import Encoder, Task, prepare

# An id is the length of its word.
LENGTHS = Encoder(words, lambda tokens: F.transform(tokens, F.length), 2, 0)
ROW = ("input_ids", "attention_mask", "labels")


def arrays(df):
    return [tuple(r[c] for c in ROW) for r in df.collect()]


def test_causal_with_steps_and_null_text(spark):
    df = spark.createDataFrame([("aaa bbbb", 1), (None, 2), ("c", 3)], "text string, input_ids int")
    task = Task("causal", max_length=3, multiple=None, steps=(lambda d: d.where("input_ids < 3"),))
    assert arrays(prepare(df, task, LENGTHS)) == [
        ([3, 4, 0], [1, 1, 0], [3, 4, -100]), ([0, 0, 0], [0, 0, 0], [-100] * 3)]


def test_prompt_is_masked_and_kept_rows_are_supervised(spark):
    df = spark.createDataFrame([("aaa bbbb", "cc"), ("a", None)], "q string, a string")
    task = Task("prompt", ("q", "a"), max_length=4, multiple=None, pad_side="left", keep=(has_supervision,))
    assert arrays(prepare(df, task, LENGTHS)) == [
        ([3, 4, 2, 2], [1] * 4, [-100, -100, 2, 2]), ([0, 0, 1, 2], [0, 0, 1, 1], [-100, -100, -100, 2])]


def test_turns_are_encoded_together_and_cut_apart(spark):
    df = spark.createDataFrame([("<usr> aaa\n<bot> bbbb c\n<usr> dd",), ("<usr> alone",)], "text string")
    task = Task("turns", marks=("<usr>", "<bot>"), max_length=8, multiple=None)
    rows = arrays(prepare(df, task, LENGTHS))
    assert rows == [([5, 3, 5, 4, 1, 2, 5, 2], [1] * 8, [-100, -100, 5, 4, 1, 2, -100, -100])]


def test_token_labels(spark):
    df = spark.createDataFrame([("aaa bb c", [(4, 5, 0.9), (7, 7, 0.1)]), ("x", None)],
                               "text string, spans array<struct<begin int, end int, prob double>>")
    got = arrays(prepare(df, Task("token_labels", max_length=3, multiple=None), LENGTHS))
    assert [r[2] for r in got] == [[0, 1, 0], [0, -100, -100]]


def test_empty_table_and_unknown_shape(spark):
    none = spark.createDataFrame([], "text string")
    for shape in ("causal", "turns"):
        assert prepare(none, Task(shape, marks=("<usr>",)), LENGTHS).count() == 0
    with pytest.raises(ValueError, match="no shape"):
        Task("other")


def test_places_of_utterances_are_summed_once(spark):
    """The sums over all utterances were made again for each of them."""
    rows = spark.createDataFrame([(1, "<usr> a bb <bot> ccc d <usr> e")], "k int, text string")
    made = prepare(rows, Task("turns", marks=("<usr>", "<bot>"), max_length=16), LENGTHS)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(slice(" not in plan
    assert made.first()["labels"][:9] == [-100, -100, -100, 5, 3, 1, 2, -100, -100]
