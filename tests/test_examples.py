
from corpusforge.operators import examples as E
from corpusforge.operators.schema import has_supervision


def test_mask_prompt(spark):
    rows = [([1, 2, 3], [7, 8]), ([1, 2, 3, 4, 5, 6], [7, 8]), ([1], [5, 6, 7, 8, 9, 10])]
    df = spark.createDataFrame(rows, "prompt array<int>, answer array<int>")
    got = [tuple(r)[2:] for r in E.mask_prompt(df, 5, eos=2).collect()]
    assert got == [
        ([1, 2, 7, 8, 2], [1] * 5, [-100, -100, 7, 8, 2]),
        ([1, 2, 7, 8, 2], [1] * 5, [-100, -100, 7, 8, 2]),
        ([5, 6, 7, 8, 9], [1] * 5, [5, 6, 7, 8, 9]),
    ]


def test_mask_prompt_keeps_the_start_of_a_left_truncated_prompt(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5, 6], [7])], "prompt array<int>, answer array<int>")
    row = E.mask_prompt(df, 4, eos=2, truncation_side="left").first()
    assert row["input_ids"] == [3, 4, 7, 2]


def test_mask_turns(spark):
    rows = [(["<usr> a", "<bot> b", "<usr> c"], [[1, 2], [3, 4, 5], [6]]), (["<usr> a"], [[1]])]
    df = spark.createDataFrame(rows, "u array<string>, ids array<array<int>>")
    got = E.mask_turns(df, "u", "ids", "<bot>", 6, 9)
    first = got.first()
    assert first["input_ids"] == [1, 2, 3, 4, 5, 9]
    assert first["labels"] == [-100, -100, 3, 4, 5, 9]
    assert has_supervision(got).count() == 1
    short = E.mask_turns(df, "u", "ids", "<bot>", 2, 9).first()
    assert short["input_ids"] == [1, 2]


def test_padding(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (0, [1]), (1, [5])], "b int, ids array<int>")
    rows = E.causal_example(df, "ids", 2)
    right = [tuple(r)[2:] for r in E.pad_examples(rows, 3, 4).collect()]
    assert right[1] == ([1, 0, 0, 0], [1, 0, 0, 0], [1, -100, -100, -100])
    left = E.pad_examples(rows, None, None, "left", 7, ["b"]).collect()
    assert sorted(r["input_ids"] for r in left) == [[1, 2], [5], [7, 1]]


def test_pad_pairs(spark):
    part = "struct<input_ids:array<int>,attention_mask:array<int>>"
    df = spark.createDataFrame([(([1], [1]), ([1, 2], [1, 1]))], f"chosen {part}, rejected {part}")
    row = E.pad_pairs(df, 3, None, "left", 5).first()
    assert row["chosen"]["input_ids"] == [5, 5, 1]
    assert row["rejected"]["attention_mask"] == [0, 1, 1]


def test_classification(spark):
    df = spark.createDataFrame([([1, 2, 3], 1)], "ids array<int>, y int")
    row = E.classification_example(df, "ids", "y", 2).first()
    assert (row["input_ids"], row["attention_mask"], row["label"]) == ([1, 2], [1, 1], 1)
