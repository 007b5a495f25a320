import pytest
from pyspark.sql import functions as F

from corpusforge.functions import text as T
from corpusforge.functions import tokens as K
from corpusforge.functions.templates import apply_template
from corpusforge.operators import schema as S
from corpusforge.operators.dialog import split_utterances


def apply(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()
    return [r["o"] for r in rows]


def test_charset(spark):
    got = apply(spark, T.keep_charset, ["가나漢字다 ok", "ㅋㅜㅜㅎ", "한 😀 글 👍🏽!", "é", "～％·"])
    assert got == ["가나 다 ok", "ㅋ ㅎ", "한 😀 글 👍🏽!", " ", " ％·"]


def test_urls(spark):
    got = apply(spark, T.strip_urls, [
        "보기 https://www.a-b.co.kr/x?y=1#z 끝", "http://a.com/가나", "no url"])
    assert got == ["보기  끝", "가나", "no url"]


def test_collapse(spark):
    got = apply(spark, T.collapse_repeats, [
        "와하하하하핫", "aaa bbbb cc", "!!!!", "a \t b\n\nc ", "ㅋㅋㅋㅋㅋ", "1111.000"])
    assert got == ["와하하핫", "aa bb cc", "!!!!", "a b\n\nc", "ㅋㅋ", "11.00"]


def test_emoticons(spark):
    got = apply(spark, T.normalize_emoticons, [
        "ㅋㅋㅋㅋㅋ쿠ㅜㅜㅜㅜ", "핳ㅎㅎㅎ", "ㅋ큐 좋다", "안녕 하세요", "a", "", "ㅋ강ㅏ"])
    assert got == ["ㅋㅋㅜㅜ", "하ㅎㅎ", "ㅋㅋㅠ 좋다", "안녕 하세요", "a", "", "ㅋ강ㅏ"]


def test_clean(spark):
    got = apply(spark, T.clean, [
        " 漢 안녕ㅋㅋㅋㅋ http://a.com/x  \n", "ㅋㅋㅋ쿠ㅜㅜ", "줄\n바꿈漢", "", None])
    assert got == ["안녕ㅋㅋ", "ㅋㅋㅜ", "줄\n바꿈", "", None]


def test_script_ratio(spark):
    got = apply(spark, T.script_ratio, ["가나ab", "가나", "", "ab"])
    assert got == [0.5, 1.0, None, 0.0]
    df = spark.createDataFrame([("가나다ab",), ("가나다라마",), ("가나다a",)], "text string")
    assert [r.text for r in S.filter_script(df).collect()] == ["가나다라마"]


def test_marks(spark):
    assert apply(spark, T.remove_speaker, ["0 : a\n1 : b 4 : c", "10 : x"]) == [
        "a\nb 4 : c", "1x"]
    marked = apply(spark, lambda c: T.mark_speakers(c, "</s>"), ["0 : a\n1 : b", "10 : x", "y"])
    assert marked == ["<unused1>a</s>\n<unused2>b", "1<unused1>x", "y"]
    df = spark.createDataFrame([(m,) for m in marked], "m string")
    assert [r[0] for r in df.select(T.speaker_count(F.col("m"))).collect()] == [2, 1, 1]


def test_speakers(spark):
    assert apply(spark, T.parse_speaker, ["P12", "P01", "Px1", "P", "12"]) == [12, 1, -1, -1, 2]
    assert apply(spark, T.document_id, ["a.b.c"]) == ["b"]


def test_nbsp(spark):
    assert apply(spark, T.strip_literal_nbsp, [" a\\xa0b ", "\\xa0 a"]) == ["ab", " a"]


def test_score_tokens(spark):
    got = apply(spark, K.score_tokens, ["one Two three", "one\n Two \nthree", "", " a", "a\x1cb"])
    assert got == [["one", "two", "three"], ["one", "two", "three"], [""], ["", "a"], ["a", "b"]]


def test_sentences(spark):
    assert apply(spark, K.sentences, ["a\n\nb\n", ""]) == [["a", "b"], []]
    assert apply(spark, lambda c: K.sentences(c, True), ["Hi. You there? ok"]) == [
        ["Hi.", "You there?", "ok"]]


def test_ngrams(spark):
    got = apply(spark, lambda c: K.ngrams(F.split(c, " "), 2), ["a b c", "a"])
    assert got == [[["a", "b"], ["b", "c"]], []]
    got = apply(spark, lambda c: K.ngrams(F.split(c, " "), 1), ["a b"])
    assert got == [[["a"], ["b"]]]


def test_truncate_pad(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],)], "a array<int>")
    rows = df.select(
        K.truncate(F.col("a"), 2).alias("r"), K.truncate(F.col("a"), 2, "left").alias("l"),
        K.pad(F.col("a"), 4, 9).alias("p"), K.pad(F.col("a"), 2, 9, "left").alias("q")).collect()
    assert [tuple(r) for r in rows] == [
        ([1, 2], [2, 3], [1, 2, 3, 9], [1, 2, 3]), ([], [], [9, 9, 9, 9], [9, 9])]
    assert K.padded_length(60, 8) == 64 and K.padded_length(64, 8) == 64


def test_split_utterances(spark):
    marks = ["<usr>", "<bot>", "<sys>"]
    texts = ["x <usr> hi <bot> yo ", "none", "<sys><usr> a", "<bot> ab"]
    assert apply(spark, lambda c: split_utterances(c, marks), texts) == [
        ["<usr> hi", "<bot> yo"], [], ["<sys>", "<usr> a"], ["<bot> ab"]]
    assert apply(spark, lambda c: split_utterances(c, marks, compat=True), texts) == [
        ["<usr> hi", "<bot> yo"], [], ["<sys>", "<usr>"], ["<bot> a"]]
    assert apply(spark, lambda c: split_utterances(c, ["0 : ", "1 : "]), ["10 : a 1 : b"]) == [
        ["0 : a", "1 : b"]]


def test_templates(spark):
    df = spark.createDataFrame(
        [("t", "a", " l\n", "", "i", "o")],
        "title string, artist string, lyrics string, input string, instruction string, "
        "output string")
    row = apply_template(apply_template(df, "lyrics"), "instruction").first()
    assert row["text"] == "제목: t\n아티스트: a\n가사:\nl</s>"
    assert row["prompt_text"] == "<usr>i\n" and row["label_text"] == "<sys>o"


def test_unify_text(spark):
    df = spark.createDataFrame([("1 : a", "b")], "dialog string, form string")
    assert S.unify_text(df).first()["text"] == "a"
    assert S.unify_text(df, keep_speakers=True).first()["text"] == "1 : a"
    assert S.unify_text(df, ["none"]).columns == ["dialog", "form"]
    assert S.text_only(df).columns == ["text"]
    with pytest.raises(ValueError):
        S.unify_text(df.withColumn("text", F.lit("own")))


def test_labels(spark):
    df = spark.createDataFrame([("love",), ("joy",)], "c string")
    names = ["joy", "love"]
    assert [r[0] for r in df.select(S.encode_label(F.col("c"), names)).collect()] == [1, 0]
    bad = spark.createDataFrame([("hate",)], "c string")
    with pytest.raises(Exception, match="unknown class: hate"):
        bad.select(S.encode_label(F.col("c"), names)).collect()
    with pytest.raises(ValueError):
        S.label_from(df, ["label"])


def test_merge_structs(spark):
    df = spark.createDataFrame(
        [(("1", "old", None), ("new",), ("s",))],
        "a struct<passage_id:string,passage:string,none:string>, b struct<passage:string>, "
        "c struct<summary1:string>")
    row = S.merge_structs(df, ["a", "b", "c"], {
        "passage_id": "id", "passage": "text", "summary1": "summary"}).first()
    assert tuple(row) == ("1", "new", "s")
    rows = spark.createDataFrame([(("old",), (None,)), (("old",), None)], "a struct<x:string>, b struct<x:string>")
    assert [r["x"] for r in S.merge_structs(rows, ["a", "b"], {"x": "x"}).collect()] == [None, "old"]


def test_valid_pairs(spark):
    df = spark.createDataFrame([("a", "b"), ("a", " 　\n"), ("", "b")],
                               "chosen string, rejected string")
    assert S.valid_pairs(df).count() == 1


def test_characters_near_rare_ones_are_a_short_class(spark):
    """Characters far from all rare ones are not compared with each of them."""
    import re

    from corpusforge.functions import text as X
    from corpusforge.values import EMOJI_CLASS, KEPT_CHARS

    near = X._near(EMOJI_CLASS)
    assert near.count("-") < 10
    spans = [(int(a, 16), int(b, 16)) for a, b in re.findall(r"x\{(\w+)\}-.x\{(\w+)\}", near)]
    assert all(any(a <= int(p, 16) <= b for a, b in spans) for p in re.findall(r"x\{(\w+)\}", EMOJI_CLASS))
    assert X._near("a-z") == ""
    texts = [(chr(c) + "x" + chr(c + 1),) for c in [*range(0, 0x3400, 2), *range(0x1F000, 0x1FB00, 2), 0xAC00, 0xFE0E]]
    df = spark.createDataFrame(texts, "t string")
    old = F.regexp_replace("t", f"[[^{KEPT_CHARS}]&&[^{EMOJI_CLASS}]]+", " ")
    assert df.where(~old.eqNullSafe(X.keep_charset(F.col("t")))).count() == 0
    # Texts without Hangul are collapsed once.
    plan = df.select(X.clean(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE(t#" in plan
