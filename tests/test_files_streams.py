import json
import os

import pytest
from pyspark.sql import functions as F

from corpusforge.operators.bootstrap import bootstrap
from corpusforge.operators.overlap import align_records, rouge
from corpusforge.sources import readers as R
from corpusforge.sources import scoring as C
from corpusforge.sources import writers as W
from corpusforge.streaming import blocks as B
from corpusforge.streaming import ingest as I
from corpusforge.streaming.ingest import stream_corpus, stream_metrics
from tests.test_packing import sequential


def lines_of(folder):
    out = []
    for name in sorted(os.listdir(folder)):
        if name.startswith("part-"):
            with open(f"{folder}/{name}", encoding="utf-8") as f:
                out += f.read().splitlines()
    return out


def test_json_tree_reports_bad_files(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/one.json").write_text(
        json.dumps({"id": "x", "document": [{"form": "가"}]}, indent=1, ensure_ascii=False))
    (tmp_path / "a/b/two.json").write_text('{"id": "y", "document": [{"form": "b"')
    (tmp_path / "a/skip.txt").write_text("{}")
    good, bad = R.read_json_tree(spark, str(tmp_path), "id string, document array<struct<form string>>")
    assert [(r["id"], r["document"][0]["form"]) for r in good.collect()] == [("x", "가")]
    assert sorted(os.path.basename(r["file"]) for r in bad.collect()) == ["two.json"]
    (tmp_path / "a/b/empty.json").write_text("")
    good, bad = R.read_json_tree(spark, str(tmp_path), "id string, document array<struct<form string>>")
    assert {os.path.basename(r["file"]): r["content"] for r in bad.collect()} == {
        "two.json": '{"id": "y", "document": [{"form": "b"', "empty.json": ""}
    assert good.count() == 1


def test_own_parser_keeps_rows_before_the_error(spark, tmp_path):
    (tmp_path / "a=1/b %+é").mkdir(parents=True)
    for name, content in (("one", "1\n2\n"), ("two", "3\nx\n4"), ("none", "")):
        (tmp_path / "a=1/b %+é" / f"{name}.num").write_text(content)
    good, bad = R.read_parsed(spark, str(tmp_path), lambda text: ({"n": int(x)} for x in text.split()),
                              "n long", "*.num")
    assert sorted((os.path.basename(r["file"]), r["n"]) for r in good.collect()) == [
        ("one.num", 1), ("one.num", 2), ("two.num", 3)]
    assert [os.path.basename(r["file"]) for r in bad.collect()] == ["two.num"]
    assert "ValueError" in bad.first()["error"]


def test_broken_line_fails(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"text": "fine"}\n{"text": broken\n')
    with pytest.raises(Exception):
        R.read_jsonl(spark, f"{tmp_path}/x.jsonl", "text string").collect()
    assert R.read_jsonl(spark, f"{tmp_path}/x.jsonl", "text string", "DROPMALFORMED").count() == 1


def test_empty_files_keep_their_rank(spark, tmp_path):
    for side, contents in (("t", ["t1", "", "t3"]), ("p", ["p1", "p2", ""]), ("q", ["q1", "", "q3"])):
        for name, content in zip("abc", contents):
            (tmp_path / side).mkdir(exist_ok=True)
            (tmp_path / side / f"{name}.txt").write_text(content)
    read = {side: R.read_records(spark, f"{tmp_path}/{side}/*.txt") for side in "tpq"}
    both = align_records(read["t"], read["q"])
    assert sorted((r["file"], r["target"], r["prediction"]) for r in both.collect()) == [
        (0, "t1", "q1"), (2, "t3", "q3")]
    with pytest.raises(Exception):
        align_records(read["t"], read["p"]).collect()
    (tmp_path / "p/d.txt").write_text("p4")
    with pytest.raises(ValueError):
        C.score_files(spark, f"{tmp_path}/t/*.txt", f"{tmp_path}/p/*.txt", f"{tmp_path}/o", ["rouge1"])


def test_tsv(spark, tmp_path):
    path = tmp_path / "x.tsv"
    path.write_text('a.1\t"he said ""hi"""\tz\nb.2\tplain\t\n', encoding="utf-8")
    rows = R.read_tsv(spark, str(path), ["0", "1", "2"]).collect()
    assert [tuple(r) for r in rows] == [("a.1", 'he said "hi"', "z"), ("b.2", "plain", None)]
    path.write_text('a.1\t"line one\nline two"\tz\n', encoding="utf-8")
    rows = R.read_tsv(spark, str(path), ["0", "1", "2"]).collect()
    assert [tuple(r) for r in rows] == [("a.1", "line one\nline two", "z")]


def test_jsonl_is_not_escaped(spark, tmp_path):
    df = spark.createDataFrame([("한글 \u2028",)], "text string").coalesce(1)
    W.write_jsonl(df, f"{tmp_path}/o")
    written = [p.read_text("utf-8") for p in (tmp_path / "o").iterdir() if p.suffix == ".json"]
    assert any("한글" in text for text in written)
    assert R.read_jsonl(spark, f"{tmp_path}/o/*", "text string").first()["text"] == "한글 \u2028"
    assert W.write_counted(spark.range(7), f"{tmp_path}/c") == 7


def test_by_source(spark, tmp_path):
    df = spark.createDataFrame([("a/b", 1), ("c", 2)], "source string, v int")
    W.write_by_source(df, f"{tmp_path}/o")
    assert {p.name for p in (tmp_path / "o").iterdir() if p.is_dir()} == {
        "source=a__b", "source=c"}


@pytest.mark.parametrize("content,want", [
    ("one:two:three:four:", ["one", "two", "three", "four"]),
    ("one:two", ["one", "two"]), ("one::two:", ["one", "", "two"])])
def test_records(spark, tmp_path, content, want):
    (tmp_path / "r.txt").write_text(content)
    rows = R.read_records(spark, f"{tmp_path}/*.txt", ":").orderBy("record").collect()
    assert [(r["file"], r["record"], r["text"]) for r in rows] == [
        (0, i, t) for i, t in enumerate(want)]


def test_records_of_split_files(spark, tmp_path):
    for name in "ba":
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows = R.read_records(spark, f"{tmp_path}/*.txt").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {(r["file"], r["record"]): r["text"] for r in rows} == {
        (f, i): f"{'ab'[f]}{i}" for f in (0, 1) for i in range(5000)}


def test_alignment(spark):
    cols = "file int, record long, text string"
    t = spark.createDataFrame([(0, 0, "a"), (0, 1, "b")], cols)
    p = spark.createDataFrame([(0, 1, "y"), (0, 0, "x")], cols)
    rows = align_records(t, p).orderBy("record").collect()
    assert [tuple(r) for r in rows] == [(0, 0, "a", "x"), (0, 1, "b", "y")]
    with pytest.raises(Exception, match="without partner"):
        align_records(t, p.limit(1)).collect()


def test_score_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("one two:three:")
    (tmp_path / "p.txt").write_text("one:three:")
    args = (spark, f"{tmp_path}/t.txt", f"{tmp_path}/p.txt")
    C.score_files(*args, f"{tmp_path}/s", ["rouge1"], ":", aggregate=False)
    assert lines_of(f"{tmp_path}/s") == [
        "id,rouge1-P,rouge1-R,rouge1-F", "0,1.000000,0.500000,0.666667",
        "1,1.000000,1.000000,1.000000"]
    C.score_files(*args, f"{tmp_path}/a", ["rouge1"], ":")
    lines = lines_of(f"{tmp_path}/a")
    assert lines[0] == "score_type,low,mid,high"
    assert [x.split(",")[0] for x in lines[1:]] == ["rouge1-R", "rouge1-P", "rouge1-F"]
    C.score_files(*args, f"{tmp_path}/own", ["rouge1"], ":",
                  scorer=lambda df: rouge(df, ["rouge1"], ["file", "record"], stem=True),
                  aggregator=lambda s: bootstrap(s, ["rouge1"], "id", 0.5, 10))
    assert len(lines_of(f"{tmp_path}/own")) == 4
    with pytest.raises(ValueError):
        C.score_files(*args, f"{tmp_path}/bad", ["rougex"], ":")
    with pytest.raises(Exception):
        C.score_files(spark, f"{tmp_path}/none*", f"{tmp_path}/none*", f"{tmp_path}/b", ["rouge1"])


SCHEMA = "source string, doc_id long, text string, ids array<int>"


def write_batches(spark, folder, rows, groups):
    """One file per group, in order of arrival."""
    size = -(-len(rows) // groups)
    for g in range(groups):
        part = spark.createDataFrame(rows[g * size:(g + 1) * size], SCHEMA)
        part.coalesce(1).write.mode("append").json(folder)
        for name in os.listdir(folder):
            path = f"{folder}/{name}"
            if name.endswith(".json") and os.path.getmtime(path) > 1e9:
                os.utime(path, (1000 * (g + 1), 1000 * (g + 1)))


def stream_rows():
    rows = []
    for i in range(90):
        source = "hot" if i % 3 else "b"
        text = "x" * (20 if i % 10 == 0 else 40)
        rows.append((source, i, text, [i * 7 % 50] * (i * 13 % 23)))
    kept = [(s, i, ids) for s, i, text, ids in rows if len(text) > 32]
    return rows, kept


def test_stream_blocks_over_micro_batches(spark, tmp_path):
    rows, kept = stream_rows()
    write_batches(spark, f"{tmp_path}/in", rows, 3)
    docs = stream_corpus(spark, f"{tmp_path}/in", SCHEMA, files_per_trigger=1)
    query = B.stream_blocks(docs, 8).writeStream.format("memory").queryName("blocks").trigger(
        availableNow=True).option("checkpointLocation", f"{tmp_path}/check").start()
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 3
    got = {(r["source"], r["block"]): r["input_ids"]
           for r in spark.table("blocks").collect()}
    assert got == sequential(kept, 8, None)


def test_pack_batches(spark, tmp_path):
    rows, kept = stream_rows()
    write_batches(spark, f"{tmp_path}/in", rows, 3)
    docs = stream_corpus(spark, f"{tmp_path}/in", SCHEMA, files_per_trigger=1)
    B.write_blocks(docs, f"{tmp_path}/out", f"{tmp_path}/state", f"{tmp_path}/check", 8,
                   availableNow=True).awaitTermination()

    def blocks():
        return {(r["source"], r["block"]): r["input_ids"]
                for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    assert blocks() == sequential(kept, 8, None)
    third = spark.read.schema(SCHEMA).json(f"{tmp_path}/in").where("doc_id >= 60")
    B.pack_batch(third.where(F.length("text") > 32), 2, f"{tmp_path}/out", f"{tmp_path}/state", 8)
    assert blocks() == sequential(kept, 8, None)


def test_pack_batch_keeps_sources_that_pause(spark, tmp_path):
    def batch(n, rows):
        df = spark.createDataFrame(rows, "source string, doc_id long, ids array<int>")
        B.pack_batch(df, n, f"{tmp_path}/out", f"{tmp_path}/state", 4)

    batch(0, [("a", 0, [1, 2, 3, 4, 5]), ("b", 0, [1, 2, 3, 4])])
    batch(1, [("c", 1, [9])])
    batch(2, [("a", 2, [6, 7, 8]), ("b", 2, [5, 6, 7, 8])])
    got = {(r["source"], r["block"]): r["input_ids"]
           for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("a", 0): [1, 2, 3, 4], ("a", 1): [5, 6, 7, 8],
                   ("b", 0): [1, 2, 3, 4], ("b", 1): [5, 6, 7, 8]}


def test_blocks_continue_after_a_restart(spark, tmp_path):
    """Five micro-batches in two runs of one checkpoint, the last batch again: the blocks of one run."""
    rows, kept = stream_rows()

    def run():
        docs = stream_corpus(spark, f"{tmp_path}/in", SCHEMA, files_per_trigger=1)
        query = B.write_blocks(docs, f"{tmp_path}/out", f"{tmp_path}/state", f"{tmp_path}/check", 8, availableNow=True)
        query.awaitTermination()
        return len([p for p in query.recentProgress if p["numInputRows"]])

    write_batches(spark, f"{tmp_path}/in", rows[:36], 2)
    assert run() == 2
    for g, part in enumerate((rows[36:54], rows[54:72], rows[72:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        for name in os.listdir(f"{tmp_path}/in"):
            path = f"{tmp_path}/in/{name}"
            if name.endswith(".json") and os.path.getmtime(path) > 1e9:
                os.utime(path, (9000 + g, 9000 + g))
    assert run() == 3
    got = {(r["source"], r["block"]): r["input_ids"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == sequential(kept, 8, None)


def test_rejected_lines_are_kept_once(spark, tmp_path):
    good = [f'{{"source":"s","doc_id":{i},"text":"{"x" * 40}"}}' for i in range(6)]
    bad = ["{broken", '{"source":"s","doc_id":"no number","text":"t"}', "[1, 2"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join([*good[:3], bad[0]]))

    def run():
        lines = I.stream_lines(spark, f"{tmp_path}/in", files_per_trigger=1)
        I.write_corpus(lines, f"{tmp_path}/out", f"{tmp_path}/rejects", f"{tmp_path}/check", availableNow=True).awaitTermination()
        return (sorted(r.doc_id for r in spark.read.parquet(f"{tmp_path}/out").collect()),
                sorted((r.file, r.line) for r in spark.read.parquet(f"{tmp_path}/rejects").collect()))

    assert run() == ([0, 1, 2], [("a.json", bad[0])])
    (tmp_path / "in/b.json").write_text("\n".join([bad[1], *good[3:], bad[2], '{"source":"s","doc_id":9,"text":"short"}']))
    want = [0, 1, 2, 3, 4, 5], sorted([("a.json", bad[0]), ("b.json", bad[1]), ("b.json", bad[2])])
    assert run() == want
    # A batch that runs again replaces its own rows.
    schema = "source string, doc_id long, text string, _line string"
    again = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_line").json(f"{tmp_path}/in/b.json").withColumn("_file", F.lit("b.json"))
    I.keep_batch(again, 1, f"{tmp_path}/out", f"{tmp_path}/rejects")
    assert run() == want


def test_lanes_split_a_source(spark, tmp_path):
    rows, kept = stream_rows()
    write_batches(spark, f"{tmp_path}/in", rows, 1)
    docs = stream_corpus(spark, f"{tmp_path}/in", SCHEMA)
    B.stream_blocks(docs, 4, lanes=3).writeStream.format("memory").queryName("lanes").trigger(
        availableNow=True).option("checkpointLocation", f"{tmp_path}/check").start(
        ).awaitTermination()
    got = spark.table("lanes").collect()
    assert {r["lane"] for r in got if r["source"] == "hot"} == {0, 1, 2}
    tokens = sum(len(i) for s, _, i in kept if s == "hot")
    packed = sum(len(r["input_ids"]) for r in got if r["source"] == "hot")
    assert tokens - 3 * 4 < packed <= tokens


def test_stream_metrics(spark, tmp_path):
    spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "name string, value double") \
        .write.json(f"{tmp_path}/in")
    steps = spark.readStream.schema("name string, value double").json(f"{tmp_path}/in")
    stream_metrics(steps).writeStream.outputMode("complete").format("memory").queryName(
        "means").trigger(availableNow=True).option(
        "checkpointLocation", f"{tmp_path}/check").start().awaitTermination()
    assert {tuple(r) for r in spark.table("means").collect()} == {("a", 2.0, 2), ("b", 5.0, 1)}
