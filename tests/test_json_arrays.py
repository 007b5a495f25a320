import json
import random

import pytest

from corpusforge.sources.json_arrays import marks, read_json_arrays

SCHEMA = "id long, text string, tags array<string>"
HARD = ['a"b', "\\", '\\"', "[{", "}]", ",", "한국어", "\\\\", "", 'x\\\\"', "line\nbreak"]


def rows(n, seed=1):
    draw = random.Random(seed)
    return [{"id": i, "text": "".join(draw.choices(HARD, k=draw.randint(0, 12))),
             "tags": draw.choices(HARD, k=draw.randint(0, 3))} for i in range(n)]


def values(good):
    return sorted((r.id, r.text, r.tags) for r in good.collect())


def wanted(items):
    return sorted((r["id"], r["text"], r["tags"]) for r in items)


@pytest.mark.parametrize("range_bytes", [37, 1000, 8 << 20])
@pytest.mark.parametrize("indent", [None, 1])
def test_ranges_of_any_size(spark, tmp_path, range_bytes, indent):
    items = rows(60)
    (tmp_path / "a.json").write_text(json.dumps(items, indent=indent, ensure_ascii=False))
    (tmp_path / "none.json").write_text(" [ ]\n")
    good, bad = read_json_arrays(spark, str(tmp_path), SCHEMA, range_bytes=range_bytes)
    assert values(good) == wanted(items)
    assert bad.count() == 0


@pytest.mark.parametrize("range_bytes", [41, 8 << 20])
def test_array_of_a_field(spark, tmp_path, range_bytes):
    items = rows(40, 2)
    whole = {"other": [{"id": -1}], "meta": {"document": [{"id": -2}]}, "document": items, "last": [[1], {"id": -3}]}
    (tmp_path / "a.json").write_text(json.dumps(whole))
    good, bad = read_json_arrays(spark, str(tmp_path), SCHEMA, "document", range_bytes=range_bytes)
    assert values(good) == wanted(items)
    assert bad.count() == 0


def test_rows_before_an_error_stay(spark, tmp_path):
    items = rows(30, 3)
    text = json.dumps(items)
    (tmp_path / "cut.json").write_text(text[: text.index('{"id": 20') + 8])
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "odd.json").write_text('[{"id": 1}, nonsense, , {"id": 2}]')
    good, bad = read_json_arrays(spark, str(tmp_path), SCHEMA, range_bytes=100)
    assert [r.id for r in good.orderBy("file", "id").collect()] == [*range(20), 1, 2]
    errors = sorted((r.file.split("/")[-1], r.error) for r in bad.collect())
    assert [e[0] for e in errors] == ["cut.json", "cut.json", "empty.json", "odd.json", "odd.json"]


def test_short_ranges_share_tasks(spark, tmp_path):
    """Each range was a task of its own, which took longer to start than to read it."""
    items = rows(60, 4)
    for i in range(3):
        (tmp_path / f"{i}").mkdir()
        (tmp_path / f"{i}/a.json").write_text(json.dumps(items[i * 20 : i * 20 + 20], ensure_ascii=False))
    usual = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    good, bad = read_json_arrays(spark, str(tmp_path), SCHEMA, range_bytes=50)
    assert values(good) == wanted(items)
    assert bad.count() == 0
    assert len(good.inputFiles()) <= spark.sparkContext.defaultParallelism
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == usual


def test_marks_against_a_plain_scan():
    draw = random.Random(5)
    for _ in range(300):
        data = bytes(draw.choices(b'"\\[]{},a', k=draw.randint(0, 30)))
        inside, escaped = draw.random() < 0.5, draw.random() < 0.2
        quoted, run, depth, want = inside, 0, 0, []
        for i, b in enumerate(b" " + data[1:] if escaped and data else data):
            if b == 92:
                run += 1
                continue
            if b == 34:
                quoted ^= run % 2 == 0
            elif not quoted and b in b"[]{},":
                depth += (b in b"[{") - (b in b"]}")
                want.append((i, depth))
            run = 0
        got = marks(data, escaped, inside)
        assert list(zip(got.place.tolist(), got.depth.tolist())) == want, (data, inside, escaped)
