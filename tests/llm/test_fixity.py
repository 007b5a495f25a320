from pyspark.sql import functions as F

from corpusforge.llm.fixity import audit, merkle_levels, record_hashes

RECORD = "archive string, offset long, length long, payload string, hash int"


def found(left, right, **options):
    return sorted((tuple(r)[:3] for r in audit(record_hashes(left), record_hashes(right), **options).collect()), key=str)


def test_damage_is_located(stored):
    rows = [(a, 100 * i, 90, f"{a}{i}", 0) for a in ("x", "y", "z") for i in range(400)]
    other = [r for r in rows if r[:2] != ("x", 300)] + [("y", 5, 1, "new", 0), ("w", 0, 1, None, 0)]
    other = [r if r[:2] != ("z", 39900) else (*r[:3], "rot", 0) for r in other]
    assert found(stored(rows, RECORD), stored(other, RECORD), span=64, fanout=3) == [
        ("w", 0, "extra"), ("x", 300, "missing"), ("y", 5, "extra"), ("z", 39900, "changed")]


def test_odd_records(stored):
    rows = [(None, 0, 4, None, 1), (None, 0, 4, None, 1), ("a", None, 1, "lost", 1), ("a", 0, None, "", 1),
            ("a", 10, 1, "x", 1), ("a", 10, 1, "y", 1)]
    assert found(stored(rows, RECORD), stored(list(reversed(rows)), RECORD)) == []
    assert found(stored(rows, RECORD), stored(rows[1:], RECORD)) == [(None, 0, "changed")]
    nothing = stored([], RECORD, 1)
    assert found(nothing, nothing) == []
    assert len(found(stored(rows, RECORD), nothing)) == 3


def test_a_node_has_few_children_and_the_root_covers_all(stored):
    rows = [("a", 7 * i, 7, str(i), 0) for i in range(1000)]
    levels = merkle_levels(record_hashes(stored(rows, RECORD)), 5, span=64, fanout=4)
    counts = [level.count() for level in levels]
    assert counts[0] == 110 and counts[-1] == 1
    assert all(b <= -(-a // 4) + 1 for a, b in zip(counts, counts[1:]))
    assert levels[0].where(F.length("hash") == 64).count() == 110
