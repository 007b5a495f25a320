import random

import pytest
from pyspark.sql import functions as F

from corpusforge.llm.url_lists import host_of, judge_captures, validity_intervals

EVENTS = "list string, kind string, pattern string, category string, action string, dated long"
CAPTURES = "id long, url string, fetched long, pattern string, rejected int"


def test_intervals(stored):
    rows = [("block", "domain", "a.b", "spam", action, day) for action, day in
            [("add", 3), ("add", 3), ("remove", 9), ("remove", 12), ("add", 12), ("remove", None)]]
    rows.append(("block", "domain", None, "spam", "add", 1))
    assert sorted((r.since, r.until) for r in validity_intervals(stored(rows, EVENTS)).collect()) == [(3, 9), (12, None)]


def active(events, fetched, entry):
    past = sorted((d, a == "add") for *e, a, d in events if tuple(e) == entry and d is not None and d <= fetched)
    return bool(past) and past[-1][1]


def expected(events, url, fetched):
    if url is None or fetched is None:
        return 0, None, False
    place = url.split("://")[1].split("?")[0].rstrip("/").lower()
    labels = place.split("/")[0].split(".")
    keys = {("url", place)} | {("domain", ".".join(labels[i:])) for i in range(len(labels))}
    met = [e for e in {tuple(e[:4]) for e in events} if e[1:3] in keys and active(events, fetched, e)]
    if not met:
        return 0, None, False
    best = max((e[1] == "url", len(e[2]), e[0] == "allow", e[2]) for e in met)
    return len(met), best[3], not best[2]


@pytest.mark.parametrize("rows_per_slice", [7, 1 << 18])
def test_as_of_join_against_brute_force(stored, rows_per_slice):
    draw = random.Random(2)
    names = ["a.com", "b.a.com", "c.b.a.com", "z.org", "com"]
    events = [(draw.choice(["block", "allow"]), "domain", draw.choice(names), draw.choice(["x", "y"]),
               draw.choice(["add", "remove"]), draw.randint(0, 30)) for _ in range(120)]
    events += [("allow", "url", "b.a.com/ok", "x", "add", 5), ("block", "url", "z.org/p", "x", "add", 9)]
    urls = ["http://B.a.com/ok/?q=1", "https://c.b.a.com/x", "http://z.org/p", "http://none.net/", "http://com", None]
    captures = [(i, draw.choice(urls), draw.choice([None, *range(32)]), "p", 1) for i in range(300)]
    captures += captures[:20]
    judged = judge_captures(stored(captures, CAPTURES), stored(events, EVENTS), rows_per_slice=rows_per_slice)
    assert judged.columns == ["id", "url", "fetched", "pattern", "n_active", "categories", "decided_by", "rejected"]
    got = sorted((r.id, r.n_active, r.decided_by, r.rejected) for r in judged.collect())
    want = sorted((i, *expected(events, url, at)) for i, url, at, *_ in captures)
    assert got == want


def test_empty_tables(stored):
    none, some = stored([], CAPTURES, 1), stored([(1, "http://a.com", 3, None, None)], CAPTURES)
    events = stored([], EVENTS, 1)
    assert judge_captures(none, events).count() == 0
    assert [r.rejected for r in judge_captures(some, events).collect()] == [False]


def test_a_pattern_listed_and_delisted_often(stored):
    events = [("block", "domain", "a.com", "x", ("add", "remove")[i % 2], i) for i in range(500)]
    captures = [(i, "http://a.com./p", i, None, None) for i in range(500)]
    judged = judge_captures(stored(captures, CAPTURES), stored(events, EVENTS), rows_per_slice=100)
    assert {r.id: r.rejected for r in judged.collect()} == {i: i % 2 == 0 for i in range(500)}


def test_hosts(stored):
    urls = ["http://A.com.:80/x", "https://u@b.org", "ftp://[2001:DB8::1]:8080/p", "http://c.net.", "no url", "http://d.e?q", None]
    hosts = [r.h for r in stored([(i, u, 1, None, None) for i, u in enumerate(urls)], CAPTURES)
             .orderBy("id").select(host_of(F.col("url")).alias("h")).collect()]
    assert hosts == ["a.com", "b.org", "[2001:db8::1]", "c.net", "", "d.e", None]


def test_long_urls_clashing_names_and_null_entries(stored):
    long = "http://a.com/" + "x" * 1_000_000
    events = [("block", "domain", "a.com", None, "add", 1), (None, "domain", "a.com", "y", "add", 2)]
    captures = stored([(1, long, 3, None, None), (1, long, 3, None, None), (2, "http://a.com", 0, None, None)], CAPTURES)
    captures = captures.withColumns({n: F.lit("s") for n in ("strongest", "url_key", "kind", "capture", "change", "n")})
    judged = judge_captures(captures, stored(events, EVENTS))
    assert sorted((r.id, r.n_active, r.categories, r.rejected) for r in judged.collect()) == [
        (1, 2, "y", True), (1, 2, "y", True), (2, 0, "", False)]
    assert judged.columns[:-4] == [c for c in captures.columns if c != "rejected"]
