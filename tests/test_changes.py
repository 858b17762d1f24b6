"""Incremental processing: the operator against a plain computation, and the durable feed through failures."""

import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftlode.operators import sync
from siftlode.operators.changes import ChangeFeed, changed_files, last_success

STATES = "state_id long, project string, relative_path string, content_hash string, file_state string, observed_at timestamp, recorded_at timestamp, done_at string, id int"
SNAPS = "identity string, status string, index_status string, last_updated timestamp"
T0 = datetime(2026, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_changed_files_against_plain_computation(spark):
    rng = random.Random(4)
    states, n = [], 0
    for p in "abc":
        for f in range(12):
            for _ in range(rng.randint(1, 5)):
                n += 1
                t = rng.randint(0, 100) * 7 + n / 60
                gone = rng.random() < 0.2
                row = (n, p, f"f{f}", None if gone else f"h{rng.randint(0, 2)}", "deleted" if gone else "present", at(t), at(t + rng.choice([0, 1, 200])), "x", 1)
                states += [row] * rng.choice([1, 1, 2])
    snaps = [("a", "indexing", None, at(90)), ("a", "indexed", "completed", at(100)), ("a", "indexing", None, at(300)), ("a", "indexfailed", None, at(310)), ("b", "indexed", "limit_reached", at(400)), ("b", "indexed", "completed", at(350)), ("c", "indexed", "limit_reached", at(50)), (None, "indexed", "completed", at(1))]
    done = {"a": at(100), "b": at(350)}
    want = set()
    for p, f in {(r[1], r[2]) for r in states}:
        rows = [r for r in states if (r[1], r[2]) == (p, f)]
        now = max(rows, key=lambda r: (r[5], r[0]))[3]
        old = [r for r in rows if p in done and r[6] <= done[p]]
        known = max(old, key=lambda r: (r[5], r[0]))[3] if old else None
        if now != known:
            want.add((p, f))
    s, c = spark.createDataFrame(states, STATES), spark.createDataFrame(snaps, SNAPS)
    got = changed_files(s, c).collect()
    assert {(r.project, r.relative_path) for r in got} == want and len(got) == len(want)
    marks = {r.project: r for r in last_success(c).collect()}
    assert set(marks) == {"a", "b"} and marks["a"].low_water == at(90)


def test_changed_files_of_nothing_and_of_nulls(spark):
    c = spark.createDataFrame([], SNAPS)
    assert changed_files(spark.createDataFrame([], STATES), c).count() == 0
    rows = [(1, None, "f", "h", "present", at(1), at(1), "", 0), (2, "a", None, "h", "present", at(1), at(1), "", 0), (3, "a", "f", "h", None, None, None, "", 0), (4, "a", "g", None, "deleted", at(1), at(1), "", 0)]
    got = changed_files(spark.createDataFrame(rows, STATES), c).collect()
    assert [(r.project, r.relative_path, r.change) for r in got] == [("a", "f", "added")]


def test_feed_survives_failures_and_late_rows(spark, tmp_path):
    feed = ChangeFeed(spark, f"file://{tmp_path}/feed", ["k"], ["v"], "pos")
    schema = "k string, v int, pos long, extra string"
    rows = [("a", 1, 10, "x"), ("b", 1, 20, "x"), ("b", 1, 20, "x")]
    seen = []
    take = lambda df: seen.extend((r.k, r.v) for r in df.collect())

    def fail(df):
        raise ValueError("broken")

    with pytest.raises(ValueError):
        feed.run(spark.createDataFrame(rows, schema), fail)
    assert feed.commits() == []
    feed.run(spark.createDataFrame(rows, schema), take, open_since=15)
    assert sorted(seen) == [("a", 1), ("b", 1)]
    rows += [("c", 1, 16, "late"), ("b", 2, 30, "x"), ("d", 1, None, "x")]
    seen.clear()
    feed.run(spark.createDataFrame(rows, schema), take)
    assert sorted(seen) == [("b", 2), ("c", 1), ("d", 1)]
    seen.clear()
    feed.run(spark.createDataFrame(rows, schema), take)
    assert seen == []


def test_feed_keeps_rows_that_turn_up_late(spark, tmp_path):
    schema, seen = "k string, v int, pos long", []
    take = lambda df: seen.extend((r.k, r.v) for r in df.collect())
    first = [("a", 1, 10)]
    feed = ChangeFeed(spark, f"file://{tmp_path}/feed", ["k"], ["v"], "pos")
    feed.run(spark.createDataFrame(first, schema), take)
    feed.run(spark.createDataFrame([*first, ("late", 1, 5)], schema), take)  # nothing is known of open transactions
    assert seen == [("a", 1), ("late", 1)]
    feed.run(spark.createDataFrame([*first, ("late", 1, 5), ("b", 1, 20)], schema), take, open_since=15)
    seen.clear()
    feed.run(spark.createDataFrame([("a", 1, 10), ("a", 1, 40), ("c", 1, 16)], schema), take, open_since=41)  # a pair again, at a later position
    assert seen == [("c", 1)]
    assert [c["low_water"] for c in feed.commits()] == [None, None, "15", "41"]
    lean = ChangeFeed(spark, f"file://{tmp_path}/feed", ["k"], ["v"], "pos", redelivered=False)
    low = lean._low(lean.commits(), spark.createDataFrame(first, schema))
    assert lean._ledger(lean.commits(), spark.createDataFrame(first, schema), low).count() == 0
    assert lean.pending(spark.createDataFrame([("d", 1, 50), ("c", 1, 16)], schema)).collect()[0].k == "d"


@settings(max_examples=5, deadline=None)
@given(st.dictionaries(st.integers(0, 9), st.sampled_from("ab"), max_size=8), st.dictionaries(st.integers(0, 9), st.sampled_from("ab"), max_size=8))
def test_applying_a_diff_gives_the_new_state(spark, old, new):
    schema = "path long, hash string"
    a, b = (spark.createDataFrame(list(x.items()), schema) for x in (old, new))
    d = sync.file_diff(a, b)
    assert {(r.path, r.hash) for r in sync.apply_changes(a, d, b).collect()} == set(new.items())
