"""Problem 5: brute force and edge cases."""

import random
from datetime import datetime

from reelmill.functions.values import is_filled_amount, is_filled_text
from reelmill.llm import survivor

BUNDLES = [survivor.Bundle("dep", ("dep",), is_filled_text), survivor.Bundle("pop", ("pop",), is_filled_amount)]


def test_survivors_field_by_field(spark):
    t = datetime(2026, 1, 1)
    rows = [
        (10, 1, "Acting", -1.0, t),
        (11, 1, " n/a ", 2.0, None),
        (12, 1, "Sound", float("nan"), datetime(2025, 1, 1)),
        (13, 2, "Acting", 1.0, t),
        (14, 3, "?", None, t),
        (15, 3, None, float("inf"), t),
        (16, 4, "x", 0.0, t),
        (17, 4, "y", 0.0, t),
        (18, None, "z", 0.0, t),
        (19, None, "z", 0.0, t),
    ]
    df = spark.createDataFrame(rows, "record_id long, id int, dep string, pop double, at timestamp")
    got = {tuple(r) for r in survivor.survivors(df, "id", "record_id", "at", BUNDLES, least_rows=2).collect()}
    assert got == {(1, "dep", 10), (1, "pop", 11), (4, "dep", 16), (4, "pop", 16)}
    assert survivor.survivors(df.where("false"), "id", "record_id", "at", BUNDLES).count() == 0


def test_survivors_under_dependencies_against_brute_force(spark):
    rnd = random.Random(1)
    rows = [(k * 10 + i, k, rnd.choice(["a", "b", "c", None]), rnd.choice(["x", "y", "z", None]), rnd.choice([None, *range(1, 9)])) for k in range(50) for i in range(rnd.randrange(1, 8))]
    df = spark.createDataFrame(rows, "record_id long, id long, a string, b string, t int").selectExpr("record_id", "id", "a", "b", "timestamp_seconds(t) as at")
    bundles = [survivor.Bundle(x, (x,), is_filled_text) for x in "ab"]
    got = {}
    for k, b, r in survivor.survivors(df, "id", "record_id", "at", bundles, [survivor.Dependency("a", "b")]).collect():
        got.setdefault(k, {})[b] = r
    by = {r[0]: r for r in rows}
    trust = lambda r: survivor.NEVER if r[4] is None else r[4]
    for k in range(50):
        group = [r for r in rows if r[1] == k]
        a_rows, b_rows = [r for r in group if r[2]], [r for r in group if r[3]]
        best = None
        for a in a_rows or [None]:
            for b in b_rows or [None]:
                beside = {r[3] for r in group if a and r[2] == a[2] and r[3]}
                if a and b and beside and b[3] not in beside:
                    continue
                total = sum(trust(x) for x in (a, b) if x)
                best = total if best is None else max(best, total)
        chosen = got.get(k, {})
        assert set(chosen) == ({"a"} if a_rows else set()) | ({"b"} if b_rows else set())
        assert sum(trust(by[r]) for r in chosen.values()) == (best or 0)


def test_dependents_follow_the_chosen_value_and_whole_records_are_built(spark):
    t = lambda s: datetime(2026, 1, 1, 0, 0, s)
    rows = [(1, 7, "old", "a", None, t(1)), (2, 7, "new", None, 3.0, t(9)), (3, 7, "new", "b", -1.0, t(2)), (4, 7, "old", "c", None, t(8)), (4, 7, "old", "c", None, t(8)), (5, 8, None, "z", None, None)]
    df = spark.createDataFrame([(*r, "x", r[0]) for r in rows], "record long, id int, name string, path string, pop double, at timestamp, bundle string, k long")
    bundles = [survivor.Bundle(x, (x,), is_filled_text) for x in ("name", "path")] + [survivor.Bundle("pop", ("pop",), is_filled_amount)]
    # "old" with its picture of second 8 is worth more than "new" with its picture of second 2
    held = survivor.survivors(df, "id", "record", "at", bundles, [survivor.Dependency("name", "path")])
    assert {tuple(r) for r in held.collect()} == {(7, "name", 4), (7, "path", 4), (7, "pop", 2), (8, "path", 5)}
    made = survivor.golden_records(df, "id", "record", "at", bundles, [survivor.Dependency("name", "path")])
    assert {tuple(r) for r in made.collect()} == {(7, "old", "c", 3.0), (8, None, "z", None)}
    assert survivor.golden_records(df.where("false"), "id", "record", "at", bundles, [survivor.Dependency("name", "path")]).count() == 0


def test_groups_too_small_are_left_out(spark):
    df = spark.createDataFrame([(1, 1, "a", None), (2, 2, "b", None), (3, 2, None, None)], "record long, id int, name string, at timestamp")
    held = survivor.survivors(df, "id", "record", "at", [survivor.Bundle("name", ("name",), is_filled_text)], least_rows=2)
    assert [tuple(r) for r in held.collect()] == [(2, "name", 2)]
