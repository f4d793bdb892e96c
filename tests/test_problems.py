"""Problems 1 to 4, 6 and 7: brute-force comparisons and edge cases on small fixtures."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from reelmill.operators import nested, profile, redelivery, rejects, snapshots, unpack

PAYLOAD = "movie_id bigint, relation string, payload struct<id:int, genres:array<struct<id:int,name:string>>, belongs_to_collection:struct<id:int,name:string>, credits:struct<cast:array<struct<credit_id:string>>>>"
RELATIONS = [nested.Relation("genre", "payload.genres", "id"), nested.Relation("collection", "payload.belongs_to_collection", "id"), nested.Relation("cast", "payload.credits.cast", "credit_id")]


def test_links_of_dirty_records(spark):
    rows = [
        (1, "clash", (1, [(5, "a"), (5, "a"), (None, "b"), None], (9, "c"), ([("x",), ("",), (None,)],))),
        (1, "clash", (1, [(5, "other")], None, None)),
        (2, None, None),
        (3, None, (3, [], (None, "c"), (None,))),
        (None, None, (4, [(7, "z")], None, None)),
    ]
    got = {tuple(r) for r in nested.link_table(spark.createDataFrame(rows, PAYLOAD), RELATIONS, "movie_id").collect()}
    assert got == {(1, "genre", "5"), (1, "collection", "9"), (1, "cast", "x"), (None, "genre", "7")}
    assert nested.link_table(spark.createDataFrame([], PAYLOAD), RELATIONS, "movie_id").count() == 0


def test_arrays_in_arrays_keep_ancestors(spark):
    df = spark.createDataFrame([(1, [(10, [("a",), ("b",)]), (20, None), None, (30, [("c",), None])]), (2, None)], "p long, a array<struct<k:long,xs:array<struct<v:string>>>>")
    rows = nested.flat_table(df, nested.Relation("x", "a.xs", "v", ("v",), (("a", "k"),)), "p").collect()
    assert [tuple(r) for r in rows] == [(1, 0, 10, 0, "a"), (1, 0, 10, 1, "b"), (1, 3, 30, 0, "c")]


def brute_redelivered(rows):
    seen, out = set(), []
    for delivery, film, fetched in sorted((r for r in rows if None not in r), key=lambda r: r[0]):
        try:
            moment = datetime.fromisoformat(fetched).timestamp()
        except ValueError:
            moment = fetched
        if (film, moment) in seen:
            out.append(delivery)
        seen.add((film, moment))
    return sorted(out)


def test_redeliveries(spark):
    rnd = random.Random(4)
    stamps = [f"2026-03-01T{h:02d}:00:0{s}+00:00" for h in range(3) for s in range(3)] + ["2026-02-28T21:00:01-03:00", "2026-03-01T01:00:02.000+00:00", "nonsense", "nonsense "]
    rows = [(d, rnd.choice([1, 1, 1, 2]), rnd.choice(stamps)) for d in range(400)]
    rows += [(500, None, stamps[0]), (501, None, stamps[0]), (502, 1, None), (503, 1, None), (None, 1, stamps[0])]
    df = spark.createDataFrame(rows, "delivery_id long, movie_id long, fetched_at string").repartition(7)
    got = sorted(r[0] for r in redelivery.redelivered(df).collect())
    assert got == brute_redelivered(rows)
    assert redelivery.redelivered(df.where("false")).count() == 0


@pytest.mark.parametrize("per_block", [5_000_000, 7])
def test_seen_ranges_over_batches(spark, monkeypatch, per_block):
    monkeypatch.setattr(redelivery, "ROWS_PER_BLOCK", per_block)
    rnd = random.Random(9)
    base = 5 * 10**12
    state, seen, accepted = None, set(), []
    for k in range(3):
        rows = [(1000 * k + d, rnd.choice([1, 1, 2]), base + rnd.randrange(-20, 20) + rnd.choice([0, 0, 0, 10**6])) for d in range(60)]
        df = spark.createDataFrame(rows, "d long, p long, n long").repartition(3)
        new, state = redelivery.dedup_batch(df, state, "p", "n", "d")
        got = sorted(r["d"] for r in new.collect())
        want = []
        for d, p, n in rows:
            if (p, n) not in seen:
                want.append(d)
                seen.add((p, n))
        assert got == sorted(want)
    held = [(r["producer"], x) for r in state.collect() for x in range(r["lo"], r["hi"] + 1)]
    assert len(held) == len(set(held)) and set(held) == seen  # disjoint
    if per_block > 1000:
        ranges = sorted((r["producer"], r["lo"], r["hi"]) for r in state.collect())
        assert all(a[0] != b[0] or b[1] > a[2] + 1 for a, b in zip(ranges, ranges[1:]))  # and merged


def test_no_message_is_lost_over_batches(spark):
    rnd = random.Random(10)
    pool = ["7", "8", " 8", "x7", "x8", "", "99999999999999999999", None]
    state, seen = None, set()
    for k in range(3):
        rows = [(100 * k + i, rnd.choice(["1", "2", "two", None]), rnd.choice(pool), k) for i in range(40)]
        rows += [(100 * k + 50, "1", f"new{k}", k)] * 2 + [(None, "1", "7", k)]
        df = spark.createDataFrame(rows, "d long, p string, n string, lo int").repartition(3)
        new, state = redelivery.dedup_batch(df, state, "p", "n", "d")
        want = []
        for d, p, n, _ in rows:
            key = None if p is None or n is None else (p, n.strip())
            if d is None or key is None or key not in seen:
                want.append((d, p, n))
            if d is not None and key is not None:
                seen.add(key)
        got = [(r["d"], r["p"], r["n"]) for r in new.collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
        assert redelivery.dedup_batch(df.where("false"), state, "p", "n", "d")[1].count() == state.count()


def test_sweep():
    import pandas as pd

    rows = pd.DataFrame([(1, 0, 1, 3), (1, 0, 2, 2), (1, 0, 4, 4), (1, 0, 4, 4), (1, 0, 6, 6), (1, 1, 6, 6), (2, 1, 6, 6)], columns=["producer", "block", "lo", "hi"])
    covered, opens = redelivery.sweep(rows)
    assert covered.tolist() == [False, True, False, True, False, False, False]
    assert opens.tolist() == [True, False, False, False, True, True, True]


SNAP = "k int, day date, title string, votes double, n_loaded int"


def brute_changes(rows):
    days = sorted({r[1] for r in rows if r[1] and r[0] is not None} | {r[1] for r in rows if r[1]})
    state = {d: {} for d in days}
    for k, d, title, votes, _ in rows:
        if k is not None and d is not None:
            state[d][k] = (title, votes)
    out = set()
    for a, b in zip(days, days[1:]):
        out |= {(k, b, "added") for k in state[b].keys() - state[a].keys()}
        out |= {(k, b, "removed") for k in state[a].keys() - state[b].keys()}
        out |= {(k, b, "changed") for k in state[a].keys() & state[b].keys() if state[a][k] != state[b][k]}
    return out


def test_snapshot_changes(spark):
    rnd = random.Random(2)
    days = [date(2026, 3, d) for d in (1, 2, 5, 9)]
    rows = []
    for d in days:
        for k in range(30):
            if rnd.random() < 0.7:
                row = (k, d, rnd.choice(["a", "A", "", None]), rnd.choice([1.0, 2.0, None]), 1)
                rows += [row] * rnd.choice([1, 1, 2])
    rows += [(None, days[0], "x", 1.0, 1), (3, None, "x", 1.0, 1)]
    df = spark.createDataFrame(rows, SNAP)
    found = snapshots.changes(df, "k", "day", ("n_loaded",))
    assert {(r["k"], r["s"], r["change"]) for r in found.collect()} == brute_changes(rows)
    cells = snapshots.fetch_old_values(df, found, "k", "day", ["title", "votes"]).collect()
    assert {(c["k"], c["s"]) for c in cells} == {(k, s) for k, s, c in brute_changes(rows) if c == "changed"}
    assert snapshots.changes(df.where("false"), "k", "day").count() == 0


def test_null_is_a_value_of_its_own(spark):
    df = spark.createDataFrame([(1, date(2026, 1, 1), None, 1.0, 1), (1, date(2026, 1, 2), "1", None, 1)], SNAP)
    assert [r["change"] for r in snapshots.changes(df, "k", "day").collect()] == ["changed"]


def test_index_is_swapped(spark, tmp_path):
    index = snapshots.SnapshotIndex(spark, str(tmp_path), "k")
    day = lambda rows: spark.createDataFrame(rows, "k int, v string")
    assert index.deliver(day([(1, "a"), (2, "b")]), "1").count() == 0
    assert {tuple(r) for r in index.deliver(day([(1, "a"), (2, "c"), (3, "d")]), "2").collect()} == {(2, "changed"), (3, "added")}
    assert {tuple(r) for r in index.deliver(day([(2, "c")]), "3").collect()} == {(1, "removed"), (3, "removed")}
    # a corrected delivery under the same label, by a process of its own
    index = snapshots.SnapshotIndex(spark, str(tmp_path), "k")
    assert {tuple(r) for r in index.deliver(day([(2, "d"), (4, "e"), (None, "x")]), "3").collect()} == {(2, "changed"), (4, "added")}
    assert len([n for n in index.files.names(str(tmp_path)) if n.startswith("index-")]) == 2


def test_probe_moves_no_index(spark, tmp_path):
    rows = spark.range(500).selectExpr("id as k", "hash(id) as v", "'a' as s")
    a, b = (snapshots.write_buckets(snapshots.key_hash_index(rows, "k", "s").drop("s"), str(tmp_path / x), 3) for x in "ab")
    plan = snapshots.probe(a, b)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan


def test_many_snapshots_are_folded_in_parts(spark, monkeypatch):
    rows = [(k, date(2026, 3, d), f"{(k * d) % 3}", 1.0, 0) for d in range(1, 8) for k in range(4) if (k + d) % 3]
    df = spark.createDataFrame(rows, SNAP)
    monkeypatch.setattr(snapshots, "PROBES", 2)
    assert {(r["k"], r["s"], r["change"]) for r in snapshots.changes(df, "k", "day").collect()} == brute_changes(rows)


def test_profile_departures(spark):
    rows = []
    for day in range(1, 5):
        for i in range(100):
            null = day == 2 and i < 20
            rows.append((date(2026, 1, day), None if null else f"ab-{i}", float(i + 1) * (1000 if day == 3 else 1), -1.0 if day == 4 and i < 15 else 2.0, float("nan"), i % 3))
    df = spark.createDataFrame(rows, "day date, code string, size double, sign double, nan double, kind int")
    got = {(r["load"].day, r["column_name"]) for r in profile.departures(df, "day").collect()}
    assert got == {(2, "code"), (3, "code"), (3, "size"), (4, "size"), (4, "sign")}
    assert profile.departures(df.where("false"), "day").count() == 0
    merged = profile.merge_states(profile.state(df.where("kind = 0"), "day"), profile.state(df.where("kind > 0"), "day"))
    a = sorted(map(str, merged.collect()))
    assert a == sorted(map(str, profile.state(df, "day").collect()))


@pytest.mark.parametrize("compiled", [500, 0])
def test_merged_sketches_give_the_same_tests(spark, monkeypatch, compiled):
    monkeypatch.setattr(profile, "COMPILED", compiled)
    rnd = random.Random(6)
    rows = [(day, rnd.choice(["aa", "b1", None, f"x{rnd.randrange(10**6)}"]), rnd.choice([None, float("nan"), 0.0, -2.0, rnd.gauss(0, 10**day)]), i) for day in range(1, 5) for i in range(400)]
    df = spark.createDataFrame(rows, "day int, code string, size double, item int")
    rules = [profile.Constraint("short", "code", "length(code) < 4")]
    halves = [profile.sketches(df.where(f"item % 2 = {k}"), "day", None, rules) for k in range(2)]
    merged, whole = profile.merge_sketches(*halves).cache(), profile.sketches(df, "day", None, rules)
    plain = lambda d: sorted(map(tuple, d.select("load", "column_name", "all_rows", "filled_rows", "negative_rows").collect()))
    assert plain(merged) == plain(whole)
    assert sorted(map(tuple, profile.broken_constraints(merged).collect())) == sorted((d, "code", "short", 400, sum(1 for r in rows if r[0] == d and r[1] and len(r[1]) >= 4)) for d in range(1, 5))
    items, middles = profile.exact_counts(df, "day", merged)
    want = {(r["load"], r["column_name"]): r["median"] for r in profile.medians(profile.expand(profile.state(df, "day"))).collect()}
    assert {(r["load"], r["column_name"]): r["median"] for r in middles.collect()} == want
    moved = lambda d: sorted((r["load"], r["column_name"], r["kind"], str(r["item"])) for r in d.collect())
    assert moved(profile.departures(df, "day", ("item",))) == moved(profile.drift(profile.expand(profile.state(df, "day", ["code", "size"]))))


@pytest.mark.parametrize(("was", "now", "departs"), [(1.0, 3.0, True), (2.0, 6.0, True), (4.0, 12.0, True), (42.0, -14.0, True), (0.1, 0.3, True), (1000.0, 2999.0, False), (1.0, 2.9984, False)])
def test_factor_of_medians_is_exact(spark, was, now, departs):
    # half of the numbers lie on either side, so only the middle one moves
    rows = [(1, x) for x in (was / 100, was, was * 1.0001)] + [(2, x) for x in (now / 100, now, now * 1.0001)]
    df = spark.createDataFrame([(day, x) for day, x in rows for _ in range(5)], "day int, x double")
    found = profile.drift(profile.expand(profile.state(df, "day")), (profile.Check("size", 3.0),))
    assert [r["column_name"] for r in found.collect()] == (["x"] if departs else [])
    assert [r["column_name"] for r in profile.departures(df, "day", (), (profile.Check("size", 3.0),)).collect()] == (["x"] if departs else [])


def test_medians_against_sorting(spark):
    rnd = random.Random(4)
    rows = [(rnd.randrange(3), rnd.choice([0.0, float("nan"), None, rnd.randrange(-5, 6) * 1.0, 100 + rnd.random() / 20, rnd.gauss(0, 1e6)])) for _ in range(900)]
    df = spark.createDataFrame(rows, "day int, x double")
    got = {r["load"]: r["median"] for r in profile.medians(profile.expand(profile.state(df, "day"))).collect()}
    for day in range(3):
        sizes = sorted(abs(x) for d, x in rows if d == day and x and x == x)
        assert got[day] == sizes[(len(sizes) - 1) // 2]


def test_form(spark):
    df = spark.createDataFrame([("VAL-01 über Straße_2x",)], "t string")
    assert df.select(profile.form(F.col("t"))).first()[0] == "A-9 a Aa_9a"
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("Ab9é٣ª-.[\\ \n|Ⅷ") for _ in range(rnd.randrange(7))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", profile.form(F.col("t")).alias("f"))
    forms = {r["f"] for r in df.collect()}
    for item in sorted(forms)[:40]:
        same = F.col("t").rlike(profile.form_pattern(item))
        assert df.where(same != (F.col("f") == F.lit(item))).count() == 0, item


@pytest.mark.parametrize(
    ("cell", "values"),
    [
        (None, []), ("", []), ("  ", []), ("\\N", []), ("Drama", ["Drama"]), (";Drama;;Heist ;", ["Drama", "Heist"]),
        ('"Crime, True" | War', ["Crime, True", "War"]), ("Rock \\& Roll,Sport", ["Rock & Roll", "Sport"]), ('{"Sea Tale",NULL,War}', ["Sea Tale", "War"]),
        ('["a \\"b\\"", "c"]', ['a "b"', "c"]), ("War\tWar\nWar", ["War"] * 3), ('"The ""Lost"" Reel";Sci-Fi', ['The "Lost" Reel', "Sci-Fi"]), ("[", ["["]), ('"open, x', ['"open', "x"]),
    ],
)
def test_segments(cell, values):
    assert [x for parts in unpack.segments(cell) for x in parts[::2]] == values


def test_unpack_keeps_positions_and_learns_joins(spark):
    cells = ["Drama/Comedy", "Sword/Sorcery|Drama", "Comedy|Sword/Sorcery", "Heist;Sword/Sorcery", "Drama", "Comedy", "Heist", "Drama/Heist", "Comedy/Heist", None, " ", "Drama;DRAMA; drama"]
    df = spark.createDataFrame([(i, c, 0) for i, c in enumerate(cells * 3)], "id long, g string, pos int")
    got = {}
    for owner, pos, value in unpack.unpack(df, "id", "g").collect():
        got.setdefault(owner, {})[pos] = value
    listed = [[got[i][p] for p in range(1, len(got[i]) + 1)] if i in got else [] for i in range(12)]
    assert listed == [["Drama", "Comedy"], ["Sword/Sorcery", "Drama"], ["Comedy", "Sword/Sorcery"], ["Heist", "Sword/Sorcery"], ["Drama"], ["Comedy"], ["Heist"], ["Drama", "Heist"], ["Comedy", "Heist"], [], [], ["Drama", "DRAMA", "drama"]]
    assert unpack.unpack(df.where("false"), "id", "g").count() == 0


def test_long_value_that_stands_whole_elsewhere_is_joined(spark):
    long, other = "Swords, Sorcery, Dragons, and More", "A/B/C/D/E"
    cells = [f'"{long}"; Drama', f"{long}; Drama", f"Comedy; {long.upper()}; Heist", f'["{other}", "Drama"]', f"Heist|{other}|Comedy", "Drama; Comedy; Heist; Western; Drama; Comedy", "Swords, Sorcery, Dragons, Drama", r"Comedy|P\/Q\/R\/S", "P/Q/R/S|Heist"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)] + [(100 + i, x) for i, x in enumerate(["Drama", "Comedy", "Heist", "Western"] * 10)], "id long, g string")
    got = {}
    for owner, pos, value in unpack.unpack(df, "id", "g").collect():
        got.setdefault(owner, {})[pos] = value
    listed = [[got[i][p] for p in range(1, len(got[i]) + 1)] for i in range(len(cells))]
    assert listed == [[long, "Drama"], [long, "Drama"], ["Comedy", long.upper(), "Heist"], [other, "Drama"], ["Heist", other, "Comedy"], ["Drama", "Comedy", "Heist", "Western", "Drama", "Comedy"], ["Swords", "Sorcery", "Dragons", "Drama"], ["Comedy", "P/Q/R/S"], ["P/Q/R/S", "Heist"]]


@pytest.mark.parametrize("broadcast", [200_000, 3])
@pytest.mark.parametrize("step", [6, 2])
def test_values_of_many_atoms_need_support_only(spark, monkeypatch, broadcast, step):
    monkeypatch.setattr(unpack, "MAX_BROADCAST", broadcast)
    monkeypatch.setattr(unpack, "STEP", step)
    long, longer = "Lock, Stock, and Two, Smoking", "/".join("abcdefghij")
    cells = [long, f"{long}; Drama", f"Heist; {long}", f"Drama|{longer}", f"{longer}|Heist", longer, "Drama; Comedy; Heist; Western; Drama; Comedy"]
    rows = [(i, c) for i, c in enumerate(cells)] + [(100 + i, c) for i, c in enumerate(cells[:6] * 4)] + [(1000 + i, x) for i, x in enumerate(["Drama", "Comedy", "Heist", "Western"] * 10)]
    df = spark.createDataFrame(rows, "id long, g string")
    got = {}
    for owner, pos, value in unpack.unpack(df, "id", "g").collect():
        got.setdefault(owner, {})[pos] = value
    listed = [[got[i][p] for p in range(1, len(got[i]) + 1)] for i in range(len(cells))]
    assert listed == [[long], [long, "Drama"], ["Heist", long], ["Drama", longer], [longer, "Heist"], [longer], ["Drama", "Comedy", "Heist", "Western", "Drama", "Comedy"]]


def plain_reason(line):
    import re

    if line is None:
        return "columns"
    values = []
    for f in line.split("\t"):
        f = f.strip()
        if '"' in f:
            whole = re.fullmatch(r'"((?:[^"]|"")*)"', f)
            if not whole:
                return "quoting"
            f = whole[1].replace('""', '"').strip()
        values.append(f)
    if len(values) != 3:
        return "columns"
    if values[1] != "\\N" and not (re.fullmatch(r"[0-9]+(\.[0-9]*)?|\.[0-9]+", values[1]) and 1 <= float(values[1]) <= 10):
        return "rating"
    if values[2] != "\\N" and not (re.fullmatch("[0-9]+", values[2]) and int(values[2]) <= 2147483647):
        return "votes"
    return None


def test_reasons_against_the_plain_rule():
    rnd = random.Random(3)
    pattern = rejects.RATINGS.pattern()
    lines = [None, "", "tt1\t5.5\t10", "tt1\t10.1\t1", 'tt1\t"5"\t"\\N"', "tt1\t5\t" + "9" * 50]
    lines += ["".join(rnd.choice('"\t a1.') for _ in range(rnd.randrange(14))) for _ in range(5000)]
    for line in lines:
        assert rejects.parse(line, rejects.RATINGS, pattern)[1] == plain_reason(line), line


def test_loaded_and_rejected(spark):
    df = spark.createDataFrame([(1, 'tt1\t"7.5"\t\\N', 1), (2, "tt2\t7.5", 1), (3, None, 1), (4, '"tt"x\t1\t1', 1), (5, " tt5\t1\t2147483648", 1), (5, "tt5\t0\t1", 1)], "line_id long, raw_line string, reason int")
    assert {tuple(r) for r in rejects.rejected(df).collect()} == {(2, "columns"), (3, "columns"), (4, "quoting"), (5, "votes"), (5, "rating")}
    assert [tuple(r) for r in rejects.loaded(df).collect()] == [(1, "tt1", 7.5, None)]
    assert rejects.rejected(df.where("false")).count() == 0


def test_clean_lines_are_loaded_as_the_search_would(spark):
    rnd = random.Random(5)
    keys = ["tt1", "a b", " tt2", "x\u00a0", "", "\\N", "a\\b", '"q"', "é"]
    ratings = ["5", "5.5", "10", "10.0", "10.1", "0.9", "1.", "01", "\\N", " 7", "7\n", "1e1", "9.99999999999999999"]
    votes = ["0", "007", "999999999", "2147483647", "2147483648", "\\N", "-1", "1.0", "5\n", '"5"']
    lines = ["\t".join(rnd.choice(x) for x in (keys, ratings, votes)[: rnd.choice([3, 3, 3, 2])]) for _ in range(1500)] + [None]
    df = spark.createDataFrame([(i, x, 0) for i, x in enumerate(lines)], "line_id long, raw_line string, line int")
    pattern = rejects.RATINGS.pattern()
    want = {i: rejects.parse(x, rejects.RATINGS, pattern) for i, x in enumerate(lines)}
    rows = rejects.parse_lines(df, "line_id", "raw_line", rejects.RATINGS).collect()
    assert len(rows) == len(lines) and all((list(r)[1:4], r["reason"]) == want[r["line_id"]][:2] for r in rows)
    assert {r[0]: r[1] for r in rejects.rejected(df).collect()} == {i: w[1] for i, w in want.items() if w[1]}


def test_edits_explain_the_fault():
    assert rejects.cheapest_edits('""1250"', 1) in ([("delete quote", k)] for k in (0, 1)) or len(rejects.cheapest_edits('""1250"', 1)) == 1
    assert rejects.cheapest_edits("a\tb", 3) == [("insert delimiter", 3)]
    assert [e for e, _ in rejects.cheapest_edits("a\tb\tc\td", 3)] == ["delete delimiter"]
    assert rejects.cheapest_edits('"' + "x" * 100_000 + "\ty\tz", 3) == [("delete quote", 0)]
