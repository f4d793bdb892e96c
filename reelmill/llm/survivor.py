"""The best representative of each group of duplicate records, chosen bundle by bundle.

A bundle is a set of fields whose values belong together and are taken from one record. Trust in a bundle of a record
is the record's time; a record whose bundle isn't filled is no candidate. A dependency says that one bundle determines
another: a value of the second may only be chosen with a value of the first beside which some record holds it (or
beside which no record holds any). The choice with the greatest sum of trust under these constraints survives.

Branch and bound, for all groups level by level. A bundle that depends on none is a root; it is searched with the
bundles it determines, as nothing ties it to other roots. Its branches are its values, equal ones merged to their most
trusted record; of a root that determines nothing the most trusted branch dominates, so the others are cut in the scan.
The bound of a branch is its trust plus the greatest trust of each dependent bundle. The first branch is the most
trusted one; its value, with the best dependent values held beside it, is the incumbent. Branches whose bound lies below
the incumbent are cut, the open ones are evaluated, and the best of all survives.

Scale. Every level is an aggregation that is merged below its shuffle: a person who holds a third of all rows sends one
row per task, root and value. Pairs of values held beside each other are looked up for open branches only. No group is
ever gathered in one task; rows are read once per level, narrow.

Edge cases: a null key makes no group; a null time is the oldest; equal times are decided for the smallest record
number, then for the greatest values; groups of fewer than ``least_rows`` rows are left out; a bundle no record fills
has no survivor; rows may repeat, an empty table gives nothing, and columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmill.session import scratch_table

#: Trust (seconds) of a record without a time: before any time.
NEVER = -(10**11)


@dataclass(frozen=True)
class Bundle:
    """Fields taken together; ``filled`` tells from a field's column whether it has a value, for all fields."""

    name: str
    fields: tuple[str, ...]
    filled: Callable[[Column], Column]

    def is_filled(self) -> Column:
        whole = F.lit(True)
        for f in self.fields:
            whole = whole & self.filled(F.col(f"`{f}`"))
        return whole

    def values(self) -> Column:
        return F.array(*[F.col(f"`{f}`").cast("string") for f in self.fields])


@dataclass(frozen=True)
class Dependency:
    """The bundle ``of`` determines the bundle ``on``; ``of`` itself depends on nothing, ``on`` on nothing else."""

    of: str
    on: str


def _candidates(df: DataFrame, key: str, record: str, time: str, bundles: list[Bundle], with_values: bool) -> DataFrame:
    """``(k, <c0>, <c1>, ...)``: per row and bundle its candidate (trust, back, v), null where it isn't filled; ``back`` is minus the record's number."""
    trust = F.coalesce(F.unix_micros(F.col(f"`{time}`").cast("timestamp")), F.lit(NEVER * 1_000_000))
    back = -F.col(f"`{record}`").cast("bigint")

    def candidate(i: int, b: Bundle) -> Column:
        v = [b.values().alias("v")] if with_values else []
        return F.when(b.is_filled(), F.struct(trust.alias("trust"), back.alias("back"), *v)).alias(f"c{i}")

    return df.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("k"), *[candidate(i, b) for i, b in enumerate(bundles)])


def _trust(c: Column) -> Column:
    return F.coalesce(c["trust"], F.lit(0))


def survivors(df: DataFrame, key: str, record: str, time: str, bundles: Iterable[Bundle], dependencies: Iterable[Dependency] = (), least_rows: int = 1, with_values: bool = False) -> DataFrame:
    """``(k, bundle, record[, v])``: for each group and bundle the number of the record that gives its fields (and their texts)."""
    bundles, dependencies = list(bundles), list(dependencies)
    if {d.of for d in dependencies} & {d.on for d in dependencies} or len({d.on for d in dependencies}) < len(dependencies):
        raise ValueError("a bundle that determines another may not depend on one, and none on two")
    at = {b.name: i for i, b in enumerate(bundles)}
    determined = {d.on for d in dependencies}
    dependents = {b.name: [d.on for d in dependencies if d.of == b.name] for b in bundles if b.name not in determined}
    rows = _candidates(df, key, record, time, bundles, with_values or bool(dependencies))
    value = lambda name: F.to_json(F.col(f"c{at[name]}")["v"])

    # level 0: branches of every root; a root that determines nothing has one per group
    cells = [F.struct(F.lit(r).alias("root"), (value(r) if on else F.lit("")).alias("x"), F.col(f"c{at[r]}").alias("t")) for r, on in dependents.items()]
    branches = rows.select("k", F.inline(F.array(*cells))).groupBy("k", "root", "x").agg(F.max("t").alias("t"), F.count(F.lit(1)).alias("n"))
    if dependencies:
        branches = scratch_table(branches, "branches")  # read for the incumbents and again for the open ones
    first = branches.groupBy("k", "root").agg(F.max(F.struct("t", "x")).alias("first"), F.sum("n").alias("n_rows"))
    if least_rows > 1:
        first = first.where(F.col("n_rows") >= least_rows)

    worth, pairs = {}, {}
    for d in dependencies:
        y, both = value(d.on), F.col(f"c{at[d.of]}").isNotNull() & F.col(f"c{at[d.on]}").isNotNull()
        worth[d.on] = rows.where(F.col(f"c{at[d.on]}").isNotNull()).groupBy("k", y.alias("y")).agg(F.max(f"c{at[d.on]}").alias("w"))
        worth[d.on] = scratch_table(worth[d.on], "worth")
        pairs[d.on] = scratch_table(rows.where(both).select("k", value(d.of).alias("x"), y.alias("y")).distinct(), "pairs")

    # bounds: what each dependent bundle can give at most
    for on in sorted(determined):
        first = first.join(worth[on].groupBy("k").agg(F.max("w").alias(f"top{at[on]}")), "k", "left")

    def evaluated(nodes: DataFrame) -> DataFrame:
        """``nodes`` (k, root, x, t, top...) with the best choice of every dependent bundle and the branch's value."""
        total = _trust(F.col("t"))
        for root, held in dependents.items():
            for on in held:
                i, mine = at[on], F.col("root") == root
                beside = nodes.where(mine).select("k", "x").join(pairs[on], ["k", "x"]).join(worth[on], ["k", "y"]).groupBy("k", "x").agg(F.max("w").alias(f"on{i}"))
                nodes = nodes.join(beside.withColumn("root", F.lit(root)), ["k", "root", "x"], "left")
                nodes = nodes.withColumn(f"on{i}", F.when(mine, F.coalesce(f"on{i}", f"top{i}")))
                total = total + _trust(F.col(f"on{i}"))
        return nodes.withColumn("value", total)

    bound = _trust(F.col("t"))
    for root, held in dependents.items():
        for on in held:
            bound = bound + F.when(F.col("root") == root, _trust(F.col(f"top{at[on]}"))).otherwise(F.lit(0))
    kept_tops = [f"top{at[on]}" for on in sorted(determined)]
    incumbents = evaluated(first.select("k", "root", F.col("first.x").alias("x"), F.col("first.t").alias("t"), *kept_tops))
    if dependencies:
        incumbents = scratch_table(incumbents, "incumbents")
    # level 1: branches whose bound reaches the incumbent stay open; a root that determines nothing has no other branch
    searched = [r for r, on in dependents.items() if on]
    open_ones = branches.where(F.col("root").isin(searched) & F.col("t").isNotNull()).join(incumbents.select("k", "root", F.col("value").alias("least"), F.col("x").alias("first"), *kept_tops), ["k", "root"])
    open_ones = open_ones.where((bound >= F.col("least")) & ~F.col("x").eqNullSafe(F.col("first")))
    nodes = incumbents.unionByName(evaluated(open_ones.select("k", "root", "x", "t", *kept_tops))) if searched else incumbents
    choices = [f"on{at[on]}" for on in sorted(determined)]
    best = nodes.groupBy("k", "root").agg(F.max(F.struct("value", "t", *choices)).alias("b")).select("k", "root", "b.*")
    chosen = [F.struct(F.col("root").alias("bundle"), F.col("t").alias("c"))]
    for root, held in dependents.items():
        chosen += [F.struct(F.when(F.col("root") == root, F.lit(on)).alias("bundle"), F.col(f"on{at[on]}").alias("c")) for on in held]
    out = best.select("k", F.inline(F.array(*chosen))).where("bundle is not null and c is not null")
    return out.select("k", "bundle", (-F.col("c.back")).alias("record"), *(["c.v"] if with_values else []))


def golden_records(df: DataFrame, key: str, record: str, time: str, bundles: Iterable[Bundle], dependencies: Iterable[Dependency] = ()) -> DataFrame:
    """One record per group: every field from the record that was chosen for its bundle; values travel with the search, so no row is fetched again."""
    bundles = list(bundles)
    held = survivors(df, key, record, time, bundles, dependencies, with_values=True)
    cells = [F.max(F.when(F.col("bundle") == b.name, F.col("v")[i])).cast(df.schema[f].dataType).alias(f) for b in bundles for i, f in enumerate(b.fields)]
    return held.groupBy(F.col("k").alias(key)).agg(*cells)
