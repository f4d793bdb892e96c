"""Column profiles per load from mergeable states, and tests on them.

The state of a load is of fixed size: exact counts (rows, filled, negative, broken constraints) and sketches of the most
frequent values and forms, of quantiles and of distinct values (:func:`sketches`). States of parts of the data (files,
partitions, days) are merged (:func:`merge_sketches`), so a profile is kept up to date without reading old data again.
Tests are declared: a :class:`Constraint` on rows, a :class:`Check` of the load before, control limits of all earlier
loads. All of them share the one scan and aggregation that make the state.

Results are exact. A share can only reach its limit for items the sketch holds, at most 1 / limit per load, column and
kind; these few are counted in a second scan (:func:`exact_counts`), as are the sizes in the narrow bracket the sketch
puts a median in. Where every distinct value is asked for (:func:`profile`), the state is how often each value stands
(:func:`state`, :func:`merge_states`), as large as the distinct values are.

Kinds of items:
  ``rows``     all rows, ``filled`` the rows that aren't null, ``negative`` the numbers below 0
  ``value``    one per value, ``form`` one per form of a text (see :func:`form`)
  ``size``     one per size of a number (its value without sign), 0 and what isn't finite left out.

Scale. One row per load and task is shuffled for the state. Items and brackets that are broadcast are a few per load and
column. What the second scan shuffles are counts of these items and of the distinct sizes within brackets.

Edge cases: a column that is null throughout a load has no values, forms or sizes there, and its shares count as 0; a
null load is left out; NaN is a value, but has no sign or size; an empty table has no state and fails no test.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelmill.session import scratch_table

#: Width of the buckets of the logarithm of a size by which a median is narrowed down.
SIZE_STEP = 0.001
#: Shares and factors that miss a limit by rounding alone reach it.
ROUNDING = 1e-9

#: Items a sketch of frequent items holds (its counts are off by 0.2 % of all at most), size of a sketch of quantiles (off
#: by 1 % of ranks), and the margin left for both.
TRACKED = 1000
QUANTILE_SIZE = 400
MARGIN = 0.03

#: Items that are counted by an expression each; more of them are counted by a join.
COMPILED = 500

#: Totals (loads x columns x kinds) that are broadcast; beyond it they are joined by a shuffle.
MAX_TOTALS = 500_000


def form(text: Column) -> Column:
    """Runs of capitals, of small letters and of digits each become one sign; other characters stay."""
    for pattern, sign in ((r"\p{Lu}+", "A"), (r"\p{Ll}+", "a"), (r"\p{Nd}+", "9")):
        text = F.regexp_replace(text, pattern, sign)
    return text


def form_pattern(item: str) -> str:
    """A regular expression of the texts whose form is ``item``; it is cheaper to match than a form is to make."""
    runs = {"A": r"\p{Lu}+", "a": r"\p{Ll}+", "9": r"\p{Nd}+"}
    return r"\A" + "".join(runs.get(c) or re.escape(c) for c in item) + r"\z"


@dataclass(frozen=True)
class Check:
    """A declared test of a column's profile against the load before.

    ``kind`` names the items compared; a share moves by ``limit`` or a median by the factor ``limit``.
    """

    kind: str
    limit: float


DRIFT = (Check("filled", 0.15), Check("negative", 0.15), Check("value", 0.15), Check("form", 0.15), Check("size", 3.0))


def _is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def state(df: DataFrame, load: str, columns: Iterable[str] | None = None) -> DataFrame:
    """``(load, column_name, type, item, n)``: the mergeable state, from one scan; ``type`` is number, text or other."""
    names = [c for c in (columns if columns is not None else df.columns) if c != load]

    def cell(name: str) -> Column:
        c, kind = F.col(f"`{name}`"), df.schema[name].dataType
        text = c.cast("string") if isinstance(kind, (T.AtomicType, T.NullType)) else F.to_json(c)
        what = "number" if _is_number(kind) else "text" if isinstance(kind, T.StringType) else "other"
        return F.struct(F.lit(name).alias("column_name"), F.lit(what).alias("type"), text.alias("item"))

    rows = df.select(F.col(f"`{load}`").alias("load"), F.array(*[cell(c) for c in names]).alias("cells")).where("load is not null")
    return rows.select("load", F.inline("cells")).groupBy("load", "column_name", "type", "item").agg(F.count(F.lit(1)).alias("n"))


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of all rows behind ``states``."""
    merged = states[0]
    for s in states[1:]:
        merged = merged.unionByName(s)
    return merged.groupBy("load", "column_name", "type", "item").agg(F.sum("n").alias("n"))


def expand(held: DataFrame) -> DataFrame:
    """``(load, column_name, kind, item, n)``: the items of all kinds, from a state's distinct values."""
    filled, is_number = F.col("item").isNotNull(), F.col("type") == "number"
    x = F.when(is_number, F.expr("try_cast(item as double)"))
    finite = F.coalesce(~F.isnan(x) & (F.abs(x) < math.inf), F.lit(False))
    nothing = F.lit(None).cast("string")

    def item(kind: str, value: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), value.alias("item")))

    derived = F.array(
        item("rows", nothing, F.lit(True)),
        item("filled", nothing, filled),
        item("form", form(F.col("item")), filled & (F.col("type") == "text")),
        item("negative", nothing, finite & (x < 0)),
        item("size", F.abs(x).cast("string"), finite & (x != 0)),
    )
    counted = held.select("load", "column_name", "n", F.inline(F.array_compact(derived))).groupBy("load", "column_name", "kind", "item").agg(F.sum("n").alias("n"))
    values = held.where("item is not null").select("load", "column_name", F.lit("value").alias("kind"), "item", "n")
    return counted.unionByName(values)


def _totals(held: DataFrame) -> DataFrame:
    return held.where("kind in ('rows', 'filled')").groupBy("load", "column_name").agg(F.sum(F.when(F.col("kind") == "rows", F.col("n"))).alias("all_rows"), F.coalesce(F.sum(F.when(F.col("kind") == "filled", F.col("n"))), F.lit(0)).alias("filled_rows"))


def medians(held: DataFrame) -> DataFrame:
    """``(load, column_name, median)`` of the sizes: the smallest one that at least half of them don't exceed.

    Counts by bucket, a few ten thousand per load and column, tell the bucket the median is in; only that one's distinct
    sizes are sorted.
    """
    sizes = held.where("kind = 'size'").withColumn("x", F.col("item").cast("double")).withColumn("bucket", F.floor(F.log("x") / SIZE_STEP))
    line = Window.partitionBy("load", "column_name")
    run = sizes.groupBy("load", "column_name", "bucket").agg(F.sum("n").alias("m"))
    run = run.withColumn("upto", F.sum("m").over(line.orderBy("bucket"))).withColumn("total", F.sum("m").over(line)).where("2 * upto >= total")
    middle = run.groupBy("load", "column_name").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("m")).alias("below"), "total")).alias("b")).select("load", "column_name", "b.*")
    inside = sizes.join(middle, ["load", "column_name", "bucket"])
    inside = inside.withColumn("upto", F.col("below") + F.sum("n").over(line.orderBy("x")))
    return inside.where("2 * upto >= total").groupBy("load", "column_name").agg(F.min("x").alias("median"))


def _ordered(totals: DataFrame) -> DataFrame:
    """The loads with their number from 0; there are as many rows as loads."""
    return totals.select("load").distinct().withColumn("at", F.row_number().over(Window.orderBy("load")) - 1)


def drift(held: DataFrame, checks: Iterable[Check] = DRIFT) -> DataFrame:
    """``(load, column_name, kind, item, moved)``: what departs from the load before, by which measure.

    ``held`` is an expanded state of exact counts; it should be materialised, as every test reads it.
    """
    checks = list(checks)
    return _moved(_totals(held), held, medians(held) if any(c.kind == "size" for c in checks) else None, checks)


def _moved(totals: DataFrame, items: DataFrame, middles: DataFrame | None, checks: Iterable[Check]) -> DataFrame:
    """:func:`drift` of totals ``(load, column_name, all_rows, filled_rows)``, counted items and medians."""
    held = items
    checks = {c.kind: c.limit for c in checks}
    loads = _ordered(totals)
    n_totals = totals.count()

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if n_totals <= MAX_TOTALS else df

    grid = totals.join(small(loads), "load")
    # shares: what is counted, over all rows or over the filled ones
    limit = F.lit(None).cast("double")
    for kind, least in checks.items():
        if kind != "size":
            limit = F.when(F.col("kind") == kind, F.lit(least)).otherwise(limit)
    shares = held.where(F.col("kind").isin([k for k in checks if k != "size"])).join(small(grid), ["load", "column_name"])
    of = F.when(F.col("kind") == "filled", F.col("all_rows")).otherwise(F.col("filled_rows"))
    shares = shares.select("column_name", "kind", "item", "at", (F.col("n") / of).alias("share"), limit.alias("limit"))
    per_item = shares.groupBy("column_name", "kind", "item", "limit").agg(F.max("share").alias("top"), F.map_from_entries(F.collect_list(F.struct("at", "share"))).alias("by_load")).where(F.col("top") >= F.col("limit") - ROUNDING)
    pairs = grid.select("load", "column_name", "at").join(per_item, "column_name")
    move = F.coalesce(F.col("by_load")[F.col("at")], F.lit(0.0)) - F.coalesce(F.col("by_load")[F.col("at") - 1], F.lit(0.0))
    moved = pairs.where("at > 0").select("load", "column_name", "kind", "item", move.alias("moved"), "limit").where(F.abs("moved") >= F.col("limit") - ROUNDING).drop("limit")
    if middles is None:
        return moved
    line = Window.partitionBy("column_name").orderBy("at")
    m = middles.join(small(loads), "load")
    m = m.withColumn("was", F.lag("median").over(line)).withColumn("was_at", F.lag("at").over(line)).where("was_at = at - 1")
    factor = F.greatest(F.col("median") / F.col("was"), F.col("was") / F.col("median"))
    far = m.select("load", "column_name", F.lit("size").alias("kind"), F.lit(None).cast("string").alias("item"), factor.alias("moved")).where(F.col("moved") >= checks["size"] * (1 - ROUNDING))
    return moved.unionByName(far)


@dataclass(frozen=True)
class Constraint:
    """A declared rule of a column: rows where ``holds`` (Spark SQL) is false break it; a null breaks nothing."""

    name: str
    column: str
    holds: str


def sketches(df: DataFrame, load: str, columns: Iterable[str] | None = None, constraints: Iterable[Constraint] = ()) -> DataFrame:
    """The mergeable state of fixed size, one row per load and column, from one scan and one aggregation.

    ``(load, column_name, all_rows, filled_rows, negative_rows, broken, top_values, top_forms, sizes, distinct)``:
    exact counts, counts of broken constraints by name, and sketches of the most frequent values and forms, of the
    quantiles of sizes and of the distinct values. Constraints and sketches of all columns are compiled into the same
    aggregation. A column's constraints are those that name it.
    """
    constraints = list(constraints)
    names = [c for c in (columns if columns is not None else df.columns) if c != load]
    parts, cells = [], []
    for i, name in enumerate(names):
        c, kind = F.col(f"`{name}`"), df.schema[name].dataType
        text = c.cast("string") if isinstance(kind, (T.AtomicType, T.NullType)) else F.to_json(c)
        size, negative = F.lit(None).cast("double"), F.lit(0).cast("bigint")
        if _is_number(kind):
            x = c.cast("double")
            finite = F.coalesce(~F.isnan(x) & (F.abs(x) < math.inf), F.lit(False))
            size = F.when(finite & (x != 0), F.abs(x))
            negative = F.count_if(finite & (x < 0))
        shape = form(c) if isinstance(kind, T.StringType) else F.lit(None).cast("string")
        mine = [k for k in constraints if k.column == name]
        broken = F.create_map(*[x for k in mine for x in (F.lit(k.name), F.count_if(~F.coalesce(F.expr(k.holds), F.lit(True))))]) if mine else F.create_map().cast("map<string,bigint>")
        values = {
            "filled_rows": F.count(c), "negative_rows": negative, "broken": broken, "top_values": F.call_function("approx_top_k_accumulate", text, F.lit(TRACKED)),
            "top_forms": F.call_function("approx_top_k_accumulate", shape, F.lit(TRACKED)), "sizes": F.kll_sketch_agg_double(size, QUANTILE_SIZE), "distinct": F.hll_sketch_agg(text),
        }
        parts += [v.alias(f"{k}{i}") for k, v in values.items()]
        cells.append(F.struct(F.lit(name).alias("column_name"), F.col("all_rows"), *[F.col(f"{k}{i}").alias(k) for k in values]))
    rows = df.where(F.col(f"`{load}`").isNotNull()).groupBy(F.col(f"`{load}`").alias("load")).agg(F.count(F.lit(1)).alias("all_rows"), *parts)
    return rows.select("load", F.inline(F.array(*cells)))


def merge_sketches(*states: DataFrame) -> DataFrame:
    """The state of all rows behind ``states``."""
    merged = states[0]
    for s in states[1:]:
        merged = merged.unionByName(s)
    sums = [F.sum(c).alias(c) for c in ("all_rows", "filled_rows", "negative_rows")]
    broken = F.expr("aggregate(collect_list(broken), cast(map() as map<string,bigint>), (a, b) -> map_zip_with(a, b, (k, x, y) -> coalesce(x, 0L) + coalesce(y, 0L)))").alias("broken")
    tops = [F.call_function("approx_top_k_combine", F.col(c)).alias(c) for c in ("top_values", "top_forms")]
    return merged.groupBy("load", "column_name").agg(*sums, broken, *tops, F.kll_merge_agg_double("sizes").alias("sizes"), F.hll_union_agg("distinct").alias("distinct"))


def _candidates(held: DataFrame, checks: dict[str, float]) -> DataFrame:
    """``(column_name, kind, item)``: what may reach its limit in some load; at most 1 / (limit - MARGIN) items per load, column and kind."""
    out = None
    for kind, sketch in (("value", "top_values"), ("form", "top_forms")):
        if kind in checks:
            least = checks[kind] - MARGIN
            top = F.call_function("approx_top_k_estimate", F.col(sketch), F.lit(int(1 / least) + 2))
            one = held.where("filled_rows > 0").select("column_name", F.lit(kind).alias("kind"), "filled_rows", F.inline(top))
            one = one.where(F.col("item").isNotNull() & (F.col("count") >= least * F.col("filled_rows"))).select("column_name", "kind", "item")
            out = one if out is None else out.unionByName(one)
    return None if out is None else out.distinct()


def exact_counts(df: DataFrame, load: str, held: DataFrame, checks: Iterable[Check] = DRIFT) -> tuple[DataFrame, DataFrame | None]:
    """``(items, medians)`` behind a state of sketches, exactly, by a second scan.

    Only items that may reach their limit are counted, and of the sizes those near the middle; what is broadcast are a
    few rows per load and column. A median that the sketch placed wrongly, which its bound makes rarer than one in a
    million, is taken from all sizes.
    """
    checks = {c.kind: c.limit for c in checks}
    names = [r[0] for r in held.select("column_name").distinct().collect()]
    known = held.select("load", "column_name", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(None).cast("string").alias("item"), F.col(c).alias("n")) for k, c in (("filled", "filled_rows"), ("negative", "negative_rows")) if k in checks] or [F.struct(F.lit("none").alias("kind"), F.lit(None).cast("string").alias("item"), F.lit(0).cast("bigint").alias("n"))])))
    items = known.where("kind <> 'none' and n > 0")
    wanted = _candidates(held, checks)
    if wanted is not None:
        few = [tuple(r) for r in wanted.limit(COMPILED + 1).collect()]
        count = _compiled_counts(df, load, few) if len(few) <= COMPILED else _joined_counts(df, load, names, wanted)
        items = items if count is None else items.unionByName(count)
    numeric = [name for name in names if _is_number(df.schema[name].dataType)]
    if "size" not in checks:
        return items, None
    near = F.kll_sketch_get_quantile_double("sizes", F.array(F.lit(0.5 - MARGIN), F.lit(0.5 + MARGIN)))
    brackets = held.where(F.col("column_name").isin(numeric) & (F.kll_sketch_get_n_double("sizes") > 0)).select("load", "column_name", F.kll_sketch_get_n_double("sizes").alias("total"), near.alias("q"))
    brackets = scratch_table(brackets.select("load", "column_name", "total", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi")), "brackets")
    if not numeric or brackets.isEmpty():
        return items, brackets.select("load", "column_name", F.col("lo").alias("median"))
    sizes = F.array(*[F.struct(F.lit(name).alias("column_name"), F.abs(F.col(f"`{name}`").cast("double")).alias("x")) for name in numeric])
    sizes = df.where(F.col(f"`{load}`").isNotNull()).select(F.col(f"`{load}`").alias("load"), F.inline(sizes)).where(f"x > 0 and not isnan(x) and x < double('inf')")
    # sizes below the bracket are one item, those above it none
    placed = sizes.join(F.broadcast(brackets), ["load", "column_name"]).where("x <= hi").select("load", "column_name", "total", F.when(F.col("x") >= F.col("lo"), F.col("x")).alias("x"))
    placed = placed.groupBy("load", "column_name", "total", "x").agg(F.count(F.lit(1)).alias("n"))
    line = Window.partitionBy("load", "column_name").orderBy(F.col("x").asc_nulls_first())
    run = placed.withColumn("upto", F.sum("n").over(line)).where("2 * upto >= total").groupBy("load", "column_name").agg(F.min("x").alias("median"), F.min(F.coalesce("x", F.lit(-1.0))).alias("first"))
    found = scratch_table(run.where("first >= 0").select("load", "column_name", "median"), "medians")
    lost = scratch_table(brackets.join(found, ["load", "column_name"], "left_anti").select("load", "column_name"), "lost")
    if not lost.isEmpty():
        again = sizes.join(F.broadcast(lost), ["load", "column_name"]).select("load", "column_name", F.lit("size").alias("kind"), F.col("x").cast("string").alias("item")).groupBy("load", "column_name", "kind", "item").agg(F.count(F.lit(1)).alias("n"))
        found = found.unionByName(medians(again))
    return items, found


def _as_text(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    return c.cast("string") if isinstance(df.schema[name].dataType, (T.AtomicType, T.NullType)) else F.to_json(c)


def _compiled_counts(df: DataFrame, load: str, wanted: list[tuple[str, str, str]]) -> DataFrame | None:
    """``(load, column_name, kind, item, n)`` of the items wanted, each one a count in one aggregation."""
    if not wanted:
        return None
    at = {name: i for i, name in enumerate(sorted({name for name, _, _ in wanted}))}
    rows = df.where(F.col(f"`{load}`").isNotNull()).select(F.col(f"`{load}`").alias("load"), *[_as_text(df, name).alias(f"c{i}") for name, i in at.items()])
    has = lambda name, kind, item: F.col(f"c{at[name]}") == F.lit(item) if kind == "value" else F.col(f"c{at[name]}").rlike(form_pattern(item))
    counts = [F.count_if(has(*w)).alias(f"n{j}") for j, w in enumerate(wanted)]
    cells = F.array(*[F.struct(F.lit(name).alias("column_name"), F.lit(kind).alias("kind"), F.lit(item).alias("item"), F.col(f"n{j}").alias("n")) for j, (name, kind, item) in enumerate(wanted)])
    return rows.groupBy("load").agg(*counts).select("load", F.inline(cells)).where("n > 0")


def _joined_counts(df: DataFrame, load: str, names: list[str], wanted: DataFrame) -> DataFrame:
    """The same by a join with the items, for many loads with items of their own."""
    cells = []
    for name in names:
        cells.append(F.struct(F.lit(name).alias("column_name"), F.lit("value").alias("kind"), _as_text(df, name).alias("item")))
        if isinstance(df.schema[name].dataType, T.StringType):
            cells.append(F.struct(F.lit(name).alias("column_name"), F.lit("form").alias("kind"), form(F.col(f"`{name}`")).alias("item")))
    rows = df.where(F.col(f"`{load}`").isNotNull()).select(F.col(f"`{load}`").alias("load"), F.inline(F.array(*cells))).where("item is not null")
    return rows.join(F.broadcast(wanted), ["column_name", "kind", "item"]).groupBy("load", "column_name", "kind", "item").agg(F.count(F.lit(1)).alias("n"))


def departures(df: DataFrame, load: str, ignore: Iterable[str] = (), checks: Iterable[Check] = DRIFT) -> DataFrame:
    """:func:`drift` of a table, through a state of sketches and exact counts of what may reach a limit."""
    left_out, checks = set(ignore), list(checks)
    columns = [c for c in df.columns if c not in left_out]
    held = scratch_table(sketches(df, load, columns), "sketches")
    items, middles = exact_counts(df, load, held, checks)
    return _moved(held.select("load", "column_name", "all_rows", "filled_rows"), scratch_table(items, "items"), middles, checks)


def broken_constraints(held: DataFrame) -> DataFrame:
    """``(load, column_name, constraint, checked_rows, broken_rows)`` of a state of sketches."""
    return held.select("load", "column_name", "all_rows", F.explode("broken").alias("constraint", "broken_rows")).select("load", "column_name", "constraint", F.col("all_rows").alias("checked_rows"), "broken_rows")


def profile(df: DataFrame, load: str, ignore: Iterable[str] = ()) -> DataFrame:
    """``(load, column_name, n_rows, n_null, n_distinct, top_share, least, most, ...)``: the profile of every column per load.

    Ranges and distinct counts come from the same state as everything else: the values are its items.
    """
    left_out = set(ignore)
    names = [c for c in df.columns if c not in left_out]
    held = expand(state(df, load, names))
    numeric = [c for c in names if c != load and _is_number(df.schema[c].dataType)]
    is_number = F.col("column_name").isin(numeric) if numeric else F.lit(False)
    value = F.col("kind") == "value"
    number = F.when(value & is_number, F.expr("try_cast(item as double)"))
    number = F.when(~F.isnan(number), number)
    count = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).cast("bigint")
    out = held.groupBy("load", "column_name").agg(
        count("rows").alias("n_rows"),
        (count("rows") - count("filled")).alias("n_null"),
        F.sum(F.when(value, 1).otherwise(0)).cast("bigint").alias("n_distinct"),
        F.max(F.when(value, F.col("n"))).cast("bigint").alias("top_count"),
        count("negative").alias("n_negative"),
        F.sum(F.when(F.col("kind") == "form", 1).otherwise(0)).cast("bigint").alias("n_forms"),
        F.min(number).alias("least"),
        F.max(number).alias("most"),
    )
    return out


def control_limits(df: DataFrame, load: str, ignore: Iterable[str] = (), width: float = 3.0, least_history: int = 3) -> DataFrame:
    """``(load, column_name, metric, value, centre, spread)``: metrics outside centre +/- width * spread of all earlier loads.

    Metrics are the shares of nulls and of negatives and the logarithm of the median size, from a state of sketches and
    exact medians. A spread below 0.01 counts as 0.01, so that a metric that never moved isn't flagged for noise.
    """
    left_out = set(ignore)
    held = scratch_table(sketches(df, load, [c for c in df.columns if c not in left_out]), "sketches")
    _, middles = exact_counts(df, load, held, (Check("size", 3.0),))
    share = lambda name, x: F.struct(F.lit(name).alias("metric"), x.cast("double").alias("value"))
    shares = F.array(share("null_share", 1 - F.col("filled_rows") / F.col("all_rows")), F.when(F.col("negative_rows") > 0, share("negative_share", F.try_divide("negative_rows", "filled_rows"))))
    m = held.select("load", "column_name", F.inline(F.array_compact(shares)))
    m = m.unionByName(middles.select("load", "column_name", F.lit("log_median").alias("metric"), F.log("median").alias("value")))
    past = Window.partitionBy("column_name", "metric").orderBy("load").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("history", F.count("value").over(past)).withColumn("centre", F.avg("value").over(past)).withColumn("spread", F.greatest(F.stddev_pop("value").over(past), F.lit(0.01)))
    return m.where((F.col("history") >= least_history) & (F.abs(F.col("value") - F.col("centre")) > width * F.col("spread"))).drop("history")
