"""Relational operators that the pipeline and the queries share; each is a composition of DataFrame operations.

All orders are total where they decide which row survives, so results don't depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _numbered(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def leading(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], n: int = 1, number: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key in ``order``, numbered if ``number`` names a column; null keys form a group of their own.

    Catalyst turns the filter into a group limit below the shuffle, so a hot key sends ``n`` rows per task.
    """
    out = _numbered(df, keys, order, number or "__at").where(F.col(number or "__at") <= n)
    return out if number else out.drop("__at")


def trailing(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """What :func:`leading` leaves: all rows but the first of each key."""
    return _numbered(df, keys, order, "__at").where("__at > 1").drop("__at")


def merge_upsert(target: DataFrame, staged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``target`` with ``staged`` rows replacing those of equal keys: insert, or update on conflict."""
    return target.join(staged, list(keys), "left_anti").unionByName(staged)


def merge_insert(target: DataFrame, staged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``target`` and the ``staged`` rows of new keys: insert, or do nothing on conflict."""
    return target.unionByName(staged.join(target, list(keys), "left_anti"))


def purge_stale(target: DataFrame, staged: DataFrame, owners: DataFrame, keys: Sequence[str], owner: str) -> DataFrame:
    """``target`` without the rows of reloaded owners that the load no longer holds."""
    reloaded = owners.select(owner).distinct()
    kept = target.join(reloaded, owner, "left_anti")
    confirmed = target.join(staged.select(*keys).distinct(), list(keys), "left_semi").join(reloaded, owner, "left_semi")
    return kept.unionByName(confirmed)


def purge_orphans(target: DataFrame, key: str, users: Iterable[tuple[DataFrame, str]]) -> DataFrame:
    """``target`` without the rows no user refers to; ``users`` are pairs of a table and its referring column."""
    used = None
    for table, column in users:
        refs = table.select(F.col(column).alias(key)).where(F.col(key).isNotNull()).distinct()
        used = refs if used is None else used.unionByName(refs)
    return target.join(used.distinct(), key, "left_semi")


def with_membership(df: DataFrame, column: str, members: DataFrame, member: str, name: str) -> DataFrame:
    """A boolean column: whether ``column`` is in ``members``; null where it is null (as IN has it)."""
    known = members.select(F.col(member).alias("__m")).where("__m is not null").distinct().withColumn("__in", F.lit(True))
    out = df.join(known, F.col(column) == F.col("__m"), "left")
    return out.withColumn(name, F.when(F.col(column).isNotNull(), F.coalesce("__in", F.lit(False)))).drop("__m", "__in")


def missing_any(df: DataFrame, parents: Iterable[tuple[str, DataFrame, str]]) -> DataFrame:
    """The rows of which at least one parent is missing; ``parents`` are (column, table, its key)."""
    out, missing = df, F.lit(False)
    for k, (column, table, key) in enumerate(parents):
        known = table.select(F.col(key).alias(f"__p{k}")).distinct()
        out = out.join(known, F.col(column) == F.col(f"__p{k}"), "left")
        missing = missing | F.col(f"__p{k}").isNull()
    return out.where(missing).select(df.columns)


def unpivot(df: DataFrame, columns: Sequence[str], name: str, value: str, kind: str = "double") -> DataFrame:
    """One row per column, in the order given."""
    cells = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias(name), F.col(c).cast(kind).alias(value)) for i, c in enumerate(columns)])
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(cells))


def fill_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column_name, n_rows, n_null, n_blank, useful_pct)`` of text columns, in one aggregation."""
    parts = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        parts += [F.count_if(F.col(c).isNull()).alias(f"null{i}"), F.count_if(F.trim(F.col(c)) == "").alias(f"blank{i}")]
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.col(f"null{i}").alias("n_null"), F.col(f"blank{i}").alias("n_blank")) for i, c in enumerate(columns)])
    out = df.agg(*parts).select(F.inline(cells))
    return out.withColumn("useful_pct", F.round(100.0 * F.try_divide(F.col("n_rows") - F.col("n_null") - F.col("n_blank"), F.col("n_rows")), 2))


def full_diff(left: DataFrame, right: DataFrame, keys: Sequence[str], left_name: str, right_name: str) -> DataFrame:
    """Keys that only one side has, with the side's name."""
    a, b = left.select(*keys).distinct().withColumn("__a", F.lit(1)), right.select(*keys).distinct().withColumn("__b", F.lit(1))
    both = a.join(b, list(keys), "full")
    return both.where("__a is null or __b is null").select(*keys, F.when(F.col("__b").isNull(), F.lit(left_name)).otherwise(F.lit(right_name)).alias("only_in"))


def contains_text(column: Column, needle: str) -> Column:
    """Case-insensitive containment of a literal text, whatever wildcards it holds."""
    escaped = needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return column.ilike(f"%{escaped}%")
