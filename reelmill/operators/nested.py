"""Nested records to flat tables with parent-child links.

A relation is a dotted path through structs and arrays. Each array on the way becomes one ``transform`` whose lambda
attaches the ancestors' keys and indices; arrays in arrays are combined with ``flatten``; one ``inline`` per target
table emits the rows. Everything is a projection: no shuffle, no Python, and the scan reads only the leaves in use.

Edge cases: a missing array, a missing struct at any depth and an empty array give no rows; a null element gives no
row; a null key is kept as null in a flat table and gives no link. Columns of the input other than those named are
not read, so clashing names can't arise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Relation:
    """``path`` leads to the elements; ``key`` is the element's own key; ``fields`` the element's columns to keep.

    ``ancestors`` maps a step of the path (an array on the way) to the key of its elements, kept as ``<step>_<key>``.
    """

    name: str
    path: str
    key: str
    fields: tuple[str, ...] = ()
    ancestors: tuple[tuple[str, str], ...] = ()


def _kind(df: DataFrame, path: str) -> tuple[Column, T.DataType, list[str]]:
    first, *rest = path.split(".")
    return F.col(first), df.schema[first].dataType, rest


def relation_rows(df: DataFrame, relation: Relation, parent: str) -> Column:
    """The array of structs (parent key, ancestors' keys and indices, element columns) of each record."""
    start, kind, steps = _kind(df, relation.path)
    fields = relation.fields or (relation.key,)

    def leaf(x: Column, seen: list[Column]) -> Column:
        return F.struct(F.col(parent).alias(parent), *seen, *[x[f].alias(f) for f in fields])

    return _walk(start, kind, steps, relation, leaf)


def _walk(start: Column, kind: T.DataType, steps: list[str], relation: Relation, leaf) -> Column:
    """The leaves below ``start`` as one array; a null array at any level is read as an empty one."""

    def walk(column: Column, kind: T.DataType, steps: list[str], seen: list[Column], last: str) -> Column:
        if isinstance(kind, T.ArrayType):
            known = dict(relation.ancestors)

            def inner(x: Column, i: Column) -> Column:
                here = [*seen, i.alias(f"{last}_index")]
                if steps and last in known:
                    here.append(x[known[last]].alias(f"{last}_{known[last]}"))
                return walk(x, kind.elementType, steps, here, last)

            return F.coalesce(F.flatten(F.transform(column, inner)), F.array())
        if steps:
            return walk(column[steps[0]], kind[steps[0]].dataType, steps[1:], seen, steps[0])
        return F.filter(F.array(F.when(column.isNotNull(), leaf(column, seen))), lambda x: x.isNotNull())

    return walk(start, kind, steps, [], relation.path.split(".")[0])


def flat_table(df: DataFrame, relation: Relation, parent: str) -> DataFrame:
    """One row per element of ``relation``: the parent's key, an index per array on the way, the element's columns."""
    return df.select(F.inline(relation_rows(df, relation, parent)))


def flat_tables(df: DataFrame, relations: list[Relation], parent: str) -> dict[str, DataFrame]:
    """One flat table per relation, each with its own ``inline`` over its own leaves."""
    return {r.name: flat_table(df, r, parent) for r in relations}


def link_table(df: DataFrame, relations: list[Relation], parent: str) -> DataFrame:
    """``(parent, relation, child_id)``: the distinct links of all relations, from one scan and one ``inline``.

    A link needs a key that is neither null nor the empty text. Repeats within a record are removed before the
    shuffle; repeats across records in the partial aggregation below it, so a record in many copies weighs little.
    """

    def links(relation: Relation) -> Column:
        start, kind, steps = _kind(df, relation.path)

        def leaf(x: Column, seen: list[Column]) -> Column:
            return F.struct(F.col(parent).alias(parent), F.lit(relation.name).alias("relation"), x[relation.key].cast("string").alias("child_id"))

        rows = _walk(start, kind, steps, relation, leaf)
        return F.filter(rows, lambda x: x["child_id"].isNotNull() & (x["child_id"] != ""))

    combined = F.array_distinct(F.flatten(F.array(*[links(r) for r in relations])))
    return df.select(F.inline(combined)).distinct()
