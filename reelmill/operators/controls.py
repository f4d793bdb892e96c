"""Data-quality controls over a dict of tables: audit, journalled cleaning, verdicts, constraints.

A row-local control is a predicate on one row; a relational one gives its own anomalies. All row-local controls of a
table are evaluated in one scan: populations and anomalies as counts of predicates in one aggregation, the evidence as one
array of the failing controls. Counts are one row per control and are gathered from concurrent jobs. A predicate that is null is no anomaly; a check that is null passes.

Cleaning is a fold over rows: fixes of a table are applied in order within one projection, each seeing what the ones
before it left, and every change is appended to a journal array that travels with the row and is cut off at the end.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]

#: Scans at work at a time: counts of small tables fill the executors that a large one leaves idle.
SCANS = 8


def _gathered(spark: SparkSession, makers: Sequence[Callable[[], DataFrame]], schema: str) -> DataFrame:
    """The rows of all parts, a few per control, made, planned and run by concurrent jobs: one plan of them all would be planned as a whole."""
    with ThreadPoolExecutor(SCANS) as pool:
        rows = [tuple(r) for part in pool.map(lambda make: make().collect(), makers) for r in part]
    return spark.createDataFrame(rows, schema)


# Weights of severities.
SEVERITY_WEIGHT = {"critical": 4, "major": 3, "minor": 2, "info": 1}


@dataclass(frozen=True)
class Branch:
    """``table``'s rows where ``population`` holds are checked; those where ``anomaly`` holds fail. Spark SQL texts."""

    table: str
    anomaly: str
    population: str = "true"
    #: what the evidence shows of a failing row
    observed: str = "cast(null as string)"


@dataclass(frozen=True)
class Control:
    control_id: str
    dimension: str
    severity: str
    threshold: float
    treatment: str
    branches: tuple[Branch, ...] = ()
    #: of a relational control: (tables) -> ((population,), (record_key,)), one row of counts and the anomalies
    relational: Callable[[Tables], tuple[DataFrame, DataFrame]] | None = None


def _local(controls: Iterable[Control]) -> dict[str, list[tuple[Control, Branch]]]:
    by_table: dict[str, list[tuple[Control, Branch]]] = {}
    for c in controls:
        for b in c.branches:
            by_table.setdefault(b.table, []).append((c, b))
    return by_table


def results(tables: Tables, controls: Sequence[Control]) -> DataFrame:
    """``(control_id, checked_rows, anomaly_rows, anomaly_rate, passed)`` of every control; tables that are absent have no rows."""
    none = F.lit(0).cast("bigint")

    def local(table: str, held: list[tuple[Control, Branch]]) -> DataFrame:
        counts = [f"count_if(coalesce({b.population}, false)) as p{i}" for i, (_, b) in enumerate(held)]
        counts += [f"count_if(coalesce(({b.population}) and ({b.anomaly}), false)) as a{i}" for i, (_, b) in enumerate(held)]
        rows = ", ".join(f"struct('{c.control_id}' as control_id, p{i} as checked, a{i} as found)" for i, (c, _) in enumerate(held))
        return tables[table].selectExpr(*counts).selectExpr(f"inline(array({rows}))")

    def related(c: Control) -> DataFrame:
        population, found = c.relational(tables)
        name = F.lit(c.control_id).alias("control_id")
        return population.select(name, F.col("population").cast("bigint").alias("checked"), none.alias("found")).union(found.agg(F.count(F.lit(1)).alias("found")).select(name, none.alias("checked"), "found"))

    makers = [partial(local, table, held) for table, held in _local(controls).items() if table in tables]
    makers += [partial(related, c) for c in controls if c.relational is not None]
    measured = _gathered(next(iter(tables.values())).sparkSession, makers, "control_id string, checked bigint, found bigint")
    spark = next(iter(tables.values())).sparkSession
    limits = spark.createDataFrame([(c.control_id, float(c.threshold)) for c in controls], "control_id string, threshold double")
    sums = measured.groupBy("control_id").agg(F.sum("checked").alias("checked_rows"), F.sum("found").alias("anomaly_rows"))
    out = F.broadcast(limits).join(sums, "control_id", "left").na.fill(0, ["checked_rows", "anomaly_rows"])
    rate = F.try_divide(F.col("anomaly_rows"), F.col("checked_rows"))
    return out.select("control_id", "checked_rows", "anomaly_rows", F.round(rate, 6).alias("anomaly_rate"), (rate <= F.col("threshold")).alias("passed"))


def anomalies(tables: Tables, controls: Sequence[Control], keys: dict[str, str]) -> DataFrame:
    """``(control_id, table_name, record_key, observed_value)``: the evidence; ``keys`` holds each table's key as a Spark SQL text."""
    parts = None
    for table, held in _local(controls).items():
        if table not in tables:
            continue
        failing = F.array(*[F.when(F.expr(f"coalesce(({b.population}) and ({b.anomaly}), false)"), F.struct(F.lit(c.control_id).alias("control_id"), F.expr(b.observed).cast("string").alias("observed_value"))) for c, b in held])
        one = tables[table].select(F.inline(F.array_compact(failing)), F.lit(table).alias("table_name"), F.expr(keys[table]).cast("string").alias("record_key")).select("control_id", "table_name", "record_key", "observed_value")
        parts = one if parts is None else parts.unionByName(one)
    for c in controls:
        if c.relational is not None:
            one = c.relational(tables)[1].select(F.lit(c.control_id).alias("control_id"), F.lit(None).cast("string").alias("table_name"), F.col("record_key").cast("string").alias("record_key"), F.lit(None).cast("string").alias("observed_value"))
            parts = one if parts is None else parts.unionByName(one)
    return parts


def verdicts(before: DataFrame, after: DataFrame, controls: Sequence[Control]) -> DataFrame:
    """Each control's counts before and after, its priority and its verdict."""
    spark = before.sparkSession
    meta = spark.createDataFrame([(c.control_id, c.dimension, c.severity, c.treatment, SEVERITY_WEIGHT[c.severity]) for c in controls], "control_id string, dimension string, severity string, treatment string, weight int")
    b = before.select("control_id", F.col("checked_rows").alias("checked_before"), F.col("anomaly_rows").alias("anomalies_before"), F.col("anomaly_rate").alias("rate_before"))
    a = after.select("control_id", F.col("checked_rows").alias("checked_after"), F.col("anomaly_rows").alias("anomalies_after"), F.col("anomaly_rate").alias("rate_after"), F.col("passed").alias("passed_after"))
    percent = lambda c: F.round(100 * F.col(c), 2)
    j = F.broadcast(meta).join(b, "control_id").join(a, "control_id", "left").withColumns({"pct_before": percent("rate_before"), "pct_after": percent("rate_after")})
    found_after = F.coalesce("anomalies_after", F.lit(0))
    verdict = (
        F.when((F.col("checked_before") == 0) & (F.coalesce("checked_after", F.lit(0)) == 0), "not evaluable")
        .when((F.col("anomalies_before") == 0) & (found_after == 0), "compliant")
        .when(found_after == 0, "fixed")
        .when((F.col("treatment") == "keep") | F.col("passed_after"), "accepted")
        .otherwise("to do")
    )
    return j.withColumn("priority", F.round(F.col("weight") * 100 * F.coalesce("rate_before", F.lit(0.0)).cast("decimal(9,6)"), 2)).withColumn("verdict", verdict)


def dimension_scores(measured: DataFrame) -> DataFrame:
    """``(phase, dimension, controls, controls_passed, anomalies, score)`` of rows (phase, dimension, anomaly_rows, anomaly_rate, passed), with a row of all dimensions (null) per phase.

    ``controls`` counts those that could be evaluated; a rate that is null isn't averaged.
    """
    sets = measured.groupingSets([["phase", "dimension"], ["phase"]], "phase", "dimension")
    return sets.agg(F.count("passed").alias("controls"), F.count_if("passed").alias("controls_passed"), F.sum("anomaly_rows").alias("anomalies"), F.round(100 * F.avg(1 - F.col("anomaly_rate")), 2).alias("score"))


def matrix(spark: SparkSession, controls: Sequence[Control]) -> DataFrame:
    """The controls as a table, one row each; it replaces the stored one as a whole, so that controls no longer listed are gone."""
    held = []
    for c in controls:
        tables = sorted({b.table for b in c.branches})
        held.append((c.control_id, c.dimension, ", ".join(tables), " or ".join(sorted({b.anomaly for b in c.branches})), c.severity, float(c.threshold), c.treatment))
    rows = spark.createDataFrame(held, "control_id string, dimension string, table_name string, rule string, severity string, threshold double, treatment string")
    return rows.withColumn("updated_at", F.current_timestamp())


# --- cleaning -------------------------------------------------------------------------------------------------------

JOURNAL = "control_id string, table_name string, record_key string, column_name string, action string, old_value string, new_value string"
_ENTRY = "array<struct<control_id:string,column_name:string,action:string,old_value:string,new_value:string>>"


@dataclass(frozen=True)
class Fix:
    """Where ``when`` holds, ``column`` becomes ``value``; both Spark SQL texts over the row as it is by then."""

    control_id: str
    action: str
    column: str
    value: str
    when: str


def _text(df: DataFrame, column: str, c: Column) -> Column:
    return F.to_json(c) if df.schema[column].dataType.typeName() in ("array", "struct", "map") else c.cast("string")


def open_journal(df: DataFrame) -> DataFrame:
    return df if "__journal" in df.columns else df.withColumn("__journal", F.array().cast(_ENTRY))


def _steps(fixes: Iterable[Fix]) -> list[list[Fix]]:
    """Runs of fixes that may be made at once: none reads or changes a column another one of its run changes."""
    steps: list[list[Fix]] = []
    changed: set[str] = set()
    for f in fixes:
        if not steps or f.column in changed or changed & set(re.findall(r"\w+", f"{f.value} {f.when}")):
            steps.append([])
            changed = set()
        steps[-1].append(f)
        changed.add(f.column)
    return steps


def fix(df: DataFrame, fixes: Iterable[Fix]) -> DataFrame:
    """Apply the fixes in order; the journal travels in ``__journal``. Fixes that don't touch each other share a projection."""
    df = open_journal(df)
    for step in _steps(fixes):
        entries, columns = [], {}
        for f in step:
            new = F.expr(f.value).cast(df.schema[f.column].dataType)
            hit = F.expr(f"coalesce({f.when}, false)")
            entries.append(F.when(hit, F.struct(F.lit(f.control_id).alias("control_id"), F.lit(f.column).alias("column_name"), F.lit(f.action).alias("action"), _text(df, f.column, F.col(f.column)).alias("old_value"), _text(df, f.column, new).alias("new_value"))))
            columns[f.column] = F.when(hit, new).otherwise(F.col(f.column))
        df = df.withColumns({"__journal": F.concat("__journal", F.array_compact(F.array(*entries)).cast(_ENTRY)), **columns})
    return df


def close_journal(df: DataFrame, table: str, key: str) -> tuple[DataFrame, DataFrame]:
    """The table without its journal, and the journal as JOURNAL rows."""
    rows = df.select(F.lit(table).alias("table_name"), F.expr(key).cast("string").alias("record_key"), F.inline("__journal"))
    return df.drop("__journal"), rows.select("control_id", "table_name", "record_key", "column_name", "action", "old_value", "new_value")


def removed(df: DataFrame, control_id: str, table: str, key: str) -> DataFrame:
    """The journal of rows that are taken out, with the first 500 characters of the row."""
    row = F.substring(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), 1, 500)
    none = F.lit(None).cast("string")
    return df.select(F.lit(control_id).alias("control_id"), F.lit(table).alias("table_name"), F.expr(key).cast("string").alias("record_key"), none.alias("column_name"), F.lit("delete").alias("action"), row.alias("old_value"), none.alias("new_value"))


# --- constraints ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Constraint:
    """``kind``: primary key, foreign key, not null, unique (nulls differ), unique group (nulls equal) or check."""

    kind: str
    table: str
    columns: tuple[str, ...]
    predicate: str = ""
    parent: str = ""
    parent_key: str = ""

    @property
    def name(self) -> str:
        return f"{self.table}.{'+'.join(self.columns)} {self.kind}" + (f" {self.predicate}" if self.kind == "check" else "")


def violations(tables: Tables, constraints: Sequence[Constraint]) -> DataFrame:
    """``(name, kind, table_name, violations)`` of every constraint; row-local ones of a table share one scan."""
    local: dict[str, list[tuple[Constraint, str]]] = {}
    for c in constraints:
        if c.kind == "not null":
            local.setdefault(c.table, []).append((c, f"count_if({c.columns[0]} is null)"))
        elif c.kind == "check":
            local.setdefault(c.table, []).append((c, f"count_if(not coalesce({c.predicate}, true))"))

    def in_one_scan(table: str, held: list[tuple[Constraint, str]]) -> DataFrame:
        numbers = tables[table].selectExpr(*[f"{x} as n{i}" for i, (_, x) in enumerate(held)])
        rows = F.array(*[F.struct(F.lit(c.name).alias("name"), F.lit(c.kind).alias("kind"), F.lit(table).alias("table_name"), F.col(f"n{i}").alias("violations")) for i, (c, _) in enumerate(held)])
        return numbers.select(F.inline(rows))

    def of_keys(c: Constraint) -> DataFrame:
        df = tables[c.table]
        if c.kind == "foreign key":
            parent = tables[c.parent].select(F.col(c.parent_key).alias("__p")).distinct()
            bad = df.where(F.col(c.columns[0]).isNotNull()).join(parent, F.col(c.columns[0]) == F.col("__p"), "left_anti").agg(F.count(F.lit(1)).alias("violations"))
        else:
            null_key = " or ".join(f"{k} is null" for k in c.columns)
            broken = {"primary key": f"__n > 1 or {null_key}", "unique": f"__n > 1 and not ({null_key})", "unique group": "__n > 1"}[c.kind]
            bad = df.groupBy(*c.columns).agg(F.count(F.lit(1)).alias("__n")).selectExpr(f"count_if({broken}) as violations")
        return bad.select(F.lit(c.name).alias("name"), F.lit(c.kind).alias("kind"), F.lit(c.table).alias("table_name"), "violations")

    makers = [partial(in_one_scan, table, held) for table, held in local.items()]
    makers += [partial(of_keys, c) for c in constraints if c.kind not in ("not null", "check")]
    return _gathered(next(iter(tables.values())).sparkSession, makers, "name string, kind string, table_name string, violations bigint")
