"""What changed between full snapshots of a table.

A snapshot is reduced to a key-to-hash index: per key 128 bits over the canonical values of all compared columns, in
which null differs from every value, in buckets of the key. The index of the last snapshot is probed with the next one:
a key that isn't held was added, one with another hash changed, one the next snapshot lacks was removed. Then the next
index takes the last one's place. :func:`changes` folds all snapshots of a table; :class:`SnapshotIndex` keeps the index
between deliveries. Old values are fetched only for keys that changed.

Scale. Only (key, snapshot, hash) is shuffled: to merge repeats within a snapshot, which partial aggregation mostly
does below the shuffle, and into its bucket. An index is never moved again, its buckets meet those of the next one. The
number of buckets follows the table's size; a key has one entry per snapshot, so no bucket is hot.

Edge cases: a null key or a null snapshot belongs to no record and is left out; rows of one key and snapshot that
differ are one record with the smallest hashes; an empty table gives nothing; columns may have any name, also that of
a result column.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelmill.session import estimated_bytes, scratch_dir, scratch_table
from reelmill.sources.files import Files

#: Bytes of a table per bucket of its index, and probes in one plan.
BUCKET_BYTES = 64 * 2**20
PROBES = 32


def value_hash(columns: Iterable[Column], seed: int) -> Column:
    """64 bits over the columns' values; a null is told from any value by a flag beside it."""
    parts = [F.lit(seed)]
    for c in columns:
        parts += [c.isNull(), c]
    return F.xxhash64(*parts)


def key_hash_index(df: DataFrame, key: str, snapshot: str, ignore: Iterable[str] = ()) -> DataFrame:
    """``(k, s, h1, h2)``: one entry per key and snapshot."""
    left_out = {key, snapshot, *ignore}
    compared = [F.col(f"`{c}`") for c in df.columns if c not in left_out]
    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{snapshot}`").alias("s"), value_hash(compared, 1).alias("h1"), value_hash(compared, 2).alias("h2"))
    return rows.where("k is not null and s is not null").groupBy("k", "s").agg(F.min("h1").alias("h1"), F.min("h2").alias("h2"))


def n_buckets(df: DataFrame) -> int:
    """Buckets of an index of ``df``: one per BUCKET_BYTES of it, and one per core at least; as many as a shuffle has where the size isn't known."""
    spark, size = df.sparkSession, estimated_bytes(df)
    if size >= 2**60:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES))


def write_buckets(index: DataFrame, path: str, buckets: int, by: str | None = None) -> DataFrame:
    """``index`` as a table in ``buckets`` buckets of its key, one file each, below ``path``; ``by``: a folder per value of it."""
    writer = index.repartition(buckets, "k").write.format("parquet").bucketBy(buckets, "k").sortBy("k").option("path", path)
    name = f"key_index_{uuid.uuid4().hex}"
    (writer.partitionBy(by) if by else writer).saveAsTable(name)
    return index.sparkSession.table(name)


def open_buckets(spark: SparkSession, schema: T.StructType, path: str, buckets: int) -> DataFrame:
    """An index that :func:`write_buckets` left at ``path``, maybe in another session."""
    name = f"key_index_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (k) SORTED BY (k) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def probe(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(k, change)`` of the index ``new`` against the index ``old``; buckets meet where they lie, nothing is shuffled."""
    old = old.select("k", F.col("h1").alias("o1"), F.col("h2").alias("o2"))
    kind = F.when(F.col("o1").isNull(), "added").when(F.col("h1").isNull(), "removed").when((F.col("h1") != F.col("o1")) | (F.col("h2") != F.col("o2")), "changed")
    return new.select("k", "h1", "h2").join(old, "k", "full").select("k", kind.alias("change")).where("change is not null")


def changes(df: DataFrame, key: str, snapshot: str, ignore: Iterable[str] = ()) -> DataFrame:
    """``(k, s, change, previous)``: each key added, removed or changed from a snapshot to the next one delivered.

    ``s`` is the later snapshot, ``previous`` the earlier one. The first snapshot has no cases. The indexes of all
    snapshots are written in one pass over the table; then they are folded in order: the last one is probed with the
    next, which takes its place.
    """
    spark = df.sparkSession
    index = write_buckets(key_hash_index(df, key, snapshot, ignore), f"{scratch_dir(spark)}/index-{uuid.uuid4().hex}", n_buckets(df), "s")
    labels = sorted(r[0] for r in index.select("s").distinct().collect())  # one per delivery
    kind = df.schema[snapshot].dataType
    schema = T.StructType([T.StructField("k", df.schema[key].dataType), T.StructField("s", kind), T.StructField("change", T.StringType()), T.StructField("previous", kind)])
    path, out = f"{scratch_dir(spark)}/changes-{uuid.uuid4().hex}", None
    for i in range(1, len(labels)):
        was, now = (index.where(F.col("s") == F.lit(x)) for x in labels[i - 1 : i + 1])
        one = probe(was, now).select("k", F.lit(labels[i]).cast(kind).alias("s"), "change", F.lit(labels[i - 1]).cast(kind).alias("previous"))
        out = one if out is None else out.unionByName(one)
        if i % PROBES == 0 and i + 1 < len(labels):  # a plan of thousands of joins would be slow to make
            out.write.mode("append").parquet(path)
            out = None
    if len(labels) <= PROBES + 1:
        return spark.createDataFrame([], schema) if out is None else out
    if out is not None:
        out.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def fetch_old_values(df: DataFrame, found: DataFrame, key: str, snapshot: str, columns: Iterable[str]) -> DataFrame:
    """``(k, s, column_name, old_value, new_value)`` of the columns that differ, for changed keys only.

    The table is read twice, each time reduced to the changed keys before anything is compared.
    """
    names = list(columns)
    changed = found.where("change = 'changed'").select("k", "s", "previous")
    sides = F.array(F.struct(F.col("previous").alias("at"), F.lit(False).alias("later")), F.struct(F.col("s").alias("at"), F.lit(True).alias("later")))
    wanted = changed.select("k", "s", F.inline(sides))
    values = [F.col(f"`{c}`").cast("string").alias(f"v{i}") for i, c in enumerate(names)]
    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{snapshot}`").alias("at"), F.struct(*values).alias("v"))
    both = wanted.join(rows, ["k", "at"]).groupBy("k", "s").agg(F.min(F.when(~F.col("later"), F.col("v"))).alias("old"), F.min(F.when(F.col("later"), F.col("v"))).alias("new"))
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"old.v{i}").alias("old_value"), F.col(f"new.v{i}").alias("new_value")) for i, c in enumerate(names)])
    return both.select("k", "s", F.inline(F.filter(cells, lambda c: ~c["old_value"].eqNullSafe(c["new_value"]))))


class SnapshotIndex:
    """The index of the last snapshot, kept below ``path`` between deliveries and swapped after each one.

    ``deliver`` reads the new snapshot, shuffles its entries into the buckets of the index in force and probes that
    where it lies. Every delivery has a folder of its own, also a corrected one under the label in force. The pointer is
    replaced when the changes are written, so a run that fails half-way leaves the former index in force; indexes beyond
    the last ``keep`` are deleted.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, ignore: Iterable[str] = (), keep: int = 2) -> None:
        self.spark, self.path, self.key, self.ignore, self.keep = spark, path, key, tuple(ignore), keep
        self.files = Files(spark)

    def deliver(self, snapshot: DataFrame, label: str) -> DataFrame:
        """``(k, change)`` against the index in force; of a first snapshot, nothing. Then the indexes are swapped."""
        pointer = f"{self.path}/current.json"
        held = json.loads(self.files.read(pointer) or '{"indexes": []}')["indexes"]
        new = key_hash_index(snapshot.withColumn("__s", F.lit(label)), self.key, "__s", self.ignore).drop("s")
        buckets = held[-1]["buckets"] if held else n_buckets(snapshot)
        place = f"index-{uuid.uuid4().hex}"
        new = write_buckets(new, f"{self.path}/{place}", buckets)
        if held:
            found = probe(open_buckets(self.spark, new.schema, f"{self.path}/{held[-1]['place']}", buckets), new)
        else:
            found = new.where("false").select("k", F.lit("").alias("change"))
        found = scratch_table(found, "changes")
        held.append({"place": place, "label": label, "buckets": buckets})
        self.files.replace(pointer, json.dumps({"indexes": held[-self.keep :]}))
        for old in held[: -self.keep]:
            self.files.delete(f"{self.path}/{old['place']}")
        return found
