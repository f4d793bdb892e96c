"""Exactly one copy of each message of an at-least-once feed.

A message is a number in its producer's sequence (here: the moment of a film's message, in microseconds). Per producer
the numbers seen so far are kept as disjoint closed ranges. A number that no range covers is accepted and becomes or
extends a range; a covered one is a redelivery. Deliveries and the ranges of earlier batches are swept in the order of
their numbers, of equal numbers the earliest delivery first: a sweep holds one open range, which decides each number.

Scale. Each Arrow batch is swept by itself before the shuffle, so that a number delivered a million times reaches the
reducer once per batch; what is found to be a repeat there travels with a random-looking route, so that no reducer gets
a hot number's copies. The one shuffle is by producer. A producer with more than ROWS_PER_BLOCK messages in the batch,
who may send a third of all, is cut into blocks of numbers, as many as its counted messages need, and earlier ranges are
cut where blocks end. A reducer streams through its sorted rows and holds nothing but the open range.

Identifiers that don't parse are resolved by exact keyed lookup of their text, also over batches. A null producer or a
null number identifies nothing: such a delivery is never a redelivery. Of equal delivery numbers one counts as the
earlier. Equal rows are redeliveries of the first; an empty batch accepts nothing and hands the state on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Messages of one producer that a reducer sweeps; with more the producer is cut into blocks.
ROWS_PER_BLOCK = 5_000_000

#: Ranges of numbers, and the texts of identifiers that don't parse.
STATE = "producer bigint, lo bigint, hi bigint, producer_text string, number_text string"

_SWEPT = "producer bigint, block bigint, lo bigint, hi bigint, old boolean, delivery bigint, again boolean"
_FOLDED = "delivery bigint, again boolean, producer bigint, lo bigint, hi bigint"


def sweep(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """``(covered, opens)`` of rows sorted by (producer, block, lo, old ranges first, delivery).

    ``covered``: a range before it holds the row's number; ``opens``: the row begins a range. All groups at once: the
    open range's end is the greatest end so far within the group.
    """
    producer, block, lo = (rows[c].to_numpy(np.int64) for c in ("producer", "block", "lo"))
    begins = np.concatenate([[True], (producer[1:] != producer[:-1]) | (block[1:] != block[:-1])])
    ends = rows["hi"].groupby(np.cumsum(begins)).cummax().to_numpy(np.int64)
    before = np.concatenate([[0], ends[:-1]])
    covered = ~begins & (lo <= before)
    return covered, begins | (lo > before + 1)


def _locally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mark what a batch by itself shows to be redelivered."""
    for batch in batches:
        batch = batch.sort_values(["producer", "block", "lo", "delivery"], kind="stable", ignore_index=True)
        yield batch.assign(again=sweep(batch)[0] if len(batch) else False)


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sweep sorted rows; yields messages as (delivery, again) and ranges, once closed, as (producer, lo, hi)."""
    open_range: pd.DataFrame | None = None

    def messages(delivery: np.ndarray, again: np.ndarray) -> pd.DataFrame:
        none = pd.array([pd.NA] * len(delivery), "Int64")
        return pd.DataFrame({"delivery": pd.array(delivery, "Int64"), "again": again, "producer": none, "lo": none, "hi": none})

    def ranges(held: pd.DataFrame) -> pd.DataFrame:
        none = pd.array([pd.NA] * len(held), "Int64")
        return pd.DataFrame({"delivery": none, "again": none.astype("boolean"), **{c: pd.array(held[c].to_numpy(np.int64), "Int64") for c in ("producer", "lo", "hi")}})

    for batch in batches:
        passed = batch["again"].to_numpy(bool)
        if passed.any():
            done = batch["delivery"].to_numpy(np.int64)[passed]
            yield messages(done, np.ones(len(done), bool))
            batch = batch[~passed]
        if batch.empty:
            continue
        rows = batch.reset_index(drop=True) if open_range is None else pd.concat([open_range, batch], ignore_index=True)
        covered, opens = sweep(rows)
        is_message = ~rows["old"].to_numpy(bool)
        yield messages(rows["delivery"].to_numpy(np.int64)[is_message], covered[is_message])
        held = rows[opens][["producer", "block", "lo"]].assign(hi=rows["hi"].groupby(np.cumsum(opens)).max().to_numpy(np.int64))
        open_range = held.iloc[-1:].assign(old=True, delivery=0, again=False)
        if len(held) > 1:
            yield ranges(held.iloc[:-1])
    if open_range is not None:
        yield ranges(open_range)


def _blocks(rows: DataFrame) -> DataFrame:
    """``(producer, base, width, last)`` of the producers with more than ROWS_PER_BLOCK rows: at most one per so many rows."""
    counted = rows.groupBy("producer").agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("base"), F.max("number").alias("top")).where(F.col("n") > ROWS_PER_BLOCK)
    n = F.ceil(F.col("n") / ROWS_PER_BLOCK)
    width = F.greatest(F.lit(1), F.expr("top div 1 - base div 1") / n + 1).cast("bigint")
    sized = counted.select("producer", "base", "top", width.alias("width"))
    return F.broadcast(sized.select("producer", "base", "width", F.expr("(top - base) div width").alias("last")))


def fold_batch(batch: DataFrame, producer: Column, number: Column, delivery: Column, state: DataFrame | None = None) -> DataFrame:
    """Fold one batch of deliveries into the ranges of ``state`` (STATE; None: nothing seen so far).

    The result holds rows of two kinds: messages ``(delivery, again)`` and ranges ``(producer, lo, hi)``. Rows with a
    null producer, number or delivery are left out; see :func:`redelivered`.
    """
    rows = batch.select(producer.cast("bigint").alias("producer"), number.cast("bigint").alias("number"), delivery.cast("bigint").alias("delivery")).dropna()
    blocks = _blocks(rows)
    block = F.when(F.col("width").isNotNull(), F.expr("(number - base) div width")).otherwise(F.lit(0))
    no = F.lit(False)
    rows = rows.join(blocks, "producer", "left").select("producer", block.alias("block"), F.col("number").alias("lo"), F.col("number").alias("hi"), no.alias("old"), "delivery", no.alias("again"))
    rows = rows.mapInPandas(_locally, _SWEPT)
    if state is not None:
        held = state.where("lo is not null").join(blocks, "producer", "left")
        # a range is cut where blocks end; what lies outside the batch's numbers is a block before or behind them
        at = lambda x: f"greatest(-1L, least(last + 1, cast(floor(({x} - base) / width) as bigint)))"
        parts = held.withColumn("block", F.explode(F.when(F.col("width").isNotNull(), F.expr(f"sequence({at('lo')}, {at('hi')})")).otherwise(F.array(F.lit(0).cast("bigint")))))
        lo = F.expr("case when width is null or block < 0 then lo else greatest(lo, base + block * width) end")
        hi = F.expr("case when width is null or block > last then hi else least(hi, base + (block + 1) * width - 1) end")
        rows = rows.unionByName(parts.select("producer", "block", lo.alias("lo"), hi.alias("hi"), F.lit(True).alias("old"), F.lit(0).cast("bigint").alias("delivery"), no.alias("again")))
    route = F.when(F.col("again"), F.xxhash64("delivery")).otherwise(F.xxhash64("producer", "block"))
    routed = rows.repartition(route).sortWithinPartitions("producer", "block", "lo", F.col("old").desc(), "delivery")
    return routed.mapInPandas(_fold, _FOLDED)


def by_text(batch: DataFrame, keys: list[Column], delivery: Column) -> DataFrame:
    """``(delivery)``: repeats among identifiers that don't parse, by exact lookup of their text.

    The first delivery of each key is found with partial aggregation and removed by a join on the delivery number,
    which is unique, so a hot key makes no hot task.
    """
    named = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    rows = batch.select(*named, delivery.cast("bigint").alias("delivery")).dropna()
    first = _first_texts(rows, [f"k{i}" for i in range(len(keys))])
    again = rows.select("delivery").join(first.select("delivery"), "delivery", "left_anti")
    return again.unionByName(first.where("n > 1").select(F.explode(F.array_repeat("delivery", (F.col("n") - 1).cast("int"))).alias("delivery")))


def _first_texts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first delivery of each key, and how many rows have its number."""
    counted = rows.groupBy(*keys, "delivery").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*keys).agg(F.min(F.struct("delivery", "n")).alias("f")).select(*keys, "f.delivery", "f.n")


def moment(text: Column) -> Column:
    """Microseconds since 1970 of an ISO-8601 text, whatever its offset or precision; null where it is none."""
    zoned = F.when(text.rlike(r"(?:[zZ]|[+-]\d\d:?\d\d)\s*$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.unix_micros(zoned.try_cast("timestamp"))


def redelivered(messages: DataFrame, film: str = "movie_id", fetched: str = "fetched_at", delivery: str = "delivery_id") -> DataFrame:
    """``(delivery_id bigint)``: each delivery that has an earlier one of the same film and the same moment.

    A moment that can't be read is compared as text.
    """
    number = moment(F.col(fetched))
    folded = fold_batch(messages, F.col(film), number, F.col(delivery))
    again = folded.where("again").select(F.col("delivery").alias("delivery_id"))
    odd = messages.where(number.isNull() & F.col(fetched).isNotNull())
    return again.unionByName(by_text(odd, [F.col(film), F.col(fetched)], F.col(delivery)).withColumnRenamed("delivery", "delivery_id"))


def dedup_batch(batch: DataFrame, state: DataFrame | None, producer: str, number: str, delivery: str) -> tuple[DataFrame, DataFrame]:
    """One step of an incremental run: ``(accepted rows of the batch, new state)``.

    Every row is accepted that isn't known to repeat another: also those whose identifier doesn't parse, at their first
    delivery in any batch, and those without an identifier or delivery number. The folded rows and the texts are kept
    in the shared folder, as both results read them. Ranges of producers the batch doesn't name are handed on unread.
    """
    from reelmill.session import scratch_table

    spark = batch.sparkSession
    if state is None:
        state = spark.createDataFrame([], STATE)
    texts = [F.trim(F.col(f"`{c}`").cast("string")) for c in (producer, number)]
    p, n = (t.try_cast("bigint") for t in texts)
    d = F.col(f"`{delivery}`").cast("bigint")
    ranges = state.where("lo is not null").select("producer", "lo", "hi")
    touched = batch.select(p.alias("producer")).distinct()
    folded = scratch_table(fold_batch(batch, p, n, d, ranges.join(touched, "producer", "left_semi")), "ranges")
    # identifiers that don't parse
    odd = batch.where(p.isNull() | n.isNull()).select(texts[0].alias("producer_text"), texts[1].alias("number_text"), d.alias("delivery")).dropna()
    known = state.where("producer_text is not null").select("producer_text", "number_text")
    first = _first_texts(odd, ["producer_text", "number_text"])
    first = scratch_table(first.join(known, ["producer_text", "number_text"], "left_anti"), "texts")
    repeats = scratch_table(folded.where("again").select("delivery").unionByName(odd.select("delivery").join(first, "delivery", "left_anti")).unionByName(first.where("n > 1").select("delivery")).distinct(), "repeats")
    key = F.col(f"`{delivery}`").cast("bigint") == F.col("__again")
    again = repeats.withColumnRenamed("delivery", "__again")
    accepted = batch.join(again, key, "left_anti")
    # rows that share a delivery number with their own repeat: the first of them stands
    taken = folded.where("not again").select("delivery").unionByName(first.select("delivery")).join(repeats, "delivery", "left_semi").distinct()
    shared = batch.join(taken.withColumnRenamed("delivery", "__again"), key, "left_semi").dropDuplicates([delivery])
    none = F.lit(None)
    after = folded.where("lo is not null").select("producer", "lo", "hi").unionByName(ranges.join(touched, "producer", "left_anti"))
    words = known.unionByName(first.select("producer_text", "number_text"))
    new = after.select("producer", "lo", "hi", none.cast("string").alias("producer_text"), none.cast("string").alias("number_text"))
    new = new.unionByName(words.select(*[none.cast("bigint").alias(c) for c in ("producer", "lo", "hi")], "producer_text", "number_text"))
    return accepted.unionByName(shared), new
