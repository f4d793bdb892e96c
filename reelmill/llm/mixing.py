"""Mixing sources to target shares of a token budget.

Sizes are tokens of a public tokenizer. The budget is the size of the whole corpus; a source's part of it is its target
share. A source is used in complete epochs as often as its part holds it, at most ``max_repeats`` times, and what is
left of its part is filled by sampling documents without replacement after Efraimidis and Spirakis: each gets the key
-ln(u) / weight, u from a hash of the seed and its number, the weight its quality (the share of its text that is prose,
see :mod:`textstats`); the documents of the smallest keys are taken as long as their tokens fit. A source too small for
its part is used ``max_repeats`` times; that it is short is read off what was used (:func:`shares`).

Scale. Documents are tokenised in Arrow batches where they are read; what is kept is 40 bytes a document. The prefix
sum over a source, which may hold a third of all documents, is taken by narrowing: an interval of keys is cut into parts
whose sums are accumulated, the part in which the budget ends is cut again, and what is left, at most ROWS_PER_BUCKET
documents, is summed row by row. Intervals are tables of one row per target; they are broadcast up to MAX_BROADCAST
targets and joined by a shuffle beyond.

Edge cases: a source without documents can't fill a share above 0; documents without a source, or of one without a
target, count for the budget and aren't used; null and empty texts have 0 tokens and are taken with any epoch; equal
keys are ordered by document number; equal document numbers are taken or left together; targets given twice for a
source are added up, with the larger number of repeats.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.llm import textstats
from reelmill.session import scratch_table, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: how texts are cut before byte pairs are merged, as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Documents that are summed one by one where a source's budget ends, parts a round cuts an interval of keys into.
ROWS_PER_BUCKET = 50_000
BUCKETS = 1000
#: Targets whose rows are broadcast.
MAX_BROADCAST = 100_000
#: Long texts are encoded in pieces of this many characters or more, so that they need little memory.
PIECE = 200_000
#: Where a text may be cut without changing a token: PATTERN begins a new match at white space behind a letter or digit.
_CUT = re.compile(r"(?<=[^\W_])[ \n]")

_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a ranks file, loaded once per Python worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def count_tokens(texts: list[str | None], path: str = TOKENIZER) -> list[int]:
    encode = encoder(path).encode_ordinary
    out = []
    for t in texts:
        n = at = 0
        while t and at < len(t):
            cut = _CUT.search(t, at + max(PIECE, 1)) if len(t) - at > PIECE else None
            end = cut.start() if cut else len(t)
            n += len(encode(t[at:end]))
            at = end
        out.append(n)
    return out


def sized(documents: DataFrame, words: DataFrame | None = None, doc_id: str = "doc_id", source: str = "source", text: str = "text", tokenizer: str = TOKENIZER, weight: Column | None = None) -> DataFrame:
    """``(doc_id, source, weight, tokens)``.

    The weight is ``weight`` if given, else the share of prose of the text, at least 0.05; ``words`` are the common
    words that tell prose.
    """
    rows = documents.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{source}`").alias("source"), (F.lit(None) if weight is None else weight).cast("double").alias("weight"), F.col(f"`{text}`").alias("text"))
    vocabulary = {} if words is None or weight is not None else textstats.common_words(words)
    if vocabulary is None:
        rows = textstats.with_known_words(rows, words)
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary or {})
    judge = weight is None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(batch["text"])
            if judge:
                batch["weight"] = [max(0.05, x or 0.0) for x in textstats.prose_shares(texts, shared.value, batch.get("known"))]
            yield batch[["doc_id", "source", "weight"]].assign(tokens=count_tokens(texts, tokenizer))

    return spread(rows).mapInPandas(run, "doc_id bigint, source string, weight double, tokens bigint")


def plan(held: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, max_repeats, n_docs, tokens, budget, epochs, rest, short)`` of each target.

    ``held`` is a result of :func:`sized`, read twice here; it should be materialised. ``rest`` is what sampling must fill after complete epochs.
    """
    targets = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    per_source = held.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))
    total = held.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    grid = targets.join(per_source, "source", "left")
    budget = F.col("target_share") * F.lit(float(total))
    tokens = F.coalesce("tokens", F.lit(0))
    epochs = F.when(tokens > 0, F.least(F.col("max_repeats").cast("bigint"), F.floor(budget / tokens))).otherwise(F.lit(0)).cast("bigint")
    return grid.select(
        "source", "target_share", "max_repeats", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), tokens.alias("tokens"), budget.alias("budget"), epochs.alias("epochs"),
        F.when(epochs < F.col("max_repeats"), budget - epochs * tokens).otherwise(F.lit(0.0)).alias("rest"),
        (tokens * F.col("max_repeats") < budget).alias("short"),
    )


def sample_key(doc_id: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u in (0, 1) from a hash of the document's number; a weight that is missing or not above 0 counts as 1e-6."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 11).cast("double") + 0.5) / 2.0**53
    return -F.log(u) / F.greatest(F.coalesce(weight, F.lit(0.0)), F.lit(1e-6))


def _small(df: DataFrame) -> DataFrame:
    """``df``, a materialised table, broadcast if it is small."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else df


def _edges(rows: DataFrame) -> DataFrame:
    """``(source, lo, hi, before)``: where each source's budget ends.

    Keys below ``lo`` fit, keys above ``hi`` don't, ``before`` tokens lie below ``lo``; between them are at most
    ROWS_PER_BUCKET documents (or one key). Each round cuts the interval of every source that holds more into BUCKETS
    equal parts and goes on with the part in which the budget ends. A round leaves the least and greatest key of one
    part, so every interval of more than one key shrinks.
    """
    at = rows.groupBy("source").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.lit(0.0).alias("before"), F.count(F.lit(1)).alias("n"))
    at = scratch_table(at, "edges")
    while True:
        is_wide = (F.col("n") > ROWS_PER_BUCKET) & (F.col("hi") > F.col("lo"))
        wide = at.where(is_wide)
        if wide.isEmpty():
            return at.drop("n")
        inside = rows.join(_small(wide.drop("n")), "source").where(F.col("key").between(F.col("lo"), F.col("hi")))
        part = F.least(F.floor((F.col("key") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS), F.lit(BUCKETS - 1))
        sums = inside.groupBy("source", "rest", "before", part.alias("part")).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        sums = sums.withColumn("upto", F.col("before") + F.sum("tokens").over(Window.partitionBy("source").orderBy("part")))
        ends = sums.where("upto > rest").groupBy("source").agg(F.min(F.struct("part", "lo", "hi", (F.col("upto") - F.col("tokens")).alias("before"), "n")).alias("e"))
        nothing = F.lit(float("inf"))  # all of it fits
        found = wide.select("source").join(ends, "source", "left").select("source", F.coalesce("e.lo", nothing).alias("lo"), F.coalesce("e.hi", nothing).alias("hi"), F.coalesce("e.before", F.lit(0.0)).alias("before"), F.coalesce("e.n", F.lit(0)).alias("n"))
        at = scratch_table(at.where(~is_wide).unionByName(found), "edges")


def mix(held: DataFrame, planned: DataFrame, seed: int = 0) -> DataFrame:
    """``(doc_id, source, tokens, repeats)``: the documents used and how often.

    ``held`` and ``planned`` are read several times and should be materialised.
    """
    p = _small(planned.select("source", "epochs", "rest", "max_repeats"))
    rows = held.where("source is not null").join(p, "source")
    rows = rows.select("doc_id", "source", "tokens", "epochs", "rest", "max_repeats", sample_key(F.col("doc_id"), F.col("weight"), seed).alias("key"))
    rows = rows.join(_small(_edges(rows)), "source")
    line = Window.partitionBy("source").orderBy("key", "doc_id")  # a range frame: equal numbers count together
    edge = rows.where("key between lo and hi").withColumn("run", F.col("before") + F.sum("tokens").over(line))
    edge = edge.withColumn("extra", (F.col("run") <= F.col("rest")).cast("int")).drop("run")
    clear = rows.where("not key between lo and hi").withColumn("extra", (F.col("key") < F.col("lo")).cast("int"))
    repeats = F.least(F.col("epochs") + F.col("extra"), F.col("max_repeats").cast("bigint")).alias("repeats")
    return clear.unionByName(edge).select("doc_id", "source", "tokens", repeats).where("repeats > 0")


def shares(planned: DataFrame, mixed: DataFrame) -> DataFrame:
    """``(source, target_share, max_repeats, tokens, budget, used_tokens, share, short)``: what was reached.

    A source is short if all its tokens were used ``max_repeats`` times and don't come up to its budget.
    """
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"))
    out = planned.drop("short").join(used, "source", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
    every = F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))  # one row per target
    short = (F.col("used_tokens") == F.col("tokens") * F.col("max_repeats")) & (F.col("used_tokens") < F.col("budget"))
    return out.select("source", "target_share", "max_repeats", "tokens", "budget", "used_tokens", F.try_divide(F.col("used_tokens"), every).alias("share"), short.alias("short"))
