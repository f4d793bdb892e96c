"""Evaluation texts in training text, found with a generalised suffix automaton of the items' words.

The automaton holds every run of words of every item. A document's words are streamed through it; its state says at
each word how many of the last words stand in some item. Where such a match ends and has at least SEED words, it is
extended in both directions along the item, over words that were altered, dropped or put in, to where two words running
agree again or else a single one does; agreeing words within such a gap count. It ends where it scores best. Any part of
it is a leak of the item that covers at least MIN_RUN of the item's words, wording that several items share not counted,
and of which at least MIN_AGREE of the item's words agree; parts that overlap are one span. If there is none, a
single agreeing word behind an altered one is taken in at either edge. What is found is given as spans of words to
remove (:func:`without_leaks`), and as the share of the document they cover (:func:`coverage`).

Scale. Documents are streamed in Arrow batches without a shuffle, whole texts, a word at a time; time is linear in the
corpus. What is broadcast is an automaton's worth of items, at most MAX_BLOCK words (or one item): test material of any
size is split into blocks of items, each of which is a pass of its own over the corpus, so that a worker holds one
automaton at a time. Wording that items of different blocks share is found by a join of their runs of words.

Edge cases: null and empty texts match nothing; an item shorter than MIN_RUN words can't leak; an item given twice is
wording that several items share, hence no leak of either; documents with equal ids are looked at separately and give
one row per id and item.
"""

from __future__ import annotations

import itertools
import re
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.llm.words import words
from reelmill.session import scratch_table, spread, work_dir

MIN_RUN = 18
SEED = 5
#: A run of this many words in two items or more is shared wording.
SHARED_RUN = 9
MIN_AGREE = 0.86
#: An agreeing word scores 1, each word of a gap costs this; a span ends where its score was highest.
GAP_COST = 2
MAX_DROP = 6

#: Words of the items of one automaton; a worker needs about 1 kB a word.
MAX_BLOCK = 500_000

#: What may lie between two stretches that agree: words of the item, words of the document.
_GAPS = sorted(((a, b) for a in range(4) for b in range(4) if a + b), key=lambda g: (g[0] + g[1], abs(g[0] - g[1])))


class Automaton:
    """Generalised suffix automaton over the items' word numbers, with item and offset of every match."""

    def __init__(self, items: list[tuple[int, list[str]]], shared: list[list[int]] | None = None) -> None:
        """``shared``: per item where its runs of SHARED_RUN words begin that other items have too; None: found among ``items``."""
        self.vocabulary: dict[str, int] = {}
        self.text: list[int] = []  # all items, each followed by a number no word has
        self.owner: list[int] = []
        self.first: list[int] = []  # of each position: where its item begins
        self.past: list[int] = []  # of each position: where its item ends
        for k, (item, tokens) in enumerate(items):
            begin = len(self.text)
            self.text += [self.vocabulary.setdefault(t, len(self.vocabulary)) for t in tokens]
            end = len(self.text)
            self.text.append(-2 - k)
            self.owner += [item] * (end - begin + 1)
            self.first += [begin] * (end - begin + 1)
            self.past += [end] * (end - begin + 1)
        self._build()
        self._share(shared_runs(items) if shared is None else shared)

    def _build(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, at = [-1], [0], [-1]
        more: dict[int, list[int]] = {}
        last = 0
        for k, c in enumerate(self.text):
            if c < 0:
                last = 0
                continue
            known = self.next[last].get(c)
            if known is not None and self.length[known] == self.length[last] + 1:
                # this run of words is known from an earlier item: the state is there, only the position is new
                more.setdefault(known, []).append(k)
                last = known
                continue
            state = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            at.append(k)
            p = last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = state
                p = self.link[p]
            if p != -1:
                q = self.next[p][c]
                if self.length[q] == self.length[p] + 1:
                    self.link[state] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    at.append(-1)
                    while p != -1 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = self.link[p]
                    self.link[q] = self.link[state] = clone
            last = state
        self._at, self._more = at, more
        self._children: list[list[int]] = [[] for _ in self.next]
        for s, p in enumerate(self.link):
            if p > 0:
                self._children[p].append(s)
        self._ends: dict[int, list[int]] = {}

    def ends(self, state: int) -> list[int]:
        """The positions at which the runs of words of ``state`` end."""
        held = self._ends.get(state)
        if held is None:
            held, todo = [], [state]
            while todo:
                s = todo.pop()
                if self._at[s] >= 0:
                    held.append(self._at[s])
                held += self._more.get(s, ())
                todo += self._children[s]
            self._ends[state] = held
        return held

    def _share(self, runs: list[list[int]]) -> None:
        """``counted[k]``: words before position k that aren't shared wording."""
        shared = [False] * len(self.text)
        begins = [k for k in range(len(self.text)) if self.first[k] == k]
        for begin, starts in zip(begins, runs):
            for k in starts:
                shared[begin + k : begin + k + SHARED_RUN] = [True] * SHARED_RUN
        self.counted = [0]
        for k, c in enumerate(self.text):
            self.counted.append(self.counted[-1] + (c >= 0 and not shared[k]))

    def seeds(self, ids: list[int]) -> list[tuple[int, int, int]]:
        """Longest matches of at least SEED words as (position after them, length, state)."""
        step, link, length = self.next, self.link, self.length
        out, state, n = [], 0, 0
        for k, c in enumerate(ids):
            to = step[state].get(c)
            if to is not None:
                state = to
                n += 1
                continue
            if n >= SEED:
                out.append((k, n, state))
            while state and to is None:
                state = link[state]
                n = length[state]
                to = step[state].get(c)
            if to is None:
                n = 0
            else:
                state = to
                n += 1
        if n >= SEED:
            out.append((len(ids), n, state))
        return out

    def spans(self, tokens: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(item, counted words, agreeing words, first, past) of each leak; positions are the document's."""
        known = self.vocabulary
        ids = [known.get(t, -1) for t in tokens]
        found: list[tuple[int, int, int, int, int]] = []
        done: dict[int, list[tuple[int, int, int, int]]] = {}
        for past, n, state in self.seeds(ids):
            for end in self.ends(state):
                first, limit = self.first[end], self.past[end]
                seen = done.setdefault(first, [])
                if any(a <= past - 1 < b and x <= end < y for a, b, x, y in seen):
                    continue
                # from the middle of the match: its last word is document past - 1, item end
                right, best_right = self._extend(ids, past, end + 1, len(ids), limit, 1)
                left, best_left = self._extend(ids, past - n - 1, end - n, -1, first - 1, -1)
                middle = list(zip(range(past - n, past), range(end - n + 1, end + 1)))
                pairs = left[:best_left][::-1] + middle + right[:best_right]
                seen.append((pairs[0][0], pairs[-1][0] + 1, pairs[0][1], pairs[-1][1] + 1))
                parts = self._parts(pairs)
                if not parts:
                    # a single word behind an altered one, at either edge
                    pairs = left[: best_left + 1][::-1] + middle + right[: best_right + 1]
                    parts = self._parts(pairs)
                for i, j in parts:
                    (a, x), (b, y) = pairs[i], pairs[j]
                    found.append((self.owner[end], self.counted[y + 1] - self.counted[x], j - i + 1, a, b + 1))
        return found

    def _parts(self, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The parts (first and last pair) of agreeing words that are leaks; parts that overlap are joined."""
        counted = self.counted
        if counted[pairs[-1][1] + 1] - counted[pairs[0][1]] < MIN_RUN:
            return []
        # i to j agree enough if lack[i] <= have[j]; the first such i covers the most words
        lack, least = [], float("inf")
        for i, (_, k) in enumerate(pairs):
            least = min(least, i - MIN_AGREE * k)
            lack.append(-least)
        out: list[tuple[int, int]] = []
        for j, (_, k) in enumerate(pairs):
            i = bisect_left(lack, MIN_AGREE * (k + 1) - (j + 1) - 1e-6)
            if i <= j and counted[k + 1] - counted[pairs[i][1]] >= MIN_RUN:
                while out and i <= out[-1][1]:
                    i = min(i, out.pop()[0])
                out.append((i, j))
        return out

    def _extend(self, ids: list[int], d: int, k: int, d_stop: int, k_stop: int, way: int) -> tuple[list[tuple[int, int]], int]:
        """Walk on from document position d and item position k; returns the pairs of positions that agree, and how many to the best score."""
        text, score = self.text, 0
        pairs: list[tuple[int, int]] = []
        best = (0, 0)
        while d != d_stop and k != k_stop:
            if ids[d] == text[k]:
                pairs.append((d, k))
                d, k, score = d + way, k + way, score + 1
                if score >= best[0]:
                    best = (score, len(pairs))
                continue
            single = None
            for a, b in _GAPS:
                kk, dd = k + way * a, d + way * b
                if (k_stop - kk) * way <= 0 or (d_stop - dd) * way <= 0 or ids[dd] != text[kk]:
                    continue
                k2, d2 = kk + way, dd + way
                if k2 == k_stop or d2 == d_stop or ids[d2] == text[k2]:
                    break
                if single is None or a == b and single[0] != single[1]:
                    single = (a, b)
            else:
                if single is None:
                    break
                a, b = single
            inside = _agreeing(ids[d : d + way * b : way], text[k : k + way * a : way])
            pairs += [(d + way * i, k + way * j) for i, j in inside]
            score += len(inside) - GAP_COST * (max(a, b) - len(inside))
            d, k = d + way * b, k + way * a
            if score < best[0] - MAX_DROP:
                break
        return pairs, best[1]


def _agreeing(these: list[int], those: list[int]) -> list[tuple[int, int]]:
    """The most pairs of positions, rising in both, at which two runs of at most three words agree."""
    held: list[tuple[int, int]] = []
    for i, x in enumerate(these):
        for j, y in enumerate(those):
            if x == y:
                chain = [(i, j), *_shift(_agreeing(these[i + 1 :], those[j + 1 :]), i + 1, j + 1)]
                if len(chain) > len(held):
                    held = chain
    return held


def _shift(pairs: list[tuple[int, int]], i: int, j: int) -> list[tuple[int, int]]:
    return [(a + i, b + j) for a, b in pairs]


def shared_runs(items: list[tuple[int, list[str]]]) -> list[list[int]]:
    """Per item the positions at which runs of SHARED_RUN words begin that an item of another number has too."""
    held: dict[tuple[str, ...], list[tuple[int, int]]] = {}
    for i, (_, tokens) in enumerate(items):
        for k in range(len(tokens) - SHARED_RUN + 1):
            held.setdefault(tuple(tokens[k : k + SHARED_RUN]), []).append((i, k))
    out: list[list[int]] = [[] for _ in items]
    for places in held.values():
        if len({items[i][0] for i, _ in places}) > 1:
            for i, k in places:
                out[i].append(k)
    return out


def _tokenised(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """``(item, tokens)`` of the items that have a number and a text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"item": batch["item"], "tokens": [words(t) for t in batch["t"]]})

    rows = items.select(F.col(f"`{item_id}`").cast("bigint").alias("item"), F.col(f"`{item_text}`").alias("t")).where("item is not null and t is not null")
    return rows.mapInPandas(run, "item bigint, tokens array<string>")


def _with_shared(tokenised: DataFrame) -> DataFrame:
    """``(item, tokens, shared)``: :func:`shared_runs` by a join, for items of any number."""
    keyed = tokenised.withColumn("key", F.md5(F.array_join("tokens", " ")))
    runs = F.expr(f"transform(sequence(0, size(tokens) - {SHARED_RUN}), k -> array_join(slice(tokens, k + 1, {SHARED_RUN}), ' '))")
    placed = keyed.where(F.size("tokens") >= SHARED_RUN).select("item", "key", F.posexplode(runs).alias("k", "run"))
    shared = placed.groupBy("run").agg(F.min("item").alias("a"), F.max("item").alias("b")).where("a <> b").select("run")
    starts = placed.join(shared, "run").groupBy("item", "key").agg(F.collect_set("k").alias("shared"))
    return keyed.join(starts, ["item", "key"], "left").select("item", "tokens", F.coalesce("shared", F.array().cast("array<int>")).alias("shared"))


_BUILT: dict = {}
_NUMBERS = (f"{uuid.uuid4().hex}-{k}" for k in itertools.count())


def _automaton(number: str, held) -> Automaton:
    """The automaton of a broadcast, built once per Python worker, which keeps one."""
    if _BUILT.get("of") != number:
        _BUILT.clear()
        _BUILT.update(of=number, automaton=Automaton(*held.value))
    return _BUILT["automaton"]


_FOUND = ["doc_id", "text_key", "item_id", "n_words", "n_agree", "first_word", "past_word", "total_words"]


def _scan(documents: DataFrame, items: list[tuple[int, list[str]]], shared: list[list[int]] | None) -> DataFrame:
    held = documents.sparkSession.sparkContext.broadcast((items, shared))
    number = next(_NUMBERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(number, held)
        for batch in batches:
            rows = []
            for doc, key, t in zip(batch["doc_id"], batch["text_key"], batch["text"]):
                if t:
                    tokens = words(t)
                    if len(tokens) >= MIN_RUN * MIN_AGREE:
                        rows += [(doc, key, *s, len(tokens)) for s in automaton.spans(tokens)]
            yield pd.DataFrame(rows, columns=_FOUND)

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.mapInPandas(run, f"doc_id {kind}, text_key bigint, item_id bigint, n_words int, n_agree int, first_word int, past_word int, total_words int")


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, text_key, item_id, n_words, n_agree, first_word, past_word, total_words)``: every span of a document that leaks an item.

    ``text_key`` tells documents of equal id apart.
    """
    spark = documents.sparkSession
    docs = spread(documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_key"), F.col(f"`{text}`").alias("text")))
    tokenised = scratch_table(_tokenised(items, item_id, item_text), "items")
    size = tokenised.agg(F.sum(F.size("tokens"))).first()[0] or 0
    if size <= MAX_BLOCK:
        held = sorted((r["item"], list(r["tokens"])) for r in tokenised.collect())
        return _scan(docs, held, None)
    n = -(-size // MAX_BLOCK)
    blocks = scratch_table(_with_shared(tokenised).withColumn("block", F.pmod(F.xxhash64("item", "tokens"), F.lit(n))), "item-blocks")
    path = f"{work_dir(spark)}/leaks-{uuid.uuid4().hex}"
    for b in range(n):
        held = sorted((r["item"], list(r["tokens"]), sorted(r["shared"])) for r in blocks.where(F.col("block") == b).collect())
        out = _scan(docs, [r[:2] for r in held], [r[2] for r in held])
        out.write.mode("append").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id)``: each document with each item that leaked into it."""
    return leaks(documents, items).select("doc_id", "item_id").distinct()


def _merged(found: DataFrame) -> DataFrame:
    """Per document the spans of all items, overlapping ones as one, and what they cover."""
    merge = """aggregate(array_sort(collect_set(struct(first_word, past_word))), cast(array() as array<struct<a:int,b:int>>),
      (held, s) -> if(size(held) > 0 and s.first_word <= held[size(held) - 1].b,
        concat(slice(held, 1, size(held) - 1), array(named_struct('a', held[size(held) - 1].a, 'b', greatest(held[size(held) - 1].b, s.past_word)))),
        concat(held, array(named_struct('a', s.first_word, 'b', s.past_word)))))"""
    spans = found.groupBy("doc_id", "text_key").agg(F.countDistinct("item_id").alias("n_items"), F.max("total_words").cast("bigint").alias("total_words"), F.expr(merge).alias("spans"))
    return spans.withColumn("leaked_words", F.expr("aggregate(spans, 0L, (n, s) -> n + s.b - s.a)")).withColumn("share", F.try_divide("leaked_words", "total_words"))


def coverage(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, n_items, leaked_words, total_words, share)`` of the documents with a leak; overlapping spans count once.

    Rows of equal id and text are one document, those of equal id and different texts are several.
    """
    return _merged(leaks(documents, items)).select("doc_id", "n_items", "leaked_words", "total_words", "share")


def without_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", most: float = 0.5) -> DataFrame:
    """``documents`` without the leaked spans, and without the documents of which they are more than ``most``.

    ``removed_words`` is added: how many words were cut out, 0 for a document that had no leak.
    """
    spans = _merged(leaks(documents, items, doc_id, text)).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("spans").alias("__spans"), F.col("share").alias("__share"), F.col("leaked_words").alias("__n"))
    keyed = documents.withColumn("__t", F.xxhash64(F.col(f"`{text}`")))
    held = keyed.join(spans, (F.col(f"`{doc_id}`") == F.col("__id")) & (F.col("__t") == F.col("__key")), "left")
    held = held.where(F.coalesce("__share", F.lit(0.0)) <= most)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else cut_spans(t, [(x["a"], x["b"]) for x in s]) for t, s in zip(texts, found)], dtype=object)

    removed = F.coalesce("__n", F.lit(0)).alias("removed_words")
    return held.select(*[cut(F.col(f"`{text}`"), F.col("__spans")).alias(c) if c == text else F.col(f"`{c}`") for c in documents.columns], removed)


#: Stretches without white space; one that is broken by a hyphen at the end of a line goes on behind it.
_CHUNK = re.compile(r"[^ \t\r\n\f\v]+(?:(?<=[^\W\d_]-)[^\S\n]*\n[\s>|]*(?=[^\W\d_])[^ \t\r\n\f\v]+)*")


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` (numbered as :func:`words` does).

    Stretches of the text that hold a word of a span are cut out and the rest stays as it is; where the words of the
    stretches aren't those of the whole text (some disguises reach across white space), the other words are returned.
    """
    places = [(m.start(), m.end()) for m in _CHUNK.finditer(text)]
    past = list(itertools.accumulate(len(words(text[a:b])) for a, b in places))
    every = words(text)
    if (past[-1] if past else 0) != len(every):
        return " ".join(w for i, w in enumerate(every) if not any(a <= i < b for a, b in spans))
    out, at = [], 0
    for a, b in spans:
        i = bisect_right(past, a)
        j = bisect_left(past, b)
        out.append(text[at : places[i][0]])
        at = places[j][1]
    return "".join(out) + text[at:]


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
