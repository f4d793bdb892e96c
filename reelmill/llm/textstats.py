"""Per-document text statistics that tell natural prose from lists, tables and junk.

Counts (words, word length, symbols, line ends, common words) are combined with the text's layout: how well delimiters
of neighbouring lines align, how periodic the indentation is, how line lengths correlate with the next line's, and
whether lines are filled up as wrapped prose is. From both, each word is judged to stand in running sentences or not,
and the share of the text that does is the document's ``prose_share``.

A word stands in prose if the WINDOW words around it are letters for the most part, hold enough common words, and
among them one that joins clauses ("that", "and", "weil"), and if no more than half of them repeat a pair of words just
read; articles and prepositions also stand in lists of fragments. Failing that, if its piece, the text between sentence
ends and list or table delimiters, is as long as sentences are. Where the layout is a table's or list's (aligned
delimiters, one short fragment a line), a line end is a delimiter; where lines are filled up it is a space. Sentences of
which hardly any word is common are in another language: they count if they end as sentences do and their words run as
those of any language (:func:`sentence_of_unknown_words`).

Lines of one sort that follow each other are a block. Its signals vote whether it is a table or list: aligned delimiters,
periodic indentation, autocorrelation of line lengths, symbols, list marks and lines without an end speak for it, filled
up lines, ends of lines within a phrase, ended and long lines against it (:func:`tabular`). In such a block the words
around a word don't count, as cells and entries may hold joining words too; what is left are pieces as long as sentences.

Scale. Row by row without a shuffle, in Arrow batches over whole texts; the words of many texts are judged at once. The
common words are broadcast up to MAX_COMMON; of a longer list, each text is joined with the words it holds.

Edge cases: a null, empty or blank text has no words, null means and a null prose share, so it isn't found; with an empty
list of common words every language is another one. Equal ids are judged row by row.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.session import spread

#: Common words that are broadcast; of a longer list each text is joined with the words it holds.
MAX_COMMON = 100_000
#: Characters of texts that are judged at once.
PORTION = 500_000

#: Words to either side that are judged together.
WINDOW = 12
LEAST_COMMON = 0.22
LEAST_LETTERS = 0.6
#: Share of lines that end in an article or preposition from which they are wrapped prose.
OPEN_ENDS = 0.12
#: Words of a piece that is a sentence by its length alone.
SENTENCE = 10
#: Lines of a block at least, and votes by which it is a table or list.
BLOCK = 4
VOTES = 3
#: Words of a sentence in a language whose words aren't known, and share of known words below which a piece is of one.
LEAST_WORDS = 5
UNKNOWN = 0.1
#: Commas and semicolons a piece without joining words may have; with more it is a list of phrases.
COMMAS = 3

# Articles, prepositions and the like, which phrases without a sentence also hold.
PHRASE_WORDS = frozenset(
    """
    a an the of in on at to for with by near under behind one from into over
    le la les l de du des d dans sur à au aux pour un une avec sous près derrière par chez en
    der die das den dem des im in auf am zu für eine einem einen ein mit unter hinter vor nach von bei
    el la los las lo de del en por al para un una con bajo cerca detrás sobre
    """.split()
)

#: Letters only: what counts as a word character but is a number (fractions, superscripts, circled digits) is none.
_WORD = re.compile("([^\\W\\d_²³¹¼-¾⁰-₟⅐-↋①-⓿]+)")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_HARD = re.compile(r"[|\t·•▪◦‣→]|^[\"']?[;,][\"']?$|\s[-–—/+*&]\s|<[^<>]*>|[:=]\s|\s{3,}|[.?!…]+(?=[\s\"'»”)]|$)|[。！？؟।]|\)\s*$")
_STOP = re.compile(r"[.?!…]+[\"'»”’)\]]*(?:\s|$)|[。！？؟।]")
#: Signs that part no words but stand within them, in noise.
_TIGHT = re.compile(r"(?!['’\-–.,]$)[^\s。！？，、]+")
#: Letters of scripts that don't part words by blanks.
_UNPARTED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")
_LATIN = re.compile("[a-z]")
_VOWEL = re.compile("[aeiouyøæœıəа-яα-ω]")
_CLUSTER = re.compile("[b-df-hj-np-tv-xz]{6}")
_LIST_MARK = re.compile(r"^\s*(?:[-–—*•▪◦»>|]|\(?\w{1,3}[.):]|\d+\s*[-:.)])\s+")
_END = re.compile(r"[.?!…:;][\"'»”)\]]*\s*$")
_LAST_WORD = re.compile(r"([^\W\d_]+)\W*$")
_HEADED = re.compile(r"\W*[A-ZÀ-ÖØ-Þ]\w*[a-zß-öø-ÿ]")
_SYMBOL = re.compile(r"[^\w\s]|_")
_CELL_END = re.compile(r"[|;\t\n<>]| {2,}")
_LINE = re.compile(r"[^\n]*[^\n\s][^\n]*")
_ROW = re.compile(r"<tr[^>]*>(?:(?!<tr).)+", re.DOTALL)
_QUOTE_MARK = re.compile(r"^\s*[|>]\s+(?!.*\|)")
_COLUMN = re.compile(r"[|;\t]|,(?=\S)| {2,}|<t[dh]")


def layout(lines: list[str]) -> tuple[float, float, float, float]:
    """(alignment of delimiters, periodicity of indentation, autocorrelation of line lengths, fill) of the lines; 0 to 1 or -1 to 1."""
    n = len(lines)
    if n < 3:
        return 0.0, 0.0, 0.0, 0.0
    signs = [tuple(m.group() if m.group()[0] != " " else " " for m in _COLUMN.finditer(x)) for x in lines]
    counts = [len(s) for s in signs]
    aligned = sum(a > 0 and a == b for a, b in zip(counts, counts[1:])) / (n - 1)
    indents = [len(x) - len(x.lstrip()) for x in lines]
    periodic = 0.0
    if max(indents) > 0:
        for lag in (1, 2, 3):
            if n > 2 * lag:
                same = sum(a == b and a > 0 for a, b in zip(indents, indents[lag:])) / (n - lag)
                periodic = max(periodic, same)
    sizes = np.array([len(x) for x in lines], float)
    a, b = sizes[:-1] - sizes[:-1].mean(), sizes[1:] - sizes[1:].mean()
    spread = float(np.sqrt((a * a).sum() * (b * b).sum()))
    auto = float((a * b).sum() / spread) if spread > 0 else 1.0
    widest = sizes.max()
    full = 0
    for x, y in zip(lines, lines[1:]):
        head = y.split(None, 1)
        full += len(x) + 1 + (len(head[0]) if head else 0) > 0.93 * widest
    return aligned, periodic, auto, full / (n - 1)


def _votes(lines: list[str]) -> int:
    """How far the signals of a block speak for a table or list."""
    bare = [_QUOTE_MARK.sub("", x) for x in lines]
    margin = min(len(x) - len(x.lstrip()) for x in bare)  # a quoted paragraph may be indented as a whole
    bare = [x[margin:] for x in bare]
    n = len(bare)
    aligned, periodic, auto, fill = layout(bare)
    marked = sum(1 for x in bare if _LIST_MARK.match(x)) / n
    untagged = [_TAG.sub(" ", x) for x in bare]
    ended = sum(1 for x in untagged if _END.search(x)) / n
    open_ends = sum(1 for x in untagged[:-1] if (w := _LAST_WORD.search(x)) and w[1].lower() in PHRASE_WORDS) / (n - 1)
    symbols = sum(len(_SYMBOL.findall(x)) for x in bare) / sum(map(len, bare))
    # words of a cell; a line without delimiters is one
    n_words = sum(len(_WORD.findall(x)) for x in untagged) / (n + sum(len(_COLUMN.findall(x.strip("| \t"))) for x in bare))
    votes = 2 * (aligned >= 0.6) + (periodic >= 0.5) + (n >= 6 and abs(auto) >= 0.5) + (symbols >= 0.06) + (marked >= 0.5) + (ended < 0.2)
    return votes - 2 * (open_ends >= OPEN_ENDS) - 2 * (ended >= 0.5) - 2 * (n_words >= SENTENCE) - (fill >= 0.75 and aligned < 0.6)


def tabular(text: str) -> list[tuple[int, int]]:
    """The character spans of the lines of tables and lists that aren't sentences of their own."""
    held = list(_LINE.finditer(text))
    if len(held) < 3 and "<t" in text:
        held = list(_ROW.finditer(text))
    out: list[tuple[int, int]] = []
    block: list[re.Match] = []
    sort = None
    for m in (*held, None):
        now = None if m is None else bool(_LIST_MARK.match(m.group())) or bool(_COLUMN.search(m.group().strip()))
        if m is None or block and (now != sort or text.count("\n", block[-1].end(), m.start()) > 1):
            if len(block) >= BLOCK and _votes([x.group() for x in block]) >= VOTES:
                out += [x.span() for x in block if not (_END.search(x.group()) and len(_WORD.findall(x.group())) >= SENTENCE)]
            block = []
        block.append(m)
        sort = now
    return out


def sentence_of_unknown_words(words: list[str]) -> bool:
    """Whether the words of an ended piece, of which too few are known, run as a sentence does in any language.

    They are in small letters, or all in capitals, for the most part: names and headings begin with capitals. Latin ones
    are pronounceable, which random letters are not. Scripts that don't part words by blanks have one long word a clause.
    """
    if len(words) < LEAST_WORDS and not (sum(map(len, words)) >= 2 * LEAST_WORDS and all(_UNPARTED.search(w) for w in words)):
        return False
    headed = sum(1 for w in words[1:] if w[0].isupper() and not w.isupper())
    spoken = sum(1 for w in words if _spoken(w))
    return headed <= 0.5 * (len(words) - 1) and spoken >= 0.85 * len(words) and len(set(words)) > 0.5 * len(words)


def _spoken(word: str) -> bool:
    if word.isascii():
        plain = word.lower()
    else:
        plain = unicodedata.normalize("NFKD", word.lower())
        if not _LATIN.search(plain):
            return True  # another script
    return len(plain) < 3 or bool(_VOWEL.search(plain)) and not _CLUSTER.search(plain)


class _Marks(dict):
    """What stands between two words, as bits: hard delimiter, line end, cell end, comma, sentence end, tight sign."""

    def __missing__(self, g: str) -> int:
        bits = bool(_HARD.search(g)) + 2 * ("\n" in g) + 4 * bool(_CELL_END.search(g)) + 8 * ("," in g or ";" in g) + 16 * bool(_STOP.search(g)) + 32 * bool(_TIGHT.fullmatch(g))
        self[g] = bits
        return bits


def _prose(texts: list[str], wrapped: list[bool], cells: list[list[tuple[int, int]]], common: list[dict[str, int]]) -> tuple[np.ndarray, ...]:
    """Per text: characters of prose, words, letters, common words; the words of all texts are judged at once.

    ``cells`` are the spans of tables and lists, ``common`` each text's known words.
    """
    m = len(texts)
    found: list[str] = []
    gaps: list[str] = []
    counts, leads = np.zeros(m, np.int64), np.zeros(m, np.int64)
    kinds_of: list[int] = []
    zeros = itertools.repeat(0)
    for d, t in enumerate(texts):
        parts = _WORD.split(t)
        held = parts[1::2]
        counts[d], leads[d] = len(held), len(parts[0])
        found += held
        gaps += parts[2::2]
        known = common[d].get
        kinds_of += map(known, map(str.lower, held), zeros)
    n = len(found)
    if not n:
        zero = np.zeros(m, np.int64)
        return zero.astype(float), zero, zero, zero
    past = np.cumsum(counts)
    first = past - counts
    doc = np.repeat(np.arange(m), counts)
    kinds = np.array(kinds_of, np.int8)
    letters = np.fromiter(map(len, found), np.int64, n)
    gap_size = np.fromiter(map(len, gaps), np.int64, n)
    span = letters + gap_size
    some = counts > 0
    span[first[some]] += leads[some]
    shared, joining = (kinds > 0).astype(np.int64), (kinds == 2).astype(np.int64)
    at = np.arange(n)
    lo, hi = np.maximum(at - WINDOW, first[doc]), np.minimum(at + WINDOW + 1, past[doc])

    def around(x: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(x)])
        return upto[hi] - upto[lo]

    n_around = hi - lo
    # a pair of words just read
    ids: dict[str, int] = defaultdict(itertools.count().__next__)
    word = np.fromiter(map(ids.__getitem__, found), np.int64, n)
    before = np.concatenate([[-1], word[:-1]])
    before[first[some]] = -1
    pair = (before + 1) * (len(ids) + 1) + word
    order = np.lexsort((pair, doc))  # stable: positions rise
    near = (pair[order][1:] == pair[order][:-1]) & (doc[order][1:] == doc[order][:-1]) & (np.diff(order) <= WINDOW)
    again = np.zeros(n, np.int64)
    again[order[1:][near]] = 1
    fresh = 2 * around(again) <= n_around
    lettered = around(letters) >= LEAST_LETTERS * around(span)
    usual = fresh & (around(shared) >= LEAST_COMMON * n_around) & lettered
    prose = usual & (around(joining) > 0)
    listed = np.zeros(n, bool)
    for d, spans in enumerate(cells):
        if spans and counts[d]:
            a, b = first[d], past[d]
            begin = np.cumsum(span[a:b]) - letters[a:b] - gap_size[a:b]
            at_cell = np.searchsorted([x for x, _ in spans], begin, "right") - 1
            listed[a:b] = (at_cell >= 0) & (begin < np.array([y for _, y in spans])[at_cell])
    prose &= ~listed
    # pieces between hard delimiters
    bits = np.fromiter(map(_Marks().__getitem__, gaps), np.int64, n)
    last_of_text = np.zeros(n, bool)
    last_of_text[past[some] - 1] = True
    cut = (bits & 1 > 0) | ((bits & 2 > 0) & ~np.array(wrapped, bool)[doc]) | ((bits & 4 > 0) & (listed | np.append(listed[1:], False))) | last_of_text
    piece = np.concatenate([[0], np.cumsum(cut)[:-1]])
    size = np.bincount(piece)
    commas = np.bincount(piece, weights=bits & 8 > 0)
    known = np.bincount(piece, weights=shared)
    rich = (known >= LEAST_COMMON * size) & (commas <= COMMAS)
    prose |= fresh & ((size >= SENTENCE) & rich)[piece] & lettered
    # sentences of other languages: they end, and their words are no known ones; a line may end within them
    unit_cut = (bits & 1 > 0) | last_of_text
    for i in np.flatnonzero((bits & 2 > 0) & cut & ~unit_cut):
        unit_cut[i] = found[i + 1][0].isupper()
    unit = np.concatenate([[0], np.cumsum(unit_cut)[:-1]])
    unit_size = np.bincount(unit)
    end = np.cumsum(unit_size)
    tight = np.bincount(unit, weights=bits & 32 > 0) <= 0.15 * unit_size
    enders = tight & (bits & 16 > 0)[end - 1] & (np.bincount(unit, weights=bits & 8 > 0) <= 0.25 * unit_size)
    for p in np.flatnonzero(enders & (np.bincount(unit, weights=shared) < UNKNOWN * unit_size)):
        a, b = end[p] - unit_size[p], end[p]
        same = fresh[a:b].mean() >= 0.5 or bool(_UNPARTED.search(found[a]))
        if not listed[a] and lettered[a:b].any() and same and sentence_of_unknown_words(found[a:b]):
            prose[a:b] = True
    per = lambda x: np.bincount(doc, weights=x, minlength=m)
    return per(span * prose), counts, per(letters).astype(np.int64), per(shared).astype(np.int64)


COLUMNS = "n_words bigint, mean_word_length double, symbol_ratio double, punctuated_lines double, common_share double, alignment double, indentation double, autocorrelation double, fill double, prose_share double"


def statistics_of(texts: list[str | None], common: list[dict[str, int]]) -> list[tuple]:
    """The values of COLUMNS of each text; ``common`` are the words known to each."""
    filled = [i for i, t in enumerate(texts) if t is not None and t.strip()]
    layouts, wraps, cells, marks = [], [], [], []
    for i in filled:
        text = texts[i]
        lines = [x for x in text.split("\n") if x.strip()]
        if len(lines) < 3 and "<t" in text:
            lines = [x for x in re.split(r"<tr[^>]*>", text) if x.strip()]
        n = len(lines)
        aligned, periodic, auto, fill = layout(lines)
        wrapped = False
        if n >= 2:
            marked = sum(1 for x in lines if _LIST_MARK.match(x)) / n
            if aligned < 0.5 and marked < 0.5:
                # a line of wrapped prose is filled up and begins anywhere, or ends where no phrase does
                open_ends = sum(1 for x in lines[:-1] if (w := _LAST_WORD.search(x)) and w[1].lower() in PHRASE_WORDS) / (n - 1)
                wrapped = open_ends >= OPEN_ENDS or n >= 3 and fill >= 0.75 and sum(1 for x in lines if _HEADED.match(x)) / n < 0.7
        layouts.append((aligned, periodic, auto, fill))
        wraps.append(wrapped)
        cells.append(tabular(text) if n >= BLOCK else [])
        marks.append((len(_SYMBOL.findall(text)) / len(text), sum(1 for x in lines if _END.search(x)) / n))
    prose, counts, letters, shared = _prose([texts[i] for i in filled], wraps, cells, [common[i] for i in filled])
    out: list[tuple] = [(0, None, None, None, None, 0.0, 0.0, 0.0, 0.0, None)] * len(texts)
    for k, i in enumerate(filled):
        n = int(counts[k])
        out[i] = (n, float(letters[k] / n) if n else None, *marks[k], float(shared[k] / n) if n else None, *map(float, layouts[k]), min(1.0, float(prose[k] / len(texts[i].strip()))))
    return out


def statistics(text: str | None, common: dict[str, int]) -> tuple:
    """One document's values of COLUMNS."""
    return statistics_of([text], [common])[0]


def word_kinds(words: Iterable[str]) -> dict[str, int]:
    """1 for a word of phrases, 2 for one that joins clauses."""
    return {w.lower(): 1 if w.lower() in PHRASE_WORDS else 2 for w in words}


def common_words(words: DataFrame, word: str = "word") -> dict[str, int] | None:
    """The list as a dictionary; None if it is longer than MAX_COMMON."""
    held = [r[0] for r in words.select(word).where(f"`{word}` is not null").distinct().limit(MAX_COMMON + 1).collect()]
    return None if len(held) > MAX_COMMON else word_kinds(held)


def with_known_words(documents: DataFrame, words: DataFrame, text: str = "text", word: str = "word") -> DataFrame:
    """``documents`` with the listed words that stand in each text as ``known``, by a join: for lists of any length."""
    listed = words.select(F.lower(F.col(f"`{word}`")).alias("w")).where("w is not null").distinct()
    keyed = documents.withColumn("__key", F.md5(F.col(f"`{text}`")))
    inside = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(f"`{text}`")), F.lit(r"(\p{L}+)"), 1))).alias("w")
    known = keyed.select("__key", inside).join(listed, "w").groupBy("__key").agg(F.collect_set("w").alias("known"))
    return keyed.join(known, "__key", "left").drop("__key")


def _portions(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are judged together: whole texts of about PORTION characters, so that memory is bounded."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= PORTION:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def prose_shares(texts: list[str | None], common: dict[str, int], known: Iterable | None = None) -> list[float | None]:
    """The share of prose of each text; ``known`` are the words known to each where the list isn't broadcast."""
    held = [common] * len(texts) if known is None else [word_kinds(() if x is None else x) for x in known]
    return [r[-1] for a, b in _portions(texts) for r in statistics_of(texts[a:b], held[a:b])]


def text_statistics(documents: DataFrame, words: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, COLUMNS)``: one row per row of ``documents``."""
    kind = documents.schema[doc_id].dataType.simpleString()
    rows = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    vocabulary = common_words(words)
    if vocabulary is None:
        rows = with_known_words(rows, words)
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            common = [shared.value] * len(batch)
            if "known" in batch:
                common = [word_kinds(() if x is None else x) for x in batch["known"]]
            texts = list(batch["text"])
            rows: list[tuple] = []
            for a, b in _portions(texts):
                rows += statistics_of(texts[a:b], common[a:b])
            out = pd.DataFrame(rows, columns=_NAMES)
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return spread(rows).mapInPandas(run, f"doc_id {kind}, {COLUMNS}")


def mostly_no_prose(documents: DataFrame, words: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id)`` of the texts of which more than half is no natural prose."""
    stats = text_statistics(documents, words, doc_id, text)
    return stats.where("prose_share < 0.5").select("doc_id")
