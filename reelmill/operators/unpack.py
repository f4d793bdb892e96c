"""Several values packed in one text, in changing notations, to one value per row with its position.

Quoted spans, escaped characters and the elements of JSON and brace arrays are atomic. What is left between them are
runs of atoms with delimiters (``, ; | /`` or a hyphen between blanks), each of which may be a boundary or part of a
value ("Sword/Sorcery"). Tabs and line breaks are always boundaries. A run is a lattice: an arc is an atom, or joins any
number of neighbouring atoms to a value that stands at least twice in the column, unquoted or whole (quoted, escaped or
in an array). Value frequencies come from the whole column by expectation-maximisation (forward-backward over every
lattice) until they settle; a value that is only ever seen as a join counts one observation less, and each join costs
prior odds, so joins need support. The Viterbi path through each lattice is the split.

Scale. Equal cells of a film and equal runs are merged first. Lattices are gathered by run once; a round sends each
worker the frequencies, broadcast up to MAX_BROADCAST values and joined beyond, and shuffles expected counts that were
summed within their batch. Joins are found by passes of rising length, as far as the column repeats itself. A lattice
needs about 100 bytes an arc; its arcs are as many as its atoms times the length of what it repeats.

Edge cases: a null, blank or ``\\N`` cell and empty pieces give nothing; an array that doesn't parse is read as plain
text between its brackets; an unclosed quote is an ordinary character; equal (id, cell) rows are one cell.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelmill.session import scratch_table

#: Lengths of joins that one pass over the runs looks for.
STEP = 6

#: Prior odds of a join at a delimiter: without it the likelihood would favour whole cells seen twice.
JOIN_PRIOR = 0.2

#: Values whose frequencies are broadcast.
MAX_BROADCAST = 200_000

#: Rounds end when counts move by less than this share of all; MOST_ROUNDS only stops a search that doesn't settle.
SETTLED = 0.001
MOST_ROUNDS = 100

_SPACE = r"[^\S\t\n]"
_QUOTED = re.compile(rf'{_SPACE}*"((?:[^"\\]|""|\\.)*+)"(?={_SPACE}*(?:[,;|/\t\n]|$)|{_SPACE}+-{_SPACE})', re.S)
_ATOM = re.compile(rf"(?:\\.|\\$|(?!{_SPACE}-{_SPACE})[^,;|/\t\n\\])+", re.S)
_DELIMITER = re.compile(rf"{_SPACE}*+(?:[,;|/\t\n]|(?<=\s)-(?={_SPACE})){_SPACE}*+")
_ESCAPED = re.compile(r"\\(.)", re.S)


def _array_elements(cell: str) -> list[str] | None:
    """The elements of a JSON array of texts."""
    try:
        held = json.loads(cell)
    except (ValueError, RecursionError):
        return None
    if not isinstance(held, list):
        return None
    return [x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in held if x is not None]


def segments(cell: str | None) -> list[list[str]]:
    """The cell's runs in order, each as [atom, delimiter, atom, ...]; an atomic value is a run of one atom."""
    if cell is None or cell.strip() in ("", "\\N"):
        return []
    text = cell.strip()
    braces = False
    if text[0] == "[" and text[-1] == "]":
        held = _array_elements(text)
        if held is not None:
            return [[x.strip()] for x in held if x.strip()]
        text = text[1:-1]
    elif text[0] == "{" and text[-1] == "}":
        text, braces = text[1:-1], True
    runs: list[list[str]] = []
    open_run = False  # whether the last run may go on: it ended with an unquoted atom and a soft delimiter
    delimiter = ""
    at, n = 0, len(text)
    while at < n:
        quoted = _QUOTED.match(text, at)
        if quoted:
            value = _ESCAPED.sub(r"\1", quoted[1].replace('""', '"')).strip()
            if value:
                runs.append([value])
            open_run = False
            at = quoted.end()
        else:
            atom = _ATOM.match(text, at)
            if atom:
                raw = atom[0].strip()
                at = atom.end()
                if raw and raw != "\\N" and not (braces and raw == "NULL"):
                    value = _ESCAPED.sub(r"\1", raw)
                    if open_run and not braces:
                        runs[-1] += [delimiter, value]
                    else:
                        runs.append([value])
                    open_run = True
                else:
                    open_run = False
        found = _DELIMITER.match(text, at)
        if not found:
            if at < n and not quoted and not atom:
                at += 1
            continue
        delimiter, at = found[0], found.end()
        if "\t" in delimiter or "\n" in delimiter:
            open_run = False
        again = _DELIMITER.match(text, at)
        if again:
            open_run = False
    return runs


def _tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for owner, cell in zip(batch["owner"], batch["cell"]):
            for k, parts in enumerate(segments(cell)):
                rows.append((owner, cell, k, parts))
        out = pd.DataFrame(rows, columns=["owner", "cell", "seg", "parts"])
        yield out


def _grams(done: int):
    """The joins of ``done`` + 1 to ``done`` + STEP neighbouring atoms that begin where the run's ``starts`` allow (null: anywhere)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, weight, parts, starts, own in zip(batch["run"], batch["weight"], batch["parts"], batch["starts"], batch["own"]):
                n = (len(parts) + 1) // 2
                for i in range(n) if starts is None else starts:
                    for j in range(i + max(2, done + 1), min(n, i + done + STEP) + 1):
                        rows.append((name, weight, i, j, "".join(parts[2 * i : 2 * j - 1]), own))
            yield pd.DataFrame(rows, columns=["run", "weight", "i", "j", "value", "own"])

    return run


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Values that stand whole, as the runs they would be without their quotes."""
    for batch in batches:
        rows = []
        for value, c in zip(batch["value"], batch["c"]):
            parts, at = [], 0
            for m in _DELIMITER.finditer(value):
                parts += [value[at : m.start()], m.group()]
                at = m.end()
            parts.append(value[at:])
            if len(parts) > 1 and all(parts[::2]):
                rows.append((value, c, parts))
        yield pd.DataFrame(rows, columns=["run", "weight", "parts"])


def _joins(runs: DataFrame, fixed: DataFrame, atoms: DataFrame) -> DataFrame:
    """``(run, i, j, value)``: the joins that stand at least twice in the column, unquoted or within a whole value.

    Joins of rising length: one can only stand twice if the shorter ones it begins with do, so a pass of STEP lengths
    goes on where the last one's longest joins did.
    """
    whole = fixed.unionByName(atoms).groupBy("value").agg(F.sum("c").alias("c"))  # an atom that holds a delimiter was escaped
    whole = whole.mapInPandas(_split, "run string, weight double, parts array<string>").withColumn("own", F.lit(False))
    texts = scratch_table(runs.withColumn("own", F.lit(True)).unionByName(whole), "runs")
    left, done, found = texts.withColumn("starts", F.lit(None).cast("array<int>")), 0, None
    while True:
        grams = scratch_table(left.mapInPandas(_grams(done), "run string, weight double, i int, j int, value string, own boolean"), "joins")
        often = grams.groupBy("value").agg(F.sum("weight").alias("n")).where(F.col("n") >= 2).select("value")
        kept = scratch_table(grams.join(often, "value", "left_semi").select("run", "i", "j", "value", "own"), "kept-joins")
        own = kept.where("own").drop("own")
        found = own if found is None else found.unionByName(own)
        done += STEP
        longest = kept.where(F.col("j") - F.col("i") == done)
        if longest.isEmpty():
            return found
        starts = longest.groupBy("run", "own").agg(F.collect_set("i").alias("starts"))
        left = texts.join(starts, ["run", "own"])


def _lattice(arcs: list[dict], total: float) -> list[tuple[int, int, str, float]]:
    return sorted((a["i"], a["j"], a["value"], math.log(a["c"] / total) + (a["j"] - a["i"] - 1) * math.log(JOIN_PRIOR) if a["c"] and a["c"] > 0 else -math.inf) for a in arcs)


def _counted(arcs, known: dict[str, float] | None) -> list[dict]:
    """The arcs as dictionaries with their counts, from ``known`` where that was broadcast."""
    return [{"i": a["i"], "j": a["j"], "value": a["value"], "c": a["c"] if known is None else known.get(a["value"])} for a in arcs]


def _expect(total: float, known):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums: dict[str, float] = {}
            for weight, n, arcs in zip(batch["weight"], batch["n"], batch["arcs"]):
                lattice = _lattice(_counted(arcs, known and known.value), total)
                into = [0.0] + [-math.inf] * n
                for i, j, _, p in lattice:  # sorted by i: into[i] is complete
                    into[j] = _add(into[j], into[i] + p)
                out = [-math.inf] * n + [0.0]
                for i, j, _, p in reversed(lattice):
                    out[i] = _add(out[i], p + out[j])
                if into[n] == -math.inf:
                    continue
                for i, j, value, p in lattice:
                    e = math.exp(into[i] + p + out[j] - into[n])
                    if e > 1e-9:
                        sums[value] = sums.get(value, 0.0) + weight * e
            yield pd.DataFrame(list(sums.items()), columns=["value", "c"])

    return run


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _decide(total: float, known):
    """The Viterbi path of each run, where it joins anything."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, n, arcs in zip(batch["run"], batch["n"], batch["arcs"]):
                best: list[tuple[float, int]] = [(0.0, 0)] + [(-math.inf, 0)] * n
                for i, j, _, p in _lattice(_counted(arcs, known and known.value), total):
                    if best[i][0] + p > best[j][0]:
                        best[j] = (best[i][0] + p, i)
                spans, j = [], n
                while j > 0 and best[n][0] > -math.inf:
                    spans.append((best[j][1], j))
                    j = best[j][1]
                if any(b - a > 1 for a, b in spans):
                    rows.append((name, [{"a": a, "b": b} for a, b in spans[::-1]]))
            yield pd.DataFrame(rows, columns=["run", "spans"])

    return run


def unpack(df: DataFrame, owner: str, cell: str) -> DataFrame:
    """``(owner, pos, value)``: the values of each cell, ``pos`` from 1."""
    kind = df.schema[owner].dataType.simpleString()
    cells = df.select(F.col(f"`{owner}`").alias("owner"), F.col(f"`{cell}`").alias("cell")).where("cell is not null").distinct()
    segs = cells.mapInPandas(_tokenise, f"owner {kind}, cell string, seg int, parts array<string>")
    run = F.lower(F.array_join("parts", "\u001f"))
    segs = scratch_table(segs.select("owner", F.md5("cell").alias("cell"), "seg", "parts", F.when(F.size("parts") > 1, run).alias("run"), F.when(F.size("parts") == 1, F.lower(F.col("parts")[0])).alias("single")), "segments")
    fixed = segs.where("single is not null").groupBy(F.col("single").alias("value")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    lowered = F.transform("parts", lambda x: F.lower(x))
    runs = scratch_table(segs.where("run is not null").groupBy("run").agg(F.count(F.lit(1)).cast("double").alias("weight"), F.first(lowered).alias("parts")), "distinct-runs")
    size = (F.size("parts") + 1) / 2
    atoms = runs.select("run", "weight", F.posexplode(F.filter("parts", lambda x, i: i % 2 == 0)).alias("i", "value"))
    fixed = scratch_table(fixed, "fixed")
    counted_atoms = atoms.groupBy("value").agg(F.sum("weight").alias("c"))
    joins = scratch_table(_joins(runs, fixed, counted_atoms), "all-joins")
    arcs = atoms.select("run", "i", (F.col("i") + 1).alias("j"), "value").unionByName(joins)
    lattices = arcs.groupBy("run").agg(F.collect_list(F.struct("i", "j", "value")).alias("arcs"))
    lattices = scratch_table(runs.select("run", "weight", size.cast("int").alias("n")).join(lattices, "run"), "lattices")
    total = max(1.0, float(atoms.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0] + segs.where("single is not null").count()))
    halves = joins.join(runs.select("run", "weight"), "run").groupBy("value").agg((F.sum("weight") / 2).alias("c"))
    freq = scratch_table(fixed.unionByName(counted_atoms).unionByName(halves).groupBy("value").agg(F.sum("c").alias("c")), "frequencies")
    never_atom = joins.select("value").distinct().join(counted_atoms, "value", "left_anti").select("value", F.lit(1.0).alias("less"))
    never_atom = scratch_table(never_atom, "only-joined")

    def counted(freq: DataFrame):
        """The lattices with their values' counts beside them: broadcast if there are few values, else joined."""
        held = freq.limit(MAX_BROADCAST + 1).toPandas()
        if len(held) <= MAX_BROADCAST:
            return lattices, df.sparkSession.sparkContext.broadcast(dict(zip(held["value"], held["c"])))
        named = lattices.select("run", "weight", "n", F.inline("arcs")).join(freq, "value", "left")
        return named.groupBy("run").agg(F.first("weight").alias("weight"), F.first("n").alias("n"), F.collect_list(F.struct("i", "j", "value", "c")).alias("arcs")), None

    for _ in range(MOST_ROUNDS):
        rows, known = counted(freq)
        seen = rows.select("weight", "n", "arcs").mapInPandas(_expect(total, known), "value string, c double").groupBy("value").agg(F.sum("c").alias("c"))
        seen = seen.join(never_atom, "value", "left").select("value", F.greatest(F.col("c") - F.coalesce("less", F.lit(0.0)), F.lit(0.0)).alias("c"))
        was, freq = freq, scratch_table(fixed.unionByName(seen).groupBy("value").agg(F.sum("c").alias("c")).where("c > 0"), "frequencies")
        if not runs.isEmpty():
            both = freq.join(was.withColumnRenamed("c", "was"), "value", "full")
            moved = both.agg(F.sum(F.abs(F.coalesce("c", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))).first()[0] or 0.0
            if moved > SETTLED * total:
                continue
        break
    rows, known = counted(freq)
    decided = rows.select("run", "n", "arcs").mapInPandas(_decide(total, known), "run string, spans array<struct<a:int,b:int>>")
    whole = F.transform("spans", lambda s: F.array_join(F.slice("parts", 2 * s["a"] + 1, 2 * (s["b"] - s["a"]) - 1), ""))
    pieces = segs.join(decided, "run", "left").select("owner", "cell", "seg", F.posexplode(F.coalesce(whole, F.filter("parts", lambda x, i: i % 2 == 0))).alias("k", "value"))
    line = Window.partitionBy("owner", "cell").orderBy("seg", "k")
    return pieces.select("owner", F.row_number().over(line).cast("bigint").alias("pos"), F.trim("value").alias("value"))
