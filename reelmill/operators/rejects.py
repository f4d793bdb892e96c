"""Loading delimited lines, with the lines that can't be loaded kept apart and explained.

A line is parsed at minimum cost: a dynamic programme reads it token by token in the states of a field (before its
content, in plain text, in quotes, after the closing quote) and may insert or delete quotes and delimiters at a cost.
Zero-cost lines whose fields pass their types are valid. Of the others the edits of the cheapest parse state the
reason: quote edits ``quoting``, else delimiter edits ``columns``, else the first field that fails its type.

A delimiter ends a field even within quotes, and delimiter edits act between fields (drop a field that is too many,
add an empty one that is missing); so no delimiter edit hides a quote that is out of place. A quote is in place where
it wraps the whole field but for outer blanks; a doubled quote within is one quote of the value.

Scale. Row by row, without a shuffle. Clean lines (no quotes, no outer blanks) are recognised, split and cast by SQL
where they are scanned, and rejects are looked for among the others only; these go to the programme in Arrow batches,
where a regular expression still takes the zero-cost ones. Runs of ordinary characters are one token: a line costs time
in proportion to its quotes, delimiters and blanks.

Edge cases: a null or empty line has too few columns; a null mark is a null for any type; extra columns of the input
are not read; repeated lines are parsed alike.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLANK = r"[^\S\t]"
_TOKEN = re.compile(rf'"|\t|{_BLANK}+|[^"\t\s]+')

# states of a field
START, PLAIN, QUOTED, CLOSED, AFTER = range(5)

#: Costs of an edit of a quote and of a delimiter.
QUOTE_COST, DELIMITER_COST = 1, 1


@dataclass(frozen=True)
class Field:
    """A column: ``convert`` gives the value of a text or raises ValueError; ``reason`` names its failure.

    ``clean`` is a regular expression of texts that SQL's cast to ``kind`` converts to the same value.
    """

    name: str
    kind: str
    convert: Callable[[str], object]
    reason: str
    clean: str


@dataclass(frozen=True)
class Layout:
    fields: tuple[Field, ...]
    null_mark: str = "\\N"

    def is_clean(self, line: Column) -> Column:
        """Whether ``line`` is a zero-cost parse of clean texts, without quotes or outer blanks; never null."""
        one = [f"(?:{f.clean}|{re.escape(self.null_mark)})" for f in self.fields]
        return F.coalesce(line.rlike("^" + r"\t".join(one) + r"\z"), F.lit(False))

    def pattern(self) -> re.Pattern:
        one = rf'(?:{_BLANK}*+"((?:[^"\t]|"")*+)"{_BLANK}*+|([^"\t]*+))'
        return re.compile(r"\t".join([one] * len(self.fields)))


def cheapest_edits(line: str, n_fields: int) -> list[tuple[str, int]]:
    """The edits of a cheapest parse into ``n_fields`` fields: ("insert quote" | "delete quote" | ..., offset)."""
    last = n_fields - 1
    # (field, state) -> (cost, edits as a chain)
    at: dict[tuple[int, int], tuple[int, tuple | None]] = {(0, START): (0, None)}

    def put(to: dict, key: tuple[int, int], cost: int, edits) -> None:
        if key not in to or cost < to[key][0]:
            to[key] = (cost, edits)

    def inserted(states: dict, offset: int) -> dict:
        """``states`` and those a quote inserted here leads to."""
        out = dict(states)
        for (f, s), (cost, edits) in states.items():
            if s == START:
                put(out, (f, QUOTED), cost + QUOTE_COST, (("insert quote", offset), edits))
            elif s == QUOTED:
                put(out, (f, AFTER), cost + QUOTE_COST, (("insert quote", offset), edits))
        return out

    for token in _TOKEN.finditer(line):
        text, offset = token.group(), token.start()
        to: dict = {}
        for (f, s), (cost, edits) in inserted(at, offset).items():
            if text == '"':
                put(to, (f, s), cost + QUOTE_COST, (("delete quote", offset), edits))
                if s == START:
                    put(to, (f, QUOTED), cost, edits)
                elif s == QUOTED:
                    put(to, (f, CLOSED), cost, edits)
                elif s == CLOSED:
                    put(to, (f, QUOTED), cost, edits)
            elif text == "\t":
                if s != QUOTED:
                    if f < last:
                        put(to, (f + 1, START), cost, edits)
                    put(to, (f, START), cost + DELIMITER_COST, (("delete delimiter", offset), edits))
            elif text.isspace():
                put(to, (f, AFTER if s == CLOSED else s), cost, edits)
            elif s in (START, PLAIN):
                put(to, (f, PLAIN), cost, edits)
            elif s == QUOTED:
                put(to, (f, QUOTED), cost, edits)
        at = to
    best = None
    for (f, s), (cost, edits) in inserted(at, len(line)).items():
        if s == QUOTED:
            continue
        for _ in range(last - f):
            cost, edits = cost + DELIMITER_COST, (("insert delimiter", len(line)), edits)
        if best is None or cost < best[0]:
            best = (cost, edits)
    chain, out = best[1], []
    while chain is not None:
        out.append(chain[0])
        chain = chain[1]
    return out[::-1]


def parse(line: str | None, layout: Layout, pattern: re.Pattern) -> tuple[list, str | None, str | None]:
    """The values, or the reason and the edits (``None`` where there is no fault)."""
    n = len(layout.fields)
    none = [None] * n
    if line is None:
        return none, "columns", f"{n - 1} x insert delimiter"
    whole = pattern.fullmatch(line)
    if whole is None:
        edits = cheapest_edits(line, n)
        reason = "quoting" if any(e.endswith("quote") for e, _ in edits) else "columns"
        return none, reason, "; ".join(f"{e} at {k}" for e, k in edits)
    values = []
    groups = whole.groups()
    for i, field in enumerate(layout.fields):
        quoted, plain = groups[2 * i], groups[2 * i + 1]
        text = (plain if quoted is None else quoted.replace('""', '"')).strip()
        if text == layout.null_mark:
            values.append(None)
            continue
        try:
            values.append(field.convert(text))
        except ValueError:
            return none, field.reason, f"no {field.kind}: {text[:40]}"
    return values, None, None


def _searched(df: DataFrame, line_id: str, line: str, layout: Layout) -> DataFrame:
    """The lines that aren't clean, through the dynamic programme."""
    names = [f.name for f in layout.fields]
    schema = f"line_id {df.schema[line_id].dataType.simpleString()}, " + ", ".join(f"`{f.name}` {f.kind}" for f in layout.fields) + ", reason string, edits string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pattern = layout.pattern()
        for batch in batches:
            parsed = [parse(x, layout, pattern) for x in batch["line"]]
            columns = {"line_id": batch["line_id"]}
            for i, name in enumerate(names):
                columns[name] = pd.Series([p[0][i] for p in parsed], index=batch.index, dtype=object)
            columns["reason"] = pd.Series([p[1] for p in parsed], index=batch.index, dtype=object)
            columns["edits"] = pd.Series([p[2] for p in parsed], index=batch.index, dtype=object)
            yield pd.DataFrame(columns)

    return _lines(df, line_id, line).where(~layout.is_clean(F.col("line"))).mapInPandas(run, schema)


def _lines(df: DataFrame, line_id: str, line: str) -> DataFrame:
    return df.select(F.col(f"`{line_id}`").alias("line_id"), F.col(f"`{line}`").alias("line"))


def _clean(df: DataFrame, line_id: str, line: str, layout: Layout) -> DataFrame:
    """The clean lines, split and cast where they are scanned."""
    parts = F.split("line", "\t")
    values = [F.nullif(parts[i], F.lit(layout.null_mark)).cast(f.kind).alias(f.name) for i, f in enumerate(layout.fields)]
    return _lines(df, line_id, line).where(layout.is_clean(F.col("line"))).select("line_id", *values)


def parse_lines(df: DataFrame, line_id: str, line: str, layout: Layout) -> DataFrame:
    """``(line_id, <fields>, reason, edits)``: each line with its values, or with what is wrong with it."""
    none = F.lit(None).cast("string")
    return _clean(df, line_id, line, layout).select("*", none.alias("reason"), none.alias("edits")).unionByName(_searched(df, line_id, line, layout))


_NUMBER = re.compile(r"[0-9]+(?:\.[0-9]*)?|\.[0-9]+")
_WHOLE = re.compile(r"[0-9]+")


def to_rating(text: str) -> float:
    if not _NUMBER.fullmatch(text) or not 1 <= float(text) <= 10:
        raise ValueError(text)
    return float(text)


def to_votes(text: str) -> int:
    if not _WHOLE.fullmatch(text) or len(text.lstrip("0")) > 10 or int(text) > 2147483647:
        raise ValueError(text)
    return int(text)


#: The daily ratings file: any text is a title's key.
RATINGS = Layout(
    (
        Field("tconst", "string", str, "key", r"[!#-\[\]-~]+"),
        Field("averageRating", "double", to_rating, "rating", r"(?:[1-9](?:\.[0-9]{0,12})?|10(?:\.0{0,12})?)"),
        Field("numVotes", "int", to_votes, "votes", r"[0-9]{1,9}"),
    )
)


def rejected(df: DataFrame, line_id: str = "line_id", line: str = "raw_line", layout: Layout = RATINGS) -> DataFrame:
    """``(line_id, reason)`` of the lines that can't be loaded."""
    return _searched(df, line_id, line, layout).where("reason is not null").select("line_id", "reason")


def loaded(df: DataFrame, line_id: str = "line_id", line: str = "raw_line", layout: Layout = RATINGS) -> DataFrame:
    """``(line_id, <fields>)`` of the valid lines, typed."""
    return parse_lines(df, line_id, line, layout).where("reason is null").drop("reason", "edits")
