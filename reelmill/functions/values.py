"""What counts as a value: blanks, stand-ins, sentinels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for "unknown", compared in lower case without outer blanks.
STAND_INS = ("-", "--", "?", "??", "/", "\\n", "n/a", "na", "nan", "nil", "none", "null", "unknown", "undefined", "missing", "tba", "tbd")


def stripped(text: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def blank_to_null(text: Column) -> Column:
    """Without outer blanks; null where nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def is_filled_text(text: Column) -> Column:
    """Neither null nor blank nor a stand-in for unknown; never null itself."""
    plain = F.lower(stripped(text))
    return F.coalesce((plain != "") & ~plain.isin(*STAND_INS), F.lit(False))


def is_filled_amount(number: Column) -> Column:
    """A number of at least 0; never null itself. NaN and the infinities are no numbers."""
    x = number.cast("double")
    return F.coalesce((x >= 0) & ~F.isnan(x) & (x < float("inf")), F.lit(False))


def positive_or_null(number: Column) -> Column:
    return F.when(number > 0, number)


def amount_or_null(number: Column, least: int) -> Column:
    """Null below ``least``: amounts that small are keyed in by mistake."""
    return F.when(number >= least, number)


def capitals(text: Column, length: int = 2) -> Column:
    """A code of ``length`` capitals; null where blank."""
    return F.nullif(F.substring(F.upper(F.trim(text)), 1, length), F.lit(""))


def quoted_literal(text: Column) -> Column:
    """A text as an SQL literal; null stays null."""
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def quoted_identifier(name: Column) -> Column:
    """A name as an SQL identifier, quoted only where it must be."""
    return F.when(name.rlike(r"^[a-z_][a-z0-9_]*\z"), name).otherwise(F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"')))
