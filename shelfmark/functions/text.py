"""Token columns: how text becomes index terms."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What ends a token: anything that is no letter, number or private-use character.
_SEPARATORS = r"[^\p{L}\p{N}\p{Co}]+"
_ASCII_SEPARATORS = "[^a-z0-9]+"  # the same in lower-case ASCII


def _accent_table() -> tuple[str, str]:
    """Lower-case Latin letters that decompose to one ASCII letter and exactly one mark."""
    accented, plain = [], []
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        if char != char.lower() or len(parts) != 2:
            continue
        if parts[0].isascii() and parts[0].isalpha() and unicodedata.category(parts[1]) == "Mn":
            accented.append(char)
            plain.append(parts[0])
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _accent_table()


def as_column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once per row.

    A column that a lambda refers to would otherwise be computed anew for every element.
    """
    return F.transform(F.array(value), use)[0]


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that is computed once per row, however often later steps use it.

    A generator of one row keeps Catalyst from copying the expression into every use and into
    the filters it pushes down.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def fold(col: Column | str) -> Column:
    """Lower case, single diacritics off; letters with two marks keep both."""
    text = F.coalesce(as_column(col), F.lit(""))
    return F.when(_is_ascii(text), F.lower(text)).otherwise(_folded(text))


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def _folded(text: Column) -> Column:
    # A capital sigma folds to the same letter wherever it stands, so it goes before lower().
    lowered = F.lower(F.replace(text, F.lit("Σ"), F.lit("σ")))
    return F.regexp_replace(F.translate(lowered, _ACCENTED, _PLAIN), r"\p{Mn}+", "")


def tokens(col: Column | str) -> Column:
    """The terms of a text, in order, as array<string>."""
    text = F.coalesce(as_column(col), F.lit(""))
    # Most texts need no folding; without lambdas, as these are not compiled.
    plain = F.split(F.lower(text), _ASCII_SEPARATORS)
    return F.array_remove(F.when(_is_ascii(text), plain).otherwise(F.split(_folded(text), _SEPARATORS)), "")


def join_tags(col: Column | str) -> Column:
    """Tags as one text for the index, parted by one blank."""
    return F.coalesce(F.array_join(as_column(col), " "), F.lit(""))


# What a Unicode-aware trim takes off both ends.
_BLANKS = r"[\t\n\x0B\f\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


def trim_blanks(col: Column | str) -> Column:
    """Trim every Unicode white space, where Spark's trim takes blanks only."""
    return F.regexp_replace(as_column(col), rf"\A{_BLANKS}|{_BLANKS}\z", "")
