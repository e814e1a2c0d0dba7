"""Column expressions on whole texts, shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a word, as white space and as a symbol.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once per row however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def place(ordered: Column, value: Column, upto: bool = False) -> Column:
    """How many elements of an array in rising order lie below ``value``, or ``upto`` it (binary search, 31 steps at most)."""
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), lambda s: s <= F.size(ordered))
    below = lambda k: F.coalesce(F.get(ordered, k) <= value if upto else F.get(ordered, k) < value, F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(below(at + s - 1), at + s).otherwise(at))


def held(ordered: Column, value: Column) -> Column:
    """Whether an array in rising order holds ``value``."""
    return F.coalesce(F.get(ordered, place(ordered, value)) == value, F.lit(False))


def whole(text) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text) -> Column:
    return F.regexp_extract_all(whole(text), F.lit(WORD), F.lit(0))


def word_count(text) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def symbol_count(text) -> Column:
    t = whole(text)
    return (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long")


def held_out(doc_id="doc_id", remainder: int = 0) -> Column:
    """Whether crc32(doc_id as text) mod 5 is ``remainder``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == remainder, F.lit(False))
