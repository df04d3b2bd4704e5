"""Small text expressions. Patterns are Unicode-aware and let `.` stop at line feeds only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U, UI = "(?Ud)", "(?iUd)"


#: Unicode's white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    """Both ends without white space of any kind; null becomes empty."""
    return F.btrim(F.coalesce(x, F.lit("")), F.lit(WHITE))


def matches(x: Column, pattern: str, ignore_case: bool = False) -> Column:
    return F.rlike(x, F.lit((UI if ignore_case else U) + pattern))


def word_count(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"(?U)\w+"))


def group(x: Column, pattern: str, k: int = 1, ignore_case: bool = False) -> Column:
    """The k-th group of the first match, or null."""
    return F.when(matches(x, pattern, ignore_case), F.regexp_extract(x, (UI if ignore_case else U) + pattern, k))


def given(x: Column) -> Column:
    """Null where a text is blank."""
    return F.nullif(strip(x), F.lit(""))


def either(*xs: Column | str) -> Column:
    """The first text that is not blank, else empty."""
    return F.coalesce(*[given(x) if isinstance(x, Column) else F.lit(x) for x in xs], F.lit(""))


def note_added(notes: Column, note: str) -> Column:
    """`notes | note`, without bars and spaces at the ends."""
    return F.btrim(F.concat(F.coalesce(notes, F.lit("")), F.lit(f" | {note}")), F.lit(" |"))


def casefold(x: Column) -> Column:
    """Lower case with sharp and long s as plain ones. Spark folds lower(upper(x)) to lower(x), so that would not do."""
    return F.replace(F.replace(F.lower(x), F.lit("ß"), F.lit("ss")), F.lit("ſ"), F.lit("s"))
