"""Small building blocks shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as browsers define it, as the inside of a character class.
JS_SPACE = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    A lambda variable is bound per row, so the optimizer cannot duplicate an
    expensive expression that ``body`` mentions more than once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def lits(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def strip(text: Column) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def nonempty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def round_half_up(value: Column) -> Column:
    return F.floor(value + F.lit(0.5)).cast("int")
