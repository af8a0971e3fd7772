"""Spreadsheet coercions and operators as column expressions.

A dynamic value is text, a number, a boolean or blank. Numbers in text count as numbers, other text and blanks
as 0. Errors are text that begins with '#': they coerce to 0 like any other text and so do not spread.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIV0, NA, REF, VALUE, NUM = "#DIV/0!", "#N/A", "#REF!", "#VALUE!", "#NUM!"


def number(text: Column) -> Column:
    return F.coalesce(text.cast("string").try_cast("double"), F.lit(0.0))


def safe_divide(a: Column, b: Column) -> tuple[Column, Column]:
    """Quotient and error text: exactly one of them is null."""
    return F.when(b != 0, a / b), F.when(b == 0, F.lit(DIV0))


def as_text(x: Column) -> Column:
    """A double as text, whole ones with one decimal."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(whole, F.concat(x.cast("bigint").cast("string"), F.lit(".0"))).otherwise(x.cast("string"))


def compare(op: str, a: Column, b: Column) -> Column:
    """Both text: by trimmed lower-case text; otherwise by number."""
    na, nb = a.try_cast("double"), b.try_cast("double")
    ta, tb = F.lower(F.trim(a)), F.lower(F.trim(b))
    text = na.isNull() & nb.isNull()
    x, y = number(a), number(b)
    by = {"=": (ta == tb, x == y), "<>": (ta != tb, x != y), "<": (ta < tb, x < y), ">": (ta > tb, x > y), "<=": (ta <= tb, x <= y), ">=": (ta >= tb, x >= y)}
    s, n = by[op]
    return F.when(text, s).otherwise(n)
