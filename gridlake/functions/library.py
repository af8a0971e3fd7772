"""The spreadsheet function library as column expressions.

Ranges are arrays of doubles in row-major order, blanks as nulls; a blank counts as 0 in SUM, AVERAGE, MIN, MAX
and COUNT. Functions that iterate to a solution (IRR, XIRR) are vectorised Python functions over arrays. Everything
else stays in the JVM. ``FUNCTIONS`` lists all by
name, and ``register`` makes the scalar ones callable from SQL.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gridlake.functions.coerce import NA, REF, VALUE

EPOCH = "1899-12-30"

# Arithmetic -----------------------------------------------------------------------------------------------


#: Powers of ten that a double holds exactly.
_TENS = [10.0**k for k in range(23)]
_SPLIT, _WHOLE = 134217729.0, 2.0**52


def ten_to(n: Column) -> Column:
    """10 to the absolute value of n, up to 22."""
    return F.element_at(F.array(*map(F.lit, _TENS)), F.least(F.abs(n), F.lit(22)) + 1)


def _halves(x: Column) -> tuple[Column, Column]:
    """A double as a sum of two with half as many digits."""
    high = x * _SPLIT - (x * _SPLIT - x)
    return high, x - high


def _at_places(x: Column, n: Column) -> Column:
    """|x| rounded to n >= 0 places. The product with a power of ten is kept with its rounding error, so that ties are those of the exact binary value."""
    power = ten_to(n)
    p = x * power
    (a, b), (c, d) = _halves(x), _halves(power)
    error = ((a * c - p) + a * d + b * c) + b * d
    whole = F.floor(p).cast("double")
    beyond = (p - (whole + 0.5)) + error
    up = (beyond > 0) | ((beyond == 0) & (whole % 2 == 1))
    return F.when((p >= _WHOLE) | F.isnan(p), x).otherwise(F.when(up, whole + 1).otherwise(whole) / power)


def _at_tens(x: Column, n: Column) -> Column:
    """|x| rounded to a multiple of 10^-n, n < 0; the remainder of doubles is exact."""
    power = ten_to(n)
    rest = x % power
    low = (x - rest) / power
    up = (rest > power / 2) | ((rest == power / 2) & (low % 2 == 1))
    return F.when(up, low + 1).otherwise(low) * power


def ROUND(x: Column, n: Column | int = 0) -> Column:
    """To the nearest; ties, of the exact binary value, to the even digit. Stays in the JVM."""
    x, n = x.cast("double"), F.lit(n) if isinstance(n, int) else n
    size = F.abs(x)
    return F.when(x < 0, -1.0).otherwise(1.0) * F.when(n >= 0, _at_places(size, n)).otherwise(_at_tens(size, n))


def _scaled(x: Column, n: int, how: Callable[[Column], Column]) -> Column:
    return how(x * F.lit(10.0**n)).cast("double") / F.lit(10.0**n)


def ROUNDUP(x: Column, n: int = 0) -> Column:
    """Toward plus infinity; a negative number of places rounds to the nearest."""
    return _scaled(x, n, F.ceil) if n >= 0 else ROUND(x, n)


def ROUNDDOWN(x: Column, n: int = 0) -> Column:
    return _scaled(x, n, F.floor) if n >= 0 else ROUND(x, n)


def ABS(x: Column) -> Column:
    return F.abs(x)


def POWER(x: Column, y: Column) -> Column:
    return F.pow(x, y)


def SQRT(x: Column) -> Column:
    """Null (an error) for negative numbers."""
    return F.when(x >= 0, F.sqrt(x))


def MOD(x: Column, y: Column) -> Column:
    """Sign of the divisor; null (an error) where it is 0."""
    return F.when(y != 0, x - y * F.floor(x / F.nullif(y, F.lit(0).cast("double"))))


def INT(x: Column) -> Column:
    """Toward zero."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long")


def SIGN(x: Column) -> Column:
    return F.signum(x).cast("int")


# Ranges -----------------------------------------------------------------------------------------------------


def _filled(cells: Column) -> Column:
    return F.transform(cells, lambda v: F.coalesce(v, F.lit(0.0)))


def SUM(cells: Column) -> Column:
    return F.aggregate(_filled(cells), F.lit(0.0), lambda a, v: a + v)


def MAX(cells: Column) -> Column:
    return F.array_max(_filled(cells))


def MIN(cells: Column) -> Column:
    return F.array_min(_filled(cells))


def AVERAGE(cells: Column) -> Column:
    return F.when(F.size(cells) > 0, SUM(cells) / F.size(cells))


def COUNT(cells: Column) -> Column:
    return F.size(cells).cast("long")


# Logic ------------------------------------------------------------------------------------------------------


def truthy(x: Column) -> Column:
    return F.coalesce(x.cast("double") != 0, F.lit(False))


def IF(condition: Column, then: Column, otherwise: Column | None = None) -> Column:
    return F.when(condition, then).otherwise(F.lit(0) if otherwise is None else otherwise)


def AND(*conditions: Column) -> Column:
    return F.forall(F.array(*conditions), lambda c: F.coalesce(c, F.lit(False))) if conditions else F.lit(True)


def OR(*conditions: Column) -> Column:
    return F.exists(F.array(*conditions), lambda c: F.coalesce(c, F.lit(False))) if conditions else F.lit(False)


def NOT(condition: Column) -> Column:
    return ~F.coalesce(condition, F.lit(False))


def ISBLANK(x: Column) -> Column:
    return x.isNull() | (x.cast("string") == "")


# Text -------------------------------------------------------------------------------------------------------


def LEN(x: Column) -> Column:
    return F.length(x)


def CONCATENATE(*parts: Column) -> Column:
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


# Dates: serial numbers count days from EPOCH ---------------------------------------------------------------------


#: The day of what is no date, and the number above which a number counts days.
NO_DATE, LEAST_SERIAL = "1900-01-01", 1000


def of_serial(x: Column) -> Column:
    """The date of a serial number above LEAST_SERIAL, else null."""
    return F.when(x > LEAST_SERIAL, F.date_add(F.lit(EPOCH).cast("date"), F.floor(x).cast("int")))


def dated(text: Column) -> Column:
    """The date of a text in one of five forms, else null."""
    forms = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/M/d", "M/d/yyyy", "d-M-yyyy"]
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in forms])


def to_date(x: Column, is_text: bool = False) -> Column:
    """A date from a date, a serial number or a text in one of five forms; otherwise NO_DATE. With `is_text` digits are no serial number."""
    text = x.cast("string")
    serial = F.lit(None).cast("date") if is_text else of_serial(text.try_cast("double"))
    return F.coalesce(serial, dated(text), F.lit(NO_DATE).cast("date"))


def serial(d: Column) -> Column:
    return F.datediff(d, F.lit(EPOCH).cast("date"))


def YEAR(d: Column) -> Column:
    return F.year(d)


def MONTH(d: Column) -> Column:
    return F.month(d)


def DAY(d: Column) -> Column:
    return F.dayofmonth(d)


def DATE(y: Column, m: Column, d: Column) -> Column:
    """Null (an error) for a day that does not exist."""
    return F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0)).cast("date")


def EDATE(d: Column, months: Column | int) -> Column:
    return serial(F.add_months(d, months))


def DATEDIF(start: Column, end: Column, unit: str) -> Column:
    """Whole days, months or years; YM months without years, MD days without months, YD days without years. A day that a
    month does not have is its last one."""
    y1, m1, d1 = F.year(start), F.month(start), F.dayofmonth(start)
    y2, m2, d2 = F.year(end), F.month(end), F.dayofmonth(end)
    months = (y2 - y1) * 12 + m2 - m1 - F.when(d2 < d1, 1).otherwise(0)
    years = y2 - y1 - F.when((m2 * 100 + d2) < (m1 * 100 + d1), 1).otherwise(0)
    by = {
        "D": F.datediff(end, start),
        "M": months,
        "Y": years,
        "YM": F.pmod(months, F.lit(12)),
        "MD": F.datediff(end, F.add_months(start, months)),
        "YD": F.datediff(end, F.add_months(start, years * 12)),
    }
    return by.get(unit.upper(), F.lit(0))


# Conditional -------------------------------------------------------------------------------------------------


def criterion(value: Column, rule: str) -> Column:
    """A COUNTIF rule: a comparison with a number, wildcards (* and ?), or equality."""
    for op in (">=", "<=", "<>", ">", "<", "="):
        if rule.startswith(op):
            n = F.lit(float(rule[len(op) :]))
            x = F.coalesce(value.try_cast("double"), F.lit(0.0))
            return {">=": x >= n, "<=": x <= n, "<>": x != n, ">": x > n, "<": x < n, "=": x == n}[op]
    if "*" in rule or "?" in rule:
        pattern = "".join({"*": ".*", "?": "."}.get(c, "\\" + c if not c.isalnum() else c) for c in rule)
        return value.cast("string").rlike(f"(?s)^{pattern}$")
    return F.lower(F.trim(value.cast("string"))) == rule.strip().lower()


def COUNTIF(value: Column, rule: str) -> Column:
    """An aggregate over rows."""
    return F.count_if(criterion(value, rule))


def SUMIF(value: Column, rule: str, summed: Column | None = None) -> Column:
    """An aggregate over rows; exact to the cent."""
    return F.sum(F.when(criterion(value, rule), value if summed is None else summed))


# Finance -----------------------------------------------------------------------------------------------------


def PMT(rate: Column, nper: Column, pv: Column, fv: Column | float = 0.0, beginning: int = 0) -> Column:
    fv = F.lit(fv) if isinstance(fv, int | float) else fv
    growth = F.pow(1 + rate, nper)
    flat = -(pv + fv) / nper
    payment = -rate * (pv * growth + fv) / F.nullif((growth - 1) * (1 + rate * beginning), F.lit(0.0))
    return F.when(nper == 0, None).when(rate == 0, flat).otherwise(payment)


def _newton(value: Callable[[float], tuple[float, float]], guess: float, scale: float) -> float:
    """A root by Newton's method, kept within the rates that make sense; NaN if 100 steps do not find it.
    The tolerance is relative to the flows, so large amounts converge as small ones do."""
    rate = guess
    for _ in range(100):
        v, slope = value(rate)
        if abs(v) < 1e-10 * max(1.0, scale):
            return rate
        if not math.isfinite(v) or slope == 0 or not math.isfinite(slope):
            return math.nan
        rate = min(10.0, max(-0.9999, rate - v / slope))
    return math.nan


def irr(flows: np.ndarray, guess: float = 0.1) -> float:
    t = np.arange(len(flows))
    if not len(flows):
        return math.nan

    def value(rate: float) -> tuple[float, float]:
        p = flows / (1 + rate) ** t
        return float(p.sum()), float((-t * p / (1 + rate)).sum())

    return _newton(value, guess, float(np.abs(flows).max()))


def xirr(flows: np.ndarray, days: np.ndarray, guess: float = 0.1) -> float:
    if not len(flows):
        return math.nan
    order = np.argsort(days, kind="stable")
    flows, t = flows[order], (days[order] - days[order][0]) / 365.0

    def value(rate: float) -> tuple[float, float]:
        p = flows * (1 + rate) ** -t
        return float(p.sum()), float((-t * p / (1 + rate)).sum())

    return _newton(value, guess, float(np.abs(flows).max()))


@F.pandas_udf(DoubleType())
def IRR(flows: pd.Series) -> pd.Series:
    """Null where no rate is found."""
    return pd.Series([irr(np.asarray(f, float)) for f in flows], dtype="float64").replace({np.nan: None}).astype("float64")


@F.pandas_udf(DoubleType())
def XIRR(flows: pd.Series, days: pd.Series) -> pd.Series:
    return pd.Series([xirr(np.asarray(f, float), np.asarray(d, float)) for f, d in zip(flows, days, strict=True)], dtype="float64")


# Lookup ------------------------------------------------------------------------------------------------------


def MATCH(value: Column, cells: Column, kind: int = 0) -> Column:
    """1-based position; kind 0 the first equal one, 1 the last one not above, -1 the last one not below. Null: not found."""
    if kind == 0:
        at = F.array_position(cells, value)
        return F.when(at > 0, at)
    spots = F.transform(cells, lambda v, i: F.when((v <= value) if kind > 0 else (v >= value), i + 1))
    return F.array_max(spots).cast("long")


def INDEX(cells: Column, row: Column, column: Column | int = 1, width: int = 1) -> Column:
    """An element of a rectangle given in row-major order with its width; null (a reference error) outside."""
    column = F.lit(column) if isinstance(column, int) else column
    at = (row - 1) * width + column
    return F.when((row >= 1) & (column >= 1) & (column <= width), F.try_element_at(cells, F.greatest(at, F.lit(1)).cast("int")))


def CHOOSE(index: Column, *values: Column) -> Column:
    return F.when((index >= 1) & (index <= len(values)), F.elt(index.cast("int"), *values))


def VLOOKUP(value: Column, keys: Column, values: Column, approximate: bool = True) -> Column:
    """Over parallel arrays of keys and values; approximate takes the last key not above, keys ascending."""
    return F.try_element_at(values, MATCH(value, keys, 1 if approximate else 0).cast("int"))


FUNCTIONS: dict[str, Callable] = {
    f.__name__: f
    for f in (
        ROUNDUP, ROUNDDOWN, SUM, ABS, MAX, MIN, AVERAGE, IF, AND, OR, NOT, POWER, SQRT, MOD, INT, LEN, CONCATENATE, SIGN,
        YEAR, MONTH, DAY, DATEDIF, EDATE, DATE, ISBLANK, COUNT, COUNTIF, SUMIF, PMT, MATCH, INDEX, CHOOSE, VLOOKUP, ROUND,
    )
} | {"IRR": IRR, "XIRR": XIRR}

ERRORS = {"MATCH": NA, "VLOOKUP": NA, "INDEX": REF, "CHOOSE": VALUE}


def _round_sql() -> str:
    """ROUND of x and n as SQL text."""
    size, ten = "abs(x)", f"element_at(array({', '.join(f'{t!r}D' for t in _TENS)}), least(abs(n), 22) + 1)"
    halves = lambda v: (h := f"({v} * {_SPLIT}D - ({v} * {_SPLIT}D - {v}))", f"({v} - {h})")
    (a, b), (c, d), p = halves(size), halves(ten), f"({size} * {ten})"
    beyond = f"(({p} - (floor({p}) + 0.5D)) + ((({a} * {c} - {p}) + {a} * {d} + {b} * {c}) + {b} * {d}))"
    places = f"CASE WHEN {p} >= {_WHOLE}D OR isnan({p}) THEN {size} ELSE CAST(floor({p}) + CASE WHEN {beyond} > 0 OR ({beyond} = 0 AND floor({p}) % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / {ten} END"
    rest = f"({size} % {ten})"
    tens = f"(({size} - {rest}) / {ten} + CASE WHEN {rest} > {ten} / 2 OR ({rest} = {ten} / 2 AND (({size} - {rest}) / {ten}) % 2 = 1) THEN 1 ELSE 0 END) * {ten}"
    return f"sign(x) * CASE WHEN n >= 0 THEN {places} ELSE {tens} END"


def register(spark: SparkSession) -> list[str]:
    """Makes scalar functions callable from SQL, as SQL functions of the session; returns their names."""
    bodies = {
        "xl_mod": ("x DOUBLE, y DOUBLE", "DOUBLE", "CASE WHEN y <> 0 THEN x - y * floor(x / nullif(y, 0D)) END"),
        "xl_int": ("x DOUBLE", "BIGINT", "CAST(CASE WHEN x < 0 THEN ceil(x) ELSE floor(x) END AS BIGINT)"),
        "xl_edate": ("d DATE, m INT", "INT", f"datediff(add_months(d, m), DATE'{EPOCH}')"),
        "xl_pmt": ("rate DOUBLE, nper DOUBLE, pv DOUBLE", "DOUBLE", "CASE WHEN nper = 0 THEN NULL WHEN rate = 0 THEN -pv / nper ELSE -rate * pv * pow(1 + rate, nper) / nullif(pow(1 + rate, nper) - 1, 0D) END"),
        "xl_num": ("s STRING", "DOUBLE", "coalesce(try_cast(s AS DOUBLE), 0D)"),
        "xl_round": ("x DOUBLE, n INT", "DOUBLE", _round_sql()),
    }
    for name, (args, kind, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    spark.udf.register("xl_irr", IRR)
    return [*bodies, "xl_irr"]
