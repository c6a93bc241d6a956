"""Arithmetic and parsing. Null or non-numeric operands are errors, never null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import as_text, trim

_FLOAT = r"(?i)^[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)$"
_INT = r"^[+-]?\d+$"


def given(c: Column, what: str = "number") -> Column:
    """The value, or an error when it is null."""
    return F.when(c.isNull(), F.raise_error(F.lit(f"expected {what}, got null"))).otherwise(c)


# Doubles below this are safely inside the long range. A `try_` function would find overflow
# too, but by an exception per row.
_SAFE = 9.0e18


def _wide(rough: Column, exact: Column) -> Column:
    return F.when(F.abs(rough) < _SAFE, exact.cast("double")).otherwise(rough)


def add(a: Column, b: Column) -> Column:
    """Integer or double sum; an integer overflow is an error (ANSI)."""
    return given(a) + given(b)


def subtract(a: Column, b: Column) -> Column:
    return given(a) - given(b)


def multiply(a: Column, b: Column) -> Column:
    return given(a) * given(b)


def add_wide(a: Column, b: Column) -> Column:
    """Sum of two integers as a double, so that an overflow continues as a double."""
    return _wide(given(a).cast("double") + given(b).cast("double"), a + b)


def subtract_wide(a: Column, b: Column) -> Column:
    return _wide(given(a).cast("double") - given(b).cast("double"), a - b)


def multiply_wide(a: Column, b: Column) -> Column:
    return _wide(given(a).cast("double") * given(b).cast("double"), a * b)


def divide(a: Column, b: Column) -> Column:
    """Always a double; a zero divisor is an error."""
    x, y = given(a).cast("double"), given(b).cast("double")
    return F.when(y == 0, F.raise_error(F.lit("division by zero"))).otherwise(x / y)


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the dividend; integers stay integers; a zero divisor is an error."""
    return F.when(given(b) == 0, F.raise_error(F.lit("modulo by zero"))).otherwise(given(a) % b)


def negate(c: Column) -> Column:
    return F.negative(given(c))


def negate_wide(c: Column) -> Column:
    """Minus an integer as a double: the smallest long has no positive twin."""
    return -given(c).cast("double")


def parse_int(c: Column, strict: bool = True) -> Column:
    """Whole-number text to a long. Strict raises on anything else, lenient gives null."""
    s = trim(c)
    n = F.when(F.rlike(s, F.lit(_INT)), s.try_cast("long"))
    return F.when(c.isNotNull(), _or_error(n, c, "parseInt") if strict else n)


def truncate_to_int(c: Column) -> Column:
    """A double towards zero as a long, held inside the long range; null stays null."""
    top = 9223372036854775807
    return (
        F.when(F.isnan(c), F.lit(0).cast("long"))
        .when(c >= 9.223372036854775807e18, F.lit(top))
        .when(c <= -9.223372036854775808e18, F.lit(-top - 1))
        .otherwise(c.try_cast("long"))
    )


def parse_float(c: Column, strict: bool = True) -> Column:
    s = trim(c)
    n = F.when(F.rlike(s, F.lit(_FLOAT)), s.try_cast("double"))
    return F.when(c.isNotNull(), _or_error(n, c, "parseFloat") if strict else n)


# The words read as booleans.
TRUE_WORDS = ("true", "yes", "1")
FALSE_WORDS = ("false", "no", "0")


def parse_bool(c: Column, strict: bool = True) -> Column:
    s = F.lower(trim(c))
    b = F.when(s.isin(*TRUE_WORDS), F.lit(True)).when(s.isin(*FALSE_WORDS), F.lit(False))
    return F.when(c.isNotNull(), _or_error(b, c, "parseBool") if strict else b)


def _or_error(parsed: Column, raw: Column, name: str) -> Column:
    return F.when(
        parsed.isNull(), F.raise_error(F.concat(F.lit(f"{name}: cannot read "), as_text(raw)))
    ).otherwise(parsed)
