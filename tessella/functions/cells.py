"""Cell by cell: arithmetic, comparison, logic, choice and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def clean(x: Column) -> Column:
    """NaN to missing."""
    return F.when(~F.isnan(x), x)


def add(a: Column, b: Column) -> Column:
    return a + b


def subtract(a: Column, b: Column) -> Column:
    return a - b


def multiply(a: Column, b: Column) -> Column:
    return a * b


def divide(a: Column, b: Column) -> Column:
    """x / 0 is infinite, 0 / 0 missing."""
    return F.when(b == 0, F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF))).otherwise(F.try_divide(a, b))


def power(a: Column, b: Column) -> Column:
    """x ** 0 and 1 ** x are 1 even where x is missing; no real result is missing."""
    return F.when((b == 0) | (a == 1), F.lit(1.0)).otherwise(clean(F.pow(a, b)))


def negate(a: Column) -> Column:
    return -a


def absolute(a: Column) -> Column:
    return F.abs(a)


def log(a: Column) -> Column:
    """Natural; log 0 is minus infinity, of a negative number missing."""
    return F.when(a == 0, F.lit(-INF)).otherwise(F.ln(a))


def sign(a: Column) -> Column:
    return F.signum(a) + F.lit(0.0)


def greater_than(a: Column, b: Column) -> Column:
    return F.coalesce(a > b, F.lit(False))


def less_than(a: Column, b: Column) -> Column:
    return F.coalesce(a < b, F.lit(False))


def greater_or_equal(a: Column, b: Column) -> Column:
    return F.coalesce(a >= b, F.lit(False))


def less_or_equal(a: Column, b: Column) -> Column:
    return F.coalesce(a <= b, F.lit(False))


def equal(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def not_equal(a: Column, b: Column) -> Column:
    """A missing side is unequal to everything."""
    return F.coalesce(a != b, F.lit(True))


def truth(a: Column, tag: str) -> Column:
    if tag == "boolean":
        return F.coalesce(a, F.lit(False))
    if tag in ("group", "object"):
        return a.isNotNull()
    return F.coalesce(a != 0, F.lit(False))


def if_else(cond: Column, yes: Column, no: Column) -> Column:
    """A missing condition chooses no."""
    return F.when(F.coalesce(cond, F.lit(False)), yes).otherwise(no)


def is_nan(a: Column) -> Column:
    return a.isNull()


def map_values(x: Column, mapping: dict) -> Column:
    """Simultaneous replacement; others stay. With numeric targets for text labels, other labels become missing unless they are numbers."""
    if not mapping:
        return x
    pairs = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    numeric = all(isinstance(v, (int, float)) for v in mapping.values()) and all(isinstance(k, str) for k in mapping)
    return F.coalesce(F.try_element_at(pairs, x).cast("double"), x.try_cast("double")) if numeric else F.coalesce(F.try_element_at(pairs, x), x)


def composite_group(a: Column, b: Column, separator: str = "&") -> Column:
    return F.concat(a.cast("string"), F.lit(separator), b.cast("string"))


def assign(x: Column, mask: Column, value) -> Column:
    """x with value where mask is true or missing."""
    return F.when(F.coalesce(mask, F.lit(True)), F.lit(value)).otherwise(x)
