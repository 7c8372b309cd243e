"""Double arithmetic with IEEE results where Spark raises or gives null.

Null stays null. Division by zero gives an infinity or NaN, ln(0) negative infinity, ln of a negative
number NaN, and a remainder by zero NaN; the remainder's sign is that of the dividend.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def double(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def divide(a, b) -> Column:
    a, b = double(a), double(b)
    # try_divide keeps a zero divisor from raising should both branches be evaluated.
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def modulo(a, b) -> Column:
    a, b = double(a), double(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(b == 0, F.lit(NAN)).otherwise(F.try_mod(a, b))


def ln(x) -> Column:
    x = double(x)
    return F.when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)).otherwise(F.ln(x))


def is_finite(x) -> Column:
    x = double(x)
    return ~F.isnan(x) & (F.abs(x) != F.lit(INF))
