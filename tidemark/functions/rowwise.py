"""Statistics across the columns of one row. Nulls are dropped first; everything is one expression on an array."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import ieee

#: Keeps a zero spread from dividing; it shows in results.
EPS = 1e-12


def valid(cols: Sequence[Column]) -> Column:
    return F.array_compact(F.array(*[ieee.double(c) for c in cols])) if cols else F.array().cast("array<double>")


def _sum(values: Column, of: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + of(x))


def _mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, _sum(values) / F.greatest(F.size(values), F.lit(1)))


def _var(values: Column) -> Column:
    mean = _mean(values)
    return F.when(F.size(values) > 1, _sum(values, lambda x: (x - mean) * (x - mean)) / F.greatest(F.size(values) - 1, F.lit(1)))


def row_sum(cols: Sequence[Column]) -> Column:
    out = F.lit(0.0)
    for c in cols:
        out = out + F.coalesce(ieee.double(c), F.lit(0.0))
    return out


def row_mean(cols: Sequence[Column]) -> Column:
    return _mean(valid(cols))


def _extreme(cols: Sequence[Column], pick: Callable) -> Column:
    values = [ieee.double(c) for c in cols]
    return F.lit(None).cast("double") if not values else values[0] if len(values) == 1 else pick(*values)


def row_min(cols: Sequence[Column]) -> Column:
    return _extreme(cols, F.least)


def row_max(cols: Sequence[Column]) -> Column:
    return _extreme(cols, F.greatest)


def row_count_valid(cols: Sequence[Column]) -> Column:
    return F.size(valid(cols)).cast("long")


def row_var(cols: Sequence[Column]) -> Column:
    return _var(valid(cols))


def row_std(cols: Sequence[Column]) -> Column:
    return F.sqrt(_var(valid(cols)))


def row_median(cols: Sequence[Column]) -> Column:
    ordered, n = F.array_sort(valid(cols)), F.size(valid(cols))
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(ordered, low) + F.get(ordered, high)) / 2)


def row_quantile(cols: Sequence[Column], q: float) -> Column:
    """The value at index floor((n - 1) q), that is, the lower of two neighbours."""
    ordered, n = F.array_sort(valid(cols)), F.size(valid(cols))
    return F.when(n > 0, F.get(ordered, F.floor((n - 1) * F.lit(float(q))).cast("int")))


def row_topk_mean(cols: Sequence[Column], k: int) -> Column:
    return _mean(F.slice(F.sort_array(valid(cols), asc=False), 1, k))


def row_bottomk_mean(cols: Sequence[Column], k: int) -> Column:
    return _mean(F.slice(F.array_sort(valid(cols)), 1, k))


def xs_demean(x: Column, cols: Sequence[Column]) -> Column:
    return ieee.double(x) - row_mean(cols)


def xs_zscore(x: Column, cols: Sequence[Column]) -> Column:
    return (ieee.double(x) - row_mean(cols)) / (row_std(cols) + F.lit(EPS))


def xs_rank(x: Column, cols: Sequence[Column]) -> Column:
    """Average rank of x; a null x beside any value ranks 0.5, a row without values gives null."""
    x, values = ieee.double(x), valid(cols)
    count = lambda test: F.aggregate(values, F.lit(0.0), lambda acc, e: acc + F.coalesce(test(e).cast("double"), F.lit(0.0)))
    return F.when(F.size(values) > 0, count(lambda e: e < x) + (count(lambda e: e == x) + 1) / 2)


def xs_pctrank(x: Column, cols: Sequence[Column]) -> Column:
    n = F.size(valid(cols)).cast("double")
    return F.when(n > 1, (xs_rank(x, cols) - 1) / (n - 1 + F.lit(EPS))).otherwise(F.lit(0.0))


def softmax_weight(x: Column, cols: Sequence[Column], temperature: float = 1.0) -> Column:
    total = _sum(valid(cols), lambda e: F.exp(e / F.lit(float(temperature))))
    return ieee.divide(F.exp(ieee.double(x) / F.lit(float(temperature))), total + F.lit(EPS))
