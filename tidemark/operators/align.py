"""Aligning sources on one time axis: time keys, duplicates, prefixes, anchored joins and gaps."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import ordered

#: Where a source's time stands if its schema doesn't say, in order of preference.
TIME_CANDIDATES = ("open_time", "create_time", "time", "timestamp", "event_time", "transact_time", "calc_time")
#: Types that count as numeric for filling.
FILLED = (T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
DAY_MS = 86_400_000


def infer_time_key(columns: Sequence[str], registered: str | None = None) -> str:
    for name in ([registered] if registered else []) + list(TIME_CANDIDATES):
        if name in columns:
            return name
    return columns[0]


def epoch_ms(value: Column) -> Column:
    """Milliseconds from an epoch in seconds, milli-, micro- or nanoseconds, by its size."""
    v = value.cast("long")
    whole = lambda by: F.call_function("div", v, F.lit(by).cast("long"))
    return F.when(v >= 10**17, whole(10**6)).when(v >= 10**14, whole(10**3)).when(v < 10**11, v * 1000).otherwise(v)


def time_to_ms(df: DataFrame, column: str) -> Column:
    """Epoch milliseconds of a time column of any kind: numbers by size, texts by format or as numbers, timestamps as they are."""
    c, kind = F.col(column), df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_millis(c.cast("timestamp"))
    if isinstance(kind, T.StringType):
        parsed = F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")])
        return F.coalesce(F.unix_millis(parsed), epoch_ms(c.try_cast("long")))
    return epoch_ms(c)


def normalise_time(df: DataFrame, column: str, to: str = "ts") -> DataFrame:
    """``column`` becomes ``to`` in epoch milliseconds."""
    made = df.withColumn("__ms", time_to_ms(df, column)).drop(column)
    return made.drop(to).withColumnRenamed("__ms", to)


def in_range(df: DataFrame, start: date, end: date, ts: str = "ts") -> DataFrame:
    """Rows from the first to the last millisecond of the days, in UTC."""
    first = (start - date(1970, 1, 1)).days * DAY_MS
    return df.where(F.col(ts).between(first, ((end - date(1970, 1, 1)).days + 1) * DAY_MS - 1))


def features(df: DataFrame, wanted: Sequence[str] | None = None, time_key: str = "ts") -> list[str]:
    """Requested columns that exist, or all; never ``ignore`` or the time key. None of the requested raises."""
    found = [c for c in (wanted or df.columns) if c in df.columns and c.lower() != "ignore" and c != time_key]
    if wanted and not found:
        raise ValueError(f"none of {list(wanted)} is there")
    return found


def dedup(df: DataFrame, keys: Sequence[str], by: Sequence[str], keep: str = "last") -> DataFrame:
    """One row for each key: the last or first along ``by``, whose columns must tell equal keys apart.

    A maximum of structs takes partial aggregates, so repeated keys are merged before the shuffle. A column of ``by``
    stands in the struct once, as all of it is shuffled.
    """
    pick = F.max if keep == "last" else F.min
    rest = [c for c in df.columns if c not in keys]
    at = {b: f"__by{i}" for i, b in enumerate(by)}
    row = F.struct(*[F.col(b).alias(name) for b, name in at.items()], *[F.col(c) for c in rest if c not in at])
    if any(isinstance(df.schema[c].dataType, (T.MapType,)) for c in rest):
        raise ValueError("map columns can't be compared")
    return df.groupBy(*keys).agg(pick(row).alias("__row")).select(*keys, *[F.col("__row")[at.get(c, c)].alias(c) for c in rest]).select(*df.columns)


def prefix(symbol: str, dataset: str, interval: str | None = None) -> str:
    """``symbol_dataset_interval_``; the interval names only bars."""
    return f"{symbol}_{dataset}_{interval}_" if interval and "klines" in dataset.lower() else f"{symbol}_{dataset}_"


def prefixed(df: DataFrame, start: str, keep: Sequence[str] = ("ts",)) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(start + c) for c in df.columns if c not in keep])


def join_on_anchor(anchor: DataFrame, others: Sequence[DataFrame], key: str | Sequence[str] = "ts") -> DataFrame:
    """Left joins in order. The others must be unique on the key, so the anchor's rows stay as they are."""
    for other in others:
        anchor = anchor.join(other, key, "left")
    return anchor


def join_sources(sources: Sequence[DataFrame], key: Sequence[str], missing: str = "drop", order: str | None = None, rows_per_block: int = ordered.ROWS_PER_BLOCK) -> DataFrame:
    """Equi-joins on ``key``: inner for ``drop``, left for ``keep_nan``, left and carried forward along ``order`` for ``ffill``.

    Columns that repeat, other than the key, get ``_right`` (and a number from the third on).
    """
    if missing not in ("drop", "keep_nan", "ffill"):
        raise ValueError(f"unknown policy {missing!r}")
    out, late = sources[0], []
    for n, source in enumerate(sources[1:], 1):
        for c in source.columns:
            if c not in key and c in out.columns:
                source = source.withColumnRenamed(c, f"{c}_right" if f"{c}_right" not in out.columns else f"{c}_right{n}")
        late += [c for c in source.columns if c not in key]
        out = out.join(source, list(key), "inner" if missing == "drop" else "left")
    if missing == "ffill" and late:
        order = order or key[-1]
        return fill(out, "ffill", order, [k for k in key if k != order], late, rows_per_block)
    return out


def as_of(left: DataFrame, right: DataFrame, ts: str = "ts", by: Sequence[str] = (), rows_per_block: int = ordered.ROWS_PER_BLOCK) -> DataFrame:
    """Each left row with the last right row at or before its time, within ``by``.

    Both sides go through one ordered pass; rows of the right only carry their values forward.
    """
    values = [c for c in right.columns if c not in (ts, *by)]
    side, carried = "__side", "__right"
    a = left.withColumn(side, F.lit(1)).withColumn(carried, F.lit(None).cast(_struct(right, values)))
    b = right.select(ts, *by, F.lit(0).alias(side), F.struct(*values).alias(carried))
    both, many = ordered.number(a.unionByName(b, allowMissingColumns=True), ts, by, [side], rows_per_block)
    filled = ordered.ffill(both, carried, "__found", many, by).where(F.col(side) == 1)
    return filled.select(*left.columns, *[F.col("__found")[c].alias(c) for c in values])


def _struct(df: DataFrame, columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, df.schema[c].dataType, True) for c in columns])


def numeric(df: DataFrame, but: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, FILLED) and f.name not in but]


def fill(df: DataFrame, strategy: str, order: str = "ts", by: Sequence[str] = (), columns: Sequence[str] | None = None, rows_per_block: int = ordered.ROWS_PER_BLOCK, ties: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """``ffill`` carries the last value on, over ``limit`` rows at most if that is set; ``adjacent_avg`` puts interior gaps on the line between neighbours, by row; anything else changes nothing.

    With a limit each value travels with its row number, within blocks and from block to block, so that a carry stops where its distance says.
    """
    if limit is not None and (limit < 0 or strategy != "ffill"):
        raise ValueError("only ffill takes a limit, of 0 rows or more")
    wanted = list(columns) if columns is not None else numeric(df, [order, *by])
    if strategy not in ("ffill", "adjacent_avg") or not wanted:
        return df
    out, many = ordered.number(df, order, by, ties, rows_per_block)
    if limit is not None:
        return _within(out, wanted, many, by, limit).select(*[F.col(f"__near_{c}").alias(c) if c in wanted else F.col(c) for c in df.columns])
    if strategy == "ffill":
        return _last_known(out, wanted, many, by, False).select(*[F.col(f"__last_{c}").alias(c) if c in wanted else F.col(c) for c in df.columns])
    for c in wanted:
        out = out.withColumn(c, F.col(c).cast("double"))
        at = F.when(F.col(c).isNotNull(), F.struct(F.col(ordered.RN).alias("rn"), F.col(c).alias("v")))
        out = out.withColumn(f"__at_{c}", at)
    at = [f"__at_{c}" for c in wanted]
    out = _last_known(_last_known(out, at, many, by, False), at, many, by, True)
    made = []
    for c in df.columns:
        low, high = F.col(f"__last___at_{c}"), F.col(f"__next___at_{c}")
        line = low["v"] + (high["v"] - low["v"]) * (F.col(ordered.RN) - low["rn"]) / (high["rn"] - low["rn"])
        made.append(F.coalesce(F.col(c), F.when(low.isNotNull() & high.isNotNull() & (high["rn"] > low["rn"]), line)).alias(c) if c in wanted else F.col(c))
    return out.select(*made)


def _within(df: DataFrame, columns: Sequence[str], many: bool, by: Sequence[str], limit: int) -> DataFrame:
    """Adds __near_c for each column: the last value, if it stands at most ``limit`` rows before."""
    placed = df.withColumns({f"__at_{c}": F.when(F.col(c).isNotNull(), F.struct(F.col(ordered.RN).alias("rn"), F.col(c).alias("v"))) for c in columns})
    known = _last_known(placed, [f"__at_{c}" for c in columns], many, by, False)
    return known.withColumns({f"__near_{c}": F.when(F.col(ordered.RN) - F.col(f"__last___at_{c}.rn") <= limit, F.col(f"__last___at_{c}.v")) for c in columns})


def _last_known(df: DataFrame, columns: Sequence[str], many: bool, by: Sequence[str], backwards: bool) -> DataFrame:
    """Adds __last_c (or __next_c) for each column; blocks are joined once for all of them."""
    name = "__next_" if backwards else "__last_"
    w = ordered.block_window(by)
    frame = w.rowsBetween(0, ordered.Window.unboundedFollowing) if backwards else w.rowsBetween(ordered.Window.unboundedPreceding, 0)
    pick, edge = (F.first, F.min_by) if backwards else (F.last, F.max_by)
    local = {c: pick(c, ignorenulls=True).over(frame) for c in columns}
    if not many:
        return df.withColumns({name + c: x for c, x in local.items()})
    edges = [edge(c, F.when(F.col(c).isNotNull(), F.col(ordered.RN))).alias(f"__edge_{c}") for c in columns]
    carried = [(f"__carry_{c}", F.last(f"__edge_{c}", ignorenulls=True)) for c in columns]
    joined = ordered.carry(df, edges, carried, by, backwards)
    return joined.withColumns({name + c: F.coalesce(x, F.col(f"__carry_{c}")) for c, x in local.items()}).drop(*[f"__carry_{c}" for c in columns])


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: the rows, and the nulls of each column, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns or df.columns])


def fill_report(before: DataFrame, after: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, before, after, filled, rows)."""
    columns = list(columns or numeric(before, ["ts"]))
    long = lambda df, name: null_counts(df, columns).select("rows", F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))])).alias("column", name))
    joined = long(before, "before").join(long(after, "after").drop("rows"), "column")
    return joined.select("column", "before", "after", (F.col("before") - F.col("after")).alias("filled"), "rows")
