"""Registered queries of the core library and their SQL.

Doubles are rounded in both, since sums of parts differ in their last bits.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.formulas import ColumnSpec, FormulaEngine, wrap
from tidemark.operators import align, ordered, processors, resample
from tidemark.plans import builder, cache, catalog, research
from tidemark.plans.store import SnapshotStore
from tidemark.session import shared_folder, table
from tidemark.sources import archives, schemas, zip_source
from tidemark.sources.recipes import InputSource, Recipe, load_recipe, save_recipe

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

KINDS = ("click", "error", "purchase", "signup", "view")
DIGITS = 6


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def ms(time: str | Column) -> Column:
    """Epoch milliseconds of a timestamp of either kind."""
    return F.unix_millis((F.col(time) if isinstance(time, str) else time).cast("timestamp"))


# Tables in the shapes that the operators work on


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide: a row an hour, the summed value of each kind of event."""
    events = table(spark, sf_dir, "events").select(ms(F.date_trunc("hour", "ts")).alias("ts"), "event_type", "value")
    return events.groupBy("ts").agg(*[F.sum(F.when(F.col("event_type") == k, F.col("value"))).alias(k) for k in KINDS])


PANEL = "panel AS (SELECT epoch_ms(date_trunc('hour', ts)) AS ts, " + ", ".join(f"sum(value) FILTER (event_type = '{k}') AS {k}" for k in KINDS) + " FROM events GROUP BY 1)"


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trades: value is the price, the quantity follows from the ids."""
    return table(spark, sf_dir, "events").select(
        ms("ts").alias("timestamp"), F.col("event_id").alias("id"), F.col("event_type").alias("symbol"), F.col("value").alias("price"),
        (F.col("user_id") % 10 + 1).cast("double").alias("quantity"), (F.col("user_id") % 2 == 0).alias("is_buyer_maker"),
    )


TRADES = "trades AS (SELECT epoch_us(ts) // 1000 AS timestamp, event_id AS id, event_type AS symbol, value AS price, CAST(user_id % 10 + 1 AS DOUBLE) AS quantity, user_id % 2 = 0 AS is_buyer_maker FROM events)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a file catalog: a file for each kind and day, there if the day has over 60 events of the kind."""
    days = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("symbol"), F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return days.select(F.lit("um").alias("market"), F.lit("trades").alias("dataset_type"), "symbol", F.lit(None).cast("string").alias("interval"), F.lit("daily").alias("cadence"), "date", (F.col("n") > 60).alias("exists"), (F.col("n") * 1000).alias("remote_size"))


FILES = "files AS (SELECT 'um' AS market, 'trades' AS dataset_type, event_type AS symbol, CAST(NULL AS VARCHAR) AS interval, 'daily' AS cadence, strftime(ts, '%Y-%m-%d') AS date, count(*) > 60 AS exists_, count(*) * 1000 AS remote_size FROM events GROUP BY event_type, strftime(ts, '%Y-%m-%d'))"


def formulas(name: str, specs: Sequence[tuple[str, str]], sql: dict[str, str], ctes: str = "", source: str = "panel", digits: int = DIGITS, rows_per_block: int | None = None) -> None:
    """Registers formulas over the panel, with a SQL expression for each; with ``rows_per_block``, once more as ``name_in_blocks``, where the panel takes many blocks."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(FormulaEngine().select_new(panel(spark, sf_dir), [ColumnSpec(*s) for s in specs]), digits)

    def in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(FormulaEngine(rows_per_block=rows_per_block).select_new(panel(spark, sf_dir), [ColumnSpec(*s) for s in specs]), digits)

    run.__name__, in_blocks.__name__ = name, f"{name}_in_blocks"
    whole = {n for n, e in sql.items() if e.startswith("/*i*/")}
    columns = ", ".join(f"{e} AS {n}" if n in whole else f"round({e}, {digits}) AS {n}" for n, e in sql.items())
    text = f"WITH {PANEL}{ctes} SELECT ts, {columns} FROM {source} WINDOW w AS (ORDER BY ts), a AS ()"
    query(text)(run)
    if rows_per_block:
        query(text)(in_blocks)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps filled, log returns, volatility and a cross-sectional score, each from the one before."""
    specs = [
        ColumnSpec("vol", "ROLL_STD(ret, 24)"),
        ColumnSpec("ret", "LOGRET(c, 1)"),
        ColumnSpec("c", "FILL_FFILL(click)"),
        ColumnSpec("xs", "XS_ZSCORE(click, COLS('^(click|error|purchase|signup|view)$'))"),
    ]
    return rounded(FormulaEngine().select_new(panel(spark, sf_dir), specs))


_SET = "list_filter([click, error, purchase, signup, view], lambda v: v IS NOT NULL)"
_STD = "sqrt(list_sum(list_transform(s, lambda v: (v - list_avg(s)) ** 2)) / (len(s) - 1))"
query(f"""
WITH {PANEL}, filled AS (SELECT *, last_value(click IGNORE NULLS) OVER (ORDER BY ts) AS c, {_SET} AS s FROM panel),
r AS (SELECT *, ln(c) - ln(lag(c) OVER (ORDER BY ts)) AS ret FROM filled)
SELECT ts, round(CASE WHEN count(ret) OVER f = 24 THEN stddev_samp(ret) OVER f END, 6) AS vol, round(ret, 6) AS ret, round(c, 6) AS c,
       round(CASE WHEN len(s) > 1 THEN (click - list_avg(s)) / ({_STD} + 1e-12) END, 6) AS xs
FROM r WINDOW f AS (ORDER BY ts ROWS 23 PRECEDING)
""")(flagship)

X = "(click - view)"
formulas(
    "formula_elementwise",
    [
        ("abs_", "ABS(click - view)"), ("log_", "LOG(ABS(click - view) + 1)"), ("exp_", "EXP((click - view) / 10000)"), ("sqrt_", "SQRT(ABS(click - view))"), ("sign_", "SIGN(click - view)"),
        ("round_", "ROUND(click + 0.003, 1)"), ("floor_", "FLOOR(click)"), ("ceil_", "CEIL(click)"), ("clip_", "CLIP(click, 100, view)"), ("clamp_", "CLAMP(click, 50, 500)"),
        ("min_", "MIN(click, view)"), ("max_", "MAX(click, view)"), ("if_", "IF(click > view, click, -view)"), ("div_", "click / view"), ("mod_", "click % 7"), ("pow_", "click ** 0.5 + +view"),
    ],
    {
        "abs_": f"abs{X}", "log_": f"ln(abs{X} + 1)", "exp_": f"exp({X} / 10000)", "sqrt_": f"sqrt(abs{X})", "sign_": f"/*i*/CAST(CASE WHEN {X} > 0 THEN 1 WHEN {X} < 0 THEN -1 ELSE 0 END AS INTEGER)",
        "round_": "round(click + 0.003, 1)", "floor_": "floor(click)", "ceil_": "ceil(click)", "clip_": "CASE WHEN click < 100 THEN 100 WHEN click > view THEN view ELSE click END", "clamp_": "CASE WHEN click < 50 THEN 50 WHEN click > 500 THEN 500 ELSE click END",
        "min_": "least(click, view)", "max_": "greatest(click, view)", "if_": "CASE WHEN click > view THEN click ELSE -view END", "div_": "click / view", "mod_": "click % 7", "pow_": "click ** 0.5 + view",
    },
)
formulas(
    "formula_logic",
    [
        ("both", "click > 100 and not view > 300"), ("either", "click > 500 or view > 500"), ("chain", "100 < click <= 400"), ("pick", "click if click >= view else view"), ("same", "click == click"), ("other", "click != view"),
        ("isna_", "ISNA(click)"), ("finite", "ISFINITE(click / 3)"),
    ],
    {
        "both": "/*i*/(click > 100 AND NOT view > 300)", "either": "/*i*/(click > 500 OR view > 500)", "chain": "/*i*/(100 < click AND click <= 400)", "pick": "CASE WHEN click >= view THEN click ELSE view END", "same": "/*i*/(click = click)", "other": "/*i*/(click <> view)",
        "isna_": "/*i*/(click IS NULL)", "finite": "/*i*/isfinite(click / 3)",
    },
)
formulas(
    "formula_lags",
    [("lag_", "LAG(click)"), ("lead_", "LAG(click, -2)"), ("diff_", "DIFF(click, 3)"), ("pct", "PCT_CHANGE(click)"), ("logret", "LOGRET(click, 2)"), ("nested", "LAG(DIFF(LAG(click, 2)), 1)")],
    {"lag_": "lag(click) OVER w", "lead_": "lead(click, 2) OVER w", "diff_": "click - lag(click, 3) OVER w", "pct": "click / lag(click) OVER w - 1", "logret": "ln(click) - ln(lag(click, 2) OVER w)", "nested": "lag(click, 3) OVER w - lag(click, 4) OVER w"},
    rows_per_block=100,
)
_F24 = "(ORDER BY ts ROWS 23 PRECEDING)"
formulas(
    "formula_rolling",
    [("mean_", "ROLL_MEAN(click, 24)"), ("std_", "ROLL_STD(FILL_ZERO(click), 24)"), ("sum_", "ROLL_SUM(view, 5)"), ("z", "ROLL_ZSCORE(FILL_ZERO(click), 24)"), ("deep", "ROLL_MEAN(DIFF(FILL_ZERO(view)), 3)")],
    {
        "mean_": f"CASE WHEN count(click) OVER {_F24} = 24 THEN avg(click) OVER {_F24} END",
        "std_": f"CASE WHEN count(*) OVER {_F24} = 24 THEN stddev_samp(coalesce(click, 0)) OVER {_F24} END",
        "sum_": "CASE WHEN count(view) OVER (ORDER BY ts ROWS 4 PRECEDING) = 5 THEN sum(view) OVER (ORDER BY ts ROWS 4 PRECEDING) END",
        "z": f"CASE WHEN count(*) OVER {_F24} = 24 THEN (coalesce(click, 0) - avg(coalesce(click, 0)) OVER {_F24}) / (stddev_samp(coalesce(click, 0)) OVER {_F24} + 1e-12) END",
        "deep": "(coalesce(view, 0) - lag(coalesce(view, 0), 3) OVER w) / 3",
    },
    rows_per_block=100,
)
formulas(
    "formula_cumulative",
    [("total", "CUMSUM(click)"), ("growth", "CUMPROD(1 + view / 1000000)"), ("of_total", "DIFF(CUMSUM(FILL_ZERO(click)), 2)")],
    {"total": "CASE WHEN click IS NOT NULL THEN sum(click) OVER w END", "growth": "CASE WHEN view IS NOT NULL THEN product(1 + view / 1000000) OVER w END", "of_total": "CASE WHEN lag(ts, 2) OVER w IS NOT NULL THEN coalesce(click, 0) + lag(coalesce(click, 0)) OVER w END"},
    digits=4,
    rows_per_block=100,
)
formulas(
    "formula_fill",
    [("forward", "FILL_FFILL(click)"), ("backward", "FILL_BFILL(click)"), ("zero", "FILL_ZERO(click)"), ("either", "COALESCE(click, view)")],
    {"forward": "last_value(click IGNORE NULLS) OVER w", "backward": "first_value(click IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)", "zero": "coalesce(click, 0)", "either": "coalesce(click, view)"},
    rows_per_block=100,
)
formulas(
    "formula_ema",
    [("ema_", "EMA(FILL_ZERO(click), 12)")],
    {"ema_": "y"},
    ctes=", n AS (SELECT ts, coalesce(click, 0) AS x, row_number() OVER (ORDER BY ts) AS i FROM panel), ema AS (WITH RECURSIVE e AS (SELECT i, ts, x AS y FROM n WHERE i = 1 UNION ALL SELECT n.i, n.ts, e.y * (1 - 2.0::DOUBLE / 13) + n.x * 2.0::DOUBLE / 13 FROM e JOIN n ON n.i = e.i + 1) SELECT ts, y FROM e)",
    source="ema",
    rows_per_block=100,
)
formulas(
    "formula_full_sample",
    [("z", "ZSCORE(click)"), ("mm", "MINMAX(click)"), ("rank_", "RANK_NORM(click)"), ("win", "WINSORIZE(click, 0.05, 0.9)"), ("robust", "ROBUST_Z(click)")],
    {
        "z": "(click - avg(click) OVER a) / (stddev_samp(click) OVER a + 1e-12)",
        "mm": "(click - min(click) OVER a) / (max(click) OVER a - min(click) OVER a + 1e-12)",
        "rank_": "CASE WHEN click IS NOT NULL THEN (rank() OVER (ORDER BY click NULLS LAST) + (count(*) OVER (PARTITION BY click) - 1) / 2 - 1) / (count(*) OVER a - 1 + 1e-12) END",
        "win": "CASE WHEN click < low THEN low WHEN click > high THEN high ELSE click END",
        "robust": "(click - med) / (mad * 1.4826 + 1e-12)",
    },
    ctes=", v AS (SELECT list_sort(list(click)) AS s FROM panel WHERE click IS NOT NULL), b AS (SELECT s[CAST(floor((len(s) - 1) * 0.05 + 0.5) AS BIGINT) + 1] AS low, s[CAST(floor((len(s) - 1) * 0.9 + 0.5) AS BIGINT) + 1] AS high, list_median(s) AS med, list_median(list_transform(s, lambda x: abs(x - list_median(s)))) AS mad FROM v), p AS (SELECT * FROM panel, b)",
    source="p",
    rows_per_block=100,
)
_P = f", p AS (SELECT *, {_SET} AS s, list_sort({_SET}) AS o FROM panel)"
_COLS = "COLS('^(click|error|purchase|signup|view)$')"
formulas(
    "formula_row_statistics",
    [
        ("sum_", f"ROW_SUM({_COLS})"), ("mean_", f"ROW_MEAN({_COLS})"), ("min_", "ROW_MIN(click, SET(error, view))"), ("max_", f"ROW_MAX({_COLS})"), ("n", f"ROW_COUNT_VALID({_COLS})"),
        ("std_", f"ROW_STD({_COLS})"), ("var_", f"ROW_VAR({_COLS}) / 7.3111"), ("median_", f"ROW_MEDIAN({_COLS})"), ("q", f"ROW_QUANTILE({_COLS}, 0.3)"), ("top2", f"ROW_TOPK_MEAN({_COLS}, 2)"), ("low3", f"ROW_BOTTOMK_MEAN({_COLS}, 3)"), ("one", "ROW_MAX(COL('click'))"),
    ],
    {
        "sum_": "coalesce(list_sum(s), 0)", "mean_": "list_avg(s)", "min_": "least(click, error, view)", "max_": "list_max(s)", "n": "/*i*/CAST(len(s) AS BIGINT)",
        "std_": f"CASE WHEN len(s) > 1 THEN {_STD} END", "var_": f"CASE WHEN len(s) > 1 THEN {_STD} ** 2 / 7.3111 END", "median_": "list_median(s)", "q": "o[CAST(floor((len(o) - 1) * 0.3) AS BIGINT) + 1]", "top2": "list_avg(list_reverse_sort(s)[1:2])", "low3": "list_avg(o[1:3])", "one": "click",
    },
    ctes=_P, source="p", digits=4,
)
_LESS, _EQUAL = "len(list_filter(s, lambda v: v < click))", "len(list_filter(s, lambda v: v = click))"
_RANK = f"CASE WHEN len(s) > 0 THEN {_LESS} + ({_EQUAL} + 1) / 2 END"
formulas(
    "formula_cross_section",
    [("demean", f"XS_DEMEAN(click, {_COLS})"), ("z", f"XS_ZSCORE(click, {_COLS})"), ("rank_", f"XS_RANK(click, {_COLS})"), ("pct", f"XS_PCTRANK(click, {_COLS})"), ("soft", f"SOFTMAX_WEIGHT(click, {_COLS}, 500.0)")],
    {
        "demean": "click - list_avg(s)", "z": f"CASE WHEN len(s) > 1 THEN (click - list_avg(s)) / ({_STD} + 1e-12) END", "rank_": _RANK, "pct": f"CASE WHEN len(s) > 1 THEN ({_RANK} - 1) / (len(s) - 1 + 1e-12) ELSE 0 END",
        "soft": "exp(click / 500) / (list_sum(list_transform(s, lambda v: exp(v / 500))) + 1e-12)",
    },
    ctes=_P, source="p",
)


@query(f"""
WITH {PANEL}, b AS (SELECT *, lag(click + 1) OVER (ORDER BY ts) AS a_lag, click + 1 AS a_ FROM panel), c AS (SELECT *, (a_ - a_lag) AS d_ FROM b)
SELECT ts, round(a_, 6) AS a_, round(d_, 6) AS d_, round(abs(d_), 6) AS wrapped FROM c
""")
def formula_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas out of order, and a template put around one of them."""
    specs = wrap([ColumnSpec("wrapped", "d_"), ColumnSpec("d_", "a_ - LAG(a_)"), ColumnSpec("a_", "click + 1")], ["wrapped"], "ABS({x})")
    made = FormulaEngine().select_new(panel(spark, sf_dir), specs)
    return rounded(made.select("ts", "a_", "d_", "wrapped"))


@query("""
WITH daily AS (SELECT event_type AS symbol, epoch_ms(date_trunc('day', ts)) AS ts, sum(value) AS v FROM events GROUP BY 1, 2)
SELECT symbol, ts, round(v - lag(v) OVER w, 6) AS diff_, round(CASE WHEN count(v) OVER f = 5 THEN avg(v) OVER f END, 6) AS mean_, round(sum(v) OVER w, 4) AS total,
       round((v - avg(v) OVER k) / (stddev_samp(v) OVER k + 1e-12), 6) AS z, round(((rank() OVER (PARTITION BY symbol ORDER BY v)) - 1) / (count(*) OVER k - 1 + 1e-12), 6) AS rank_
FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY ts), f AS (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING), k AS (PARTITION BY symbol)
""")
def formula_long_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same functions within a key."""
    daily = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("symbol"), ms(F.date_trunc("day", "ts")).alias("ts")).agg(F.sum("value").alias("v"))
    specs = [ColumnSpec("diff_", "DIFF(v)"), ColumnSpec("mean_", "ROLL_MEAN(v, 5)"), ColumnSpec("total", "CUMSUM(v)"), ColumnSpec("z", "ZSCORE(v)"), ColumnSpec("rank_", "RANK_NORM(v)")]
    made = FormulaEngine(partition_by=["symbol"]).select_new(daily, specs)
    return rounded(made.withColumn("total", F.round("total", 4)))


_HOT = "CASE WHEN event_id % 10 = 0 THEN event_type ELSE 'hot' END"


def _hot_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in long form; nine of ten have one key."""
    return table(spark, sf_dir, "events").select(F.expr(_HOT).alias("symbol"), ms("ts").alias("ts"), "event_id", F.col("value").alias("v"))


_HOT_SQL = f"""
WITH s AS (SELECT {_HOT} AS symbol, epoch_us(ts) // 1000 AS ts, event_id, value AS v FROM events),
o AS (SELECT *, row_number() OVER k AS i, lag(v, 3) OVER k AS before, avg(v) OVER f AS mean_, count(v) OVER f AS n, sum(v) OVER k AS total FROM s WINDOW k AS (PARTITION BY symbol ORDER BY ts, event_id), f AS (PARTITION BY symbol ORDER BY ts, event_id ROWS 11 PRECEDING)),
q AS (SELECT symbol, list_sort(list(v)) AS l FROM s GROUP BY symbol), b AS (SELECT symbol, l[CAST(floor((len(l) - 1) * 0.1 + 0.5) AS BIGINT) + 1] AS low, l[CAST(floor((len(l) - 1) * 0.9 + 0.5) AS BIGINT) + 1] AS high FROM q)
SELECT symbol, ts, round(v - before, 6) AS diff_, round(CASE WHEN n = 12 THEN mean_ END, 6) AS mean_, round(total, 3) AS total, round(least(greatest(v, low), high), 6) AS win FROM o JOIN b USING (symbol)
"""


@query(_HOT_SQL)
def formula_hot_key_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas within a key of which one has nine rows of ten: its series takes many blocks."""
    specs = [ColumnSpec("diff_", "DIFF(v, 3)"), ColumnSpec("mean_", "ROLL_MEAN(v, 12)"), ColumnSpec("total", "CUMSUM(v)"), ColumnSpec("win", "WINSORIZE(v, 0.1, 0.9)")]
    series = _hot_series(spark, sf_dir)
    made = FormulaEngine(partition_by=["symbol"], ties=["event_id"], rows_per_block=1000).select_new(series, specs)
    return rounded(made.withColumn("total", F.round("total", 3)))


# Bars and typed sources

_BARS = """min_by(price, (timestamp, id)) AS open, max(price) AS high, min(price) AS low, max_by(price, (timestamp, id)) AS close, round(sum(quantity), 6) AS volume, round(sum(price * quantity) / sum(quantity) + 1 / 3e7, 6) AS vwap,
  round(sum(CASE WHEN is_buyer_maker THEN 0 ELSE quantity END), 6) AS buy_volume, round(sum(CASE WHEN is_buyer_maker THEN quantity ELSE 0 END), 6) AS sell_volume, count(*) AS trade_count"""


def _off_ties(bars: DataFrame) -> DataFrame:
    """A third of a unit of the seventh digit on vwap: quotients by powers of two often end on a five that is to be rounded."""
    return bars.withColumn("vwap", F.col("vwap") + F.lit(1 / 3e7))


@query(f"WITH {TRADES} SELECT timestamp - timestamp % 3600000 AS ts, {_BARS} FROM trades GROUP BY 1")
def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_off_ties(resample.bars(trades(spark, sf_dir), "1h")))


@query(f"WITH {TRADES} SELECT symbol, timestamp - timestamp % 60000 AS ts, {_BARS} FROM trades GROUP BY 1, 2")
def bars_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_off_ties(processors.process("trades", trades(spark, sf_dir), "1m", by=("symbol",))))


@query(f"WITH {TRADES} SELECT * FROM trades")
def source_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return processors.process("trades", trades(spark, sf_dir).withColumnsRenamed({"timestamp": "time", "quantity": "qty"}), None)


@query(f"WITH {TRADES} SELECT id AS agg_trade_id, timestamp, symbol, price, quantity, is_buyer_maker FROM trades")
def source_agg_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trade twice, the second time later."""
    one = trades(spark, sf_dir).withColumnsRenamed({"id": "agg_trade_id", "timestamp": "transact_time"})
    return processors.process("aggTrades", one.unionByName(one.withColumn("transact_time", F.col("transact_time") + 1))).select("agg_trade_id", "timestamp", "symbol", "price", "quantity", "is_buyer_maker")


@query(f"""
WITH {TRADES} SELECT timestamp AS ts, 'BTCUSDT' AS symbol, price AS best_bid_price, CAST(NULL AS DOUBLE) AS best_bid_qty, price + quantity AS best_ask_price, CAST(NULL AS DOUBLE) AS best_ask_qty,
  round(price + quantity - price, 6) AS spread, round((price + price + quantity) / 2, 6) AS mid, id AS update_id, CAST(NULL AS BIGINT) AS transaction_time FROM trades
""")
def source_book_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    book = t.select(F.col("id").alias("update_id"), F.col("timestamp").alias("event_time"), F.col("price").alias("best_bid_price"), (F.col("price") + F.col("quantity")).alias("best_ask_price"))
    made = processors.process("bookTicker", book.unionByName(book), symbol="BTCUSDT")
    return made.withColumns({"spread": F.round("spread", 6), "mid": F.round("mid", 6)})


@query(f"WITH {TRADES} SELECT timestamp, price AS percentage, quantity AS depth, price * quantity AS notional FROM trades")
def source_book_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    return processors.process("bookDepth", t.select("timestamp", F.col("price").alias("percentage"), F.col("quantity").alias("depth"), (F.col("price") * F.col("quantity")).alias("notional")))


# Alignment


@query("SELECT event_id, epoch_ms(ts) AS seconds, epoch_ms(ts) AS millis, epoch_ms(ts) AS micros, epoch_ms(ts) AS nanos, epoch_ms(ts) AS text, epoch_ms(date_trunc('second', ts)) AS plain, epoch_ms(date_trunc('day', ts)) AS day, epoch_ms(ts) AS digits FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def time_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in every unit and format, back to epoch milliseconds."""
    e = table(spark, sf_dir, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    stamp = F.timestamp_seconds("s")
    made = e.select(
        "event_id", F.col("s").alias("seconds"), (F.col("s") * 1000).alias("millis"), (F.col("s") * 10**6).alias("micros"), (F.col("s") * 10**9).alias("nanos"),
        F.date_format(stamp, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("text"), F.date_format(stamp, "yyyy-MM-dd HH:mm:ss").alias("plain"), F.date_format(stamp, "yyyy-MM-dd").alias("day"), F.col("s").cast("string").alias("digits"),
    )
    return made.select("event_id", *[align.time_to_ms(made, c).alias(c) for c in made.columns[1:]])


@query("SELECT event_id, epoch_us(ts) // 1000 AS ts FROM events WHERE ts >= (SELECT date_trunc('day', min(ts)) FROM events) + INTERVAL 2 DAY AND ts < (SELECT date_trunc('day', min(ts)) FROM events) + INTERVAL 7 DAY")
def time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    first = events.agg(F.min("ts").cast("date")).first()[0]
    return align.in_range(align.normalise_time(events, "ts"), first + _days(2), first + _days(6))


def _days(n: int):
    from datetime import timedelta

    return timedelta(days=n)


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def dedup_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value", "ts")
    return align.dedup(events, ["user_id"], ["ts", "event_id"], "last").drop("ts")


@query("SELECT user_id, min_by(event_id, (ts, event_id)) AS event_id, min_by(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value", "ts")
    return align.dedup(events, ["user_id"], ["ts", "event_id"], "first").drop("ts")


def _daily(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Line items by ship day, and orders by order day: the low-frequency side."""
    lines = table(spark, sf_dir, "lineitem").groupBy(ms("l_shipdate").alias("ts")).agg(*[F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))).alias(f"qty_{f.lower()}") for f in "ANR"])
    orders = table(spark, sf_dir, "orders").groupBy(ms("o_orderdate").alias("ts")).agg(F.round(F.sum("o_totalprice"), 2).alias("price"), F.count(F.lit(1)).alias("n"))
    return lines, orders


DAILY = "a AS (SELECT epoch_ms(l_shipdate) AS ts, sum(l_quantity) FILTER (l_returnflag = 'A') AS qty_a, sum(l_quantity) FILTER (l_returnflag = 'N') AS qty_n, sum(l_quantity) FILTER (l_returnflag = 'R') AS qty_r FROM lineitem GROUP BY 1), b AS (SELECT epoch_ms(o_orderdate) AS ts, round(sum(o_totalprice), 2) AS price, count(*) AS n FROM orders GROUP BY 1)"
_WIDE = "SELECT a.ts, qty_a AS X_lines_qty_a, qty_n AS X_lines_qty_n, qty_r AS X_lines_qty_r, price AS X_orders_price, n AS X_orders_n FROM a LEFT JOIN b USING (ts)"


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = _daily(spark, sf_dir)
    return align.join_on_anchor(align.prefixed(lines, align.prefix("X", "lines")), [align.prefixed(orders, align.prefix("X", "orders"))])


@query(f"WITH {DAILY} {_WIDE}")
def anchored_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(spark, sf_dir)


@query(f"WITH {DAILY}, w AS ({_WIDE}) SELECT ts, " + ", ".join(f"last_value({c} IGNORE NULLS) OVER (ORDER BY ts) AS {c}" for c in ("X_lines_qty_a", "X_lines_qty_n", "X_lines_qty_r", "X_orders_price", "X_orders_n")) + " FROM w")
def fill_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.fill(_wide(spark, sf_dir), "ffill")


@query(f"""
WITH {PANEL}, r AS (SELECT ts, click, row_number() OVER (ORDER BY ts) AS i FROM panel),
n AS (SELECT ts, click, i, last_value(CASE WHEN click IS NOT NULL THEN i END IGNORE NULLS) OVER (ORDER BY ts) AS pi, first_value(CASE WHEN click IS NOT NULL THEN i END IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni,
  last_value(click IGNORE NULLS) OVER (ORDER BY ts) AS pv, first_value(click IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv FROM r)
SELECT ts, round(coalesce(click, CASE WHEN pi IS NOT NULL AND ni > pi THEN pv + (nv - pv) * (i - pi) / (ni - pi) END), 6) AS click FROM n
""")
def fill_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(align.fill(panel(spark, sf_dir).select("ts", "click"), "adjacent_avg"))


_LIMITED = f"""
WITH {PANEL}, r AS (SELECT ts, click, view, row_number() OVER (ORDER BY ts) AS i FROM panel),
n AS (SELECT *, max(CASE WHEN click IS NOT NULL THEN i END) OVER (ORDER BY i) AS pi, max(CASE WHEN view IS NOT NULL THEN i END) OVER (ORDER BY i) AS qi FROM r)
SELECT n.ts, CASE WHEN n.i - pi <= 2 THEN p.click END AS click, CASE WHEN n.i - qi <= 2 THEN q.view END AS view FROM n LEFT JOIN r p ON p.i = n.pi LEFT JOIN r q ON q.i = n.qi
"""


@query(_LIMITED)
def fill_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carried forward over two rows at most."""
    return align.fill(_gaps(spark, sf_dir), "ffill", limit=2)


@query(_LIMITED)
def fill_limited_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.fill(_gaps(spark, sf_dir), "ffill", limit=2, rows_per_block=100)


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).select("ts", "click", "view")


@query(f"WITH {PANEL}, f AS (SELECT " + ", ".join(f"last_value({k} IGNORE NULLS) OVER (ORDER BY ts) AS f_{k}, {k}" for k in KINDS) + " FROM panel) " + " UNION ALL ".join(f"SELECT '{k}' AS \"column\", count(*) FILTER ({k} IS NULL) AS before, count(*) FILTER (f_{k} IS NULL) AS after, count(*) FILTER ({k} IS NULL AND f_{k} IS NOT NULL) AS filled, count(*) AS rows FROM f" for k in KINDS))
def fill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = panel(spark, sf_dir)
    return align.fill_report(before, align.fill(before, "ffill"))


@query(f"WITH {PANEL} SELECT count(*) AS rows, " + ", ".join(f"count(*) FILTER ({k} IS NULL) AS {k}" for k in KINDS) + " FROM panel")
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.null_counts(panel(spark, sf_dir), KINDS)


@query(f"WITH {DAILY} SELECT a.ts, qty_a, price FROM a JOIN b USING (ts)")
def recipe_join_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = _daily(spark, sf_dir)
    return align.join_sources([lines.select("ts", "qty_a"), orders.select("ts", "price")], ["ts"], "drop")


@query(f"WITH {DAILY} SELECT a.ts, qty_a, price FROM a LEFT JOIN b USING (ts)")
def recipe_join_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = _daily(spark, sf_dir)
    return align.join_sources([lines.select("ts", "qty_a"), orders.select("ts", "price")], ["ts"], "keep_nan")


@query(f"WITH {DAILY} SELECT a.ts, qty_a, last_value(price IGNORE NULLS) OVER (ORDER BY a.ts) AS price FROM a LEFT JOIN b USING (ts)")
def recipe_join_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = _daily(spark, sf_dir)
    return align.join_sources([lines.select("ts", "qty_a"), orders.select("ts", "price")], ["ts"], "ffill")


@query(f"WITH {DAILY} SELECT a.ts, a.qty_a, b.price, b.n FROM a ASOF LEFT JOIN b ON a.ts >= b.ts")
def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = _daily(spark, sf_dir)
    return align.as_of(lines.select("ts", "qty_a"), orders)


@query(f"WITH {TRADES}, b AS (SELECT symbol, timestamp - timestamp % 3600000 AS ts, max_by(price, (timestamp, id)) AS close, round(sum(quantity), 6) AS volume FROM trades GROUP BY 1, 2) SELECT ts, " + ", ".join(f"max(close) FILTER (symbol = '{k}') AS {k}_close, max(volume) FILTER (symbol = '{k}') AS {k}_volume" for k in ("click", "view")) + " FROM b WHERE symbol IN ('click', 'view') GROUP BY ts")
def recipe_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recipe that resamples trades and pivots by symbol."""
    recipe = Recipe("wide", ["click", "view"], {"start": "2020-01-01", "end": "2030-01-01"}, [InputSource("trades", ["close", "volume"], resample=True, resample_freq="1h")], join_policy={"key": "ts", "missing": "drop"}, output_format="wide")
    rows = trades(spark, sf_dir)
    return rounded(builder.execute(recipe, lambda symbol, _: rows.where(F.col("symbol") == symbol).drop("symbol"))[0])


@query(f"WITH {TRADES}, b AS (SELECT symbol, timestamp - timestamp % 3600000 AS ts, max_by(price, (timestamp, id)) AS close FROM trades GROUP BY 1, 2), m AS (SELECT symbol, timestamp - timestamp % 3600000 AS ts, count(*) AS trade_count FROM trades GROUP BY 1, 2) SELECT symbol, ts, close, trade_count FROM b JOIN m USING (symbol, ts) WHERE symbol IN ('click', 'view')")
def recipe_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two inputs of two symbols, joined on symbol and time."""
    inputs = [InputSource("trades", ["close"], resample=True, resample_freq="1h"), InputSource("trades", ["trade_count"], resample=True, resample_freq="1h")]
    recipe = Recipe("long", ["click", "view"], {"start": "2020-01-01", "end": "2030-01-01"}, inputs, join_policy={"key": "ts", "missing": "drop"})
    rows = trades(spark, sf_dir)
    return builder.execute(recipe, lambda symbol, _: rows.where(F.col("symbol") == symbol).drop("symbol"))[0]


@query(f"WITH {TRADES}, d AS (SELECT symbol, timestamp - timestamp % 1000 AS ts, max((id, price, quantity)) AS r FROM trades GROUP BY 1, 2), a AS (SELECT ts, r[2] AS click_trades_price FROM d WHERE symbol = 'click'), b AS (SELECT ts, r[2] AS view_trades_price FROM d WHERE symbol = 'view') SELECT a.ts, click_trades_price, last_value(view_trades_price IGNORE NULLS) OVER (ORDER BY a.ts) AS view_trades_price FROM a LEFT JOIN b USING (ts)")
def dataset_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two selections to a wide table by the builder: times, range, repeats by their place in the source, prefixes, anchored join, fill."""
    rows = trades(spark, sf_dir).withColumn("timestamp", F.col("timestamp") - F.pmod("timestamp", F.lit(1000)))

    def read(s: builder.Selection) -> DataFrame:
        return rows.where(F.col("symbol") == s.symbol).select("timestamp", "price", F.struct("id", "price", "quantity").alias(builder.ORDINAL))

    selections = [builder.Selection("um", "trades", s, "1990", "2050") for s in ("click", "view")]
    return builder.build(builder.BuildConfig(selections, 0, "ffill"), read)[0].select("ts", "click_trades_price", "view_trades_price")


# Metadata


@query(f"WITH {FILES} SELECT market, dataset_type, symbol, interval, cadence, min(date) FILTER (exists_) AS start_date, max(date) FILTER (exists_) AS end_date, count(*) FILTER (exists_) AS num_files, count(*) FILTER (NOT exists_) AS num_missing, coalesce(string_agg(date, ',' ORDER BY date) FILTER (NOT exists_), '') AS missing_dates, CAST(sum(remote_size) FILTER (exists_) AS BIGINT) AS total_size_estimate, round(sum(remote_size) FILTER (exists_) / 1024 / 1024, 2) AS size_mb FROM files GROUP BY ALL HAVING count(*) FILTER (exists_) > 0")
def catalog_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.coverage(files(spark, sf_dir)).withColumn("missing_dates", F.array_join("missing_dates", ","))


@query(f"WITH {FILES} SELECT DISTINCT date FROM files WHERE symbol = 'click' AND NOT exists_")
def catalog_missing_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.missing_dates(files(spark, sf_dir), "trades", "click", "1900-01-01", "2999-01-01")


@query("SELECT strftime(d, '%Y-%m-%d') AS date FROM (SELECT unnest(generate_series((SELECT CAST(min(ts) AS DATE) FROM events)::TIMESTAMP, (SELECT CAST(max(ts) AS DATE) FROM events)::TIMESTAMP, INTERVAL 1 DAY)) AS d)")
def catalog_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = table(spark, sf_dir, "events").agg(F.min("ts").cast("date").cast("string"), F.max("ts").cast("date").cast("string")).first()
    return catalog.dates(spark, low, high)


@query("SELECT s AS symbol, d AS date, 'https://x.example/daily/' || p || '/' || s || '/' || CASE WHEN i IS NULL THEN '' ELSE i || '/' END || s || '-' || coalesce(i, p) || '-' || d || '.zip' AS remote_url FROM (SELECT DISTINCT n_name AS s FROM nation), (VALUES ('klines', '1h'), ('trades', NULL)) v(p, i), (VALUES ('2024-02-28'), ('2024-02-29'), ('2024-03-01')) w(d)")
def catalog_expected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = [r[0] for r in table(spark, sf_dir, "nation").select("n_name").distinct().collect()]
    return catalog.expected_files(spark, "um", symbols, [("klines", "1h"), ("trades", None)], "2024-02-28", "2024-03-01", "daily", "https://x.example/").select("symbol", "date", "remote_url")


@query(f"WITH {FILES} SELECT symbol, date, CASE WHEN symbol = 'click' THEN TRUE ELSE exists_ END AS \"exists\", remote_size FROM files UNION ALL SELECT 'new', date, TRUE, NULL FROM files WHERE symbol = 'click'")
def catalog_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = files(spark, sf_dir)
    clicks = old.where("symbol = 'click'").withColumn("exists", F.lit(True)).withColumn("remote_size", F.lit(None).cast("long"))
    new = clicks.unionByName(clicks.withColumn("symbol", F.lit("new")))
    return catalog.upsert(old, new, always=("exists",)).select("symbol", "date", "exists", "remote_size")


@query(f"WITH {FILES} SELECT symbol, date, remote_size FROM files WHERE symbol = 'view' AND exists_")
def catalog_to_download(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.to_download(files(spark, sf_dir).withColumn("local_size", F.lit(None).cast("long")), "um", "trades", "view", "1900-01-01", "2999-01-01").select("symbol", "date", "remote_size")


@query(f"WITH {FILES}, c AS (SELECT symbol, min(date) FILTER (exists_) AS start_date FROM files GROUP BY symbol HAVING count(*) FILTER (exists_) > 0) SELECT symbol, start_date, 'b/daily/trades/' || symbol || '/' || symbol || '-trades-' || start_date || '.zip' AS remote_url FROM c ORDER BY symbol LIMIT 1")
def catalog_schema_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.schema_samples(catalog.coverage(files(spark, sf_dir)), "b").select("symbol", "start_date", "remote_url")


@query("SELECT DISTINCT event_type AS dataset_type FROM events")
def catalog_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What isn't there yet is added once."""
    kinds = table(spark, sf_dir, "events").select(F.col("event_type").alias("dataset_type"))
    return catalog.register(kinds.where("dataset_type = 'click'").distinct(), kinds, ["dataset_type"])


@query("SELECT event_id, value, NULL AS extra FROM events UNION ALL SELECT o_orderkey, NULL, o_orderstatus FROM orders")
def union_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "events").select("event_id", "value")
    return schemas.union([a, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderstatus").alias("extra"))])


@query("SELECT count(*) AS n_rows, epoch_us(min(ts)) // 1000 AS first_ts, epoch_us(max(ts)) // 1000 AS last_ts FROM events")
def inspect_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("n_rows"), ms(F.min("ts")).alias("first_ts"), ms(F.max("ts")).alias("last_ts"))


@query("(SELECT event_id, value FROM events ORDER BY ts, event_id LIMIT 50) UNION ALL (SELECT event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 50)")
def inspect_head_and_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.orderBy("ts", "event_id").limit(50).union(events.orderBy(F.desc("ts"), F.desc("event_id")).limit(50)).select("event_id", "value")


def _order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a catalog of monthly files: one for each status and month, there if the month has an even number of its orders."""
    months = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("symbol"), F.date_format("o_orderdate", "yyyy-MM").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return months.select(F.lit("um").alias("market"), F.lit("trades").alias("dataset_type"), "symbol", F.lit(None).cast("string").alias("interval"), F.lit("monthly").alias("cadence"), "date", (F.col("n") % 2 == 0).alias("exists"))


def _order_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("symbol")).agg(F.date_add(F.min("o_orderdate").cast("date"), 3).cast("string").alias("start"), F.max("o_orderdate").cast("date").cast("string").alias("end"))
    return ends.select(F.lit("um").alias("market"), F.lit("trades").alias("dataset_type"), "symbol", F.lit(None).cast("string").alias("interval"), "start", "end")


_COVER = """
WITH files AS (SELECT o_orderstatus AS symbol, strftime(o_orderdate, '%Y-%m') AS month, count(*) % 2 = 0 AS there FROM orders GROUP BY 1, 2),
ends AS (SELECT o_orderstatus AS symbol, CAST(min(o_orderdate) AS DATE) + 3 AS low, CAST(max(o_orderdate) AS DATE) AS high FROM orders GROUP BY 1),
days AS (SELECT symbol, CAST(unnest(generate_series(low::TIMESTAMP, high::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM ends WHERE low <= high),
m AS (SELECT symbol, day, strftime(day, '%Y-%m') AS month, count(*) OVER (PARTITION BY symbol, strftime(day, '%Y-%m')) = day(last_day(day)) AS whole FROM days),
p AS (SELECT m.symbol, day, CASE WHEN whole AND coalesce(there, TRUE) THEN month END AS monthly FROM m LEFT JOIN files USING (symbol, month)),
tasks AS (SELECT symbol, CASE WHEN monthly IS NULL THEN 'daily' ELSE 'monthly' END AS cadence, coalesce(monthly, strftime(day, '%Y-%m-%d')) AS date, strftime(min(day), '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day, count(*) AS days FROM p GROUP BY ALL)
"""


@query(f"{_COVER} SELECT * FROM tasks")
def cache_file_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fewest files that hold each status's days: monthly where a month is whole and its file isn't known to be absent."""
    made = cache.cover(_order_requests(spark, sf_dir), _order_files(spark, sf_dir), prefer_monthly=True)
    return made.select("symbol", "cadence", "date", *[F.col(c).cast("string").alias(c) for c in ("first_day", "last_day")], "days")


@query(f"{_COVER} SELECT cadence, substr(date, 1, 4) AS year, count(*) AS files, CAST(sum(days) AS BIGINT) AS days FROM tasks WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderstatus = tasks.symbol AND tasks.cadence = 'daily' AND strftime(o.o_orderdate, '%Y-%m-%d') = tasks.date AND o.o_orderkey % 4 = 0) GROUP BY ALL")
def cache_outstanding_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by year that a build has still to make: those of the days of every fourth order are recorded as built, others with errors."""
    tasks = cache.cover(_order_requests(spark, sf_dir), _order_files(spark, sf_dir), prefer_monthly=True)
    orders = table(spark, sf_dir, "orders").select(F.lit("um").alias("market"), F.lit("trades").alias("dataset_type"), F.col("o_orderstatus").alias("symbol"), F.lit(None).cast("string").alias("interval"), F.lit("daily").alias("cadence"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.when(F.col("o_orderkey") % 4 == 0, cache.OK).otherwise(cache.ERROR).alias("status")).distinct()
    return cache.outstanding(tasks, orders).groupBy("cadence", F.substring("date", 1, 4).alias("year")).agg(F.count(F.lit(1)).alias("files"), F.sum("days").alias("days"))


_ISLANDS = f"""
WITH {FILES}, e AS (SELECT symbol, date, CAST(date AS DATE) - DATE '1970-01-01' AS k FROM files WHERE exists_), r AS (SELECT *, k - row_number() OVER (PARTITION BY symbol ORDER BY k) AS run FROM e),
i AS (SELECT symbol, run, min(date) AS start_date, max(date) AS end_date, count(*) AS n FROM r GROUP BY symbol, run)
"""


@query(f"{_ISLANDS} SELECT symbol, start_date, end_date, n FROM i")
def catalog_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of days with files."""
    return catalog.islands(files(spark, sf_dir)).select("symbol", "start_date", "end_date", "n")


@query(f"{_ISLANDS}, g AS (SELECT symbol, end_date AS after, lead(start_date) OVER (PARTITION BY symbol ORDER BY start_date) AS before FROM i) SELECT symbol, after, before, CAST(before AS DATE) - CAST(after AS DATE) - 1 AS n FROM g WHERE before IS NOT NULL")
def catalog_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies between the runs."""
    return catalog.gaps(files(spark, sf_dir)).select("symbol", "after", "before", "n")


# Archives, the cache and the store, made of the given tables in the shared folder


def _archives(spark: SparkSession, sf_dir: str, folder: str, header: bool) -> None:
    """Trades as ZIP archives of a CSV file for each symbol and day, written by the tasks that hold them."""
    t = trades(spark, sf_dir).withColumn("day", F.date_format(F.timestamp_millis("timestamp"), "yyyy-MM-dd"))
    line = F.concat_ws(",", "id", F.format_string("%.6f", "price"), F.format_string("%.6f", "quantity"), F.format_string("%.6f", F.col("price") * F.col("quantity")), "timestamp", F.lower(F.col("is_buyer_maker").cast("string")))
    files = t.groupBy("symbol", "day").agg(F.array_join(F.array_sort(F.collect_list(F.struct("timestamp", "id", line.alias("line")))).line, "\n").alias("text"))

    def write(rows) -> None:
        import io
        import zipfile

        from tidemark.sources.zip_source import file_system

        for r in rows:
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(f"{r['symbol']}.csv", ("id,price,qty,quote_qty,time,is_buyer_maker\n" if header else "") + r["text"] + "\n")
            system, inner = file_system(f"{folder}/um/daily/trades/{r['symbol']}/{r['symbol']}-trades-{r['day']}.zip")
            system.create_dir(inner.rpartition("/")[0], recursive=True)
            with system.open_output_stream(inner) as out:
                out.write(held.getvalue())

    files.foreachPartition(write)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_ARCHIVED = f"WITH {TRADES} SELECT symbol, id, round(price, 6) AS price, quantity AS qty, timestamp AS time, is_buyer_maker FROM trades"


@query(_ARCHIVED)
def archive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades from archives with headers, by the data source; the symbol is that of the file's name."""
    folder = _folder(spark, "archives")
    _archives(spark, sf_dir, folder, True)
    rows = archives.read_archives(spark, [folder], "trades")
    return rounded(rows.select(schemas.symbol_of_file(F.col(f"{archives.ORDINAL}._path")).alias("symbol"), "id", "price", "qty", "time", "is_buyer_maker"))


@query(f"WITH {TRADES} SELECT symbol || '-trades-' || strftime(make_timestamp(timestamp * 1000), '%Y-%m-%d') || '.zip' AS file, symbol || '.csv' AS member, count(*) AS n_rows, CAST(NULL AS VARCHAR) AS note FROM trades GROUP BY symbol, strftime(make_timestamp(timestamp * 1000), '%Y-%m-%d')")
def archive_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of archives without headers, with their rows, from the decoding pass."""
    folder = _folder(spark, "archives")
    _archives(spark, sf_dir, folder, False)
    told = archives.manifest_of(zip_source.read(spark, [folder], "trades"))
    return told.select(F.element_at(F.split("path", "/"), -1).alias("file"), "member", F.col("rows").alias("n_rows"), "note")


@query(f"WITH {TRADES}, d AS (SELECT *, CAST(make_timestamp(timestamp * 1000) AS DATE) AS day FROM trades), e AS (SELECT min(day) + 3 AS low, min(day) + 9 AS high FROM d) SELECT symbol, id, round(price, 6) AS price FROM d, e WHERE symbol = 'view' AND day BETWEEN low AND high")
def cache_build_and_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A week of one symbol from archives through the cache."""
    folder = _folder(spark, "archives")
    _archives(spark, sf_dir, folder, True)
    first = table(spark, sf_dir, "events").agg(F.min("ts").cast("date")).first()[0]
    held = cache.RawCache(spark, _folder(spark, "cache"), folder)
    week = str(first + _days(3)), str(first + _days(9))
    held.build(held.plan("um", "trades", "view", *week))
    return rounded(held.scan("um", "trades", "view", *week, columns=["id", "price"]).select(F.lit("view").alias("symbol"), "id", "price"))


@query(f"WITH {FILES} SELECT symbol, date, remote_size FROM files WHERE exists_ UNION ALL SELECT symbol, date, NULL FROM files WHERE NOT exists_")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in the snapshot store: first without sizes, then the sizes of those that are there; a file without one keeps what it has."""
    store, rows = SnapshotStore(spark, _folder(spark, "store")), files(spark, sf_dir)
    store.upsert("files", rows.withColumn("remote_size", F.lit(None).cast("long")))
    store.upsert("files", rows.withColumn("remote_size", F.when(F.col("exists"), F.col("remote_size"))))
    return store.read("files").select("symbol", "date", "remote_size")


@query(f"WITH {PANEL} SELECT ts, round(click + 1, 6) AS more FROM panel WHERE click > 100")
def sink_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A formula's column written and read again, with the filter in the scan."""
    path = _folder(spark, "table")
    made, _ = FormulaEngine().apply(panel(spark, sf_dir), [ColumnSpec("more", "click + 1")])
    made.write.parquet(path)
    return rounded(spark.read.parquet(path).where("click > 100").select("ts", "more"))


@query(f"WITH {FILES} SELECT symbol, min(date) AS start_date, max(date) AS end_date FROM files GROUP BY symbol")
def catalog_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges found by probing: a source has a file on every day from its first event to its last."""
    days = files(spark, sf_dir).groupBy(*catalog.KEY).agg(F.min("date").alias("low"), F.max("date").alias("high"))
    ends = {r["symbol"]: (r["low"], r["high"]) for r in days.collect()}  # one row a source
    probe = lambda url: {} if ends[url.split("/")[-2]][0] <= url[-14:-4] <= ends[url.split("/")[-2]][1] else None
    low, high = min(a for a, _ in ends.values()), max(b for _, b in ends.values())
    return catalog.discover(days, probe, "b", date.fromisoformat(low) - _days(400), date.fromisoformat(high) + _days(90)).select("symbol", "start_date", "end_date")


@query(f"WITH {FILES} SELECT symbol, date, CAST(substr(date, 10, 1) AS INTEGER) % 2 = 0 AS \"exists\", CASE WHEN CAST(substr(date, 10, 1) AS INTEGER) % 2 = 0 THEN CAST(length(symbol) AS BIGINT) END AS remote_size FROM files")
def catalog_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existence by a probe: files of even days are there."""
    asked = files(spark, sf_dir).drop("exists", "remote_size").withColumn("remote_url", catalog.url("b", *[F.col(c) for c in ("cadence", "dataset_type", "symbol", "interval", "date")]))
    probe = lambda url: {"remote_size": len(url.split("/")[-2])} if int(url[-5]) % 2 == 0 else None
    return catalog.with_probe(asked, probe).select("symbol", "date", "exists", "remote_size")


@query(f"WITH {FILES} SELECT symbol, date, coalesce(CASE WHEN exists_ THEN 'seen' END, '') AS notes, CAST(0 AS BIGINT) AS local_size FROM files")
def catalog_migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column is added, and nulls of another filled."""
    old = files(spark, sf_dir).select("symbol", "date", F.when(F.col("exists"), "seen").alias("notes"))
    return catalog.migrate(old, {"notes": ("string", ""), "local_size": ("long", 0)})


@query(f"WITH {FILES}, c AS (SELECT symbol, min(date) FILTER (exists_) AS start_date, count(*) FILTER (exists_) AS num_files FROM files GROUP BY symbol HAVING count(*) FILTER (exists_) > 0) SELECT symbol, CASE WHEN symbol = 'view' THEN '' ELSE start_date END AS start_date, CASE WHEN symbol = 'view' THEN 0 ELSE num_files END AS num_files FROM c")
def catalog_coverage_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source whose files have gone is marked by an empty range."""
    old = catalog.coverage(files(spark, sf_dir)).select(*catalog.KEY, "start_date", "num_files")
    gone = old.where("symbol = 'view'").withColumns({"start_date": F.lit(""), "num_files": F.lit(0).cast("long")})
    return catalog.upsert_coverage(old, gone).select("symbol", "start_date", "num_files")


@query(f"WITH {FILES} SELECT symbol, min(date) FILTER (exists_) AS start_date, max(date) FILTER (exists_) AS end_date FROM files WHERE symbol = 'view' GROUP BY symbol HAVING count(*) FILTER (exists_) > 0")
def catalog_coverage_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.coverage_of(catalog.coverage(files(spark, sf_dir)), "um", "trades", "view").select("symbol", "start_date", "end_date")


@query(f"WITH {FILES} SELECT symbol, 'trades' AS dataset_type FROM files GROUP BY symbol HAVING count(*) FILTER (exists_) > 0 ORDER BY symbol LIMIT 1")
def catalog_menu_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a choice in a menu names; an interval doesn't count where there are no bars."""
    return catalog.menu_row(catalog.coverage(files(spark, sf_dir)), "trades", "daily", "1h").select("symbol", "dataset_type")


@query(f"WITH {FILES} SELECT symbol, CAST(count(*) FILTER (NOT exists_) AS BIGINT) AS missing FROM files WHERE symbol IN ('click', 'view') GROUP BY symbol HAVING count(*) FILTER (NOT exists_) > 0")
def recipe_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of a recipe with missing dates, and how many, as validation finds them."""
    recipe = Recipe("v", ["click", "view"], {"start": "1990-01-01", "end": "2050-01-01"}, [InputSource("trades", ["price"])], join_policy={"key": "time", "missing": "drop"})
    registry = schemas.SchemaRegistry(spark)
    registry.register(schemas.RegisteredSchema("trades", ["time", "price"], primary_time_key="time"))
    told = {e.split(" ")[0] for e in builder.validate(recipe, files(spark, sf_dir), registry)}
    gone = files(spark, sf_dir).where(F.col("symbol").isin(sorted(told)) & ~F.col("exists"))
    return gone.groupBy("symbol").agg(F.count(F.lit(1)).alias("missing"))


@query("SELECT column_name AS name, CASE WHEN column_type IN ('BIGINT', 'INTEGER') THEN 'int64' WHEN column_type = 'DOUBLE' THEN 'float64' ELSE 'str' END AS dtype, 'unknown' AS validation FROM (DESCRIBE events) UNION ALL SELECT 'later', 'float64', 'unknown'")
def schema_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What inspection finds of events, registered, and a column registered later."""
    registry = schemas.SchemaRegistry(spark)
    registry.register(schemas.RegisteredSchema(**schemas.inspect(table(spark, sf_dir, "events"), "events")))
    registry.register(schemas.RegisteredSchema("events", ["later", "ts"], {"later": "float64"}))
    held = registry.to_df()
    names = held.select(F.explode("columns").alias("name"), F.from_json("dtypes", "map<string,string>").alias("dtypes"), F.col("validation_status").alias("validation"))
    return names.select("name", F.col("dtypes")[F.col("name")].alias("dtype"), "validation")


@query(f"WITH {TRADES}, b AS (SELECT symbol, timestamp - timestamp % 3600000 AS ts, max_by(price, (timestamp, id)) AS close FROM trades GROUP BY 1, 2) SELECT symbol, ts, close FROM b WHERE symbol IN ('click', 'error')")
def recipe_from_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recipe written as JSON, read and executed."""
    recipe = Recipe("file", ["click", "error"], {"start": "2020-01-01", "end": "2030-01-01"}, [InputSource("trades", ["close"], resample=True, resample_freq="1h")], join_policy={"key": "ts", "missing": "drop"})
    with tempfile.TemporaryDirectory() as folder:
        save_recipe(recipe, f"{folder}/r.json")
        recipe = load_recipe(f"{folder}/r.json")
    rows = trades(spark, sf_dir)
    return builder.execute(recipe, lambda symbol, _: rows.where(F.col("symbol") == symbol).drop("symbol"))[0]


@query(f"WITH {PANEL}, l AS (SELECT *, last_value(click IGNORE NULLS) OVER (ORDER BY ts) AS c, last_value(view IGNORE NULLS) OVER (ORDER BY ts) AS v FROM panel) SELECT 'X_panel_click' AS \"column\", count(*) FILTER (click IS NULL) AS before, count(*) FILTER (c IS NULL) AS after, count(*) AS rows FROM l UNION ALL SELECT 'X_panel_view', count(*) FILTER (view IS NULL), count(*) FILTER (v IS NULL), count(*) FROM l")
def build_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a build, as rows."""
    one = builder.Selection("um", "panel", "X", "1990", "2050", columns=["click", "view"])
    _, report = builder.build(builder.BuildConfig([one], 0, "ffill"), lambda s: panel(spark, sf_dir))
    rows = [(c, n["before"], n["after"], report["rows"]) for c, n in report["nulls"].items()]  # one row a column
    return spark.createDataFrame(rows, "column string, before long, after long, rows long")


@query(f"WITH {PANEL} SELECT round(click * 2, 6) AS good, round(click * 2 + view, 6) AS later, 8 AS errors, ts FROM panel")
def formula_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas that can't be compiled are left out and told: circles, a need of itself, unknown names, syntax, what isn't allowed, a name that is there."""
    bad = [("a", "b + 1"), ("b", "COL('a')"), ("self", "self + 1"), ("unknown", "nothing + 1"), ("syntax", "click +"), ("unsafe", "click.real"), ("view", "click"), ("", "click")]
    specs = [ColumnSpec("later", "good + COL('view')"), *[ColumnSpec(*x) for x in bad], ColumnSpec("good", "COL('click') * 2")]
    made, errors = FormulaEngine().apply(panel(spark, sf_dir), specs)
    return rounded(made.select("good", "later", F.lit(len(errors)).alias("errors"), "ts"))


_NO_ID = f"WITH {TRADES} SELECT timestamp, price, quantity, id AS first_trade_id, id + 1 AS last_trade_id"


def _without_id(spark: SparkSession, sf_dir: str, *drop: str) -> DataFrame:
    t = trades(spark, sf_dir).select(F.col("timestamp").alias("transact_time"), "price", "quantity", F.col("id").alias("first_trade_id"), (F.col("id") + 1).alias("last_trade_id"))
    return processors.process("aggTrades", t.unionByName(t).drop(*drop))


@query(f"{_NO_ID} FROM trades")
def source_agg_trades_without_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats by the five columns that stand for an id."""
    return _without_id(spark, sf_dir).select("timestamp", "price", "quantity", "first_trade_id", "last_trade_id")


@query(f"{_NO_ID.replace(', id + 1 AS last_trade_id', '')} FROM trades, (VALUES (1), (2)) v(n)")
def source_agg_trades_without_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a key all rows stay."""
    return _without_id(spark, sf_dir, "last_trade_id").select("timestamp", "price", "quantity", "first_trade_id")


@query(f"WITH {PANEL} SELECT ts, click, view FROM panel")
def fill_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strategy that isn't known changes nothing."""
    return align.fill(panel(spark, sf_dir).select("ts", "click", "view"), "none")


# Evaluation of forecasts; inferred from published results, there is no definition


@query(f"""
WITH {TRADES}, b AS (SELECT symbol, timestamp - timestamp % 3600000 AS ts, max_by(price, (timestamp, id)) AS close FROM trades GROUP BY 1, 2),
r AS (SELECT symbol, ts, close / lag(close) OVER w - 1 AS signal, lead(close) OVER w / close - 1 AS forward FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, ts, round(signal, 6) AS signal, round(forward - avg(forward) OVER (PARTITION BY ts), 6) AS label FROM r
""")
def research_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = resample.bars(trades(spark, sf_dir), "1h", ["symbol"])
    return rounded(research.relative_returns(b, "symbol", "close", 1, 1).select("symbol", "ts", "signal", "label"))


@query(f"""
WITH {TRADES}, b AS (SELECT symbol, timestamp - timestamp % 3600000 AS ts, max_by(price, (timestamp, id)) AS close FROM trades GROUP BY 1, 2),
r AS (SELECT symbol, ts, close / lag(close) OVER w - 1 AS signal, lead(close) OVER w / close - 1 AS forward FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
l AS (SELECT symbol, ts, signal, forward - avg(forward) OVER (PARTITION BY ts) AS label FROM r),
k AS (SELECT ts, rank() OVER (PARTITION BY ts ORDER BY signal) + (count(*) OVER (PARTITION BY ts, signal) - 1) / 2 AS a, rank() OVER (PARTITION BY ts ORDER BY label) + (count(*) OVER (PARTITION BY ts, label) - 1) / 2 AS b FROM l WHERE signal IS NOT NULL AND label IS NOT NULL)
SELECT ts, CASE WHEN abs(corr(a, b)) < 1e-7 THEN 0 ELSE round(corr(a, b), 6) END AS rank_ic, count(*) AS n FROM k GROUP BY ts HAVING count(*) > 2
""")
def research_rank_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = resample.bars(trades(spark, sf_dir), "1h", ["symbol"])
    found = research.rank_ic(research.relative_returns(b, "symbol", "close", 1, 1))
    return rounded(found.withColumn("rank_ic", F.when(F.abs("rank_ic") < 1e-7, 0.0).otherwise(F.col("rank_ic"))))  # no negative zero


@query(f"""
WITH {PANEL}, s AS (SELECT ts, ntile(6) OVER (ORDER BY ts) AS part FROM panel), e AS (SELECT part, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY part)
SELECT CAST(t.part - 1 AS INTEGER) AS fold, (SELECT min(ts) FROM panel) AS train_start, p.last_ts AS train_end, t.first_ts AS test_start, t.last_ts AS test_end, t.n AS n_test FROM e t JOIN e p ON p.part = t.part - 1
""")
def research_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.walk_forward(panel(spark, sf_dir), 6)


@query(f"WITH {PANEL}, v AS (SELECT ts, click, ntile(3) OVER (ORDER BY click, ts) AS regime FROM panel WHERE click IS NOT NULL) SELECT CAST(regime AS INTEGER) AS regime, count(*) AS n, round(avg(click), 6) AS mean FROM v GROUP BY regime")
def research_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(research.terciles(panel(spark, sf_dir).where("click is not null"), "click").groupBy("regime").agg(F.count(F.lit(1)).alias("n"), F.avg("click").alias("mean")))


__all__ = ["ORACLE_SQL", "QUERIES", "flagship", "ordered"]
