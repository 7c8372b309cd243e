"""Typed sources: each takes the raw rows of a dataset and returns them cleaned, in its canonical columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import align, resample
from tidemark.sources.schemas import agg_trade_keys

#: Canonical columns of a book ticker, and their types.
BOOK_TICKER = {
    "ts": "long", "symbol": "string", "best_bid_price": "double", "best_bid_qty": "double", "best_ask_price": "double", "best_ask_qty": "double",
    "spread": "double", "mid": "double", "update_id": "long", "transaction_time": "long",
}


def _renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Accepts other names of a column where the canonical one is missing."""
    for old, new in names.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def trades(df: DataFrame, interval: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Trades in order of time, or bars of them."""
    df = _renamed(df, {"time": "timestamp", "qty": "quantity"})
    if interval:
        return resample.bars(df, interval, by, tie=("id",) if "id" in df.columns else ("price", "quantity")).orderBy(*by, "ts")
    return df.orderBy("timestamp")


def agg_trades(df: DataFrame) -> DataFrame:
    """Aggregated trades without repeats: by agg_trade_id, or else by all of time, price, quantity and both trade ids, or else in order of time only, which ``key_notes`` tells."""
    df = _renamed(df, {"transact_time": "timestamp"})
    keys = agg_trade_keys(df.columns)
    if not keys:
        return df.orderBy("timestamp")
    rest = [c for c in df.columns if c not in keys]
    return align.dedup(df, keys, (["timestamp"] if "timestamp" in rest else []) + [c for c in rest if c != "timestamp"], "first").orderBy("timestamp")


def book_ticker(df: DataFrame, symbol: str | None = None) -> DataFrame:
    """Best prices with spread and mid, one row for each (event_time, update_id), in canonical columns; what is missing is null."""
    df = _renamed(df, {"ts": "event_time"})
    keys = [k for k in ("event_time", "update_id") if k in df.columns]
    df = align.dedup(df, keys, [c for c in df.columns if c not in keys], "first")
    if {"best_bid_price", "best_ask_price"} <= set(df.columns):
        bid, ask = F.col("best_bid_price"), F.col("best_ask_price")
        df = df.withColumns({"spread": ask - bid, "mid": (bid + ask) / 2})
    df = df.withColumnRenamed("event_time", "ts")
    if "symbol" not in df.columns:
        df = df.withColumn("symbol", F.lit(symbol).cast("string"))
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in BOOK_TICKER.items()]).orderBy("ts", "update_id")


def book_depth(df: DataFrame) -> DataFrame:
    """Depth rows in order of the first column that has ``time`` in its name."""
    found = [c for c in df.columns if "time" in c.lower()]
    return df.orderBy(found[0]) if found else df


def generic(df: DataFrame) -> DataFrame:
    return df


PROCESSORS: dict[str, Callable[..., DataFrame]] = {"trades": trades, "aggTrades": agg_trades, "bookTicker": book_ticker, "bookDepth": book_depth}


def process(dataset: str, df: DataFrame, resample_to: str | None = "1m", **more) -> DataFrame:
    """The processor of a dataset; only trades are resampled, and unknown datasets pass as they are."""
    if dataset == "trades":
        return trades(df, resample_to, **more)
    return PROCESSORS.get(dataset, generic)(df, **more)
